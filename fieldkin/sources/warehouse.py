"""The driver's star schema as four named sources, with their declared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldkin.sources.model import RELATIONAL, Entity, Key, Source, SourceSet
from fieldkin.sources.readers import read_files

NAMESPACE = "public"

#: Entities of each source, in request order.
SOURCES = {
    "crm": ("customer", "nation", "region"),
    "sales": ("lineitem", "orders"),
    "supply": ("part", "supplier"),
    "content": ("documents", "labels"),
}

PRIMARY_KEYS = {
    "customer": ("c_custkey",),
    "nation": ("n_nationkey",),
    "region": ("r_regionkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "orders": ("o_orderkey",),
    "part": ("p_partkey",),
    "supplier": ("s_suppkey",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
}

UNIQUE_KEYS = {
    "customer": {"customer_name_key": ("c_name",)},
    "nation": {"nation_place_key": ("n_regionkey", "n_name"), "nation_name_key": ("n_name",)},
}

OTHER_INDEXES = {"orders": ("orders_custkey_idx", "orders_date_idx")}

#: Declared schemas: opening a table then reads no file, whatever their number.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return read_files(spark, f"{directory}/{name}.parquet", schema=SCHEMAS.get(name))


def warehouse(spark: SparkSession, directory: str) -> SourceSet:
    """Named sources ``crm``, ``sales``, ``supply`` and ``content``."""
    return SourceSet(
        Source(
            source_id,
            RELATIONAL,
            tuple(_entity(spark, directory, name) for name in names),
        )
        for source_id, names in SOURCES.items()
    )


def _entity(spark: SparkSession, directory: str, name: str) -> Entity:
    key = PRIMARY_KEYS.get(name)
    keys = (Key(f"{name}_pkey", "primary", key),) if key else ()
    keys += tuple(Key(k, "unique", c) for k, c in UNIQUE_KEYS.get(name, {}).items())
    return Entity(
        NAMESPACE,
        name,
        table(spark, directory, name),
        keys=keys,
        indexes=tuple(k.name for k in keys) + OTHER_INDEXES.get(name, ()),
    )
