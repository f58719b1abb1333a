"""The registered queries: every operator over the driver's whole tables.

Each takes ``(spark, directory)`` and returns flat columns: lists become joined
strings and ratios are rounded to six decimals, so that results can be compared
by value with any other engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.functions.values import fingerprint, normal_form
from fieldkin.operators import batch, catalog, documents, expect, mapping, overlap, paths, profile
from fieldkin.operators import query as q
from fieldkin.operators import relate, sketches
from fieldkin.operators.value_counts import value_counts
from fieldkin.plans import discovery
from fieldkin.sources.model import DOCUMENT, RELATIONAL, Entity, Key, Source, SourceSet
from fieldkin.sources.readers import DOCUMENT_COLUMN, documents_from_json, documents_from_rows
from fieldkin.sources.session import catalog_source
from fieldkin.sources.warehouse import NAMESPACE, table, warehouse

Query = Callable[[SparkSession, str], DataFrame]


def _joined(values: str | Column) -> Column:
    return F.array_join(values, ",")


def _ratio(value: str) -> Column:
    return F.floor(F.col(value) * 1e6 + F.lit(0.5)) / 1e6


ENDS = [f"{side}_{c}" for side in ("left", "right") for c in ("source_id", "entity", "path")]


# -- catalog -----------------------------------------------------------------


def _wide(spark: SparkSession, directory: str) -> SourceSet:
    """The named sources and ``web``, which has columns that are not profiled."""
    web = Source("web", RELATIONAL, tuple(
        Entity(NAMESPACE, name, table(spark, directory, name)) for name in ("embeddings", "pages")
    ))
    return SourceSet([*warehouse(spark, directory), web])


def _counted_fields(spark: SparkSession, sources: SourceSet) -> DataFrame:
    """Catalog rows beside the measured size of their entity."""
    return catalog.catalog_fields(spark, sources).join(
        catalog.row_counts(sources), ["source_id", "namespace", "entity"]
    )


def catalog_fields(spark: SparkSession, directory: str) -> DataFrame:
    return _counted_fields(spark, _wide(spark, directory)).select(
        "source_id", "namespace", "entity", "ordinal", "path",
        _joined("types").alias("types"), F.col("declared_nullable").alias("nullable"),
        "row_count",
    )


#: Tables of ``catalog_session``.
SESSION_TABLES = ("customer", "nation", "orders", "region")


def catalog_session(spark: SparkSession, directory: str) -> DataFrame:
    """Columns and rows of tables that are known to the session's catalog only.

    The tables are external, so creating and dropping them moves no data, and a plan that
    reads one outlives its name.
    """
    prefix = f"fieldkin_{uuid.uuid4().hex}_"
    try:
        for name in SESSION_TABLES:
            spark.catalog.createTable(f"{prefix}{name}", f"{directory}/{name}.parquet", "parquet")
        sources = SourceSet([catalog_source(spark, "live", "default", f"{prefix}*")])
    finally:
        for name in SESSION_TABLES:
            spark.sql(f"DROP TABLE IF EXISTS `{prefix}{name}`")
    return _counted_fields(spark, sources).select(
        F.substr("entity", F.lit(len(prefix) + 1)).alias("entity"),
        F.col("ordinal").cast("bigint").alias("ordinal"), "path",
        F.col("types")[0].alias("type"), F.col("declared_nullable").alias("nullable"), "row_count",
    )


def catalog_keys(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    keys = catalog.catalog_keys(
        catalog.catalog_entities(spark, sources), catalog.declared_keys(spark, sources)
    )
    return keys.join(catalog.row_counts(sources), ["source_id", "namespace", "entity"]).select(
        "source_id", "kind", "entity", _joined("indexes").alias("indexes"), "key_name",
        _joined("key_fields").alias("key_fields"),
        _joined("unique_fields").alias("unique_fields"), "row_count",
    )


def type_families(spark: SparkSession, directory: str) -> DataFrame:
    fields = catalog.with_families(_counted_fields(spark, _wide(spark, directory)))
    return fields.groupBy(
        _joined("types").alias("types"), _joined("type_families").alias("type_families")
    ).agg(F.count("*").alias("fields"), F.sum("row_count").alias("total_values"))


def profile_eligible(spark: SparkSession, directory: str) -> DataFrame:
    return _counted_fields(spark, _wide(spark, directory)).select(
        "source_id", "entity", "path",
        catalog.profiled(F.col("types")[0]).alias("eligible"), "row_count",
    )


def row_counts(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.row_counts(warehouse(spark, directory)).select(
        "source_id", "entity", "row_count"
    )


# -- documents ---------------------------------------------------------------


def _shop_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Orders as nested documents: a mixed total, optional and null members."""
    customer = F.struct(
        F.col("o_custkey").alias("id"),
        F.struct(F.col("o_orderstatus").alias("code")).alias("state"),
    ).alias("customer")
    tags = F.array(
        F.struct(F.col("o_orderpriority").alias("name")),
        F.struct(F.col("o_orderstatus").alias("name")),
    ).alias("tags")
    key = F.col("o_orderkey").alias("_id")
    plain = F.to_json(F.struct(key, customer, tags, F.col("o_totalprice").alias("total")))
    pending = F.to_json(
        F.struct(
            key, customer, F.array("o_orderpriority").alias("tags"),
            F.concat(F.lit(" Pending "), F.col("o_orderpriority")).alias("total"),
            F.lit(None).cast("string").alias("note"),
        ),
        {"ignoreNullFields": "false"},
    )
    text = F.when(F.col("o_orderstatus") == "P", pending).otherwise(plain)
    orders = table(spark, directory, "orders")
    return documents_from_json(orders.select(text.alias("value")))


def _parsed_shop(spark: SparkSession, directory: str) -> DataFrame:
    return q.computed_once(_shop_documents(spark, directory), DOCUMENT_COLUMN)


def _event_documents(spark: SparkSession, directory: str) -> DataFrame:
    return documents_from_json(table(spark, directory, "events"), "props")


def _shop(spark: SparkSession, directory: str) -> Source:
    """A collection with a unique key over two paths."""
    return Source("shop", DOCUMENT, (Entity(
        "docs", "orders", _shop_documents(spark, directory),
        keys=(Key("orders_customer_total", "unique", ("customer.id", "total")),),
        indexes=("_id_", "orders_customer_total"), document=DOCUMENT_COLUMN,
    ),))


def _stream(spark: SparkSession, directory: str) -> Source:
    data = _event_documents(spark, directory)
    return Source("stream", DOCUMENT, (
        Entity("docs", "events", data, indexes=("_id_",), document=DOCUMENT_COLUMN),
    ))


def _collections(spark: SparkSession, directory: str) -> SourceSet:
    return SourceSet([_stream(spark, directory), _shop(spark, directory)])


def catalog_mixed(spark: SparkSession, directory: str) -> DataFrame:
    """Tables and collections in one catalog."""
    crm = warehouse(spark, directory)["crm"]
    found = discovery.catalog(spark, SourceSet([crm, *_collections(spark, directory)]))
    field = F.transform("fields", lambda f: F.concat_ws(
        ":", f["path"], F.array_join(f["types"], "|"), F.when(f["nullable"], "null")))
    return found.select(
        "source_id", "kind", "namespace", "entity", _joined(field).alias("fields"),
        _joined("indexes").alias("indexes"), _joined("key_fields").alias("key_fields"),
        _joined("unique_fields").alias("unique_fields"),
    )


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get(DOCUMENT_COLUMN, f"$.{path}", kind)


def find_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents by members at dotted paths, sorted by one that has several types."""
    data, document = _parsed_shop(spark, directory), F.col(DOCUMENT_COLUMN)
    return q.find(
        data,
        where=paths.compares(document, "customer.state.code", "in", ["F", "P"])
        & paths.compares(document, "total", "gte", 1000),
        columns=[_at("_id", "bigint").alias("order_key"), _at("customer.id", "bigint").alias("customer")],
        sort=[(paths.sort_value(document, "total", -1), -1), (paths.sort_value(document, "_id", 1), 1)],
        limit=500,
    )


def document_membership(spark: SparkSession, directory: str) -> DataFrame:
    """Arrays that hold a value, as an element or as a member of an element."""
    data = _parsed_shop(spark, directory)
    found = data.select(
        _at("_id", "bigint").alias("order_key"),
        q.matches(data, "document.tags.name", "1-URGENT").alias("by_name"),
        q.matches(data, "document.tags", "1-URGENT").alias("by_element"),
        q.matches(data, "document.note", None).alias("no_note"),
        paths.compares(F.col(DOCUMENT_COLUMN), "note", "exists", True).alias("has_note"),
    )
    return found.where("by_name or by_element")


def document_elem_match(spark: SparkSession, directory: str) -> DataFrame:
    """Arrays with one element that passes two tests at once."""
    tests = [("name", "gte", "F"), ("name", "lt", "G")]
    data, document = _parsed_shop(spark, directory), F.col(DOCUMENT_COLUMN)
    return data.where(paths.element_matches(document, "tags", tests)).select(
        _at("_id", "bigint").alias("order_key"), _at("customer.id", "bigint").alias("customer")
    )


def document_numbers(spark: SparkSession, directory: str) -> DataFrame:
    """Numbers that doubles can't tell apart, beside large ones and texts."""
    key = F.col("o_orderkey")
    amount = (
        F.when(key % 4 == 0, (F.lit(9007199254740992) + key % 3).cast("string"))
        .when(key % 4 == 1, F.concat(F.lit("1.000000000"), (key % 3).cast("string")))
        .when(key % 4 == 2, F.lit("1e30")).otherwise(F.concat(F.lit('"'), key.cast("string"), F.lit('"')))
    )
    text = F.concat(F.lit('{"_id":'), key.cast("string"), F.lit(',"amount":'), amount, F.lit("}"))
    data = q.computed_once(documents_from_json(table(spark, directory, "orders").select(text.alias("value"))), DOCUMENT_COLUMN)

    def passes(operator: str, value: object) -> Column:
        return paths.compares(F.col(DOCUMENT_COLUMN), "amount", operator, value)

    return data.select(
        _at("_id", "bigint").alias("order_key"), passes("eq", 1).alias("is_one"), passes("gt", 1).alias("above_one"),
        passes("gte", 5).alias("from_five"), passes("eq", 9007199254740993).alias("is_odd"),
        passes("lte", 9007199254740992.0).alias("to_even"), passes("in", [9007199254740994, "7"]).alias("listed"),
    )


def document_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """Customers as documents with their orders, documents too."""
    customers = documents_from_rows(table(spark, directory, "customer"), "c_custkey", "c_name")
    orders = _shop_documents(spark, directory).withColumn("of", _at("customer.id", "bigint"))
    found = q.lookup(
        customers.withColumn("key", _at("c_custkey", "bigint")), orders, "key", "of", "orders",
        columns=[DOCUMENT_COLUMN],
    )
    keys = F.transform("orders", lambda o: F.try_variant_get(o[DOCUMENT_COLUMN], "$._id", "bigint"))
    return found.select(
        "key", _at("c_name", "string").alias("name"),
        F.size("orders").cast("bigint").alias("order_count"), _joined(F.array_sort(keys)).alias("orders"),
    )


def _inferred(data: DataFrame) -> DataFrame:
    fields = documents.infer_fields(data, DOCUMENT_COLUMN)
    return fields.select("path", _joined("types").alias("types"))


def infer_fields_props(spark: SparkSession, directory: str) -> DataFrame:
    return _inferred(_event_documents(spark, directory))


def infer_fields_nested(spark: SparkSession, directory: str) -> DataFrame:
    return _inferred(_shop_documents(spark, directory))


def document_profile(spark: SparkSession, directory: str) -> DataFrame:
    return _flat_profile(documents.document_profile(_collections(spark, directory)))


# -- profiles ----------------------------------------------------------------


def _flat_profile(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "source_id", "namespace", "entity", "path", _joined("types").alias("types"),
        _joined("type_families").alias("type_families"), "primary_key", "unique", "nullable",
        "sampled_value_count", "distinct_sample_count", "distinct_count", "null_count",
        fingerprint(_joined("value_fingerprints")).alias("fingerprint_digest"),
    )


def field_profile(spark: SparkSession, directory: str) -> DataFrame:
    return _flat_profile(profile.field_profile(spark, warehouse(spark, directory)))


def bounded_sample(spark: SparkSession, directory: str) -> DataFrame:
    sample = profile.bounded_sample(table(spark, directory, "orders"), "o_orderkey")
    return sample.select("o_orderkey", "o_custkey", "o_totalprice")


def _forms(spark: SparkSession, directory: str, name: str, key: str) -> tuple:
    data = table(spark, directory, name)
    fields = [f for f in data.schema.fields if f.name != key]
    return data, {f"{f.name}_form": normal_form(F.col(f.name), f.dataType) for f in fields}


def normalize_values(spark: SparkSession, directory: str) -> DataFrame:
    data, forms = _forms(spark, directory, "events", "event_id")
    return data.select("event_id", *(c.alias(n) for n, c in forms.items()))


def fingerprint_values(spark: SparkSession, directory: str) -> DataFrame:
    data, forms = _forms(spark, directory, "documents", "doc_id")
    staged = data.select("doc_id", *(c.alias(n) for n, c in forms.items()))
    return staged.select("doc_id", *(
        fingerprint(F.col(n)).alias(n.replace("_form", "_fingerprint")) for n in forms
    ))


def measured_uniqueness(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    fields = catalog.profiled_fields(spark, sources)
    return profile.measured_uniqueness(sources, fields).select(
        "source_id", "entity", "path", "value_count", "distinct_count",
        "declared_unique", "measured_unique",
    )


def field_uniqueness(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    fields = catalog.profiled_fields(spark, sources)
    return sketches.uniqueness(spark, sources, fields).select(
        "source_id", "entity", "path", "declared_unique", "measured_unique"
    )


def _named(sketch: DataFrame, fields: DataFrame) -> DataFrame:
    return sketch.join(fields, "field_id").select(
        "source_id", "entity", "path", F.col("rank").cast("bigint").alias("rank"), "fingerprint"
    )


def fingerprint_sketch(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    fields = catalog.catalog_fields(spark, sources)
    return _named(profile.fingerprint_sketch(value_counts(sources)), fields)


def fingerprint_sketch_bounded(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    return _named(sketches.fingerprints(sources), catalog.catalog_fields(spark, sources))


# -- relationships -----------------------------------------------------------


ENTITY = ["source_id", "namespace", "entity"]


#: Overlap from which pairs of fields are asked for where sketches rule out the others.
LEAST_OVERLAP = 0.1


def _described(spark: SparkSession, directory: str) -> DataFrame:
    return relate.describe(catalog.profiled_fields(spark, warehouse(spark, directory)))


def _with_sizes(pairs: DataFrame, spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of fields beside the measured size of both entities."""
    counts = catalog.row_counts(warehouse(spark, directory))
    for side in ("left", "right"):
        sizes = counts.toDF(*(f"{side}_{c}" for c in ENTITY), f"{side}_rows")
        pairs = pairs.join(sizes, [f"{side}_{c}" for c in ENTITY])
    return pairs


def name_tokens(spark: SparkSession, directory: str) -> DataFrame:
    counts = catalog.row_counts(warehouse(spark, directory))
    return _described(spark, directory).join(counts, ENTITY).select(
        "source_id", "entity", "path", _joined(F.array_sort("tokens")).alias("tokens"), "row_count"
    )


def name_similarity(spark: SparkSession, directory: str) -> DataFrame:
    pairs = relate.name_similarity(_described(spark, directory))
    return _with_sizes(pairs, spark, directory).select(
        *ENDS, _ratio("similarity").alias("similarity"), "left_rows", "right_rows"
    )


def compatible_pairs(spark: SparkSession, directory: str) -> DataFrame:
    pairs = relate.compatible_pairs(relate.name_pairs(_described(spark, directory)))
    return _with_sizes(pairs, spark, directory).select(
        *ENDS, "compatible", "left_rows", "right_rows"
    )


def value_overlap(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    described = relate.describe(catalog.profiled_fields(spark, sources))
    pairs = overlap.value_overlap(value_counts(sources)).select("a", "b", "shared", "overlap")
    return relate.orient(pairs, described).select(
        *ENDS, "shared", _ratio("overlap").alias("overlap")
    )


def value_overlap_screened(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    fields = catalog.profiled_fields(spark, sources)
    pairs = sketches.screened_overlap(spark, sources, fields, LEAST_OVERLAP, across=True)
    return relate.orient(pairs.select("a", "b", "shared", "overlap"), relate.describe(fields)).select(
        *ENDS, "shared", _ratio("overlap").alias("overlap")
    )


def value_overlap_sketch(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    described = relate.describe(catalog.profiled_fields(spark, sources))
    pairs = discovery.overlaps(spark, sources, "sketch")
    return relate.orient(pairs, described).select(
        *ENDS, "shared", "sampled", _ratio("overlap").alias("overlap")
    )


def _flat_suggestions(suggestions: DataFrame) -> DataFrame:
    return suggestions.withColumn("evidence", _joined("evidence"))


def relationship_suggestions(spark: SparkSession, directory: str) -> DataFrame:
    return _flat_suggestions(discovery.suggest(spark, warehouse(spark, directory)))


def relationship_suggestions_sketch(spark: SparkSession, directory: str) -> DataFrame:
    return _flat_suggestions(discovery.suggest(spark, warehouse(spark, directory), "sketch"))


def relationship_suggestions_mixed(spark: SparkSession, directory: str) -> DataFrame:
    """Suggestions between tables and a collection."""
    sources = SourceSet([warehouse(spark, directory)["crm"], _shop(spark, directory)])
    return _flat_suggestions(discovery.suggest(spark, sources))


#: Positions of mappings are made from the numbers of their two fields, so that these
#: must not reach it; the position of a mapping then fits in 64 bits.
FIELDS = 1 << 28


def _proposals(spark: SparkSession, sources: SourceSet, *variants: Column) -> DataFrame:
    """A mapping of each key column to each field of its families in another source,
    in every variant."""
    described = relate.describe(catalog.profiled_fields(spark, sources))
    left, right = (
        described.select(*(F.col(c).alias(f"{side}_{c}") for c in described.columns))
        .withColumn("family", F.explode(f"{side}_type_families"))
        for side in ("left", "right")
    )
    pairs = (
        left.where("left_is_key").join(right, "family")
        .where("left_source_ord <> right_source_ord")
        .withColumns({
            "operator": F.lit("equals"), "cardinality": F.lit("one-to-many"),
            "join_type": F.lit("inner"),
        })
    )
    place = F.col("left_field_id") * FIELDS + F.col("right_field_id")
    proposed = pairs.select(
        place.alias("place"), F.posexplode(F.array(*variants)).alias("variant", "r")
    )
    position = F.col("place") * len(variants) + F.col("variant")
    return proposed.select(position.cast("bigint").alias("pos"), "r.*")


def _variant(**changed: Column) -> Column:
    columns = [*relate.endpoint_columns(), "operator", "cardinality", "join_type"]
    return F.struct(*(changed.get(c, F.col(c)).alias(c) for c in columns))


def _swapped() -> Column:
    ends = relate.endpoint_columns()
    half = len(ends) // 2
    return _variant(**{c: F.col(o) for c, o in zip(ends, ends[half:] + ends[:half])})


def validate_relationships(spark: SparkSession, directory: str) -> DataFrame:
    sources = warehouse(spark, directory)
    proposals = _proposals(
        spark, sources,
        _variant(left_path=F.concat(F.lit(" "), "left_path", F.lit("\t"))),
        _swapped(),
        _variant(operator=F.lit("contains")),
        _variant(right_path=F.concat("right_path", F.lit("_missing"))),
        _variant(
            right_source_id=F.lit("sales"), right_entity=F.lit("orders"),
            right_path=F.lit("o_orderdate"),
        ),
    )
    checked = mapping.validate(proposals, catalog.profiled_fields(spark, sources))
    counts = catalog.row_counts(sources).select(
        *(F.col(c).alias(f"left_{c}") for c in ENTITY), F.col("row_count").alias("left_rows"))
    return checked.join(counts, [f"left_{c}" for c in ENTITY]).select(
        "pos", *ENDS, "status", "left_rows")


def duplicate_relationships(spark: SparkSession, directory: str) -> DataFrame:
    proposals = _proposals(spark, warehouse(spark, directory), _variant(), _swapped())
    marked = mapping.mark_duplicates(proposals)
    return _with_sizes(marked, spark, directory).select(
        "pos", *ENDS, "duplicate", "left_rows", "right_rows")


def join_inner(spark: SparkSession, directory: str) -> DataFrame:
    joined = mapping.join_sources(warehouse(spark, directory), mapping.Relationship(
        mapping.Endpoint("crm", NAMESPACE, "customer", "c_custkey"),
        mapping.Endpoint("sales", NAMESPACE, "orders", "o_custkey"),
        "one-to-many",
    ))
    return joined.select(
        "left_c_custkey", "left_c_name", "right_o_orderkey", "right_o_totalprice"
    )


def join_left(spark: SparkSession, directory: str) -> DataFrame:
    joined = mapping.join_sources(warehouse(spark, directory), mapping.Relationship(
        mapping.Endpoint("crm", NAMESPACE, "customer", "c_custkey"),
        mapping.Endpoint("content", NAMESPACE, "labels", "doc_id"),
        "one-to-many", "left",
    ), by_form=True)
    return joined.select("left_c_custkey", "left_c_name", "right_doc_id", "right_quality")


# (relationship, claimed class): the foreign keys, and one that is none.
REFERENCES = (
    ("customer", "c_custkey", "orders", "o_custkey", "one-to-many"),
    ("nation", "n_nationkey", "supplier", "s_nationkey", "one-to-many"),
    ("lineitem", "l_partkey", "part", "p_partkey", "many-to-one"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey", "one-to-one"),
    ("customer", "c_custkey", "labels", "doc_id", "one-to-one"),
)


def observed_cardinality(spark: SparkSession, directory: str) -> DataFrame:
    parts = []
    for left, left_column, right, right_column, claimed in REFERENCES:
        measured = mapping.observed_cardinality(
            table(spark, directory, left), table(spark, directory, right),
            left_column, right_column, claimed,
        )
        name = F.lit(f"{left}.{left_column}={right}.{right_column}").alias("relationship")
        parts.append(measured.select(name, "*"))
    return reduce(DataFrame.unionAll, parts)


# -- queries -----------------------------------------------------------------


def sql_bounded(spark: SparkSession, directory: str) -> DataFrame:
    views = {name: table(spark, directory, name) for name in ("customer", "orders")}
    return q.bounded_sql(spark, """
        WITH big AS (SELECT * FROM orders WHERE o_totalprice > 1000)
        SELECT o_orderkey, c_name, o_totalprice  -- a ';' in a comment is no end
        FROM big JOIN customer ON c_custkey = o_custkey
        WHERE o_orderpriority <> ';'
        ORDER BY o_totalprice DESC, o_orderkey; -- a comment after the end
    """, views)


def find_orders(spark: SparkSession, directory: str) -> DataFrame:
    return q.find(
        table(spark, directory, "orders"),
        where=(F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 1000),
        columns=["o_orderkey", "o_custkey", "o_totalprice"],
        sort={"o_orderpriority": 1, "o_totalprice": -1, "o_orderkey": 1},
        limit=2000,
    )


def aggregate_capped(spark: SparkSession, directory: str) -> DataFrame:
    return q.aggregate(
        table(spark, directory, "orders"),
        lambda d: d.where(F.col("o_orderstatus").isin("F", "O")),
        lambda d: d.groupBy("o_custkey").agg(
            F.count("*").alias("order_count"), F.max("o_totalprice").alias("top_price")
        ),
        lambda d: d.orderBy(F.desc("order_count"), F.desc("top_price"), "o_custkey"),
    )


def _words(spark: SparkSession, directory: str) -> DataFrame:
    parts = table(spark, directory, "part")
    return parts.select("p_partkey", "p_name", F.split("p_name", " ").alias("words"))


def array_membership(spark: SparkSession, directory: str) -> DataFrame:
    data = _words(spark, directory)
    return q.find(
        data.where(q.matches(data, "words", "ring")),
        columns=["p_partkey", "p_name"], sort={"p_name": 1, "p_partkey": 1},
    )


def array_any_match(spark: SparkSession, directory: str) -> DataFrame:
    allowed = ("small", "large", "red", "blue", "ring", "bolt", "widget")
    return _words(spark, directory).where(q.any_outside("words", allowed)).select(
        "p_partkey", "p_name"
    )


def filter_compound(spark: SparkSession, directory: str) -> DataFrame:
    events = table(spark, directory, "events").withColumn("doc", F.parse_json("props"))
    return events.where(
        (F.col("value") >= 20)
        & F.col("event_type").isin("purchase", "signup")
        & q.has_path("doc", "$.k")
        & ~q.has_path("doc", "$.missing")
    ).select("event_id", "event_type", "value")


def lookup_nested(spark: SparkSession, directory: str) -> DataFrame:
    nested = q.lookup(
        table(spark, directory, "customer").select("c_custkey", "c_mktsegment"),
        table(spark, directory, "orders"),
        "c_custkey", "o_custkey", "orders", columns=["o_orderkey", "o_orderstatus"],
    )
    texts = F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"], o["o_orderstatus"]))
    return nested.select(
        "c_custkey", "c_mktsegment", F.size("orders").cast("bigint").alias("order_count"),
        _joined(texts).alias("orders"),
    )


def lookup_orphans(spark: SparkSession, directory: str) -> DataFrame:
    return q.without_match(
        table(spark, directory, "documents"), table(spark, directory, "labels"),
        "doc_id", "doc_id",
    ).select("doc_id", "lang", "n_chars")


def ordered_string_agg(spark: SparkSession, directory: str) -> DataFrame:
    joined = table(spark, directory, "orders").join(
        table(spark, directory, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return q.ordered_strings(
        joined, ["c_name"], "o_orderpriority", "o_orderpriority", "/", "priorities", distinct=True
    )


def ordered_string_repeats(spark: SparkSession, directory: str) -> DataFrame:
    """Flags of an order's lines in the order of the lines, repeats kept."""
    return q.ordered_strings(
        table(spark, directory, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber",
        "/", "flags",
    )


def tolerant_text_match(spark: SparkSession, directory: str) -> DataFrame:
    return q.tolerant_match(
        table(spark, directory, "part"), "p_name", {"SMALL ring": "sma", "Blue Bolt": "blu"}
    ).select("p_partkey", "p_name", "match_rank")


def result_envelope(spark: SparkSession, directory: str) -> DataFrame:
    """A bounded result and an empty one."""
    def envelope(status: str) -> DataFrame:
        found = q.find(
            table(spark, directory, "orders"),
            where=F.col("o_orderstatus") == status,
            columns=["o_orderkey", "o_custkey", "o_orderpriority"],
            sort={"o_orderkey": 1},
        )
        return q.result_envelope(found, RELATIONAL)

    return envelope("O").unionAll(envelope("no such status")).select(
        "kind", F.array_join("rows", "\n").alias("rows"), "returned_count"
    )


# -- several sources ---------------------------------------------------------


def _batch(spark: SparkSession, directory: str) -> batch.Batch:
    def opened(name: str) -> Callable[[], DataFrame]:
        return lambda: table(spark, directory, name)

    return batch.multi_source_batch(spark, [
        batch.SourceQuery(
            "source_1", RELATIONAL, opened("customer"),
            lambda d: d.where("c_nationkey < 5").select("c_custkey", "c_name"), ("c_custkey",),
        ),
        batch.SourceQuery(
            "source_2", RELATIONAL, opened("no_such_table"), lambda d: d, ("id",),
        ),
        batch.SourceQuery(
            "source_3", RELATIONAL, opened("orders"),
            lambda d: d.select("o_orderkey", "o_custkey", "o_orderstatus"), ("o_orderkey",),
        ),
        batch.SourceQuery(
            "source_4", DOCUMENT, opened("events"),
            lambda d: d.select("no_such_member"), ("event_id",),
        ),
        batch.SourceQuery(
            "source_5", DOCUMENT, opened("events"),
            lambda d: d.where("event_type = 'error'").select("event_id", "user_id"), ("event_id",),
        ),
        batch.SourceQuery(
            "source_6", RELATIONAL, opened("orders"),
            lambda d: d.where("o_totalprice < 0").select("o_orderkey"), ("o_orderkey",),
        ),
        batch.SourceQuery(
            "source_7", DOCUMENT, opened("events"),
            lambda d: d.select("event_id", F.assert_true(F.col("event_id") < 0).alias("checked")),
            ("event_id",),
        ),
    ])


def multi_source_batch(spark: SparkSession, directory: str) -> DataFrame:
    rows = _batch(spark, directory).rows
    return rows.select(
        "source_id", F.col("row_no").cast("bigint").alias("row_no"), "returned_count", "row"
    )


def multi_source_outcomes(spark: SparkSession, directory: str) -> DataFrame:
    return _batch(spark, directory).outcomes.select(
        "source_id", "kind", "stage", "status", "error", "returned_count"
    )


def pack_rows_per_group(spark: SparkSession, directory: str) -> DataFrame:
    packed = batch.pack_rows(
        table(spark, directory, "conversations"),
        ["conv_id"], ["turn"], ["turn", "role", "text"], max_rows=6, max_chars=3000,
    )
    return batch.pack_summary(packed, ["conv_id"])


def pack_rows_shared(spark: SparkSession, directory: str) -> DataFrame:
    rows = _batch(spark, directory).rows
    packed = batch.pack_shared(rows, max_rows=40, max_chars=4000)
    return packed.select(
        "source_ord", F.col("kept_rows").cast("bigint").alias("kept_rows"), "kept_chars",
        "truncated",
    )


# -- expectations ------------------------------------------------------------


def expect_row_counts(spark: SparkSession, directory: str) -> DataFrame:
    counts = catalog.row_counts(warehouse(spark, directory)).select("entity", "row_count")
    return expect.expect_row_counts(counts, {"region": 5, "nation": 25, "labels": 1})


def expect_domains(spark: SparkSession, directory: str) -> DataFrame:
    lines = expect.expect_domains(table(spark, directory, "lineitem"), {
        "linestatus_listed": F.col("l_linestatus").isin("O", "F"),
        "returnflag_constant": F.col("l_returnflag") == "N",
        "quantity_in_range": F.col("l_quantity").between(1, 50),
        "discount_below": F.col("l_discount") < 0.1,
    })
    orders = expect.expect_domains(table(spark, directory, "orders"), {
        "status_listed": F.col("o_orderstatus").isin("O", "F"),
        "price_positive": F.col("o_totalprice") > 0,
    })
    return lines.unionAll(orders)


def expect_unique(spark: SparkSession, directory: str) -> DataFrame:
    checks = (
        ("customer", ["c_custkey"]),
        ("part", ["p_name"]),
        ("lineitem", ["l_orderkey", "l_linenumber"]),
        ("conversations", ["conv_id", "turn"]),
    )
    return reduce(DataFrame.unionAll, [
        expect.expect_unique(table(spark, directory, name), columns).select(
            F.lit(f"{name}({','.join(columns)})").alias("rule"), "repeated_keys", "surplus_rows"
        )
        for name, columns in checks
    ])


def expect_references(spark: SparkSession, directory: str) -> DataFrame:
    checks = (
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("documents", "doc_id", "labels", "doc_id"),
        ("events", "user_id", "supplier", "s_suppkey"),
    )
    return reduce(DataFrame.unionAll, [
        expect.expect_references(
            table(spark, directory, child), column, table(spark, directory, parent), key
        ).select(
            F.lit(f"{child}.{column}->{parent}.{key}").alias("rule"), "orphan_keys", "orphan_rows"
        )
        for child, column, parent, key in checks
    ])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        result_envelope,
        catalog_fields, catalog_keys, catalog_session, catalog_mixed, infer_fields_props, infer_fields_nested,
        bounded_sample, normalize_values, fingerprint_values, type_families, profile_eligible,
        field_profile, document_profile, measured_uniqueness, field_uniqueness,
        fingerprint_sketch, fingerprint_sketch_bounded,
        name_tokens, name_similarity, value_overlap, value_overlap_screened, value_overlap_sketch,
        compatible_pairs,
        relationship_suggestions, relationship_suggestions_sketch, relationship_suggestions_mixed,
        validate_relationships, duplicate_relationships, join_inner, join_left,
        observed_cardinality,
        sql_bounded, find_orders, aggregate_capped, array_membership, array_any_match,
        filter_compound, find_documents, document_membership, document_elem_match, document_numbers,
        document_lookup, lookup_nested, lookup_orphans, ordered_string_agg,
        ordered_string_repeats, row_counts,
        tolerant_text_match,
        multi_source_batch, multi_source_outcomes, pack_rows_per_group, pack_rows_shared,
        expect_row_counts, expect_domains, expect_unique, expect_references,
    )
}
