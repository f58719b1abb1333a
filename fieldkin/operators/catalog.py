"""Catalog: one row per field of every relational source, and declared keys.

A catalog is made from schemas the session already holds, so its size is the
number of columns of the sources, never a function of their rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.functions.types import is_profiled, profiled, type_families, type_name
from fieldkin.sources.model import RELATIONAL, Entity, Source, SourceSet

FIELD_SCHEMA = pa.schema([
    ("source_ord", pa.int32()), ("source_id", pa.string()), ("namespace", pa.string()),
    ("entity", pa.string()), ("ordinal", pa.int32()), ("path", pa.string()),
    ("types", pa.list_(pa.string())), ("field_id", pa.int64()),
    ("primary_key", pa.bool_()), ("unique", pa.bool_()), ("declared_nullable", pa.bool_()),
])

ENTITY_SCHEMA = pa.schema([
    ("source_ord", pa.int32()), ("source_id", pa.string()), ("kind", pa.string()),
    ("namespace", pa.string()), ("entity", pa.string()), ("indexes", pa.list_(pa.string())),
])

KEY_SCHEMA = pa.schema([
    ("source_ord", pa.int32()), ("source_id", pa.string()), ("namespace", pa.string()),
    ("entity", pa.string()), ("key_name", pa.string()), ("key_type", pa.string()),
    ("ordinal", pa.int32()), ("path", pa.string()),
])


def local_rows(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Metadata as a local relation: its size is known, so joins with it broadcast
    exactly as long as it is small, and expressions over it fold when planning."""
    columns = zip(*rows) if rows else ([] for _ in schema)
    arrays = [pa.array(list(c), field.type) for c, field in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


@dataclass(frozen=True)
class FieldRef:
    """A profiled column, and the identifier its values are counted under."""

    field_id: int
    column: str
    data_type: T.DataType
    identifier: bool


def _type_of(entity: Entity, column: T.StructField) -> str:
    return "uuid" if column.name in entity.identifiers else type_name(column.dataType)


def _relational(sources: SourceSet) -> list[tuple[int, Source, Entity]]:
    return [
        (i, source, entity)
        for i, source in sources.of_kind(RELATIONAL)
        for entity in source.entities
    ]


def profiled_columns(sources: SourceSet) -> list[tuple[Entity, list[FieldRef]]]:
    """The columns to profile of each entity, numbered across the whole set."""
    numbered, first = [], 0
    for _, _, entity in _relational(sources):
        fields = entity.data.schema.fields
        numbered.append((entity, [
            FieldRef(first + i, c.name, c.dataType, c.name in entity.identifiers)
            for i, c in enumerate(fields)
            if is_profiled(_type_of(entity, c))
        ]))
        first += len(fields)
    return numbered


def catalog_fields(spark: SparkSession, sources: SourceSet) -> DataFrame:
    """Fields of the relational sources in ordinal order, with one type each."""
    rows, field_id = [], 0
    for i, source, entity in _relational(sources):
        primary, unique = entity.columns_of("primary"), entity.columns_of("unique")
        for ordinal, column in enumerate(entity.data.schema.fields, start=1):
            rows.append((
                i, source.source_id, entity.namespace, entity.name, ordinal,
                column.name, [_type_of(entity, column)], field_id,
                column.name in primary, column.name in unique,
                column.name not in entity.required,
            ))
            field_id += 1
    return local_rows(spark, rows, FIELD_SCHEMA)


def with_families(fields: DataFrame) -> DataFrame:
    return fields.withColumn("type_families", type_families(F.col("types")))


def profiled_fields(spark: SparkSession, sources: SourceSet) -> DataFrame:
    """Catalog rows of the columns that get a profile, with their families."""
    fields = catalog_fields(spark, sources)
    return with_families(fields.where(profiled(F.col("types")[0])))


def declared_keys(spark: SparkSession, sources: SourceSet) -> DataFrame:
    """One row per column of a declared key, in key order."""
    rows = [
        (i, source.source_id, entity.namespace, entity.name, key.name, key.kind, n, column)
        for i, source in enumerate(sources)
        for entity in source.entities
        for key in entity.keys
        for n, column in enumerate(key.columns, start=1)
    ]
    return local_rows(spark, rows, KEY_SCHEMA)


def catalog_entities(spark: SparkSession, sources: SourceSet) -> DataFrame:
    """Every entity of every source with the names of its indexes."""
    rows = [
        (i, source.source_id, source.kind, entity.namespace, entity.name, sorted(entity.indexes))
        for i, source in enumerate(sources)
        for entity in source.entities
    ]
    return local_rows(spark, rows, ENTITY_SCHEMA)


def catalog_keys(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """Primary keys of every cataloged entity, columns in key order, and its unique columns.

    Entities without a key keep one row with an empty list; keys of entities
    that are not in the catalog are left out.
    """
    entity = ["source_ord", "source_id", "namespace", "entity"]
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda k: k["path"]
    )
    primary = (
        keys.where(F.col("key_type") == "primary")
        .groupBy(*entity, "key_name")
        .agg(listed.alias("key_fields"))
    )
    unique = (
        keys.where(F.col("key_type") == "unique")
        .groupBy(*entity)
        .agg(F.array_sort(F.collect_set("path")).alias("unique_fields"))
    )
    none = F.array().cast("array<string>")
    return entities.join(primary, entity, "left").join(unique, entity, "left").select(
        *entity, "kind", "indexes", "key_name",
        F.coalesce("key_fields", none).alias("key_fields"),
        F.coalesce("unique_fields", none).alias("unique_fields"),
    )


def row_counts(sources: SourceSet) -> DataFrame:
    """Rows of every entity: one count per scan, no column read."""
    counts = [
        entity.data.agg(F.count("*").alias("row_count")).select(
            F.lit(source.source_id).alias("source_id"),
            F.lit(entity.namespace).alias("namespace"),
            F.lit(entity.name).alias("entity"),
            "row_count",
        )
        for source in sources
        for entity in source.entities
    ]
    return reduce(DataFrame.unionAll, counts)
