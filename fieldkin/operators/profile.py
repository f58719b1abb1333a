"""Field profiles: counts, nullability, keys and fingerprints of every field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.functions import values as V
from fieldkin.operators.catalog import profiled_columns, profiled_fields
from fieldkin.operators.value_counts import value_counts
from fieldkin.sources.model import Entity, Source, SourceSet

# Fingerprints kept per field, and the size of a bounded sample.
MAX_FINGERPRINTS = 100
SAMPLE_SIZE = 100

PROFILE_COLUMNS = (
    "source_ord", "source_id", "namespace", "entity", "path", "field_id",
    "types", "type_families", "primary_key", "unique", "nullable",
    "sampled_value_count", "distinct_sample_count", "distinct_count",
    "null_count", "value_fingerprints",
)


def comparable() -> Column:
    """Whether counted values have a fingerprint.

    The answer of the counts alone would be pushed below them, and queries that
    filter would not share the shuffle of those that do not. Asking ``n`` keeps
    the filter above.
    """
    return F.when(F.col("n") > 0, F.col("comparable"))


def field_statistics(counts: DataFrame) -> DataFrame:
    """Values, distinct values and nulls per field, from value counts."""
    valued = comparable()
    return counts.groupBy("field_id").agg(
        F.sum(F.when(valued, F.col("n")).otherwise(0)).alias("sampled_value_count"),
        F.count_if(valued).alias("distinct_count"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
    )


def fingerprint_sketch(counts: DataFrame, size: int = MAX_FINGERPRINTS) -> DataFrame:
    """The ``size`` smallest fingerprints of each field (k minimum values).

    Deterministic, mergeable, and a uniform sample of the distinct values. The
    rank filter is applied before the shuffle as well, so a task sends at most
    ``size`` rows per field however many distinct values the field has.
    """
    ranked = counts.where(comparable()).select(
        "field_id", V.key_fingerprint(F.col("key")).alias("fingerprint")
    )
    rank = F.row_number().over(W.partitionBy("field_id").orderBy("fingerprint"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= size)


def _sketch_arrays(counts: DataFrame) -> DataFrame:
    return fingerprint_sketch(counts).groupBy("field_id").agg(
        F.array_sort(F.collect_list("fingerprint")).alias("value_fingerprints")
    )


def assemble(fields: DataFrame, counts: DataFrame, nullable: Column) -> DataFrame:
    """Field rows joined with what was measured; a field without rows counts zero."""
    measured = field_statistics(counts)
    zero = F.lit(0).cast("bigint")
    return (
        fields.join(measured, "field_id", "left")
        .join(_sketch_arrays(counts), "field_id", "left")
        .withColumns({
            name: F.coalesce(name, zero)
            for name in ("sampled_value_count", "distinct_count", "null_count")
        })
        .withColumns({
            "value_fingerprints": F.coalesce(
                "value_fingerprints", F.array().cast("array<string>")
            ),
            "distinct_sample_count": F.least(
                F.col("distinct_count"), F.lit(MAX_FINGERPRINTS)
            ).cast("bigint"),
        })
        .withColumn("nullable", nullable)
        .select(*PROFILE_COLUMNS)
    )


def field_profile(
    spark: SparkSession, sources: SourceSet, counts: DataFrame | None = None
) -> DataFrame:
    """Profiles of the relational fields over whole tables.

    ``counts`` may be value counts already written out by the caller.
    """
    counts = value_counts(sources) if counts is None else counts
    nullable = F.col("declared_nullable") | (F.col("null_count") > 0)
    return assemble(profiled_fields(spark, sources), counts, nullable)


def measured_uniqueness(sources: SourceSet, fields: DataFrame) -> DataFrame:
    """Whether a field's values are in fact all different, beside the declared keys.

    Measured on the values themselves, not on normal forms: texts of any length, case
    and spacing count, nulls don't. Only where a key is plausible: integers, text,
    identifiers. A floating measure that happens not to repeat is no key. Texts are
    compared by 128-bit digests, which combine before they are shuffled.
    """
    tables = profiled_columns(sources)
    parts = []
    for entity, refs in tables:
        columns = {
            str(ref.field_id): F.unhex(F.md5(F.col(f"`{ref.column}`").cast("string")))
            for ref in refs
            if isinstance(ref.data_type, (T.IntegralType, T.StringType))
        }
        if columns:
            data = entity.data.select(*(c.alias(name) for name, c in columns.items()))
            parts.append(data.unpivot([], list(columns), "field", "value"))
    values = reduce(DataFrame.unionAll, parts).groupBy("field", "value").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    measured = values.groupBy(F.col("field").cast("bigint").alias("field_id")).agg(
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("value_count"),
        F.count_if(present).alias("distinct_count"),
    )
    return (
        fields.join(measured, "field_id")
        .withColumn("declared_unique", F.col("primary_key") | F.col("unique"))
        .withColumn(
            "measured_unique",
            (F.col("value_count") > 0) & (F.col("value_count") == F.col("distinct_count")),
        )
    )


def bounded_sample(data: DataFrame, *key: str, size: int = SAMPLE_SIZE) -> DataFrame:
    """``size`` rows in the order of a hash of their key: random but repeatable.

    Each task keeps its own ``size`` best rows, so nothing else is moved.
    """
    digest = F.sha2(F.concat_ws("\u0000", *(F.col(c).cast("string") for c in key)), 256)
    return data.orderBy(digest, *key).limit(size)


def sampled(sources: SourceSet, size: int = SAMPLE_SIZE) -> SourceSet:
    """The same sources, each entity cut to a bounded sample of its rows.

    Rows are ordered by a hash of their declared primary key, else of their JSON.
    """
    return SourceSet(
        Source(s.source_id, s.kind, tuple(_sampled(e, size) for e in s.entities))
        for s in sources
    )


def _sampled(entity: Entity, size: int) -> Entity:
    key = next((k.columns for k in entity.keys if k.kind == "primary"), None)
    if entity.document is not None:
        text = F.to_json(F.col(entity.document))
    elif key:
        text = F.concat_ws("\u0000", *(F.col(f"`{c}`").cast("string") for c in key))
    else:
        text = F.to_json(F.struct(*(f"`{c}`" for c in entity.data.columns)))
    ordered = entity.data.orderBy(F.sha2(text, 256), text).limit(size)
    return Entity(
        entity.namespace, entity.name, ordered, entity.keys, entity.indexes,
        entity.not_null, entity.identifiers, entity.document,
    )
