"""From named sources of either kind to ranked relationship suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.operators.catalog import (
    catalog_entities,
    catalog_fields,
    catalog_keys,
    declared_keys,
    profiled_fields,
)
from fieldkin.operators.documents import (
    document_counts,
    document_fields,
    document_presence,
    document_value_counts,
)
from fieldkin.operators.overlap import sketch_overlap, value_overlap
from fieldkin.operators.profile import fingerprint_sketch, sampled
from fieldkin.operators.relate import best, candidate_pairs, describe, score
from fieldkin.operators.value_counts import value_counts
from fieldkin.sources.model import DOCUMENT, RELATIONAL, SourceSet

MODES = ("exact", "sketch", "sample")


@dataclass(frozen=True)
class Inspection:
    """Profiled fields of all sources, and the counts of their values."""

    fields: DataFrame
    counts: DataFrame


def inspect(spark: SparkSession, sources: SourceSet) -> Inspection:
    """Fields and value counts of relational and document sources together."""
    fields, counts = [], []
    if sources.of_kind(RELATIONAL):
        fields.append(profiled_fields(spark, sources))
        counts.append(value_counts(sources))
    if sources.of_kind(DOCUMENT):
        occurrences = document_counts(sources)
        fields.append(document_fields(sources, occurrences))
        counts.append(document_value_counts(occurrences))
    if len(fields) == 1:
        return Inspection(fields[0], counts[0])
    shared = [c for c in fields[0].columns if c in fields[1].columns]
    return Inspection(
        fields[0].select(*shared).unionByName(fields[1].select(*shared)),
        counts[0].unionByName(counts[1]),
    )


def catalog(spark: SparkSession, sources: SourceSet) -> DataFrame:
    """Every entity of sources of both kinds: its fields, indexes and keys, one row each.

    Fields of tables come in their order, fields of documents by path.
    """
    entity = ["source_ord", "source_id", "namespace", "entity"]
    described = ["path", "types", F.col("declared_nullable").alias("nullable")]
    fields = []
    if sources.of_kind(RELATIONAL):
        fields.append(catalog_fields(spark, sources).select(*entity, "ordinal", *described))
    if sources.of_kind(DOCUMENT):
        found = document_fields(sources, document_presence(sources))
        fields.append(found.select(*entity, F.lit(0).alias("ordinal"), *described))
    every = fields[0] if len(fields) == 1 else fields[0].unionAll(fields[1])
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "path", "types", "nullable"))),
        lambda f: F.struct(f["path"].alias("path"), f["types"].alias("types"), f["nullable"].alias("nullable")),
    )
    keys = catalog_keys(catalog_entities(spark, sources), declared_keys(spark, sources))
    return keys.join(every.groupBy(*entity).agg(listed.alias("fields")), entity, "left")


def _overlaps(counts: DataFrame, mode: str) -> DataFrame:
    return sketch_overlap(fingerprint_sketch(counts)) if mode == "sketch" else value_overlap(counts)


def _inspected(spark: SparkSession, sources: SourceSet, mode: str) -> Inspection:
    if mode not in MODES:
        raise ValueError(f"Unknown mode: {mode!r}.")
    return inspect(spark, sampled(sources) if mode == "sample" else sources)


def overlaps(spark: SparkSession, sources: SourceSet, mode: str = "exact") -> DataFrame:
    """Value overlap of field pairs, over all values, sketches, or row samples."""
    return _overlaps(_inspected(spark, sources, mode).counts, mode)


def relationships(spark: SparkSession, sources: SourceSet, mode: str = "exact") -> DataFrame:
    """Every relationship that meets the confidence threshold."""
    return related(_inspected(spark, sources.for_mapping(), mode), mode)


def related(found: Inspection, mode: str = "exact") -> DataFrame:
    """Relationships of an inspection, whose parts may have been kept in files."""
    return score(candidate_pairs(describe(found.fields), _overlaps(found.counts, mode)))


def suggest(spark: SparkSession, sources: SourceSet, mode: str = "exact") -> DataFrame:
    """The ranked suggestions, at most one hundred."""
    return best(relationships(spark, sources, mode))
