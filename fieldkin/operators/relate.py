"""Relationship discovery: candidates from shared names and values, then scores.

A key signal alone stays below the threshold, so every relationship worth
suggesting shares a name token or a value. Candidates therefore come from
equi-joins, never from a loop over all field pairs. Field rows are a catalog, so
these joins are small; the sizes are known and Spark picks the strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldkin.functions import scoring as S
from fieldkin.functions.names import jaccard, name_tokens
from fieldkin.functions.types import families_compatible

#: Columns that describe one side of a pair.
SIDE = (
    "source_ord", "source_id", "namespace", "entity", "path", "field_id",
    "type_families", "is_key", "tokens",
)
ENDPOINT = ("source_id", "namespace", "entity", "path")


def describe(fields: DataFrame) -> DataFrame:
    """What scoring needs to know about each field."""
    return fields.select(
        "source_ord", "source_id", "namespace", "entity", "path", "field_id",
        "type_families",
        (F.col("primary_key") | F.col("unique")).alias("is_key"),
        name_tokens(F.col("entity"), F.col("path")).alias("tokens"),
    )


def _side(described: DataFrame, side: str, *extra: str) -> DataFrame:
    return described.select(*(F.col(c).alias(f"{side}_{c}") for c in (*SIDE, *extra)))


def _first_shared(left: str, right: str) -> Column:
    return F.array_min(F.array_intersect(left, right))


def name_pairs(described: DataFrame) -> DataFrame:
    """Pairs of fields of different sources that share a name token.

    A pair meets once, on its first shared token, and needs no distinct.
    """
    tokened = described.withColumn("token", F.explode("tokens"))
    left, right = _side(tokened, "left", "token"), _side(tokened, "right", "token")
    return (
        left.join(right, F.col("left_token") == F.col("right_token"))
        .where(F.col("left_source_ord") < F.col("right_source_ord"))
        .where(F.col("left_token") == _first_shared("left_tokens", "right_tokens"))
        .drop("left_token", "right_token")
    )


def name_similarity(described: DataFrame) -> DataFrame:
    """Token similarity of each pair that shares a token."""
    return name_pairs(described).withColumn(
        "similarity", jaccard(F.col("left_tokens"), F.col("right_tokens"))
    )


def _name_candidates(described: DataFrame) -> DataFrame:
    """Pairs whose names may carry them over the threshold without shared values.

    With a key on either side any shared token may. Without one, names must be
    nearly equal: more than ``size - ceil(5/6 size)`` of the rarest tokens of
    both sides cannot be missing, so only these prefixes are joined, and a token
    that every field carries is hardly ever one of them.
    """
    tokened = described.withColumn("token", F.explode("tokens"))
    needed = (S.MIN_CONFIDENCE - S.TYPE_SCORE) / S.NAME_SCORE - 1e-9
    frequency = tokened.groupBy("token").agg(F.count("*").alias("seen"))
    rarest_first = F.array_sort(F.collect_list(F.struct("seen", "token")))
    prefixes = (
        tokened.where(~F.col("is_key"))
        .join(frequency, "token")
        .groupBy("field_id", "source_ord", "type_families", "tokens")
        .agg(rarest_first.alias("ranked"))
        .select(
            "field_id", "source_ord", "type_families", "tokens",
            F.explode(F.slice(
                "ranked", 1,
                F.size("ranked") - F.ceil(F.size("ranked") * F.lit(needed)).cast("int") + 1,
            )).alias("entry"),
        )
        .withColumn("token", F.col("entry.token"))
    )
    keyed = tokened.where("is_key")
    return _matches(keyed, tokened).unionAll(_matches(prefixes, prefixes))


def _matches(one: DataFrame, other: DataFrame) -> DataFrame:
    """Field pairs equal in ``token``, of different sources and one type family."""
    a, b = one.alias("x"), other.alias("y")
    return (
        a.join(b, F.col("x.token") == F.col("y.token"))
        .where(F.col("x.source_ord") != F.col("y.source_ord"))
        .where(families_compatible(F.col("x.type_families"), F.col("y.type_families")))
        .select(
            F.least("x.field_id", "y.field_id").alias("a"),
            F.greatest("x.field_id", "y.field_id").alias("b"),
        )
    )


def candidate_pairs(described: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Pairs sharing a telling name or a value, left side from the earlier source."""
    shared_values = overlaps.select("a", "b", "overlap")
    merged = (
        _name_candidates(described)
        .withColumn("overlap", F.lit(0.0))
        .unionAll(shared_values)
        .groupBy("a", "b")
        .agg(F.max("overlap").alias("overlap"))
    )
    return orient(merged, described)


def orient(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """Describe both sides of (a, b) pairs; pairs within one source fall away."""
    side = F.struct(*SIDE)
    a = described.select(F.col("field_id").alias("a"), side.alias("x"))
    b = described.select(F.col("field_id").alias("b"), side.alias("y"))
    x_first = F.col("x.source_ord") < F.col("y.source_ord")
    sides = {
        "left": F.when(x_first, F.col("x")).otherwise(F.col("y")),
        "right": F.when(x_first, F.col("y")).otherwise(F.col("x")),
    }
    return (
        pairs.join(a, "a").join(b, "b")
        .where(F.col("x.source_ord") != F.col("y.source_ord"))
        .withColumns(sides)
        .select(
            *(c for c in pairs.columns if c not in ("a", "b")),
            *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in sides for c in SIDE),
        )
    )


def compatible_pairs(candidates: DataFrame) -> DataFrame:
    """Whether the two sides of each candidate share a type family."""
    return candidates.withColumn(
        "compatible",
        families_compatible(F.col("left_type_families"), F.col("right_type_families")),
    )


def score(candidates: DataFrame) -> DataFrame:
    """Relationships whose confidence meets the threshold, with their evidence."""
    name = F.col("name_similarity")
    key, overlap = F.col("left_is_key") | F.col("right_is_key"), F.col("overlap")
    return (
        compatible_pairs(candidates)
        .where("compatible")
        .withColumn("name_similarity", jaccard(F.col("left_tokens"), F.col("right_tokens")))
        .withColumn("raw_confidence", S.raw_confidence(name, key, overlap))
        .where((name > 0) | key | (overlap > 0))
        .where(F.col("raw_confidence") >= S.MIN_CONFIDENCE)
        .select(
            *(F.col(f"{side}_{c}") for side in ("left", "right") for c in ENDPOINT),
            F.lit(S.OPERATOR).alias("operator"),
            S.cardinality(F.col("left_is_key"), F.col("right_is_key")).alias("cardinality"),
            F.lit(S.JOIN_TYPES[0]).alias("join_type"),
            S.rounded_confidence(F.col("raw_confidence")).alias("confidence"),
            S.evidence(name, key, overlap).alias("evidence"),
        )
    )


def endpoint_columns() -> list[str]:
    return [f"{side}_{c}" for side in ("left", "right") for c in ENDPOINT]


def best(relationships: DataFrame, limit: int = S.MAX_SUGGESTIONS) -> DataFrame:
    """The strongest relationships, ties in the order of their endpoints."""
    return relationships.orderBy(F.desc("confidence"), *endpoint_columns()).limit(limit)
