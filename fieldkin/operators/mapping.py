"""Reviewed relationships: validation, observed cardinality, execution."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.functions import scoring as S
from fieldkin.functions.types import families_compatible
from fieldkin.functions.values import WHITE_SPACE, normal_form
from fieldkin.operators.catalog import local_rows
from fieldkin.operators.relate import ENDPOINT, endpoint_columns
from fieldkin.sources.model import SourceSet

# Limits of a mapping request, and what each failure is called.
MAX_MAPPINGS = 100
MAX_NAME_LENGTH = 256
MAX_PATH_LENGTH = 512
VALID = "valid"
BAD_DEFINITION = "Invalid relationship definition."
NO_ENDPOINT = "Relationship endpoint does not exist."
BAD_TYPES = "Relationship fields have incompatible types."
DUPLICATE = "Duplicate relationship."


@dataclass(frozen=True)
class Endpoint:
    source_id: str
    namespace: str
    entity: str
    path: str


@dataclass(frozen=True)
class Relationship:
    left: Endpoint
    right: Endpoint
    cardinality: str
    join_type: str = "inner"
    operator: str = S.OPERATOR


def mapping_rows(spark: SparkSession, relationships: list[Relationship]) -> DataFrame:
    """A mapping request as rows, numbered by position."""
    if len(relationships) > MAX_MAPPINGS:
        raise ValueError(f"At most {MAX_MAPPINGS} relationships are allowed.")
    rows = [
        (pos, *asdict(r.left).values(), *asdict(r.right).values(),
         r.operator, r.cardinality, r.join_type)
        for pos, r in enumerate(relationships, start=1)
    ]
    texts = [*endpoint_columns(), "operator", "cardinality", "join_type"]
    schema = pa.schema([("pos", pa.int64()), *((c, pa.string()) for c in texts)])
    return local_rows(spark, rows, schema)


def _well_defined() -> Column:
    limits = {"path": MAX_PATH_LENGTH}
    checks = F.col("operator") == S.OPERATOR
    checks &= F.col("cardinality").isin(*S.CARDINALITIES)
    checks &= F.col("join_type").isin(*S.JOIN_TYPES)
    checks &= F.col("left_source_id") != F.col("right_source_id")
    for side in ("left", "right"):
        for part in ENDPOINT:
            checks &= F.length(f"{side}_{part}").between(1, limits.get(part, MAX_NAME_LENGTH))
    return F.coalesce(checks, F.lit(False))


def edge() -> Column:
    """The two endpoints of a relationship regardless of direction."""
    left = F.struct(*(F.col(f"left_{c}").alias(c) for c in ENDPOINT))
    right = F.struct(*(F.col(f"right_{c}").alias(c) for c in ENDPOINT))
    return F.struct(F.least(left, right).alias("one"), F.greatest(left, right).alias("other"))


def mark_duplicates(mappings: DataFrame) -> DataFrame:
    """Adds ``duplicate``: an earlier position connects the same two endpoints.

    The first position of each edge is found by aggregation, so many copies of
    one edge never meet in one task.
    """
    keyed = mappings.withColumn("edge", edge())
    first = keyed.groupBy("edge").agg(F.min("pos").alias("first_pos"))
    return (
        keyed.join(first, "edge")
        .withColumn("duplicate", F.col("pos") > F.col("first_pos"))
        .drop("edge", "first_pos")
    )


def validate(mappings: DataFrame, fields: DataFrame) -> DataFrame:
    """Status of each mapping: ``valid`` or its first failure, in checking order.

    ``fields`` are profiled fields (relational, document, or both).
    """
    trimmed = mappings.withColumns({
        c: F.btrim(c, F.lit(WHITE_SPACE)) for c in endpoint_columns()
    })
    known = fields.select(*ENDPOINT, "type_families")
    for side in ("left", "right"):
        renamed = known.toDF(*(f"{side}_{c}" for c in (*ENDPOINT, "families")))
        trimmed = trimmed.join(renamed, [f"{side}_{c}" for c in ENDPOINT], "left")
    compatible = families_compatible(F.col("left_families"), F.col("right_families"))
    checked = trimmed.withColumn(
        "failure",
        F.when(~_well_defined(), F.lit(BAD_DEFINITION))
        .when(
            F.col("left_families").isNull() | F.col("right_families").isNull(),
            F.lit(NO_ENDPOINT),
        )
        .when(~compatible, F.lit(BAD_TYPES)),
    )
    sound = mark_duplicates(checked.where("failure IS NULL"))
    columns = ["pos", *endpoint_columns(), "operator", "cardinality", "join_type"]
    return (
        checked.where("failure IS NOT NULL")
        .select(*columns, F.col("failure").alias("status"))
        .unionAll(sound.select(
            *columns,
            F.when(F.col("duplicate"), F.lit(DUPLICATE)).otherwise(F.lit(VALID)).alias("status"),
        ))
    )


def _data(sources: SourceSet, end: Endpoint) -> DataFrame:
    return sources[end.source_id].entity(end.entity, end.namespace).data


def _join_key(data: DataFrame, column: str, by_form: bool) -> Column:
    return normal_form(data[column], data.schema[column].dataType) if by_form else data[column]


def join_on(
    left: DataFrame,
    right: DataFrame,
    left_column: str,
    right_column: str,
    join_type: str = "inner",
    cardinality: str = "many-to-one",
    by_form: bool = False,
) -> DataFrame:
    """Join two entities on a mapped pair of fields; columns become ``left_…``, ``right_…``.

    Spark picks the strategy and splits skewed partitions: of either side in an
    inner join, of the left side in a left join. When the right side may repeat
    a key, a left join is therefore written as an inner join plus the unmatched
    rows, found against the distinct right keys, so that a right key holding a
    third of all rows can be split as well.
    """
    l = left.select(
        *(F.col(f"`{c}`").alias(f"left_{c}") for c in left.columns),
        _join_key(left, left_column, by_form).alias("_left_key"),
    )
    r = right.select(
        *(F.col(f"`{c}`").alias(f"right_{c}") for c in right.columns),
        _join_key(right, right_column, by_form).alias("_right_key"),
    )
    on = F.col("_left_key") == F.col("_right_key")
    if join_type not in S.JOIN_TYPES:
        raise ValueError(f"Unknown join type: {join_type!r}.")
    if join_type == "left" and cardinality in ("one-to-many", "many-to-many"):
        absent = l.join(r.select("_right_key").distinct(), on, "left_anti")
        joined = l.join(r, on).unionByName(absent, allowMissingColumns=True)
    else:
        joined = l.join(r, on, join_type)
    return joined.drop("_left_key", "_right_key")


def join_sources(
    sources: SourceSet, relationship: Relationship, by_form: bool = False
) -> DataFrame:
    """Execute a validated relationship across two sources.

    ``by_form`` compares normal forms, as discovery does, instead of raw values.
    """
    return join_on(
        _data(sources, relationship.left), _data(sources, relationship.right),
        relationship.left.path, relationship.right.path,
        relationship.join_type, relationship.cardinality, by_form,
    )


def observed_cardinality(
    left: DataFrame, right: DataFrame, left_column: str, right_column: str,
    claimed: str | None = None,
) -> DataFrame:
    """One row: matches, orphans and the class the data itself supports.

    Both sides are counted per key before they meet, so the join sees distinct
    keys only.
    """
    one = left.groupBy(left[left_column].alias("k")).agg(F.count("*").alias("left_n"))
    other = right.groupBy(right[right_column].alias("k")).agg(F.count("*").alias("right_n"))
    met = one.join(other, one["k"] == other["k"], "full").select(
        F.coalesce(one["k"], other["k"]).alias("k"),
        F.coalesce("left_n", F.lit(0)).alias("left_n"),
        F.coalesce("right_n", F.lit(0)).alias("right_n"),
    )
    matched = (F.col("left_n") > 0) & (F.col("right_n") > 0)
    most = [F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col(c))), F.lit(0))
            for c in ("left_n", "right_n")]
    measured = met.agg(
        F.coalesce(F.sum("left_n"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("right_n"), F.lit(0)).alias("right_rows"),
        F.count_if(matched).alias("matched_keys"),
        F.coalesce(F.sum(F.when(~matched, F.col("left_n"))), F.lit(0)).alias("left_orphans"),
        F.coalesce(F.sum(F.when(~matched, F.col("right_n"))), F.lit(0)).alias("right_orphans"),
        most[0].alias("max_left_per_key"),
        most[1].alias("max_right_per_key"),
    )
    observed = S.cardinality(F.col("max_left_per_key") <= 1, F.col("max_right_per_key") <= 1)
    return measured.withColumn("observed", observed).withColumn(
        "as_claimed", F.lit(claimed).cast("string") == F.col("observed")
    )
