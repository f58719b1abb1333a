"""What sketches spare: values that need not be grouped, and columns that need not be read.

An exact count of the distinct values of a field shuffles all of them. Each operator
here first asks a small question of the scan, whose answer has one row per field, and
lets it decide what is shuffled afterwards:

- :func:`fingerprints` keeps values below a threshold that follows from a HyperLogLog
  estimate, so what it groups doesn't grow with the number of distinct values,
- :func:`screened_overlap` rules out pairs of fields by theta sketches,
- :func:`uniqueness` looks for one repeated value per field in a sample by hash, and
  counts in full only the fields that show none.

The answers are read by the driver: a number or two per column of the sources, never
anything that grows with their rows.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.functions.values import NO_FINGERPRINT, decimal_form, key_fingerprint, with_text_key
from fieldkin.operators.catalog import FieldRef, local_rows, profiled_columns
from fieldkin.operators.overlap import value_overlap
from fieldkin.operators.profile import MAX_FINGERPRINTS, comparable, fingerprint_sketch
from fieldkin.operators.value_counts import typed_columns, value_counts, value_rows
from fieldkin.session import keep
from fieldkin.sources.model import SourceSet

#: Standard error of an estimated number of distinct values.
ERROR = 0.05

#: Entries of a theta sketch: 2^12, which estimate a union to 1.6 %.
LOG_ENTRIES = 12

#: Numbers below this are told apart by their double; larger ones have a text of their own.
EXACT = 10**15

#: Groups in which the sketches of tasks are merged before those of a field are.
MERGES = 64

#: Expected values of a field below its threshold, for each one wanted. With 100 wanted,
#: 300 are expected, and fewer than 100 are out of reach of an estimate that is 5 % off.
MARGIN = 3

#: Values a field's search for a repeat is expected to look at.
WITNESSES = 65_536

#: Share of the least overlap at which a sketch still lets a pair through.
SLACK = 0.5


def _one(sources: SourceSet, aggregate, only: Collection[int] | None = None) -> DataFrame:
    """``(field, value)``: one aggregate per column, each table read once.

    Columns are aggregated side by side, so a task sends one row whatever it has read.
    """
    parts = []
    for entity, columns in typed_columns(sources, only):
        if columns:
            taken = {str(f.field_id): aggregate(c) for f, c in columns}
            row = entity.data.agg(*(c.alias(name) for name, c in taken.items()))
            parts.append(row.unpivot([], list(taken), "field", "value"))
    return reduce(DataFrame.unionAll, parts)


def distinct_estimates(sources: SourceSet) -> DataFrame:
    """``(field_id, estimate)``: about how many different values each field holds."""
    return _one(sources, lambda column: F.approx_count_distinct(column, ERROR)).select(
        F.col("field").cast("bigint").alias("field_id"), F.col("value").alias("estimate")
    )


def _bound(share: float) -> str:
    """Hex digits below which this share of all fingerprints lies."""
    return f"{int(share * 2.0 ** 64):016x}"


def below(rows: DataFrame, bounds: dict[int, str]) -> DataFrame:
    """``(field_id, fingerprint)`` of the different values under their field's bound.

    The filter is part of the scan's stage, and values combine before the shuffle.
    """
    # By position, since a search in a map or a chain of conditions would be made per cell.
    listed = F.array(*(F.lit(bounds.get(i, "")) for i in range(max(bounds) + 1)))
    # A generator's output is made once; a filter would make form and digest again.
    digest = F.explode(F.array(F.when(comparable(), key_fingerprint(F.col("key")))))
    return (
        rows.select("field_id", digest.alias("fingerprint"))
        .where(F.col("fingerprint") < F.get(listed, F.col("field_id").cast("int")))
        .distinct()
    )


def fingerprints(sources: SourceSet, size: int = MAX_FINGERPRINTS) -> DataFrame:
    """The ``size`` smallest fingerprints of each field: the rows of
    :func:`fieldkin.operators.profile.fingerprint_sketch`, found without grouping all values.

    Fields with few values are counted, so that each is hashed once. Of others only
    values under a bound are grouped. A field with fewer of them than wanted (its values
    are the same in normal form, say) is counted in full afterwards, so rows are exact
    whatever the estimates were. The result is written to the shared folder.
    """
    estimates = {r.field_id: r.estimate for r in distinct_estimates(sources).collect()}
    wanted = MARGIN * size
    many = {i: _bound(wanted / n) for i, n in estimates.items() if n > 2 * wanted}
    few = set(estimates) - set(many)
    parts = [fingerprint_sketch(value_counts(sources, few), size)] if few else []
    if many:
        rank = F.row_number().over(W.partitionBy("field_id").orderBy("fingerprint"))
        ranked = below(value_rows(sources, set(many)), many).withColumn("rank", rank)
        parts.append(ranked.where(F.col("rank") <= size))
    found = keep(reduce(DataFrame.unionByName, parts), "fingerprints")
    full = found.where(F.col("rank") == size).select("field_id").collect()
    short = set(many) - {r.field_id for r in full}
    if not short:
        return found
    counted = fingerprint_sketch(value_counts(sources, short), size)
    return found.where(~F.col("field_id").isin(list(short))).unionByName(counted)


def _double_entry(value: Column) -> Column:
    """Whole numbers as they are, hashes of others; infinities and NaN have none."""
    size = F.abs(value)
    whole = (size < EXACT) & (value == F.rint(value))
    return F.when(whole, value.try_cast("bigint")).when(size < float("inf"), F.xxhash64(value))


def _entry(field: FieldRef, value: Column) -> Column:
    """What a sketch takes in for a counted value: equal in two fields of a family where
    their keys are, and different (barring a collision of hashes) where those are not.

    Large and exact numbers stand for the double of the same key, if there is one. The
    expressions are short on purpose: those of all columns have to fit one compiled method.
    """
    kind, double = field.data_type, value.try_cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double_entry(value)
    if isinstance(kind, T.LongType):
        same = double.cast("string").try_cast("decimal(38,0)") == value
        large = F.when(same, F.xxhash64(double)).when(value.isNotNull(), F.xxhash64(value.cast("string")))
        return F.when(value.between(1 - EXACT, EXACT - 1), value).otherwise(large)
    if isinstance(kind, T.DecimalType):
        number = F.col(f"`{field.column}`")
        same = (F.abs(double) < 1e21) & (double.cast("string").try_cast(kind) == number)
        return F.when(same, _double_entry(double)).when(value.isNotNull(), F.xxhash64(decimal_form(value)))
    return value


def theta_sketches(sources: SourceSet) -> DataFrame:
    """``(field_id, sketch)``: a theta sketch of the keys of each field.

    Columns are sketched side by side, in their own type. Tasks merge their sketches in
    a bounded number of groups, and then by field, so no task takes in those of all.
    """
    parts = []
    for entity, columns in typed_columns(sources):
        if not columns:
            continue
        names = [str(f.field_id) for f, _ in columns]
        row = entity.data.select(*(_entry(f, c).alias(name) for name, (f, c) in zip(names, columns)))
        texts = [name for name, (f, _) in zip(names, columns) if isinstance(f.data_type, T.StringType)]
        for name in texts:
            row = with_text_key(row, name)
        taken = {
            name: F.when(F.col(name) != NO_FINGERPRINT, F.col(name)) if name in texts else F.col(name)
            for name in names
        }
        merged = row.withColumn("part", F.spark_partition_id() % MERGES).groupBy("part").agg(
            *(F.theta_sketch_agg(c, F.lit(LOG_ENTRIES)).alias(name) for name, c in taken.items()))
        parts.append(merged.drop("part").unpivot([], names, "field", "sketch"))
    return reduce(DataFrame.unionAll, parts).groupBy(F.col("field").cast("bigint").alias("field_id")).agg(
        F.theta_union_agg("sketch", F.lit(LOG_ENTRIES)).alias("sketch")
    )


def theta_overlap(sketches: DataFrame, fields: DataFrame, across: bool = False) -> DataFrame:
    """``(a, b, shared, overlap)``, estimated, of the fields of one type family, ``a < b``.

    Pairs are of fields, so their number depends on the sources' schemas alone. With
    ``across`` only fields of different sources are paired.
    """
    family = F.explode("type_families").alias("family")
    sides = fields.select("field_id", "source_ord", family).join(sketches, "field_id")
    a, b = (
        sides.select("family", F.col("field_id").alias(x), F.col("sketch").alias(f"of_{x}"),
                     F.col("source_ord").alias(f"source_{x}"))
        for x in "ab"
    )
    shared = F.theta_sketch_estimate(F.theta_intersection("of_a", "of_b"))
    either = F.theta_sketch_estimate(F.theta_union("of_a", "of_b"))
    return (
        a.join(b, "family").where("a < b AND source_a <> source_b" if across else "a < b")
        .select("a", "b", shared.alias("shared"), either.alias("either"))
        .where("shared > 0")
        .select("a", "b", "shared", (F.col("shared") / F.col("either")).alias("overlap"))
    )


def screened_overlap(
    spark: SparkSession, sources: SourceSet, fields: DataFrame, least: float, across: bool = False
) -> DataFrame:
    """Exact overlap of the pairs of one type family that reach ``least``.

    With ``across`` only of pairs of different sources: fields that meet none but those of
    their own source are not grouped then.

    Theta sketches of all fields come first. Pairs estimated at less than half of ``least``
    are ruled out, and only columns with a pair left are read again and grouped by value.
    An estimate of a tenth or more is off by about 5 %, so a pair that reaches ``least`` is
    ruled out at ten standard errors; where that is not enough, there is ``value_overlap``.
    """
    estimated = theta_overlap(keep(theta_sketches(sources), "theta"), fields, across)
    pairs = estimated.where(F.col("overlap") >= SLACK * least).select("a", "b").distinct().collect()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not pairs:
        return value_overlap(value_counts(sources)).where(F.lit(False))
    left = {i for pair in pairs for i in pair}
    exact = value_overlap(value_counts(sources, left))
    return exact.join(local_rows(spark, pairs, schema), ["a", "b"]).where(F.col("overlap") >= least)


def _digests(sources: SourceSet, only: Collection[int] | None = None, shares: dict | None = None) -> DataFrame:
    """``(field, value)``: digests of the values that a key may consist of.

    With ``shares`` only of a sample: the values whose hash lies in the share of their
    field, and the rows whose hash does.
    """
    parts = []
    for entity, refs in profiled_columns(sources):
        texts = {
            ref.field_id: F.col(f"`{ref.column}`").cast("string") for ref in refs
            if isinstance(ref.data_type, (T.IntegralType, T.StringType))
            and (only is None or ref.field_id in only)
        }
        if not texts:
            continue
        columns, row = [], F.xxhash64(*texts.values())
        for field_id, text in texts.items():
            digest = F.unhex(F.md5(text))
            if shares is not None and shares[field_id] < 1:
                bound = F.lit(int(shares[field_id] * 2.0 ** 63))
                within = [F.shiftrightunsigned(h, 1) < bound for h in (F.xxhash64(text), row)]
                digest = F.when(within[0] | within[1], digest)
            columns.append(digest.alias(str(field_id)))
        data = entity.data.select(*columns)
        parts.append(data.unpivot([], data.columns, "field", "value"))
    return reduce(DataFrame.unionAll, parts).where(F.col("value").isNotNull())


def _repeats(digests: DataFrame) -> DataFrame:
    """``(field_id, repeats)`` of the fields that have values."""
    return (
        digests.groupBy("field", "value").agg(F.count("*").alias("n"))
        .groupBy(F.col("field").cast("bigint").alias("field_id"))
        .agg((F.max("n") > 1).alias("repeats"))
    )


def sampled_shares(sources: SourceSet, witnesses: int = WITNESSES) -> dict[int, float]:
    """Per field that may be a key, the share of its values in which a repeat is looked for."""
    refs = profiled_columns(sources)
    counts = [
        entity.data.agg(F.count("*").alias("rows")).select(F.lit(i).alias("table"), "rows")
        for i, (entity, _) in enumerate(refs)
    ]
    rows = {r.table: r.rows for r in reduce(DataFrame.unionAll, counts).collect()}
    return {
        f.field_id: min(1.0, witnesses / max(rows[i], 1))
        for i, (_, fields) in enumerate(refs) for f in fields
        if isinstance(f.data_type, (T.IntegralType, T.StringType))
    }


def uniqueness(
    spark: SparkSession, sources: SourceSet, fields: DataFrame, witnesses: int = WITNESSES
) -> DataFrame:
    """Fields with ``measured_unique``, as ``profile.measured_uniqueness`` finds it.

    A value that occurs twice proves that its field is not unique. It is looked for in a
    sample by hash of values, which come with all of their occurrences, and of rows, in
    which the values of a small domain repeat. Fields with such a witness are done; only
    the others are read again and grouped in full. Fields of tables with ``witnesses`` rows
    or fewer are done at once. Fields without values are not unique.
    """
    shares = sampled_shares(sources, witnesses)
    found = _repeats(_digests(sources, shares=shares)).collect() if shares else []
    seen = {r.field_id: r.repeats for r in found}
    whole = {i for i, share in shares.items() if share == 1}
    decided = {i: not repeats for i, repeats in seen.items() if repeats or i in whole}
    open_fields = set(shares) - set(decided) - whole
    schema = pa.schema([("field_id", pa.int64()), ("measured_unique", pa.bool_())])
    listed = [(i, decided.get(i, False)) for i in shares if i not in open_fields]
    answers = local_rows(spark, listed, schema)
    if open_fields:
        counted = _repeats(_digests(sources, open_fields))
        every = local_rows(spark, [(i,) for i in sorted(open_fields)], pa.schema([("field_id", pa.int64())]))
        unique = F.coalesce(~F.col("repeats"), F.lit(False)).alias("measured_unique")
        answers = answers.unionAll(every.join(counted, "field_id", "left").select("field_id", unique))
    return fields.join(answers, "field_id").withColumn(
        "declared_unique", F.col("primary_key") | F.col("unique")
    )
