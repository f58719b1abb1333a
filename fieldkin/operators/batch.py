"""Several sources at once: labelled results, and packing rows into a budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldkin.operators.catalog import local_rows
from fieldkin.operators.query import MAX_ROWS
from fieldkin.session import keep

# Default budget of a packed request, and what is said of failed sources.
MAX_PACKED_ROWS = 100
MAX_PACKED_CHARS = 50_000
NO_SOURCE = "Unable to access any data source."


def _no_access(kind: str) -> str:
    return f"Unable to access the {kind} source."


#: Sources asked at a time. Their jobs share the executors as Spark schedules them.
CONCURRENT = 16
#: Rank filters of Spark reach below the shuffle for smaller limits than this.
EARLY_RANK_LIMIT = 1000
SLICES = 256

OUTCOME_SCHEMA = pa.schema([
    ("source_ord", pa.int32()), ("source_id", pa.string()), ("kind", pa.string()),
    ("stage", pa.string()), ("status", pa.string()), ("error", pa.string()),
    ("returned_count", pa.int64()),
])


@dataclass(frozen=True)
class SourceQuery:
    """A query of one source: how to open it, what to ask, how its rows are ordered."""

    source_id: str
    kind: str
    open: Callable[[], DataFrame]
    ask: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...]


@dataclass(frozen=True)
class Batch:
    """``rows`` of the sources that answered, ``outcomes`` of all of them."""

    rows: DataFrame
    outcomes: DataFrame


def _answer(query: SourceQuery, position: int) -> tuple[DataFrame | None, str, int | None]:
    """The written result, the stage reached and the number of rows; no result when a stage failed.

    Only failures of Spark or of a driver below it are kept per source; a mistake in
    the caller's own code is raised.
    """
    stage = "catalog"
    try:
        data = query.open()
        data.schema
        stage = "execute"
        result = keep(_labelled(position, query, query.ask(data)), "answer")
        return result, stage, result.count()
    except (PySparkException, Py4JJavaError):
        return None, stage, None


def _answers(
    spark: SparkSession, queries: Sequence[SourceQuery]
) -> list[tuple[DataFrame | None, str, int | None]]:
    """Answers in request order, asked for concurrently, each under a job tag of its own.

    A mistake in the caller's code is raised once the sources already asked are done;
    those still waiting are not asked any more.
    """
    def ask(query: SourceQuery, position: int) -> tuple[DataFrame | None, str, int | None]:
        tag = f"source-{position}"
        spark.addTag(tag)
        try:
            return _answer(query, position)
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(max_workers=max(1, min(CONCURRENT, len(queries)))) as pool:
        # Wrapped one by one, so that each job has a copy of the caller's local properties.
        asked = [pool.submit(inheritable_thread_target(spark)(ask), query, i) for i, query in enumerate(queries)]
        try:
            return [answer.result() for answer in asked]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def multi_source_batch(spark: SparkSession, queries: Sequence[SourceQuery]) -> Batch:
    """Ask every source at once, keep the answers of those that can be read.

    Each source is a job of its own, whose result, at most :data:`MAX_ROWS` rows in
    its own order, is written to the shared folder; up to :data:`CONCURRENT` run side
    by side, so a slow source delays none of the others. A source that can't be
    opened, analysed or read to its end fails alone; which error it was stays hidden.
    Outcomes count the rows of the sources that answered, and keep request order.
    """
    outcomes, parts = [], []
    for i, (query, (result, stage, count)) in enumerate(zip(queries, _answers(spark, queries), strict=True)):
        failed = result is None
        outcomes.append((
            i, query.source_id, query.kind, stage,
            "failed" if failed else "succeeded",
            _no_access(query.kind) if failed else None,
            count,
        ))
        if not failed:
            parts.append(result)
    if not parts:
        raise RuntimeError(NO_SOURCE)
    return Batch(reduce(DataFrame.unionAll, parts), local_rows(spark, outcomes, OUTCOME_SCHEMA))


def _labelled(position: int, query: SourceQuery, result: DataFrame) -> DataFrame:
    bounded = result.orderBy(*query.order).limit(MAX_ROWS)
    one_source = W.partitionBy(F.lit(position))
    return bounded.select(
        F.lit(position).alias("source_ord"),
        F.lit(query.source_id).alias("source_id"),
        F.row_number().over(one_source.orderBy(*query.order)).alias("row_no"),
        F.count("*").over(one_source).alias("returned_count"),
        F.to_json(
            F.struct(*(f"`{c}`" for c in result.columns)), {"ignoreNullFields": "false"}
        ).alias("row"),
    )


def _first_rows(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], count: int
) -> DataFrame:
    """The first ``count`` rows of each group, numbered ``rn``.

    Spark also applies a rank filter before the shuffle, so that a group sends few
    rows per task, but only up to a limit. Beyond it, slices of each group are cut
    first, so that no group has to be ranked by one task as a whole.
    """
    def cut(data: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
        spec = W.partitionBy(*keys).orderBy(*order)
        return data.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= count)

    if count >= EARLY_RANK_LIMIT:
        content = F.xxhash64(*group, *order)
        sliced = rows.withColumn("_slice", F.pmod(content, F.lit(SLICES)))
        rows = cut(sliced, [*group, "_slice"], "_rank").drop("_slice", "_rank")
    return cut(rows, group, "rn")


def pack_rows(
    data: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    max_rows: int = MAX_PACKED_ROWS,
    max_chars: int = MAX_PACKED_CHARS,
) -> DataFrame:
    """The leading rows of each group that fit a row and a character budget.

    Rows count with the length of their JSON text. Packing stops at the first row
    that does not fit; lengths cannot be negative, so that is where the running
    sum leaves the budget. ``truncated`` tells that a group had more to give.
    """
    kept = list(dict.fromkeys((*group, *order, *columns)))
    leading = _first_rows(data.select(*kept), group, order, max_rows + 1)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    running = W.partitionBy(*group).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    fits = (F.col("rn") <= max_rows) & (F.col("used_chars") <= max_chars)
    return (
        leading.withColumn("row", text)
        .withColumn("used_chars", F.sum(F.length("row").cast("bigint")).over(running))
        .withColumn("fits", fits)
        .withColumn("truncated", F.bool_or(~F.col("fits")).over(W.partitionBy(*group)))
        .select(*group, "rn", "row", "used_chars", "fits", "truncated")
    )


def pack_summary(packed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows and characters kept of each group, and whether it was truncated."""
    fits = F.col("fits")
    return packed.groupBy(*group).agg(
        F.count_if(fits).alias("kept_rows"),
        F.coalesce(F.max(F.when(fits, F.col("used_chars"))), F.lit(0)).alias("kept_chars"),
        F.bool_or("truncated").alias("truncated"),
    )


def pack_shared(
    rows: DataFrame,
    group: str = "source_ord",
    order: Sequence[str] = ("row_no",),
    row: str = "row",
    max_rows: int = MAX_PACKED_ROWS,
    max_chars: int = MAX_PACKED_CHARS,
) -> DataFrame:
    """Pack ordered groups into one character budget: what one keeps, the next lacks.

    Groups are the few sources of a request. Each contributes at most
    ``max_rows`` lengths, which is all the fold over the groups has to hold.
    Returns one row per group; full results stay with the caller.
    """
    leading = _first_rows(rows.select(group, *order, row), [group], order, max_rows + 1)
    running = W.partitionBy(group).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    sums = leading.withColumn(
        "used", F.sum(F.length(row).cast("bigint")).over(running)
    ).groupBy(group).agg(
        F.array_sort(F.collect_list(F.when(F.col("rn") <= max_rows, F.col("used")))).alias("sums"),
        (F.max("rn") > max_rows).alias("more_rows"),
    )
    kept_type = f"array<struct<g: {rows.schema[group].dataType.simpleString()}, n: int, chars: bigint>>"
    groups = F.array_sort(F.collect_list(F.struct(
        F.col(group).alias("g"), "sums", "more_rows"
    )))

    def spend(state, entry):
        fitting = F.filter(entry["sums"], lambda s: s <= state["left"])
        chars = F.coalesce(F.array_max(fitting), F.lit(0).cast("bigint"))
        packed = F.struct(entry["g"].alias("g"), F.size(fitting).alias("n"), chars.alias("chars"))
        return F.struct(
            (state["left"] - chars).alias("left"),
            F.array_append(state["out"], packed).alias("out"),
        )

    start = F.struct(
        F.lit(max_chars).cast("bigint").alias("left"), F.array().cast(kept_type).alias("out")
    )
    folded = sums.agg(F.aggregate(groups, start, spend, lambda s: s["out"]).alias("out"))
    kept = folded.select(F.inline("out").alias(group, "kept_rows", "kept_chars"))
    return sums.join(kept, group).select(
        group, "kept_rows", "kept_chars",
        (F.col("more_rows") | (F.col("kept_rows") < F.size("sums"))).alias("truncated"),
    )
