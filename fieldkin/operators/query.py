"""Bounded queries in the two dialects of the sources, and their building blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.operators import paths

# Most rows any query hands back.
MAX_ROWS = 1000

#: Parts that the matches of a key are gathered in before they become one array.
PARTS = 64

# A final semicolon may be followed by white space and comments.
_END = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*(?:(?!\*/).)*\*/)*$", re.S)


def bounded_sql(
    spark: SparkSession, text: str, views: Mapping[str, DataFrame], limit: int = MAX_ROWS
) -> DataFrame:
    """One read query over the named tables, at most ``limit`` rows.

    The text is placed as a subquery, so Spark's own parser refuses commands,
    writes and further statements before anything runs. It is analysed at once;
    views of the caller with the same names are put back after that.
    """
    before = {name: _set_aside(spark, name) for name in views}
    try:
        for name, data in views.items():
            data.createOrReplaceTempView(name)
        return spark.sql(f"SELECT * FROM (\n{_unended(text)}\n) LIMIT {_positive(limit)}")
    finally:
        for name, own in before.items():
            spark.catalog.dropTempView(name)
            if own is not None:
                own.createOrReplaceTempView(name)


def _set_aside(spark: SparkSession, name: str) -> DataFrame | None:
    try:
        return spark.table(name) if spark.catalog.getTable(name).isTemporary else None
    except AnalysisException:
        return None


def _unended(text: str) -> str:
    """The text without a final semicolon, where only comments and space follow it."""
    for at in reversed([m.start() for m in re.finditer(";", text)]):
        if _END.match(text, at + 1):
            return text[:at]
    return text


def _positive(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("A limit must be a positive integer.")
    return limit


def _ordering(sort: Mapping[str, int]) -> list[Column]:
    if any(direction not in (1, -1) for direction in sort.values()):
        raise ValueError("A sort direction must be 1 or -1.")
    return [
        F.asc_nulls_first(c) if direction == 1 else F.desc_nulls_last(c)
        for c, direction in sort.items()
    ]


def find(
    data: DataFrame,
    where: Column | None = None,
    columns: Sequence[str | Column] | None = None,
    sort: Mapping[str, int] | Sequence[Column | tuple[Column, int]] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, sort, project and cut, at most :data:`MAX_ROWS` rows.

    Nulls sort lowest, as document stores sort them. Sorting happens before the
    projection, so a query may sort by a column it does not return. Members of
    documents sort by ``paths.sort_value``, in pairs with their direction: such values
    are worked out once per row, not once per comparison.
    """
    found = data if where is None else data.where(where)
    if sort and not isinstance(sort, Mapping) and all(isinstance(x, tuple) for x in sort):
        names = {f"_sort{n}": direction for n, (_, direction) in enumerate(sort)}
        found = found.withColumns({f"_sort{n}": value for n, (value, _) in enumerate(sort)})
        found = found.orderBy(*_ordering(names))
        found = found.select(*columns) if columns is not None else found.drop(*names)
        return found.limit(MAX_ROWS if limit is None else min(_positive(limit), MAX_ROWS))
    if sort:
        found = found.orderBy(*(_ordering(sort) if isinstance(sort, Mapping) else sort))
    if columns is not None:
        found = found.select(*columns)
    return found.limit(MAX_ROWS if limit is None else min(_positive(limit), MAX_ROWS))


def computed_once(data: DataFrame, column: str) -> DataFrame:
    """The same rows, with a computed column behind a generator.

    Spark moves a filter below a plain projection and then works the column out anew
    for every place where the filter names it. For documents parsed from text, whose
    filters read many members, that is most of the time.
    """
    others = [c for c in data.columns if c != column]
    return data.select(*others, F.explode(F.array(column)).alias(column))


def aggregate(data: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A chain of stages with a hard cap on the result."""
    return reduce(DataFrame.transform, stages, data).limit(MAX_ROWS)


def matches(data: DataFrame, column: str, value: object) -> Column:
    """Equality as documents mean it: an array matches by any of its elements.

    ``column`` may name a path within a VARIANT column (``document.tags.name``).
    None matches what is null or missing.
    """
    name, _, path = column.partition(".")
    if column not in data.columns and isinstance(data.schema[name].dataType, T.VariantType):
        return paths.compares(F.col(name), path, "eq", value)
    kind = data.schema[column].dataType
    if isinstance(kind, T.VariantType):
        return paths.compares(F.col(column), "", "eq", value)
    missing = F.col(column).isNull()
    if isinstance(kind, T.ArrayType):
        if value is None:
            return missing | F.exists(column, lambda x: x.isNull())
        return F.coalesce(F.array_contains(column, value), F.lit(False))
    return missing if value is None else F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def any_outside(column: str, allowed: Iterable[object]) -> Column:
    """Whether an array has an element, null or not, that is none of the allowed values."""
    listed = list(allowed)
    outside = F.exists(column, lambda x: ~F.coalesce(x.isin(listed), F.lit(False)))
    return F.coalesce(outside, F.lit(False))


def has_path(document: str, path: str) -> Column:
    """Whether a VARIANT document has the path at all, be its value null or not."""
    return F.try_variant_get(F.col(document), path, "variant").isNotNull()


def _unordered(kind: T.DataType) -> bool:
    """Whether Spark can neither hash nor order values of a type."""
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.VariantType, T.MapType))


def lookup(
    left: DataFrame,
    right: DataFrame,
    left_column: str,
    right_column: str,
    alias: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Left join that nests the matching rows of ``right``, sorted, in an array.

    One row per left row, whatever the number of matches; rows without a match get
    an empty array. Matches are gathered in parts by their content first, so that
    many tasks share the rows of a frequent key before they become its array. For
    matches that are too many for one row there is :func:`lookup_rows`.

    Rows with VARIANT or MAP members are dealt out and sorted by their JSON text.
    """
    nested = F.struct(*(columns or right.columns))
    keyed = right.where(F.col(right_column).isNotNull()).select(
        F.col(right_column).alias("_key"), nested.alias("_row")
    )
    kind = keyed.schema["_row"].dataType
    rank = F.to_json("_row") if _unordered(kind) else F.lit(None).cast("string")
    content = "_rank" if _unordered(kind) else "_row"
    part = F.pmod(F.xxhash64(content), F.lit(PARTS))
    entry = F.struct("_rank", "_row")
    parts = keyed.withColumn("_rank", rank).groupBy("_key", part.alias("_part")).agg(
        F.collect_list(entry).alias("_rows")
    )
    rows = F.flatten(F.collect_list("_rows"))
    if _unordered(kind):
        rows = F.array_sort(rows, lambda a, b: (
            F.when(a["_rank"] < b["_rank"], -1).when(a["_rank"] > b["_rank"], 1).otherwise(0)
        ))
    else:
        rows = F.array_sort(rows)
    gathered = parts.groupBy("_key").agg(F.transform(rows, lambda e: e["_row"]).alias(alias))
    none = F.array().cast(gathered.schema[alias].dataType)
    joined = left.join(gathered, left[left_column] == F.col("_key"), "left").drop("_key")
    return joined.withColumn(alias, F.coalesce(alias, none))


def lookup_rows(
    left: DataFrame,
    right: DataFrame,
    left_column: str,
    right_column: str,
    alias: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The same pairs as :func:`lookup`, one row per match; null where there is none."""
    keyed = right.select(
        F.col(right_column).alias("_key"), F.struct(*(columns or right.columns)).alias(alias)
    ).where("_key IS NOT NULL")
    return left.join(keyed, left[left_column] == F.col("_key"), "left").drop("_key")


def without_match(
    left: DataFrame, right: DataFrame, left_column: str, right_column: str
) -> DataFrame:
    """Rows that have a key but no match in ``right``."""
    keys = right.select(F.col(right_column).alias("_key")).distinct()
    present = left.where(F.col(left_column).isNotNull())
    return present.join(keys, F.col(left_column) == F.col("_key"), "left_anti")


def ordered_strings(
    data: DataFrame,
    keys: Sequence[str],
    value: str,
    order: str,
    separator: str,
    alias: str,
    distinct: bool = False,
) -> DataFrame:
    """The values of each group as one string, in the given order.

    ``distinct`` drops repeated (order, value) entries before they are gathered,
    with a map-side combine, so that a group is as large as its variety only.
    Otherwise entries are range partitioned by group, order and value, which splits
    large groups; values of equal order come in their own order. Each part is joined on its own and the parts are strung together.
    """
    order_column = F.col(order).alias("_order")
    entries = data.select(*keys, order_column, value)
    if distinct:
        return entries.distinct().groupBy(*keys).agg(_listed(value, separator, "_order", alias))
    parts = (
        entries.where(F.col(value).isNotNull())
        .repartitionByRange(*keys, "_order", value)
        .withColumn("_part", F.spark_partition_id())
        .groupBy(*keys, "_part")
        .agg(_listed(value, separator, "_order", "_text"))
    )
    strings = parts.groupBy(*keys).agg(_listed("_text", separator, "_part", alias))
    groups = entries.select(*keys).distinct()
    return groups.join(strings, list(keys), "left")


def _listed(value: str, separator: str, order: str, alias: str) -> Column:
    text = separator.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(
        f"listagg(`{value}`, '{text}') WITHIN GROUP (ORDER BY `{order}`, `{value}`)"
    ).alias(alias)


def _contains(column: Column, fragment: str) -> Column:
    escaped = fragment.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")


def tolerant_match(
    data: DataFrame, column: str, fragments: Mapping[str, str], rank: str = "match_rank"
) -> DataFrame:
    """Rows whose text contains a fragment, or at least its short fallback.

    ``fragments`` maps each wanted fragment to its fallback. Rank 0 marks a whole
    fragment, rank 1 a fallback only; case is ignored throughout.
    """
    text = F.col(column)
    whole = reduce(or_, (_contains(text, f) for f in fragments))
    loose = reduce(or_, (_contains(text, f) for f in fragments.values()))
    return data.where(whole | loose).withColumn(rank, F.when(whole, 0).otherwise(1))


def as_json(data: DataFrame, alias: str = "row") -> DataFrame:
    """Each row as JSON text, nulls included."""
    row = F.to_json(F.struct(*(f"`{c}`" for c in data.columns)), {"ignoreNullFields": "false"})
    return data.select(row.alias(alias))


def result_envelope(result: DataFrame, kind: str, limit: int = MAX_ROWS) -> DataFrame:
    """One row: the kind of the source, a bounded result as JSON rows, and their number.

    An empty result has no rows and the number 0. The array holds at most ``limit``
    rows, never an open-ended result; it keeps the order of a sorted result.
    """
    rows = as_json(result.limit(limit))
    return rows.agg(
        F.lit(kind).alias("kind"),
        F.collect_list("row").alias("rows"),
        F.count("*").alias("returned_count"),
    )
