"""Data expectations: counts, domains, uniqueness and references.

Each check aggregates before anything is compared and returns counts of what
breaks the rule, so clean data of any size yields a handful of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expect_row_counts(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Counted rows of each entity against what was expected of it.

    ``counts`` has ``entity`` and ``row_count``; entities without an expectation
    are reported without a verdict.
    """
    wanted = F.lit(None).cast("bigint")
    for name, count in expected.items():
        wanted = F.when(F.col("entity") == name, F.lit(count).cast("bigint")).otherwise(wanted)
    return counts.withColumn("expected", wanted).withColumn(
        "as_expected", F.col("row_count") == F.col("expected")
    )


def expect_domains(data: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass. Nulls break no rule."""
    broken = data.agg(*(F.count_if(~rule).alias(name) for name, rule in rules.items()))
    return broken.unpivot([], list(rules), "rule", "violations")


def expect_unique(
    data: DataFrame, columns: Sequence[str], nulls_repeat: bool = True
) -> DataFrame:
    """One row: keys that repeat, and the rows beyond the first of each.

    Keys with a null may repeat, as in SQL, unless ``nulls_repeat`` is false.
    """
    if nulls_repeat:
        data = data.dropna(subset=list(columns))
    repeated = data.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return repeated.agg(
        F.count("*").alias("repeated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
    )


def expect_references(
    child: DataFrame, child_column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """One row: distinct dangling keys, and the rows that carry them.

    The child is counted per key first; only distinct keys are compared.
    """
    keys = child.where(F.col(child_column).isNotNull()).groupBy(child_column).agg(
        F.count("*").alias("n")
    )
    parents = parent.select(F.col(parent_column).alias("_key"))
    return keys.join(parents, F.col(child_column) == F.col("_key"), "left_anti").agg(
        F.count("*").alias("orphan_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
    )
