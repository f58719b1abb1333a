"""Sketches decide what is shuffled, never what comes out."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldkin.operators import profile, sketches
from fieldkin.operators.catalog import profiled_fields
from fieldkin.operators.overlap import value_overlap
from fieldkin.operators.value_counts import value_counts, value_rows
from fieldkin.sources.model import RELATIONAL, Entity, Source, SourceSet


def tables(**data):
    return SourceSet([Source("s", RELATIONAL, tuple(
        Entity("public", name, frame) for name, frame in data.items()
    ))])


@pytest.fixture(scope="module")
def odd(spark):
    """Empty tables, columns of nulls, one hot value, and values that are equal in normal form."""
    hot = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("hot"),
        F.concat(F.lit("x"), F.repeat(F.lit(" "), F.col("id").cast("int"))).alias("padded"),
        F.lit(None).cast("string").alias("none"),
        (F.col("id") / 7).alias("real"),
        F.when(F.col("id") < 2, F.lit("")).otherwise(F.col("id").cast("string")).alias("rare"),
        F.col("id").cast("string").alias("key"),
        F.lit(float("nan")).alias("nan"),
    )
    return tables(hot=hot, empty=spark.createDataFrame([], "n int, t string, d double"))


def ranked(sketch):
    return sorted((r.field_id, r.rank, r.fingerprint) for r in sketch.collect())


@pytest.mark.parametrize("size", [1, 10, 100])
def test_bounded_fingerprints_are_those_of_all_values(sources, odd, size):
    for case in (sources, odd):
        want = ranked(profile.fingerprint_sketch(value_counts(case), size))
        assert ranked(sketches.fingerprints(case, size)) == want


def test_an_estimate_too_large_costs_a_count_and_no_row(odd, monkeypatch):
    many = odd.sources[0].entities[0].data.sparkSession.range(45).selectExpr(
        "id AS field_id", "1000000000000 AS estimate")
    monkeypatch.setattr(sketches, "distinct_estimates", lambda s: many.where("field_id < 7"))
    want = ranked(profile.fingerprint_sketch(value_counts(odd), 10))
    assert ranked(sketches.fingerprints(odd, 10)) == want


def test_what_is_grouped_does_not_grow_with_the_values(spark):
    for rows in (20_000, 200_000):
        case = tables(t=spark.range(rows).select(F.col("id").alias("n"), F.col("id").cast("string").alias("t")))
        estimates = {r.field_id: r.estimate for r in sketches.distinct_estimates(case).collect()}
        assert all(abs(n - rows) < rows / 5 for n in estimates.values())
        bounds = {i: sketches._bound(300 / n) for i, n in estimates.items()}
        below = sketches.below(value_rows(case), bounds)
        assert 400 < below.count() < 800
        plan = below._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        # Filters stand below the one exchange, in the stage of the scan.
        assert "Filter" not in plan[:plan.index("Exchange")] and "Filter" in plan


def test_theta_sketches_estimate_overlaps(spark, sources):
    fields = profiled_fields(spark, sources)
    exact = {(r.a, r.b): r.overlap for r in value_overlap(value_counts(sources)).collect()}
    estimated = sketches.theta_overlap(sketches.theta_sketches(sources), fields).collect()
    assert len(estimated) > 50
    for r in estimated:
        assert abs(exact.get((r.a, r.b), 0) - r.overlap) < 0.02


def test_an_estimate_of_large_fields_is_near(spark):
    case = tables(
        a=spark.range(0, 100_000).select("id"), b=spark.range(80_000, 180_000).select("id"))
    estimated = sketches.theta_overlap(
        sketches.theta_sketches(case), profiled_fields(spark, case)).collect()
    assert [(r.a, r.b) for r in estimated] == [(0, 1)]
    assert abs(estimated[0].overlap - 20_000 / 180_000) < 0.02


@pytest.mark.parametrize("least", [0.01, 0.1, 0.5, 1.0])
def test_screened_pairs_are_the_exact_ones_that_reach_the_least(spark, sources, odd, least):
    for case in (sources, odd):
        fields = profiled_fields(spark, case)
        family = {r.field_id: r.type_families for r in fields.collect()}
        want = {
            (r.a, r.b): (r.shared, r.overlap) for r in value_overlap(value_counts(case)).collect()
            if r.overlap >= least and family[r.a] == family[r.b]
        }
        got = sketches.screened_overlap(spark, case, fields, least).collect()
        assert {(r.a, r.b): (r.shared, r.overlap) for r in got} == want


def test_sketch_entries_are_equal_where_keys_are(spark):
    """Numbers of several types, at the limits of doubles, estimated as their keys are."""
    longs = [0, -5, 7, 10**15 - 1, 10**15, -10**15, 2**53 + 1, 2**60, 1152921504606846980, -2**63, 2**63 - 1, None]
    doubles = [-0.0, 0.1, 7.0, 1e15, 2.0**60, 1e22, 123456789.25, 1e-4, 1e-9, float("nan"), float("inf"), None]
    decimals = [Decimal(t) for t in ("0", "0.1", "7.000", "1000000000000000", "9007199254740993", "0.1000000000000000055",
                                     "123456789.25", "0.0001", "1152921504606846980", "-5")] + [None, None]
    texts = ["A", " a ", "", "x" * 70, "X" * 70, "y" * 1025, None, "b", "B\u00a0", "c", "d", "e"]
    moments = [datetime(2024, 1, 1, 0, 0, 7, 179000 + i % 3) for i in range(12)]
    case = tables(
        one=spark.createDataFrame(list(zip(longs, texts, moments)), "l bigint, t string, m timestamp_ntz"),
        two=spark.createDataFrame(list(zip(doubles, texts[::-1], [m.date() for m in moments])), "d double, u string, day date"),
        three=spark.createDataFrame([(x, i, i % 2 == 0) for i, x in enumerate(decimals)], "c decimal(38,19), i int, b boolean"),
    )
    fields = profiled_fields(spark, case)
    family = {r.field_id: r.type_families for r in fields.collect()}
    want = {(r.a, r.b): (r.shared, r.overlap) for r in value_overlap(value_counts(case)).collect()
            if family[r.a] == family[r.b]}
    got = sketches.theta_overlap(sketches.theta_sketches(case), fields).collect()
    assert {(r.a, r.b): (round(r.shared), r.overlap) for r in got} == want and len(want) > 5
    sizes = value_counts(case).where("comparable").groupBy("field_id").count()
    counted = sketches.theta_sketches(case).join(sizes, "field_id").select(
        F.theta_sketch_estimate("sketch").alias("sketched"), "count").collect()
    assert counted and all(r.sketched == r["count"] for r in counted)


def test_sketches_are_made_side_by_side_and_without_texts_of_numbers(spark):
    case = tables(t=spark.range(10).selectExpr("id", "id / 7 AS x", "cast(id AS string) AS t"))
    plan = sketches.theta_sketches(case)._jdf.queryExecution().executedPlan().toString()
    # Sketches become rows above the merge of the tasks; cells never do.
    assert plan.index("Expand") < plan.index("partial_theta_sketch_agg")
    assert plan.count("Expand") == 1 and "regexp" not in plan.lower()


def test_pairs_across_sources_spare_the_others(spark, sources):
    fields = profiled_fields(spark, sources)
    of = {r.field_id: r.source_ord for r in fields.collect()}
    every, across = (
        sketches.screened_overlap(spark, sources, fields, 0.1, across=x) for x in (False, True))
    want = {(r.a, r.b): r.overlap for r in every.collect() if of[r.a] != of[r.b]}
    assert want and {(r.a, r.b): r.overlap for r in across.collect()} == want
    assert "l_shipdate" in every._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in across._jdf.queryExecution().executedPlan().toString()


def test_columns_without_a_pair_are_not_read_again(spark, small, sources):
    fields = profiled_fields(spark, sources)
    plan = sketches.screened_overlap(spark, sources, fields, 0.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" in text and "p_name" not in text and "l_extendedprice" not in text


@pytest.mark.parametrize("witnesses", [1, 50, 65_536])
def test_uniqueness_is_that_of_all_values(spark, sources, odd, witnesses):
    for case in (sources, odd):
        fields = profiled_fields(spark, case)
        want = {r.field_id: r.measured_unique for r in profile.measured_uniqueness(case, fields).collect()}
        got = sketches.uniqueness(spark, case, fields, witnesses).collect()
        assert len(got) == len({r.field_id for r in got})
        assert {r.field_id: r.measured_unique for r in got} == {
            r.field_id: want.get(r.field_id, False) for r in got}
        assert set(want) <= {r.field_id for r in got}


def test_fields_with_a_witness_are_not_shuffled(spark, sources):
    fields = profiled_fields(spark, sources)
    plan = sketches.uniqueness(spark, sources, fields, 200)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "o_orderkey" in text
    for column in ("l_orderkey", "l_returnflag", "o_custkey", "o_orderstatus"):
        assert column not in text


def test_fields_that_cannot_be_keys_give_no_rows(spark):
    case = tables(t=spark.createDataFrame([(1.5,), (None,)], "d double"))
    assert sketches.uniqueness(spark, case, profiled_fields(spark, case)).count() == 0
