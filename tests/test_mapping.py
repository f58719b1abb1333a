"""Validation, execution and observed cardinality of mappings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldkin.operators import mapping as M
from fieldkin.operators.catalog import profiled_fields
from fieldkin.sources.model import RELATIONAL, Entity, Source, SourceSet


def end(source_id, field="id", entity="t", namespace="public"):
    return M.Endpoint(source_id, namespace, entity, field)


@pytest.fixture(scope="module")
def pair(spark):
    def made(source_id):
        data = spark.createDataFrame([], "id int, created_at timestamp, name string, note binary")
        return Source(source_id, RELATIONAL, (Entity("public", "t", data),))

    return SourceSet([made("a"), made("b")])


def statuses(spark, pair, *relationships):
    rows = M.validate(M.mapping_rows(spark, list(relationships)), profiled_fields(spark, pair))
    return [r.status for r in rows.orderBy("pos").collect()]


def test_statuses_in_checking_order(spark, pair):
    good = M.Relationship(end("a"), end("b"), "one-to-many")
    assert statuses(
        spark, pair,
        M.Relationship(end(" a "), end("b\t"), "one-to-many", "left"),
        M.Relationship(end("a"), end("b", "missing"), "one-to-many"),
        M.Relationship(end("a"), end("b", "created_at"), "one-to-many"),
        M.Relationship(end("b"), end("a"), "many-to-many"),
        M.Relationship(end("a"), end("b"), "one-to-many", operator="contains"),
        M.Relationship(end("a"), end("b"), "few-to-many"),
        M.Relationship(end("a"), end("b"), "one-to-many", "full"),
        M.Relationship(end("a"), end("a", "name"), "one-to-many"),
        M.Relationship(end("a", " "), end("b"), "one-to-many"),
        M.Relationship(end("a", "x" * 513), end("b"), "one-to-many"),
        M.Relationship(end("a", "note"), end("b"), "one-to-many"),
        good,
    ) == [M.VALID, M.NO_ENDPOINT, M.BAD_TYPES, M.DUPLICATE, *[M.BAD_DEFINITION] * 6,
          M.NO_ENDPOINT, M.DUPLICATE]


def test_a_failed_mapping_makes_no_duplicate(spark, pair):
    assert statuses(
        spark, pair,
        M.Relationship(end("a"), end("b"), "one-to-many", operator="contains"),
        M.Relationship(end("a"), end("b"), "one-to-many"),
    ) == [M.BAD_DEFINITION, M.VALID]


def test_at_most_one_hundred_mappings(spark):
    with pytest.raises(ValueError):
        M.mapping_rows(spark, [M.Relationship(end("a"), end("b"), "one-to-one")] * 101)


LEFT = [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (9, "e")]
RIGHT = [(1, "x"), (1, "y"), (2, "z"), (None, "n"), (5, "o")]


@pytest.fixture(scope="module")
def sides(spark):
    return (spark.createDataFrame(LEFT, "k int, l string"),
            spark.createDataFrame(RIGHT, "k bigint, r string"))


def brute(join_type):
    out = [(lv, rv) for lk, lv in LEFT for rk, rv in RIGHT if lk is not None and lk == rk]
    if join_type == "left":
        matched = {lv for lv, _ in out}
        out += [(lv, None) for _, lv in LEFT if lv not in matched]
    return sorted(out, key=str)


@pytest.mark.parametrize("join_type", ["inner", "left"])
@pytest.mark.parametrize("cardinality", ["many-to-one", "one-to-many", "many-to-many"])
def test_joins_equal_brute_force(sides, join_type, cardinality):
    joined = M.join_on(*sides, "k", "k", join_type, cardinality)
    assert joined.columns == ["left_k", "left_l", "right_k", "right_r"]
    got = sorted(((r.left_l, r.right_r) for r in joined.collect()), key=str)
    assert got == brute(join_type)


def test_a_left_join_can_split_a_hot_right_key(sides):
    plan = M.join_on(*sides, "k", "k", "left", "one-to-many")._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" in plan and "LeftOuter" not in plan
    with pytest.raises(ValueError):
        M.join_on(*sides, "k", "k", "full")


def test_joining_by_form(spark):
    left = spark.createDataFrame([(" Ab ",), ("c",)], "k string")
    right = spark.createDataFrame([("aB",), ("d",)], "k string")
    assert M.join_on(left, right, "k", "k").count() == 0
    assert M.join_on(left, right, "k", "k", by_form=True).count() == 1


def test_observed_cardinality(sides):
    row = M.observed_cardinality(*sides, "k", "k", "one-to-many").first()
    assert row.asDict() == {
        "left_rows": 5, "right_rows": 5, "matched_keys": 2, "left_orphans": 2, "right_orphans": 2,
        "max_left_per_key": 2, "max_right_per_key": 2, "observed": "many-to-many",
        "as_claimed": False,
    }


def test_observed_cardinality_of_empty_sides(spark, sides):
    empty = spark.createDataFrame([], "k int")
    row = M.observed_cardinality(empty, sides[1].where(F.lit(False)), "k", "k").first()
    assert (row.left_rows, row.right_orphans, row.observed, row.as_claimed) == (0, 0, "one-to-one", None)
