"""Batches over several sources, packing into a budget, and expectations."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from fieldkin.operators import batch as B
from fieldkin.operators import expect as E
from fieldkin.sources.readers import read_files


def test_a_failing_source_does_not_stop_the_others(spark, tmp_path):
    def query(source_id, opened, ask=lambda d: d):
        return B.SourceQuery(source_id, "relational", opened, ask, ("id",))

    got = B.multi_source_batch(spark, [
        query("s1", lambda: read_files(spark, str(tmp_path / "none"))),
        query("s2", lambda: spark.range(3)),
        query("s3", lambda: spark.range(3), lambda d: d.select("nope")),
        query("s4", lambda: spark.range(2000)),
        query("s5", lambda: spark.range(3), lambda d: d.select("id", F.raise_error(F.lit("x")).alias("e"))),
        query("s6", lambda: spark.range(3).where("id > 5")),
        query("s7", lambda: spark.read.format("jdbc").options(url="jdbc:nosuch:x", dbtable="t").load()),
    ])
    outcomes = {
        r.source_id: (r.stage, r.status, r.error, r.returned_count) for r in got.outcomes.collect()
    }
    hidden = "Unable to access the relational source."
    assert outcomes == {
        "s1": ("catalog", "failed", hidden, None), "s2": ("execute", "succeeded", None, 3),
        "s3": ("execute", "failed", hidden, None), "s4": ("execute", "succeeded", None, 1000),
        "s5": ("execute", "failed", hidden, None), "s6": ("execute", "succeeded", None, 0),
        "s7": ("catalog", "failed", hidden, None),
    }
    rows = got.rows.collect()
    assert [(r.row_no, r.returned_count, r.row) for r in rows if r.source_id == "s2"] == [
        (1, 3, '{"id":0}'), (2, 3, '{"id":1}'), (3, 3, '{"id":2}'),
    ]
    assert {r.returned_count for r in rows if r.source_id == "s4"} == {1000}


def test_sources_are_asked_side_by_side(spark):
    # Each source opens only when the other is being opened as well.
    meet = threading.Barrier(2, timeout=60)

    def opened():
        meet.wait()
        tags.append(set(spark.getTags()))
        return spark.range(2)

    tags: list[set[str]] = []
    got = B.multi_source_batch(
        spark, [B.SourceQuery(s, "relational", opened, lambda d: d, ("id",)) for s in ("s1", "s2")])
    assert sorted(map(sorted, tags)) == [["source-0"], ["source-1"]] and not spark.getTags()
    assert [(r.source_ord, r.source_id, r.returned_count) for r in got.outcomes.collect()] == [
        (0, "s1", 2), (1, "s2", 2)]
    assert sorted((r.source_id, r.row) for r in got.rows.collect()) == [
        (s, f'{{"id":{i}}}') for s in ("s1", "s2") for i in range(2)]


def test_no_answer_at_all_is_an_error(spark, tmp_path):
    failing = B.SourceQuery("s", "document", lambda: read_files(spark, str(tmp_path / "x")),
                            lambda d: d, ("id",))
    with pytest.raises(RuntimeError):
        B.multi_source_batch(spark, [failing])


def test_a_mistake_of_the_caller_is_not_hidden(spark):
    broken = B.SourceQuery("s", "document", lambda: spark.range(1), lambda d: 1 / 0, ("id",))
    with pytest.raises(ZeroDivisionError):
        B.multi_source_batch(spark, [broken])


def test_packing_keeps_one_hundred_of_one_hundred_and_one_rows(spark):
    data = spark.range(101).withColumn("g", F.lit("a"))
    packed = B.pack_rows(data, ["g"], ["id"], ["id"])
    row = B.pack_summary(packed, ["g"]).first()
    assert (row.kept_rows, row.truncated) == (100, True)
    assert B.pack_summary(B.pack_rows(data.where("id < 100"), ["g"], ["id"], ["id"]), ["g"]).first().truncated is False


def pack(lengths, max_rows, max_chars):
    """Rows, characters and truncation of one group, row by row."""
    kept = used = 0
    truncated = len(lengths) > max_rows
    for length in lengths[:max_rows]:
        if length > max_chars - used:
            truncated = True
            break
        kept, used = kept + 1, used + length
    return kept, used, truncated


def test_packing_equals_brute_force(spark):
    rng = random.Random(5)
    groups = {g: [rng.randint(0, 40) for _ in range(rng.randint(1, 12))] for g in range(30)}
    rows = [(g, i, "x" * n) for g, lengths in groups.items() for i, n in enumerate(lengths)]
    data = spark.createDataFrame(rows, "g int, i int, t string")
    packed = B.pack_summary(B.pack_rows(data, ["g"], ["i"], ["t"], 5, 90), ["g"])
    overhead = len('{"t":""}')
    wanted = {g: pack([n + overhead for n in lengths], 5, 90) for g, lengths in groups.items()}
    assert {r.g: (r.kept_rows, r.kept_chars, r.truncated) for r in packed.collect()} == wanted


def test_packing_ranks_before_it_shuffles(spark):
    data = spark.range(100_000).withColumn("g", F.col("id") % 7)
    packed = B.pack_rows(data, ["g"], ["id"], ["id"])
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 101, Partial" in plan and plan.count("Exchange hashpartitioning") == 1


def test_packing_many_rows_slices_large_groups(spark):
    data = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    row = B.pack_summary(B.pack_rows(data, ["g"], ["id"], ["id"], 2000, 10**9), ["g"]).where("g = 1").first()
    assert (row.kept_rows, row.truncated) == (2000, True)
    assert row.kept_chars == sum(len(f'{{"id":{i}}}') for i in range(1, 4000, 2))


def shared(spark, groups, max_rows, max_chars):
    rows = [(g, i, "x" * n) for g, lengths in enumerate(groups) for i, n in enumerate(lengths)]
    data = spark.createDataFrame(rows, "source_ord int, row_no int, row string")
    out = B.pack_shared(data, max_rows=max_rows, max_chars=max_chars).orderBy("source_ord").collect()
    return [(r.kept_rows, r.kept_chars, r.truncated) for r in out]


def test_a_shared_budget_goes_to_the_first(spark):
    assert shared(spark, [[30, 30, 30], [50], [20, 20]], 100, 100) == [
        (3, 90, False), (0, 0, True), (0, 0, True),
    ]
    # A later group still gets what an overflowing one left.
    assert shared(spark, [[60, 60], [50, 1], [40]], 100, 100) == [
        (1, 60, True), (0, 0, True), (1, 40, False),
    ]


def test_a_shared_budget_equals_brute_force(spark):
    rng = random.Random(11)
    for _ in range(3):
        groups = [[rng.randint(1, 30) for _ in range(rng.randint(1, 9))] for _ in range(6)]
        left, wanted = 200, []
        for lengths in groups:
            kept, used, truncated = pack(lengths, 4, left)
            left -= used
            wanted.append((kept, used, truncated))
        assert shared(spark, groups, 4, 200) == wanted


def test_expectations(spark):
    data = spark.createDataFrame(
        [(1, "town", 1), (1, "moon", 2), (2, None, 9), (3, "city", 1), (3, "city", 1)],
        "id int, kind string, n int",
    )
    rules = {"kind": F.col("kind").isin("town", "city"), "range": F.col("n").between(1, 3)}
    got = {r.rule: r.violations for r in E.expect_domains(data, rules).collect()}
    assert got == {"kind": 1, "range": 1}
    assert tuple(E.expect_unique(data, ["id"]).first()) == (2, 2)
    assert tuple(E.expect_unique(data, ["id", "kind"]).first()) == (1, 1)
    assert tuple(E.expect_unique(data.where("id = 2"), ["id"]).first()) == (0, 0)
    parent = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert tuple(E.expect_references(data, "id", parent, "k").first()) == (1, 2)
    counts = spark.createDataFrame([("a", 5), ("b", 1), ("c", 1)], "entity string, row_count bigint")
    verdicts = E.expect_row_counts(counts, {"a": 5, "b": 2}).orderBy("entity").collect()
    assert [r.as_expected for r in verdicts] == [True, False, None]


def test_nulls_may_repeat_in_a_unique_key(spark):
    data = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3)], "a int, b int")
    assert tuple(E.expect_unique(data, ["a", "b"]).first()) == (1, 1)
    assert tuple(E.expect_unique(data, ["a", "b"], nulls_repeat=False).first()) == (2, 2)
