"""The archive, the mixture, the SQL of all queries, and the pipeline."""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks import compare
from fieldkin.llm import mixing, warc
from fieldkin.llm.common import table
from fieldkin.llm.queries import ORACLE_SQL, QUERIES
from fieldkin.session import shared_directory
from tests.llm.conftest import SCHEMA, edge_rows
from tests.llm.test_dedup import components, lowered, slow_fingerprint
from tests.llm.test_scan import slow_contamination

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare.compare(spark, compare.connect(SMALL), SMALL, name) is None


def test_every_query_returns_every_row(spark):
    for name in set(QUERIES) - {"op5_mixing", "op11_source_divergence", "op12_hard_negatives"}:
        source = "pages" if name == "op4_warc_archive" else "documents"
        assert QUERIES[name](spark, SMALL).count() == table(spark, SMALL, source).count(), name


# -- archive ------------------------------------------------------------------------


def folder(spark) -> str:
    return f"{shared_directory(spark)}/{uuid.uuid4().hex}"


def test_records_come_back(spark):
    big, small = "<p>é" + "x" * 200, "<p>short"
    rows = [(5, "http://a/5", big), (3, "http://a/3", big), (9, None, big), (1, "http://a/1", small), (2, "http://a/2", small),
            (4, "http://a/4\r\nX: y", None), (6, "", ""), (3, "http://a/again", big), (None, "http://a/n", big),
            (None, "http://a/m", "z" * 300), (7, "http://a/7", "y" * 100), (8, "http://a/8", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as row", "'x' as digest")
    where = folder(spark)
    warc.write_archive(pages, where)
    got = warc.records(spark, where).collect()
    assert Counter((x["page_id"], bytes(x["payload"])) for x in got) == Counter((r[0], (r[2] or "").encode()) for r in rows)
    kinds = Counter((x["page_id"], x["record_type"], x["refers_to"]) for x in got)
    assert kinds == Counter([
        (5, "revisit", 3), (3, "response", None), (3, "response", None), (9, "revisit", 3), (None, "revisit", 3),
        (None, "response", None), (1, "response", None), (2, "response", None), (4, "response", None), (6, "response", None),
        (7, "response", None), (8, "revisit", 7)])
    assert spark.read.parquet(f"{where}/payloads").count() == len({r[2] or "" for r in rows})
    for x in got:
        head, body = bytes(x["record"]).split(b"\r\n\r\n", 1)
        assert body == (bytes(x["payload"]) if x["record_type"] == "response" else b"") + b"\r\n\r\n"
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and head.count(b"WARC-Target-URI") <= 1
    assert len({x["record_id"] for x in got}) == len(rows)


def test_a_changed_payload_is_noticed(spark):
    where, other = folder(spark), folder(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), where)
    spark.read.parquet(f"{where}/payloads").withColumn("payload", F.encode(F.lit("y"), "UTF-8")).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="not what its digest says"):
        warc.payloads(spark, other).collect()


def test_archive_of_an_empty_table(spark):
    where = folder(spark)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), where)
    assert warc.records(spark, where).count() == 0


# -- mixture ------------------------------------------------------------------------


def slow_share(total: int, nodes: dict[str, tuple[int, int]]) -> dict[str, int]:
    """Fill by weight, take out what is full, and share again."""
    budget, open_ = {}, dict(nodes)
    while open_:
        weights = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * weights <= w * total]
        if not full:
            return budget | {k: w * total // weights for k, (_, w) in open_.items()}
        for k in full:
            budget[k] = open_.pop(k)[0]
            total -= budget[k]
    return budget


@pytest.mark.parametrize("seed", range(3))
def test_budgets_go_to_siblings_first(spark, seed):
    rng = random.Random(seed)
    leaves = [(d, g, f"s{i}", rng.choice([0, 1, 7, 100, 5_000, 90_000]))
              for d in ("main", "body", "tail", "odd") for g in ("en", "de", "zz") for i in range(rng.randint(1, 4))]
    frame = spark.createDataFrame(leaves, "domain string, language string, source string, tokens long")
    got = {(x["domain"], x["language"], x["source"]): x["budget"] for x in mixing.leaf_budgets(frame, 150, 3).collect()}
    total = min(sum(x[3] for x in leaves) * 150 // 100, 3 * sum(x[3] for x in leaves))
    size = defaultdict(int)
    for d, g, s, n in leaves:
        for key in ((d,), (d, g), (d, g, s)):
            size[key] += 3 * n
    top = slow_share(total, {k[0]: (v, mixing.DOMAIN_WEIGHTS.get(k[0], 1)) for k, v in size.items() if len(k) == 1})
    for d, budget in top.items():
        middle = slow_share(budget, {k[1]: (v, mixing.LANGUAGE_WEIGHTS.get(k[1], 1)) for k, v in size.items() if len(k) == 2 and k[0] == d})
        for g, part in middle.items():
            low = slow_share(part, {k[2]: (v, 1) for k, v in size.items() if len(k) == 3 and k[:2] == (d, g)})
            for s, value in low.items():
                assert got[d, g, s] == value
                assert value <= size[d, g, s]


def test_mixture_edges(spark, edge, nothing):
    got = mixing.mixture(edge).collect()
    again = mixing.mixture(edge).collect()
    assert Counter(got) == Counter(again)
    times = Counter((x["row"], x["epoch"]) for x in got)
    assert max(times.values()) == 1, "a row is read once in an epoch"
    assert {x["epoch"] for x in got} <= {0, 1, 2}
    rows = {(x["row"], x["epoch"]) for x in got}
    assert all((row, e) in rows for row, epoch in rows for e in range(epoch))
    assert mixing.mixture(nothing).count() == 0
    mixed = mixing.mixed(edge.withColumn("mix_epoch", F.lit("x")))
    assert mixed.columns == [*edge.columns, "mix_epoch", "mix_tokens"] and mixed.count() == len(got)


def test_no_python_in_the_mixture(spark, edge):
    plan = mixing.mixture(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# -- pipeline -----------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, edge, tmp_path):
    """All stages but the mixture in plain Python; the mixture is taken from its own input."""
    rng = random.Random(1)
    rows = [r for r in edge_rows() if r[0] is None or r[0] not in (7, 8)]
    bench = [(1, rows[20][1].split("\n")[1])]
    rows += [(900 + i, bench[0][1] if i else bench[0][1] + " " + "clean " * 900, "en", "src1", 0) for i in range(2)]
    rng.shuffle(rows)
    directory = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{directory}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{directory}/benchmark.parquet")

    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for at, r in enumerate(rows):
        rank = (r[0] is None, -(r[0] or 0), at)
        key = lowered(r[1])
        best[key] = min(best.get(key, (rank, at)), (rank, at))
    rows = [rows[at] for at in sorted(x[1] for x in best.values())]
    root = components([slow_fingerprint(r[1]) for r in rows], 2)
    chosen = {}
    for at, x in enumerate(root):
        rank = (2**63 if rows[at][0] is None else rows[at][0], at)
        chosen[x] = min(chosen.get(x, rank), rank)
    rows = [rows[at] for at in sorted(x[1] for x in chosen.values())]
    found = {k[0]: (k[1], k[2]) for k in slow_contamination(rows, bench)}
    rows = [r for r in rows if not (found[r[0]][1] and 20 * found[r[0]][1] >= found[r[0]][0])]

    docs = table(spark, directory, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, directory)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(f"{directory}/{name}")
        docs = spark.read.parquet(f"{directory}/{name}")
    assert Counter(tuple(x) for x in docs.collect()) == Counter(rows)
    want = Counter((x["doc_id"], x["mix_epoch"]) for x in mixing.mixed(docs).collect())
    got = Counter((x["doc_id"], x["mix_epoch"]) for x in corpus_pipeline.run(spark, directory).collect())
    assert got == want


def test_pipeline_stages_on_edges(spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge, SMALL).count() > 0, name
        assert stage(spark, nothing, SMALL).count() == 0, name
