"""The audit of sources, hard negatives and the quality classifier against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldkin.llm import divergence, negatives, quality
from fieldkin.llm.common import table
from tests.llm.conftest import SCHEMA, edge_rows, words

SMALL = "/root/testdata/sf0.001"


# -- divergence ---------------------------------------------------------------------


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow_audit(rows: list[tuple], least: int = 3, ranks: int = 200) -> Counter:
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if df[t] >= least)
        whole = sum(counts.values(), Counter())

        def share(of: Counter, term: str) -> int:
            return 1 + 10**9 * (of[term] + 1) // (sum(of.values()) + len(kept))

        def far(p: int, q: int) -> int:
            return (p - q) ** 2 // q

        for source, own in counts.items():
            pairs = [(-sum(far(share(own, t), share(other, t)) for t in kept), name)
                     for name, other in counts.items() if name != source]
            terms = [(-far(share(own, t), share(whole, t)), t) for t in kept if own[t] and share(own, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, source, part, item, -v, n) for n, (v, item) in enumerate(found, 1) if part == "pair" or n <= ranks]
    return Counter(out)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("held", [1 << 19, 40])
def test_audit(spark, edge, nothing, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    assert Counter(tuple(x[c] for c in COLUMNS) for x in divergence.audit(edge).collect()) == slow_audit(edge_rows())
    assert divergence.audit(nothing).count() == 0


def test_audit_of_many_copies(spark):
    """A text that a third of all rows are, in many sources, and a language without kept terms."""
    rng = random.Random(3)
    hot = words(rng, 30)
    rows = [(i, hot, "en", f"s{i % 7}", 0) for i in range(300)]
    rows += [(1000 + i, words(rng, rng.randint(0, 40)), rng.choice(["en", "de"]), f"s{i % 5}", 0) for i in range(300)]
    rows += [(2000 + i, f"only{i}", "xx", f"s{i}", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(x[c] for c in COLUMNS) for x in divergence.audit(docs, ranks=4).collect()) == slow_audit(rows, ranks=4)
    found = divergence.collapsed(docs).where("lang = 'en' and size(found) = 7").collect()
    assert len(found) == 1 and sum(x["n"] for x in found[0]["found"]) >= 300
    alone = divergence.audit(spark.createDataFrame(rows[-3:], SCHEMA)).collect()
    assert {x["value"] for x in alone} == {0} and len(alone) == 6


# -- hard negatives -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def slow_negatives(rows: list[tuple], every: int, low: int = 80, high: int = 100) -> Counter:
    last = 2**63 - 1
    usable = [(last if r[0] is None else r[0], n, r[2], [math.floor(256 * np.float32(x).astype(float)) for x in r[1]])
              for n, r in enumerate(rows)
              if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for anchor, at, label, vector in usable:
        if anchor == last or anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, n, l) for i, n, l, v in usable if n != at)
        for s, i, n, _ in [x for x in scored if x[3] == label][:5]:
            near = [x for x in scored if x[3] != label and low * -s <= -100 * x[0] <= high * -s][:5]
            out += [(anchor, None if i == last else i, k, None if x[1] == last else x[1], -s, -x[0]) for k, x in enumerate(near, 1)]
    return Counter(out)


def vector_rows() -> list[tuple]:
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(size=12) * rng.choice([0, 0.05, 0.5])], int(rng.integers(3)))
            for i in range(600)]
    rows += [rows[20], rows[40], (40, None, 1), (60, [1.0] * 12, None), (80, [None] * 12, 1), (None, rows[3][1], 1),
             (100, [float("nan")] * 12, 0), (101, [float("inf")] * 12, 0), (120, [], 1), (140, [2.0] * 5, 2), (141, [3.0] * 20, 1),
             (-20, rows[5][1], 0), (0, [0.0] * 12, 0)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"TREE": 7, "BLOCK": 9, "SLOT": 150, "ROWS": 40}, {"EXACT": 0.0}])
def test_hard_negatives(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows()
    data = spark.createDataFrame(rows, VECTORS).coalesce(1).selectExpr("*", "1 as row", "'x' as id", "2 as anchor", "3 as rank")
    got = negatives.hard_negatives(data, every=20).collect()
    assert Counter(tuple(x) for x in got) == slow_negatives(rows, 20)
    got = negatives.hard_negatives(data, every=20, low=10, high=130).collect()
    assert Counter(tuple(x) for x in got) == slow_negatives(rows, 20, 10, 130)
    assert negatives.hard_negatives(data.limit(0), every=20).count() == 0
    assert negatives.hard_negatives(data.where("vec_id = 7"), every=20).count() == 0


def test_bounds_spare_scores():
    """Anchors close to each other: candidates off their windows are never scored."""
    rng = np.random.default_rng(1)
    centre = rng.integers(-300, 300, 32)
    anchors = centre + rng.integers(-2, 3, (50, 32))
    others = np.concatenate([rng.integers(-300, 300, (2_000, 32)), centre + rng.integers(-40, 40, (20, 32))])
    scored = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self) * other.shape[1])
            return np.asarray(self) @ other

    best = [[int(x)] for x in (anchors @ anchors.T).max(axis=1)]
    tree = negatives.Tree(np.arange(50), np.arange(50), 0, anchors, best, 5, 80, 100)
    tree.vectors = tree.vectors.view(Counting)
    norms = np.sqrt((others.astype(float) ** 2).sum(axis=1))
    tree.meet(np.arange(len(others)), 1_000 + np.arange(len(others)), others, norms, 400.0)
    assert sum(scored) < 0.2 * 50 * len(others), "only the root meets all"
    exact = anchors @ others.T
    for node in range(50):
        inside = [(-int(s), n) for n, s in enumerate(exact[node]) if 80 * best[node][0] <= 100 * s <= 100 * best[node][0]]
        mine = tree.found["place"] == node
        assert sorted(zip((-tree.found["score"][mine]).tolist(), tree.found["id"][mine].tolist())) == sorted(inside)[:5]


def test_edges_of_the_tree_are_true():
    vectors = np.random.default_rng(2).integers(-50, 50, (40, 8)).astype(float)
    levels, parent, lengths = negatives.spanning_tree(vectors)
    assert sorted(np.concatenate(levels).tolist()) == list(range(40)) and levels[0].tolist() == [0]
    depth = {int(n): d for d, level in enumerate(levels) for n in level}
    for node in range(1, 40):
        assert depth[int(parent[node])] == depth[node] - 1
        assert lengths[node] >= np.linalg.norm(vectors[node] - vectors[parent[node]]) - 1e-9


# -- quality ------------------------------------------------------------------------


def slow_features(content: bytes) -> Counter:
    def bucket(h: int) -> int:
        return (h * int(quality.MIXER) % 2**64) >> 49

    parts = [w[a : a + quality.PIECE] for w in content.split() for a in range(0, len(w), quality.PIECE)]
    found, hashes = Counter(), []
    for word in parts:
        framed = [256, *word, 257]
        for n in quality.NGRAMS:
            for at in range(len(framed) - n + 1):
                h = 0
                for x in framed[at : at + n]:
                    h = h * int(quality.STRIDE) + x
                found[bucket(h + n)] += 1
        hashes.append(sum(x * int(p) for x, p in zip(framed, quality.POWERS)) % 2**64)
        found[bucket(hashes[-1])] += 1
    for a, b in zip(hashes, hashes[1:]):
        found[quality.REPEATED if a == b else bucket(a * int(quality.STRIDE) + b)] += 1
    return found


@pytest.mark.parametrize("part", [1 << 19, 700])
def test_features_and_scores(monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)
    model = quality.Model(*(np.random.default_rng(6).normal(size=s) for s in ((quality.BUCKETS, 8), (2, 8), (2,))))
    contents = [(r[1] or "")[:20_000] for r in edge_rows()] + ["the the a", "x" * 1_500 + " y " + "x" * 64 + "x", "é" * 900]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(contents))), "id": [0] * len(contents),
                                        "label": [1] * len(contents), "text": contents})
    scores = next(quality._scored(type("Shared", (), {"value": model}))(iter([batch]))).column("probabilities").to_pylist()
    made = next(quality._featured(iter([batch])))
    for n, content in enumerate(contents):
        want = slow_features(content.encode())
        got = dict(zip(*(made.column(x)[n].as_py() for x in ("features", "shares"))))
        assert got == pytest.approx({k: v / want.total() for k, v in want.items()}, rel=1e-6)
        mean = sum((model.embedding[k] * v for k, v in want.items()), np.zeros(8)) / max(want.total(), 1)
        assert scores[n] == pytest.approx(quality.softmax(model.weights @ mean + model.offsets).tolist())


def test_steps_go_down_the_gradient():
    """One step lowers the loss of its text, and the embedding moves as finite differences say."""
    rng = np.random.default_rng(0)
    ids, share = np.array([3, 9, 70]), np.array([0.5, 0.25, 0.25], np.float32)
    model = quality.fit([ids] * 40, [share] * 40, rng.integers(0, 2, 40) * 0 + 1, 2, epochs=3)
    mean = share @ model.embedding[ids]
    assert quality.softmax(model.weights @ mean + model.offsets)[1] > 0.97
    untouched = np.random.default_rng(quality.SEED).uniform(
        -1 / quality.DIMENSIONS, 1 / quality.DIMENSIONS, (quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    same = (model.embedding == untouched).all(axis=1)
    assert (~same).sum() == 3 and not same[ids].any()


def test_classifier_on_rows_it_has_not_seen(spark):
    directory = "/root/testdata/sf0.01"
    found = quality.op13_quality_classifier(spark, directory)
    held = found.where("held_out").join(table(spark, directory, "labels"), "doc_id")
    right, rows, low = held.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*"),
                                F.count_if(F.col("quality") == 0)).first()
    assert rows > 80 and low > 5 and right >= 0.95 * rows


def test_classifier_on_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (100, 0), (101, 0), (102, 1), (None, 1), (9, None), (200, 7)],
                                   "doc_id long, quality int").selectExpr("*", "'x' as row", "'y' as text")
    rows = edge_rows()
    got = quality.quality(edge, labels).collect()
    assert Counter(x["id"] for x in got) == Counter(r[0] for r in rows)
    assert all(abs(sum(x["probabilities"]) - 1) < 1e-9 for x in got)
    empty = {tuple(x["probabilities"]) for x in got if x["id"] in (4, 5, 6)}
    assert len(empty) == 1, "null, empty and blank texts score alike"
    for docs, taught in ((edge, labels.limit(0)), (edge.where("doc_id is null"), labels)):
        assert {tuple(x["probabilities"]) for x in quality.quality(docs, taught).collect()} == {(0.5, 0.5)}
    assert quality.quality(nothing, labels).count() == 0
    learned = quality.sample_of(edge, labels, F.lit(True), "doc_id", "text", "quality", rows=2)
    assert learned.count() == 2
