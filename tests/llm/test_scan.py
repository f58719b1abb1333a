"""Language, toxicity, secrets and contamination against brute force and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldkin.llm import language, secrets, toxicity, winnowing
from fieldkin.llm.common import held_out, table
from tests.llm.conftest import SCHEMA, edge_rows, words

# -- language -----------------------------------------------------------------------


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    symbols = [rng.randrange(3) for _ in range(60)]
    moves = language.SuffixAutomaton(symbols, 3).table
    inside = {tuple(symbols[a:b]) for a in range(60) for b in range(a, min(a + 7, 61))}
    for _ in range(500):
        text = tuple(rng.randrange(3) for _ in range(rng.randint(1, 6)))
        state = 0
        for x in text:
            state = moves[state, x] if state >= 0 else -1
        assert (state >= 0) == (text in inside)


def test_phrases_are_longest_matches():
    samples = {"x": "the cat sat on the mat", "y": "el gato come pescado"}
    model = language.Model(samples, 10_000)
    text = "the gato sat el mat"
    symbols = language._collapsed(model.symbols[language._points(text)])
    for at, name in enumerate(model.languages):
        sample = language._collapsed(model.symbols[language._points(samples[name])]).tolist()
        inside = {tuple(sample[a:b]) for a in range(len(sample)) for b in range(a, len(sample) + 1)}
        count, start = 1, 0
        for end in range(1, len(symbols) + 1):
            if tuple(symbols[start:end].tolist()) not in inside:
                # A symbol that the sample lacks ends a phrase and begins none.
                count, start = count + 1, end - 1 if tuple(symbols[end - 1 : end].tolist()) in inside else end
        assert model.phrases(symbols, np.array([0, len(symbols)]))[at, 0] == count


@pytest.mark.parametrize("entries", [1 << 26, 1])
def test_every_letter_of_every_script_tells_languages_apart(monkeypatch, entries):
    """Languages of one script each and word lengths alike, the last far behind in letters."""
    monkeypatch.setattr(language, "ENTRIES", entries)
    rng = random.Random(9)
    scripts = {"latin": range(0x61, 0x7B), "greek": range(0x3B1, 0x3C2), "cyrillic": range(0x430, 0x450),
               "han": range(0x4E00, 0x4F00), "hebrew": range(0x5D0, 0x5EA), "arabic": range(0x628, 0x638)}

    def text(points, count):
        return " ".join(rng.choices(points, k=count))

    scripts = {k: ["".join(chr(rng.choice(v)) for _ in range(4)) for _ in range(100)] for k, v in scripts.items()}
    samples = {k: text(v, 200 if k in ("hebrew", "arabic") else 400) for k, v in scripts.items()}
    model = language.Model(samples, 10_000)
    names, _, _ = model.predict([text(v, 30) for v in scripts.values()])
    assert names == list(scripts)
    assert len(np.unique(model.symbols)) == 2 + len({c for x in samples.values() for c in x if c.isalpha()})


def test_the_share_of_a_language_does_not_depend_on_the_others(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, "ab " * 2_000, f"l{i % 40}", "", 0) for i in ids], SCHEMA)
    few = language.train(docs.where("lang < 'l2'"), chars=7_000)
    many = language.train(docs, chars=7_000)
    assert len(many.languages) == 40
    assert dict(zip(few.languages, few.bits)).items() <= dict(zip(many.languages, many.bits)).items()
    assert min(many.bits) > 13, "whole rows"


def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.languages(docs, language.train(docs)).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    row = found.where(held_out(F.col("id"))).agg(F.avg((F.col("lang") == F.col("language")).cast("int")).alias("share")).first()
    assert row["share"] >= 0.98


def test_language_edges(spark, edge, nothing):
    model = language.train(edge)
    assert set(model.languages) == {"en", "de"}
    got = language.languages(edge, model).collect()
    assert len(got) == len(edge_rows())
    for x in got:
        assert 0 <= x["score"] <= 1
    letters = Counter((r[0], any(c.isalpha() for c in r[1] or "")) for r in edge_rows())
    assert Counter((x["id"], x["language"] != "und") for x in got) == letters
    assert language.languages(nothing, language.train(nothing)).count() == 0
    assert language.languages(edge, language.train(nothing)).where("language <> 'und'").count() == 0
    kept = language.with_language(edge)
    assert kept.columns == edge.columns
    assert kept.count() == sum(n for (_, letter), n in letters.items() if letter)


def test_no_label_of_a_held_out_row_is_learned(spark, edge):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "only held out rows", "xx", "", 0) for i in ids], SCHEMA)
    assert language.train(docs).languages == []


def test_only_texts_without_a_letter_go_when_no_language_is_known(spark, edge):
    want = sum(any(c.isalpha() for c in r[1] or "") for r in edge_rows())
    assert language.with_language(edge.withColumn("lang", F.lit(None).cast("string"))).count() == want


# -- toxicity -----------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    found = toxicity.toxicity(docs, toxicity.train(docs, labels))
    both = found.join(labels.select(F.col("doc_id").alias("id"), "toxic"), "id").where(held_out(F.col("id"))).collect()
    caught = Counter((x["score"] >= toxicity.THRESHOLD, x["toxic"]) for x in both)
    assert caught[True, 1] / (caught[True, 1] + caught[False, 1]) >= 0.8
    assert caught[True, 1] / (caught[True, 1] + caught[True, 0]) >= 0.95


def test_shouting_is_heard_in_the_whole_text():
    bit = 1 << (toxicity.LEXICONS + 1)
    for calm, loud in (("calm words ", "LOUD WORDS "), ("ruhige wörter ", "LAUTE WÖRTER ")):
        assert toxicity.votes_of(calm * 300 + loud * 900, set(), {}) == bit
        assert toxicity.votes_of(loud * 300 + calm * 900, set(), {}) == 0
    assert toxicity.votes_of("12 !", set(), {}) == toxicity.votes_of("", set(), {}) == 0


def test_label_model_learns_accuracies_and_a_dependence():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.2
    votes = np.zeros((len(truth), toxicity.VOTERS), int)
    for voter, (hit, false) in enumerate([(0.9, 0.02), (0.8, 0.05), (0.7, 0.01), (0.6, 0.1)]):
        votes[:, voter] = rng.random(len(truth)) < np.where(truth, hit, false)
    votes[:, 4] = np.where(rng.random(len(truth)) < 0.95, votes[:, 3], 1 - votes[:, 3])  # a copy of voter 3
    codes = (votes << np.arange(toxicity.VOTERS)).sum(axis=1)
    labelled = Counter(zip(codes[:500].tolist(), truth[:500].astype(int).tolist()))
    model = toxicity.LabelModel(Counter(codes.tolist()), labelled)
    assert model.parent[4] == 3 or model.parent[3] == 4
    guess = np.array([model.table[x] for x in codes.tolist()])
    assert abs(guess.mean() - 0.2) < 0.02
    assert ((guess > 0.5) == truth).mean() > 0.97
    twice = model.posterior(np.eye(toxicity.VOTERS, dtype=int)[[3]] + np.eye(toxicity.VOTERS, dtype=int)[[4]])[0, 1]
    assert twice < 0.2, "a copied vote is not counted twice"


def test_toxicity_edges(spark, edge, nothing):
    labels = spark.createDataFrame(
        [(i, 1, i % 2) for i in range(100, 112)] + [(100, 0, 1), (None, 1, 1), (5, 1, None), (999, 1, 1)],
        "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for docs, known in ((edge, labels), (edge, none), (nothing, labels)):
        got = toxicity.toxicity(docs, toxicity.train(docs, known)).collect()
        assert len(got) == docs.count()
        assert all(0 <= x["score"] <= 1 for x in got)


# -- secrets ------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text: str | None) -> str:
    spans = []
    for rank, (kind, pattern, least) in enumerate(
            (("assign", ASSIGN, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16))):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(spans))


def test_base_spans(spark, edge, nothing):
    rng = random.Random(9)
    pieces = ["token=", "Password : '", "api_key\": \"", "apikey=", "secret==", "AKIA", "AKIAAKIA", "ABCDEF0123456789",
              "deadbeef", "0123456789abcdef", "é日", " ", "\n", "x", "token=token:", "aB3/aB3/aB3/aB3/aB3/aB3/aB3/"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 25))), "en", f"src{i % 5}", 0) for i in range(300)]
    rows += [(None, "token=abcdefghijkl", None, None, 0), (3, None, "en", "src1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest", "1 as start", "2 as row", "3 as owner")
    got = secrets.secrets(docs, F.col("source"), F.col("source")).collect()
    assert Counter((x["id"], x["base_spans"]) for x in got) == Counter((r[0], slow_base(r[1])) for r in rows)
    assert all(set(filter(None, x["base_spans"].split(","))) <= set(x["spans"].split(",")) for x in got)
    assert secrets.secrets(nothing, F.col("source"), F.col("source")).count() == 0
    assert secrets.secrets(edge, F.col("source"), F.col("source")).count() == len(edge_rows())


def test_ownership_tells_examples_from_live_secrets(spark):
    own, shared, opaque = "q7Zp0LkT9vXc2BnM", "Example0Example1", "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v"
    rows = [(i, f"token={shared}", "en", f"src{i}", 0) for i in range(6)]
    rows += [(10, f"token={own} and token={own}", "en", "src1", 0), (11, f"see {opaque} here", "en", "src1", 0)]
    rows += [(20 + i, f"see {opaque[::-1]} here", "en", f"src{i}", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x["id"]: x for x in secrets.secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source")).collect()}
    assert (got[0]["n_example"], got[0]["n_live"]) == (1, 0)
    assert (got[10]["n_example"], got[10]["n_live"]) == (0, 2)
    assert got[11]["spans"] == f"opaque:4:{4 + len(opaque)}" and got[11]["n_opaque"] == 1
    assert got[20]["spans"] == "", "what many owners hold is not added"


def test_no_python_in_the_scan(spark, edge):
    plan = secrets.secrets(edge, F.col("source"), F.col("source"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- contamination ------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def slow_contamination(docs: list[tuple], items: list[tuple]) -> Counter:
    windows = defaultdict(set)
    for item, text in items:
        own = slow_words(text)
        size = min(13, len(own))
        for at in range(len(own) - size + 1 if own else 0):
            windows[tuple(own[at : at + size])].add("" if item is None else str(item))
    sizes, out = {len(x) for x in windows}, Counter()
    for id_, text, *_ in docs:
        own, hit, names = slow_words(text), set(), set()
        for size in sizes:
            for at in range(len(own) - size + 1):
                if found := windows.get(tuple(own[at : at + size])):
                    names |= found
                    hit |= set(range(at, at + size))
        out[id_, len(own), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_windows_in_documents(spark, edge, nothing, block_bytes):
    rng = random.Random(11)
    items = [(i, words(rng, rng.randint(1, 40))) for i in range(25)]
    items += [(None, words(rng, 20)), (3, words(rng, 20)), (40, None), (41, ""), (42, "a b c a b c a b c a b c a b c a b c"),
              (43, items[0][1]), (44, "an"), (45, "the an the an the an the an the an the an the an the an")]
    docs = [r for r in edge_rows() if r[0] not in (7, 8)]
    for i in range(120):
        parts = [words(rng, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            low = rng.randint(0, max(len(own) - 13, 0))
            parts += own[low : low + rng.randint(10, 40)] + words(rng, rng.randint(0, 5)).split()
        docs.append((500 + i, rng.choice([" ", "-", ", "]).join(parts).title(), "en", "s", 0))
    docs.append((700, "a b c " * 30 + "the an " * 40, "en", "s", 0))
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as row", "'x' as items", "'y' as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item")
    got = winnowing.contamination(frame, bench, block_bytes=block_bytes).collect()
    assert Counter((x["id"], x["n_words"], x["n_hit"], x["items_sha256"]) for x in got) == slow_contamination(docs, items)
    assert all(sum(x["spans"][1::2]) - sum(x["spans"][::2]) == x["n_hit"] for x in got)
    if block_bytes > 300:
        assert winnowing.contamination(nothing, bench).count() == 0
        assert winnowing.contamination(edge, bench.where("false")).where("n_hit > 0").count() == 0
        assert winnowing.without_contaminated(edge, bench).columns == edge.columns


def test_a_label_decides_only_where_voters_have_little_to_say():
    posterior = np.array([0.99] * 40 + [0.01] * 200 + [0.4, 0.4, 0.999])
    labels = np.array([True] * 40 + [False] * 200 + [True, False, False])
    targets = toxicity.with_labels(posterior, labels)
    assert targets[-3] > 0.9 and targets[-2] < 0.1 and targets[-1] > 0.8
    assert len(toxicity.with_labels(np.zeros(0), np.zeros(0, bool))) == 0
