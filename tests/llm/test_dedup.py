"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fieldkin.llm import exact, lines, repeats, simhash
from fieldkin.llm.anchors import SPAN, anchored
from fieldkin.llm.components import stars
from tests.llm.conftest import SCHEMA, edge_rows, words


def lowered(text: str | None) -> bytes:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode()


# -- exact --------------------------------------------------------------------------


def test_trie_holds_every_string_with_its_smallest_rank():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(400)]
    trie = exact.Trie()
    for at, content in enumerate(strings):
        trie.insert(content, (-at,), 1, content)
    found = {x[2]: x for x in trie.owners()}
    assert {k: v[1] for k, v in found.items()} == Counter(strings)
    assert all(-rank[0] == max(i for i, s in enumerate(strings) if s == k) for k, (rank, _, _) in found.items())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_copies_have_one_owner(spark, edge, keep):
    got = exact.exact_duplicates(edge, keep=keep).collect()
    groups = defaultdict(list)
    for id_, text, *_ in edge_rows():
        groups[hashlib.sha256(lowered(text)).hexdigest()].append(id_)
    assert len(got) == len(edge_rows())
    for row in got:
        ids = [x for x in groups[row["text_sha256"]] if x is not None]
        assert row["group_size"] == len(groups[row["text_sha256"]])
        assert row["keep_id"] == ((max if keep == "largest" else min)(ids) if ids else None)
    kept = Counter(x["text_sha256"] for x in got if x["kept"])
    assert kept == Counter(groups.keys()), "one row of each group stays, repeated identifiers or not"


def test_exact_copies_of_an_empty_table(nothing):
    assert exact.exact_duplicates(nothing).count() == 0


def test_stage_keeps_columns(edge):
    out = exact.without_exact_copies(edge)
    assert out.columns == edge.columns
    assert out.count() == len({lowered(x[1]) for x in edge_rows()})


# -- near ---------------------------------------------------------------------------


def slow_fingerprint(text: str | None) -> int:
    tokens = re.findall(rb"[^\x20\x09-\x0d]+", lowered(text))
    if not tokens:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + 3]), 42) for i in range(max(len(tokens) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], errors: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= errors:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(prints))]


@pytest.mark.parametrize("shift", [0, 40, 56])
def test_trie_join_finds_every_pair(shift):
    rng = np.random.default_rng(shift)
    values = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64) >> np.uint64(shift))
    want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= 2}
    x, y = simhash.joined_tries(values, None, 0, 2, leaf=2)
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == want
    assert len(x) == len(want)


def test_links_across_subtries_of_several_depths(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTRIE", 16)
    monkeypatch.setattr(simhash, "PAIR", 20)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(60)}
    dense = rng.getrandbits(64)
    for _ in range(150):  # a dense neighbourhood, and chains of two bits
        prints.add(dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    at = rng.getrandbits(64)
    for _ in range(15):
        at ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        prints.add(at)
    ordered = sorted(prints)
    signed = [x - 2**64 if x >= 2**63 else x for x in ordered]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.subtrie_pairs(frame, len(signed), 2).repartition("depth", "lo", "hi").sortWithinPartitions(
        "depth", "lo", "hi").mapInArrow(simhash._linked(2), "u long, v long")
    roots = {x["node"]: x["root"] for x in stars(edges).collect()}
    root = components(ordered, 2)
    got = defaultdict(set)
    for at, x in enumerate(signed):
        got[roots.get(x, x)].add(at)
    want = defaultdict(set)
    for at, x in enumerate(root):
        want[x].add(at)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_copies(edge):
    rows = edge_rows()
    got = simhash.near_duplicates(edge).collect()
    prints = [slow_fingerprint(x[1]) for x in rows]
    assert Counter((x["id"], x["fp"] % 2**64) for x in got) == Counter((r[0], p) for r, p in zip(rows, prints))
    root = components(prints, 2)
    least = {}
    for at, x in enumerate(root):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == x and rows[j][0] is not None]
        least[at] = min(ids) if ids else None
    assert Counter((x["id"], x["component_id"]) for x in got) == Counter((r[0], least[i]) for i, r in enumerate(rows))
    assert simhash.without_near_copies(edge).count() == len(set(root))


def test_near_copies_of_an_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "u long, v long")
    got = {x["node"]: x["root"] for x in stars(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)}


# -- strings of 50 bytes ------------------------------------------------------------


def slow_removed(rows: list[tuple]) -> list[tuple]:
    last, owner = 2**63, {}
    for id_, text, *_ in rows:
        content = (text or "").encode()
        for at in range(len(content) - SPAN + 1):
            gram = content[at : at + SPAN]
            owner[gram] = min(owner.get(gram, last), last if id_ is None else id_)
    out = []
    for id_, text, *_ in rows:
        content = (text or "").encode()
        gone = bytearray(len(content))
        for at in range(len(content) - SPAN + 1):
            if owner[content[at : at + SPAN]] < (last if id_ is None else id_):
                gone[at : at + SPAN] = b"\1" * SPAN
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(content, gone) if not g)
        out.append((id_, len(content), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows() -> list[tuple]:
    rng = random.Random(8)
    passage, line = words(rng, 70), "x" * 10 + words(rng, 9)[:50]
    rows = [r for r in edge_rows() if r[0] not in (7, 8)]
    for i in range(60):
        parts = [words(rng, 20)]
        if i % 3 == 0:
            parts.append(passage)
        if i % 2:
            parts.append(line)
        rows.append((1000 - i, " ".join([*parts, words(rng, 10)]), "en", "src0", i))
    rows.append((2000, "ab" * 400, "en", "src0", 1))
    rows.append((2001, "ba" * 300 + "z", "en", "src0", 1))
    return rows


@pytest.mark.parametrize("limits", [{}, {"frequent": 3}, {"frequent": 3, "contexts": 4}, {"frequent": 10**9}])
def test_repeated_strings_go(spark, limits):
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as start", "3 as h")
    got = repeats.repeated_spans(docs, **limits).collect()
    columns = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(x[c] for c in columns) for x in got) == Counter(slow_removed(rows))
    assert all(sum(x["spans"][1::2]) - sum(x["spans"][::2]) == x["n_removed"] for x in got)


def test_repeated_strings_of_an_empty_table_and_long_texts(spark, nothing):
    assert repeats.repeated_spans(nothing).count() == 0
    long = words(random.Random(3), 60_000)
    docs = spark.createDataFrame([(2, long, "", "", 0), (1, long[1000:], "", "", 0)], SCHEMA)
    got = {x["id"]: x["n_removed"] for x in repeats.repeated_spans(docs).collect()}
    assert got == {1: 0, 2: len(long) - 1000}


def test_every_string_has_one_anchor_wherever_it_lies(monkeypatch):
    rng = random.Random(4)
    shared = bytes(rng.choices(b"abc ", k=300))
    parts = [bytes(rng.choices(b"abc ", k=rng.randint(0, 400))) + shared + b"tail" for _ in range(5)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.cumsum([0, *map(len, parts)])

    def anchors():
        found = {}
        for h, place, first, last in anchored(data, offsets):
            for a, p, f, l in zip(h.tolist(), place.tolist(), first.tolist(), last.tolist()):
                for start in range(f, l + 1):
                    assert start not in found
                    found[start] = (a, p - start)
        return found

    found = anchors()
    assert set(found) == {s for a, b in zip(offsets[:-1], offsets[1:]) for s in range(a, b - SPAN + 1)}
    same = defaultdict(set)
    for start, anchor in found.items():
        same[data[start : start + SPAN].tobytes()].add(anchor)
    assert all(len(x) == 1 for x in same.values())
    monkeypatch.setattr("fieldkin.llm.anchors.CHUNK", 97)
    assert anchors() == found


# -- lines --------------------------------------------------------------------------


def slow_lines(rows: list[tuple], separator: str, least: int | None) -> Counter:
    """What stays of each text: every unit is compared with all before it."""
    def normed(x):
        return re.sub("[A-Z]", lambda m: m.group().lower(), " ".join(re.split("[ \t\n\r\x0b\f]+", x))).strip(" ")

    def parts(x):
        cut = [0] + [m.end() for m in re.finditer("[.!?。！？](?![.!?。！？])[ \t\n\r\x0b\f]*", x)]
        return [x[a:b] for a, b in zip(cut, cut[1:] + [len(x)]) if a < b]

    units = []
    for at, (id_, text, *_) in enumerate(rows):
        start = 0
        for unit in (text or "").split(separator):
            units.append(((2**63 if id_ is None else id_), at, start, 0, normed(unit), bool(normed(unit))))
            inner, cut = start, parts(unit)
            for part in cut:
                fits = least is not None and len(cut) > 1 and len(normed(part)) >= least
                units.append(((2**63 if id_ is None else id_), at, inner, 1, normed(part), fits))
                inner += len(part)
            start += len(unit) + len(separator)
    seen, gone = set(), set()
    for _, at, start, kind, content, counts in sorted(units):
        if counts and content in seen:
            gone.add((at, start, kind))
        if counts:
            seen.add(content)
    out = Counter()
    for at, (id_, text, *_) in enumerate(rows):
        start, stays = 0, []
        for unit in (text or "").split(separator):
            inner, left = start, ""
            for part in parts(unit):
                left += "" if (at, inner, 1) in gone else part
                inner += len(part)
            if (at, start, 0) not in gone:
                stays.append(left)
            start += len(unit) + len(separator)
        out[id_, separator.join(stays)] += 1
    return out


def line_rows() -> list[tuple]:
    rng = random.Random(6)
    line, passage = words(rng, 9), words(rng, 60) + "."
    japanese = "これは句読点だけで区切られたとても長い一つの文であり、空白をまったく含まないので単語を数えることはできません。"
    texts = [
        (3, f"{line}\nshort one\n\n{line.upper()}"), (2, f"a b\n {line}  \nshort one"), (2, None), (None, line),
        (5, f"{line}\n\nb"), (5, f"{line}\n\nb"), (6, f"Before it. {passage} After it?!  {passage.upper()}"),
        (7, f"Something else! {passage}\tAnd \x0b more... "), (8, passage), (9, japanese + "短い。"),
        (10, "別の文。" + japanese + "終わり"), (11, japanese), (12, "one. two. three."), (13, "one. four."),
        (14, "\n".join(f"{words(rng, 12)}. {words(rng, 12)}." for _ in range(3000))),
    ]
    texts.append((15, texts[-1][1].replace("\n", " ")))
    return [(id_, text, "", "", 0) for id_, text in texts]


@pytest.mark.parametrize("sentence_chars", [None, 1, lines.SENTENCE_CHARS])
@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_repeated_lines_and_sentences_go(spark, edge, unit, sentence_chars):
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = lines.without_repeats(docs, unit, sentence_chars=sentence_chars).collect()
    assert Counter((x["id"], x["kept"]) for x in got) == slow_lines(rows, lines.SEPARATORS[unit], sentence_chars)
    texts = defaultdict(list)
    for id_, text, *_ in rows:
        texts[id_].append(text or "")
    for row in got:
        spans = row["spans"]
        assert spans == sorted(spans) and row["removed"] == len(spans) // 2
        assert row["chars"] == sum(spans[1::2]) - sum(spans[::2])
        assert all(b <= max(map(len, texts[row["id"]])) for b in spans)
    if sentence_chars is None:
        return
    kept = {x["id"]: x["kept"] for x in got}
    assert kept[8] == "" and kept[11] == "", "a passage within a line meets a line of its own"
    assert kept[10] == "別の文。終わり", "scripts without white space"
    got = lines.without_repeats(edge, unit, sentence_chars=sentence_chars)
    assert Counter((x["id"], x["kept"]) for x in got.collect()) == slow_lines(
        edge_rows(), lines.SEPARATORS[unit], sentence_chars)


def test_short_lines_stay_on_request(spark):
    rows = [(1, "a b\nc d e", "", "", 0), (2, "a b\nc d e", "", "", 0)]
    got = lines.without_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1), least_words=3).collect()
    assert {x["id"]: x["kept"] for x in got} == {1: "a b\nc d e", 2: "a b"}


def test_lines_of_an_empty_table(nothing):
    assert lines.without_repeats(nothing).count() == 0
