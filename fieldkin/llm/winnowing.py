"""Benchmark decontamination by winnowing: shared fingerprints, extended to shared windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.llm.common import numbered, numbered_rows, slices, table, utf8

#: Words per window, per fingerprint, and fingerprints that one is chosen from: a
#: window holds exactly GUARD fingerprints, so it always contains a chosen one.
WINDOW, GRAM = 13, 5
GUARD = WINDOW - GRAM + 1
#: Benchmark bytes that may be handed to all tasks; a larger benchmark goes in blocks.
BLOCK_BYTES = 16 << 20
#: Bytes of documents, and pairs of fingerprints, handled at a time.
SLICE, PAIRS = 1 << 20, 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Hashes of the words of many texts, and where each text's words begin.

    Words are runs of ASCII letters, digits and all bytes of other characters; A-Z
    are lower-cased. A word's hash is a polynomial over its bytes, taken from sums
    over the whole text, so no word is cut out.
    """

    def __init__(self) -> None:
        self.letter = np.zeros(256, bool)
        for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
            self.letter[low : high + 1] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 32
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(data)
        if size > len(self.up):
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        inside = self.letter[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((self.lower[data].astype(np.uint64) + np.uint64(1)) * self.up[:size], dtype=np.uint64, out=sums[1:])
        hashes = (sums[ends] - sums[begins]) * self.down[begins]
        return _mixed(hashes ^ (ends - begins).astype(np.uint64)), np.searchsorted(begins, offsets)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words."""
    count = max(len(words) - size + 1, 0)
    out = np.zeros(count, np.uint64)
    for at in range(size):
        out = out * _BASE + words[at : at + count]
    return _mixed(out)


def chosen(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the smallest gram, the leftmost of equals, of each whole window of a text."""
    if len(grams) < GUARD:
        return np.zeros(0, np.int64)
    place, span = np.arange(len(grams)), 1
    while span < GUARD:
        step = min(span, GUARD - span)
        left, right = place[:-step], place[step:]
        place = np.where(grams[right] < grams[left], right, left)
        span += step
    starts = np.arange(len(place))
    text = np.searchsorted(bounds, starts, side="right") - 1
    return np.unique(place[starts + WINDOW <= bounds[text + 1]])


class Benchmark:
    """Fingerprints of the items of 13 words or more; hashes of shorter ones as a whole."""

    def __init__(self, ids: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        self.ids = np.array(ids, object)
        self.words, self.bounds = Words()(data, offsets)
        place = chosen(_grams(self.words, GRAM), self.bounds)
        self.prints, self.places = _sorted(_grams(self.words, GRAM)[place], place)
        sizes = np.diff(self.bounds)
        self.short = {}
        for size in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)]).tolist():
            place = self.bounds[:-1][sizes == size]
            self.short[size] = _sorted(_grams(self.words, size)[place], place)


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _joined(keys: np.ndarray, prints: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``keys`` with each place of an equal fingerprint, some pairs at a time."""
    if not len(prints) or not len(keys):
        return
    low = np.searchsorted(prints, keys, side="left")
    match = np.flatnonzero(prints[np.minimum(low, len(prints) - 1)] == keys)
    low = low[match]
    count = np.searchsorted(prints, keys[match], side="right") - low
    total = np.concatenate(([0], np.cumsum(count)))
    for first, last in slices(total, PAIRS):
        run = np.repeat(np.arange(first, last), count[first:last])
        at = np.arange(len(run)) - (total[run] - total[first])
        yield match[run], places[low[run] + at]


def contaminated_words(words: np.ndarray, bounds: np.ndarray, bench: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words lie in an occurrence of a window; pairs of texts and items with one."""
    other, other_bounds = bench["words"], bench["bounds"]
    steps = np.zeros(len(words) + 1, np.int64)
    texts_, items = [], []

    def found(p: np.ndarray, q: np.ndarray, before: np.ndarray, size: np.ndarray) -> None:
        np.add.at(steps, p - before, 1)
        np.add.at(steps, p - before + size, -1)
        pair = np.stack([np.searchsorted(bounds, p, side="right") - 1, np.searchsorted(other_bounds, q, side="right") - 1])
        pair = np.unique(pair, axis=1)
        texts_.append(pair[0])
        items.append(pair[1])

    grams = _grams(words, GRAM)
    place = chosen(grams, bounds)
    for at, q in _joined(grams[place], bench["prints"], bench["places"]):
        p = place[at]
        text = np.searchsorted(bounds, p, side="right") - 1
        item = np.searchsorted(other_bounds, q, side="right") - 1
        same = np.ones(len(p), bool)
        for step in range(GRAM):
            same &= words[p + step] == other[q + step]
        reach = []
        for sign, begin in ((-1, 0), (1, GRAM - 1)):
            alive, far = same.copy(), np.zeros(len(p), np.int64)
            for step in range(1, GUARD):
                a, b = p + begin + sign * step, q + begin + sign * step
                alive &= (a >= bounds[text]) & (a < bounds[text + 1]) & (b >= other_bounds[item]) & (b < other_bounds[item + 1])
                live = np.flatnonzero(alive)
                alive[live] = words[a[live]] == other[b[live]]
                far += alive
            reach.append(far)
        size = reach[0] + GRAM + reach[1]
        whole = same & (size >= WINDOW)
        found(p[whole], q[whole], reach[0][whole], size[whole])
    for size, (prints, places) in bench["short"].items():
        grams = _grams(words, size)
        for p, q in _joined(grams, prints, places):
            same = p + size <= bounds[np.searchsorted(bounds, p, side="right")]
            for step in range(size):
                same &= words[p + step] == other[q + step]
            p, q = p[same], q[same]
            found(p, q, np.zeros(len(p), np.int64), np.full(len(p), size))
    hit = np.cumsum(steps)[:-1] > 0
    none = [np.zeros(0, np.int64)]
    pairs = np.unique(np.stack([np.concatenate(texts_ or none), np.concatenate(items or none)]), axis=1)
    return hit, pairs[0], pairs[1]


_FOUND = "id long, row long, n_words long, spans array<long>, items array<string>"


def _found(bench: Broadcast):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_words, known = Words(), bench.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            counts, spans, items = [], [], []
            for first, last in slices(offsets, SLICE):
                own = offsets[first : last + 1] - offsets[first]
                words, bounds = to_words(data[offsets[first] : offsets[last]], own)
                hit, texts_, which = contaminated_words(words, bounds, known)
                counts += np.diff(bounds).tolist()
                if not len(texts_):
                    spans += [[]] * (last - first)
                    items += [[]] * (last - first)
                    continue
                cut = np.searchsorted(texts_, np.arange(last - first + 1))
                for at in range(last - first):
                    if cut[at] == cut[at + 1]:
                        spans.append([])
                        items.append([])
                        continue
                    inside = np.concatenate(([0], hit[bounds[at] : bounds[at + 1]].view(np.int8), [0]))
                    spans.append(np.flatnonzero(np.diff(inside)).tolist())
                    items.append(known["ids"][which[cut[at] : cut[at + 1]]].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(counts, pa.int64()),
                 pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["id", "row", "n_words", "spans", "items"])
    return found


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of all blocks of the benchmark, and the columns that follow from them."""
    for batch in batches:
        spans, hits, items, digests = [], [], [], []
        for parts in batch.column("spans").to_pylist():
            merged: list[int] = []
            for start, end in sorted(p for x in parts for p in zip(x[::2], x[1::2], strict=True)):
                if merged and start <= merged[-1]:
                    merged[-1] = max(merged[-1], end)
                else:
                    merged += [start, end]
            spans.append(merged)
            hits.append(sum(merged[1::2]) - sum(merged[::2]))
        for parts in batch.column("items").to_pylist():
            names = sorted({x for part in parts for x in part})
            items.append(names)
            digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"), batch.column("n_words"), pa.array(hits, pa.int64()),
             pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
             pa.array(digests, pa.string())],
            ["id", "row", "n_words", "n_hit", "spans", "items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_id_column: str = "item_id", item_text_column: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The words of every row that lie in a window of a benchmark item, and those items.

    A window is 13 consecutive words of an item, or all of an item with fewer. Of each
    window both sides keep the smallest of its fingerprints of 5 words. Equal kept
    fingerprints are extended in both directions, as far as a window can reach, and
    count where 13 words or more agree. Every shared window is found, since both sides
    keep the same fingerprint of it. Words are compared by 64-bit hashes.

    The benchmark is handed to all tasks when its texts fit ``block_bytes``; else it is
    cut into blocks by a hash of its items, the documents are read once per block, and
    the spans of the blocks are united. Null texts have no words. Items that repeat an
    identifier count as one; those without an identifier are named by the empty string.

    Columns: ``row``, ``id``, ``n_words``, ``n_hit``, ``spans`` (starts and ends of the
    runs of hit words, in turn), ``items`` (identifiers as sorted strings), ``items_sha256``.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_id_column).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text_column).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = max(-(-size // block_bytes), 1)
    rows = numbered(docs, id_column, text_column)
    parts = []
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        bench = Benchmark(held.column("item").to_pylist(), *utf8(held.column("text")))
        shared = spark.sparkContext.broadcast(vars(bench))
        parts.append(rows.mapInArrow(_found(shared), _FOUND))
    if blocks == 1:
        merged = parts[0].select("id", "row", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionAll(part)
        merged = merged.groupBy("row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"),
        ).select("id", "row", "n_words", "spans", "items")
    return merged.mapInArrow(
        _united, "id long, row long, n_words long, n_hit long, spans array<long>, items array<string>, items_sha256 string")


#: A document is contaminated when this share of its words, or more, is hit.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def op8_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Words, hit words and items of every document against the benchmark."""
    found = contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        "items_sha256", F.expr(CONTAMINATED).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    row = "__llm_row"
    clean = contamination(docs, benchmark).where(f"not ({CONTAMINATED})").select(F.col("row").alias(row))
    return numbered_rows(docs, row).join(clean, row, "left_semi").drop(row)
