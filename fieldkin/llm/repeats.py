"""Substring dedup: a collection's suffixes sorted column by column, with common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldkin.llm.anchors import ANCHOR, CHOICES, SPAN, anchored
from fieldkin.llm.common import LAST_ID, numbered, slices, table, texts, utf8, whole_groups
from fieldkin.session import keep

#: Bytes of text handled at a time; contexts sorted together, one anchor's at least.
SLICE, COLLECTION = 1 << 20, 1 << 15
#: Frequent anchors are looked for in about so many documents, are in so many of them
#: or more, and are at most so many.
SAMPLE, FREQUENT, LISTED = 8_192, 8, 20_000
#: A frequent anchor with more different contexts than this is split by whole strings.
CONTEXTS = 250_000

#: Contexts are aligned at their anchor; a string starts in one of the first columns.
COLUMNS = CHOICES - 1 + SPAN
#: Bits of an anchor's hash that are compared while candidates are looked for.
_CANDIDATE = np.uint64((1 << 48) - 1)

_CONTEXTS = "left int, context binary, start long, rank long, row long"


# -- reading texts ------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = list(texts(batch.column("text")))
        digests = [hashlib.sha256(x).digest() for x in contents]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), pa.array([len(x) for x in contents], pa.int64()),
             pa.array(digests, pa.binary()), pa.array([_key(x) for x in digests], pa.int64())],
            ["row", "id", "length", "digest", "key"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are shuffled whole, so they are compressed first."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [packer.compress(x) for x in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(packed, pa.binary())], ["row", "packed"])


def _unpacked(column: pa.Array) -> list[bytes]:
    reader = zstandard.ZstdDecompressor()
    return [reader.decompress(x) for x in column.to_pylist()]


def _key(digest: bytes) -> int:
    """Equal for equal texts: copies of a text are one holder of its anchors."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Hash, place, first and last start of each run, and its text, some texts at a time."""
    for begin, end in slices(offsets, SLICE):
        own = offsets[begin : end + 1]
        for h, place, first, last in anchored(data[own[0] : own[-1]], own - own[0]):
            text = np.searchsorted(own - own[0], first, side="right") - 1 + begin
            yield h, place + own[0], first + own[0], last + own[0], text


def _listed(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _anchors(frequent: np.ndarray, contexts_of: bool = False):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor of a text once without the frequent ones, or only those with their contexts."""
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            view = memoryview(data)
            keys = np.array([_key(hashlib.sha256(view[a:b]).digest()) for a, b in zip(
                offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
            for h, place, first, last, text in _runs(data, offsets):
                h = h & _CANDIDATE
                rest = _listed(h, frequent) == contexts_of
                h, place, first, last, text = (x[rest] for x in (h, place, first, last, text))
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                columns = [pa.array(h[new].view(np.int64)), pa.array(keys[text[new]])]
                names = ["h", "key"]
                if contexts_of:
                    first, last = first[order][new], last[order][new]
                    columns.append(pa.array(np.array(
                        [xxhash.xxh64_intdigest(view[a : b + SPAN]) for a, b in zip(first.tolist(), last.tolist(), strict=True)],
                        np.uint64).view(np.int64)))
                    names.append("context")
                yield pa.RecordBatch.from_arrays(columns, names)
    return anchors


def _contexts(frequent: np.ndarray, ragged: np.ndarray, of_frequent: bool):
    """The contexts of the texts' candidate anchors, or those of the frequent anchors."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = _unpacked(batch.column("packed"))
            data = np.frombuffer(b"".join(contents), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in contents], dtype=np.int64)))
            rows, ranks = batch.column("row").to_numpy(), batch.column("rank").to_numpy()
            wanted, bounds = batch.column("hs").values, batch.column("hs").offsets.to_numpy()
            wanted = wanted.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for h, place, first, last, text in _runs(data, offsets):
                small = h & _CANDIDATE
                if of_frequent:
                    chosen = _listed(small, frequent)
                else:
                    chosen = np.zeros(len(h), bool)
                    cuts = np.searchsorted(text, np.arange(text[0], text[-1] + 2)) if len(text) else []
                    for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        own = int(text[0]) + at
                        chosen[a:b] = np.isin(small[a:b], wanted[bounds[own] : bounds[own + 1]])
                h, small, place, first, last, text = (x[chosen] for x in (h, small, place, first, last, text))
                if of_frequent and len(ragged):
                    # Each string on its own, under its own hash.
                    split = np.where(_listed(small, ragged), last - first + 1, 1)
                    run = np.repeat(np.arange(len(h)), split)
                    at = np.arange(len(run)) - np.repeat(np.cumsum(split) - split, split)
                    alone = split[run] > 1
                    h, place, first, last, text = h[run], place[run], first[run] + at, last[run], text[run]
                    last = np.where(alone, first, last)
                    single = np.flatnonzero(_listed(small[run], ragged))
                    view = memoryview(data)
                    h[single] = [xxhash.xxh64_intdigest(view[a : a + SPAN]) for a in first[single].tolist()]
                if not len(h):
                    continue
                size = last - first + SPAN
                ends = np.cumsum(size)
                source = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
                content = pa.Array.from_buffers(
                    pa.binary(), len(h),
                    [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data[source])])
                columns = [pa.array((place - first).astype(np.int32)), content, pa.array(first - offsets[text]),
                           pa.array(ranks[text]), pa.array(rows[text])]
                names = ["left", "context", "start", "rank", "row"]
                if of_frequent:
                    columns, names = [pa.array(h.view(np.int64)), *columns], ["h", *names]
                yield pa.RecordBatch.from_arrays(columns, names)
    return contexts


# -- the collection -----------------------------------------------------------------


def owners(columns: np.ndarray, first: np.ndarray, last: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The smallest rank that holds each string, by start column and context.

    ``columns`` has the contexts' bytes, one row per column. Round by round, from the
    last column to the first, one symbol of every context is put before what is sorted
    so far: a stable sort by that symbol gives the order of the longer suffixes, and
    the prefix that neighbours have in common is one more than the least between
    their places before, or nothing where the symbols differ. Suffixes with ``SPAN``
    common bytes are equal strings. Only the order and the prefixes of the last column
    are held; the symbols are read in sequence, column by column.
    """
    width, count = columns.shape
    order, common = np.arange(count), np.zeros(count + 1, np.uint8)
    out = np.full((CHOICES, count), LAST_ID, np.int64)
    for column in range(width - 1, -1, -1):
        symbols = columns[column][order]
        moved = np.argsort(symbols, kind="stable")
        symbols = symbols[moved]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        longer = np.zeros(count + 1, np.uint8)
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[::2], between[1::2] = moved[same - 1] + 1, moved[same] + 1
            longer[same] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[moved], longer
        if column < CHOICES:
            begins = np.flatnonzero(common[:count] < SPAN)
            inside = (first[order] <= column) & (column <= last[order])
            least = np.minimum.reduceat(np.where(inside, ranks[order], LAST_ID), begins)
            each = np.repeat(least, np.diff(np.append(begins, count)))
            out[column, order] = np.where(inside, each, LAST_ID)
    return out


def _columns(contexts: pa.Array, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts' bytes aligned at their anchors, and their first and last start column."""
    data, offsets = utf8(contexts)
    size = np.diff(offsets)
    first = CHOICES - 1 - left.astype(np.int64)
    out = np.zeros((COLUMNS, len(size)), np.uint8)
    run = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(run)) - offsets[run] + first[run]
    out[column, run] = data
    return out, first, first + size - SPAN


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of contexts that a smaller rank holds, as spans of their texts."""
    for group in whole_groups(batches, ["h"], COLLECTION):
        columns, first, last = _columns(group.column("context"), group.column("left").to_numpy())
        ranks = group.column("rank").to_numpy()
        gone = np.zeros((CHOICES + 2, len(ranks)), np.int8)
        gone[1:-1] = owners(columns, first, last, ranks) < ranks
        edges = np.diff(gone, axis=0)
        context, begin = np.nonzero((edges == 1).T)
        _, end = np.nonzero((edges == -1).T)
        base = group.column("start").to_numpy()[context] - first[context]
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.column("row").to_numpy()[context]), pa.array(base + begin), pa.array(base + end - 1 + SPAN)],
            ["row", "begin", "end"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each different context the runs of strings with the same owner."""
    for group in whole_groups(batches, ["h"], COLLECTION):
        columns, first, last = _columns(group.column("context"), group.column("left").to_numpy())
        held = owners(columns, first, last, group.column("rank").to_numpy()).T
        new = np.ones((len(first), CHOICES + 1), bool)
        new[:, 1:-1] = held[:, 1:] != held[:, :-1]
        context, begin = np.nonzero(new[:, :-1])
        _, end = np.nonzero(new[:, 1:])
        owner = held[context, begin]
        inside = owner < LAST_ID
        context, begin, end, owner = context[inside], begin[inside], end[inside] + 1, owner[inside]
        taken = group.select(["h", "left", "context"]).combine_chunks().take(pa.array(context))
        for part in taken.to_batches():
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(begin - first[context]), pa.array(end - first[context]), pa.array(owner)],
                ["h", "left", "context", "from", "to", "owner"])


# -- results ------------------------------------------------------------------------


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, runs, digests, spans = [], [], [], []
        for content, found in zip(_unpacked(batch.column("packed")), batch.column("found").to_pylist(), strict=True):
            merged: list[int] = []
            for start, end in sorted((x >> 31, (x >> 31) + (x & (1 << 31) - 1)) for x in found):
                if merged and start <= merged[-1]:
                    merged[-1] = max(merged[-1], end)
                else:
                    merged += [start, end]
            edges = [0, *merged, len(content)]
            digest = hashlib.sha256()
            for start, end in zip(edges[::2], edges[1::2], strict=True):
                digest.update(content[start:end])
            removed.append(sum(merged[1::2]) - sum(merged[::2]))
            runs.append(len(merged) // 2)
            spans.append(merged)
            digests.append(digest.digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
             pa.array(digests, pa.binary()), pa.array(spans, pa.list_(pa.int64()))],
            ["first_row", "removed", "runs", "kept", "spans"])


def _frequent(rows: DataFrame, count: int, sample: int, frequent: int, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of many texts, and those of them with too many different contexts for one task.

    A bounded list from a share of the documents. It decides how an anchor is handled,
    never whether.
    """
    share = max(count // sample, 1)
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("text")

    def listed(held: DataFrame, counted: str, least: int) -> np.ndarray:
        counts = held.repartition("h").groupBy("h").agg(F.count_distinct(counted).alias("n")).where(F.col("n") >= least)
        found = counts.orderBy(F.desc("n"), "h").limit(LISTED).collect()
        return np.array(sorted(x["h"] for x in found), np.int64).view(np.uint64)

    none = np.zeros(0, np.uint64)
    hashes = listed(some.mapInArrow(_anchors(none), "h long, key long"), "key", frequent)
    if not len(hashes):
        return none, none
    held = some.mapInArrow(_anchors(hashes, True), "h long, key long, context long")
    return hashes, listed(held, "context", contexts // share + 1)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE,
                   frequent: int = FREQUENT, contexts: int = CONTEXTS) -> DataFrame:
    """What stays of each text when repeated strings of 50 bytes go.

    A byte goes if a string of 50 bytes covers it that also starts in a row with a
    smaller identifier; strings are judged on the input. Texts are UTF-8, null is
    empty, and matches never cross texts. Rows without an identifier come after all
    others. Rows with the same identifier never remove from each other.

    Every string has one anchor, so equal strings meet at equal anchors:

    1. Equal texts are one text; all but the first identifier's copies go whole.
    2. Anchors that only one text holds are dropped.
    3. The contexts of the others, the strings around an anchor, are dealt out by
       anchor. Each task sorts its contexts' suffixes column by column and finds the
       equal strings by their common prefixes.
    4. Anchors that a sample shows to be frequent skip step 2. Of their contexts equal
       ones meet before the shuffle, the different ones are sorted, and all find their
       owners in a join whose large keys Spark can split. Frequent anchors with very
       many different contexts are split into the strings themselves.

    Candidates are compared by 48 bits of a hash and texts by 64; strings by all bytes.

    Columns: ``row``, ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``,
    ``spans`` (starts and ends of the removed runs in bytes of the text, in turn).
    """
    source = numbered(docs, id_column, text_column)
    rows = keep(
        source.mapInArrow(_digests, "row long, id long, length long, digest binary, key long")
        .withColumn("rank", F.coalesce("id", F.lit(LAST_ID))), "digests")
    firsts = rows.groupBy("digest").agg(F.min(F.struct("rank", "row", "key")).alias("first")).select(
        "digest", F.col("first.rank").alias("first_rank"), F.col("first.row").alias("first_row"), F.col("first.key").alias("key"))
    listed, ragged = _frequent(source, rows.count(), sample, frequent, contexts)
    holders = source.select("text").mapInArrow(_anchors(listed), "h long, key long").repartition("h")
    one = Window.partitionBy("h")
    shared = holders.withColumn("low", F.min("key").over(one)).withColumn("high", F.max("key").over(one))
    wanted = shared.where("low <> high").groupBy("key").agg(F.collect_set("h").alias("hs"))
    units = firsts.drop("digest").join(wanted, "key", "left").select(
        F.col("first_row").alias("row"), F.col("first_rank").alias("rank"),
        F.coalesce("hs", F.array().cast("array<long>")).alias("hs"))
    contents = source.select("row", "text").mapInArrow(_packed, "row long, packed binary")
    told = contents.join(units, "row").select("row", "rank", "hs", "packed")
    rare = told.mapInArrow(_contexts(listed, ragged, False), _CONTEXTS)
    anchor = F.substring("context", F.col("left") + 1, F.lit(ANCHOR))
    spans = (
        rare.repartition(F.xxhash64(anchor)).sortWithinPartitions(anchor).withColumn("h", F.xxhash64(anchor))
        .mapInArrow(_removed, "row long, begin long, end long")
    )
    if len(listed):
        often = told.mapInArrow(_contexts(listed, ragged, True), f"h long, {_CONTEXTS}")
        different = often.groupBy("h", "left", "context").agg(F.min("rank").alias("rank"))
        held = different.repartition("h").sortWithinPartitions("h").mapInArrow(
            _owned, "h long, left int, context binary, from long, to long, owner long")
        spans = spans.unionAll(
            often.join(held, ["h", "left", "context"]).where("owner < rank").select(
                "row", (F.col("start") + F.col("from")).alias("begin"), (F.col("start") + F.col("to") - 1 + SPAN).alias("end")))
    # Begin and length in one number, so that a span takes eight bytes of the shuffle.
    span = F.shiftleft("begin", 31).bitwiseOR(F.col("end") - F.col("begin"))
    cut = contents.join(spans.groupBy("row").agg(F.collect_list(span).alias("found")), "row")
    results = cut.select("row", "packed", "found").mapInArrow(
        _kept, "first_row long, removed long, runs long, kept binary, spans array<long>")
    copy = (F.col("rank") > F.col("first_rank")) & (F.col("length") >= SPAN)
    return rows.join(firsts.drop("key"), "digest").join(results, "first_row", "left").select(
        "row", "id", F.col("length").alias("n_bytes"),
        F.when(copy, F.col("length")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("runs", F.lit(0))).alias("n_spans"),
        F.lower(F.hex(F.when(copy, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "digest")))).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0).cast("long"), F.col("length"))).otherwise(
            F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"))


def op3_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """What stays of every document without strings of 50 bytes of documents before it."""
    return repeated_spans(table(spark, directory, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
