"""SimHash near-dedup: fingerprints in a binary trie joined with itself."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.llm.common import LAST_ID, numbered, numbered_rows, table, texts, whole_groups
from fieldkin.llm.components import stars
from fieldkin.session import keep

SEED = 42
BITS = 64
#: Fingerprints per subtrie that the first depth aims at, and the most that a pair of
#: subtries may hold before it is split further.
SUBTRIE, PAIR = 2_048, 100_000


def fingerprint(content: bytes, shingle: int = 3) -> int:
    """The SimHash of a text: a bit is set when over half of the shingles' hashes set it."""
    words = content.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in texts(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(found.view(np.int64))], ["id", "row", "fp"])
    return fingerprints


def _masks(bits: int, errors: int) -> list[int]:
    """All differences of at most ``errors`` of so many bits."""
    return [sum(1 << b for b in chosen) for n in range(errors + 1) for chosen in combinations(range(bits), n)]


def _paired(prefix: Column, other: Column, depth: Column) -> list[Column]:
    return [depth.alias("depth"), F.least(prefix, other).alias("lo"), F.greatest(prefix, other).alias("hi"), F.col("fp")]


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def subtrie_pairs(fingerprints: DataFrame, count: int, errors: int) -> DataFrame:
    """Each fingerprint in every pair of subtries that it may have partners in.

    The upper trie is walked by arithmetic: two subtries of a depth are a pair when
    their prefixes differ in at most ``errors`` bits. Pairs with too many
    fingerprints are walked deeper, four levels at a time, the others stay.
    """
    depth = min(max(math.ceil(math.log2(max(count, 1) / SUBTRIE)), 0), 20)
    masks = F.array(*[F.lit(x).cast("long") for x in _masks(depth, errors)])
    pairs = (
        fingerprints.select("fp", F.explode(masks).alias("mask"))
        .select(*_paired(_prefix(depth), _prefix(depth).bitwiseXOR(F.col("mask")), F.lit(depth)))
    )
    done: list[DataFrame] = []
    while True:
        large = keep(pairs.groupBy("depth", "lo", "hi").count().where(F.col("count") > PAIR).drop("count"), "pairs")
        if large.isEmpty() or depth == BITS:
            break
        done.append(pairs.join(large, ["depth", "lo", "hi"], "left_anti"))
        step = min(4, BITS - depth)
        own = F.shiftrightunsigned("fp", BITS - depth - step) if depth + step < BITS else F.col("fp")
        # The partner's prefix is the one of the two that is not the fingerprint's own.
        partner = F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(_prefix(depth))
        masks = F.array(*[F.lit(x).cast("long") for x in _masks(step, errors)])
        low = own.bitwiseAND(F.lit((1 << step) - 1)).bitwiseXOR(F.col("mask"))
        pairs = (
            pairs.join(large, ["depth", "lo", "hi"], "left_semi")
            .select("fp", partner.alias("partner"), F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))).alias("spent"),
                    F.explode(masks).alias("mask"))
            .where(F.col("spent") + F.bit_count("mask") <= errors)
            .select(*_paired(own, F.shiftleft("partner", step).bitwiseOR(low), F.lit(depth + step)))
        )
        depth += step
    for other in done:
        pairs = pairs.unionAll(other)
    return pairs


def joined_tries(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int,
                 leaf: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted fingerprints that differ in at most ``errors`` bits.

    ``right`` is None for a trie joined with itself. A node is a run of the sorted
    array. Pairs of nodes go down together, one bit a step, all pairs of a level at
    once; differing bits are added up, and a pair over the budget is dropped with all
    below it. Pairs of few leaves are compared directly.
    """
    alone, right = right is None, left if right is None else right
    shared = BITS if not len(left) or not len(right) else depth
    a0, a1 = np.array([0]), np.array([len(left)])
    b0, b1 = np.array([0]), np.array([len(right)])
    spent = np.array([bin(int(left[0] ^ right[0]) >> (BITS - depth)).count("1") if depth and shared < BITS else 0])
    found_a, found_b = [], []
    for level in range(shared, BITS + 1):
        small = (a1 - a0) * (b1 - b0) <= leaf
        if level == BITS:
            small[:] = True
        if small.any():
            x, y = _products(a0[small], a1[small], b0[small], b1[small])
            if alone:
                ordered = x < y
                x, y = x[ordered], y[ordered]
            near = np.bitwise_count(left[x] ^ right[y]) <= errors
            found_a.append(x[near])
            found_b.append(y[near])
            a0, a1, b0, b1, spent = (v[~small] for v in (a0, a1, b0, b1, spent))
        if level == BITS or not len(a0):
            break
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        am, bm = _split(left, a0, a1, bit), _split(right, b0, b1, bit)
        twin = (a0 == b0) & (a1 == b1) & alone
        parts = []
        for (p0, p1), (q0, q1), cost in (((a0, am), (b0, bm), 0), ((am, a1), (bm, b1), 0),
                                         ((a0, am), (bm, b1), 1), ((am, a1), (b0, bm), 1)):
            lives = (p1 > p0) & (q1 > q0) & (spent + cost <= errors)
            if cost and p0 is am:
                lives &= ~twin  # a node with itself: the mirrored pair is the one before
            parts.append([v[lives] for v in (p0, p1, q0, q1)] + [spent[lives] + cost])
        a0, a1, b0, b1, spent = (np.concatenate(v) for v in zip(*parts, strict=True))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where each run's values with ``bit`` begin."""
    above = ~np.uint64(0) << np.uint64(int(bit).bit_length() - 1)
    return np.clip(np.searchsorted(values, (values[low] & above) | bit), low, high)


def _products(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of each pair of runs."""
    width = b1 - b0
    sizes = (a1 - a0) * width
    run = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a0[run] + at // width[run], b0[run] + at % width[run]


def _forest(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches."""
    root = np.arange(size)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _linked(errors: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each subtrie pair a spanning forest of its links."""
        for group in whole_groups(batches, ["depth", "lo", "hi"], 1):
            depths, lows, highs = (group.column(x).to_numpy() for x in ("depth", "lo", "hi"))
            prints = group.column("fp").to_numpy().view(np.uint64)
            change = (np.diff(depths) != 0) | (np.diff(lows) != 0) | (np.diff(highs) != 0)
            bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [len(prints)]))
            us, vs = [], []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                values, depth = np.unique(prints[start:end]), int(depths[start])
                if lows[start] == highs[start]:
                    x, y = joined_tries(values, None, depth, errors)
                else:
                    own = values >> np.uint64(BITS - depth) == np.array(lows[start], np.int64).view(np.uint64)
                    a, b = np.flatnonzero(own), np.flatnonzero(~own)
                    if not len(a) or not len(b):
                        continue
                    x, y = joined_tries(values[a], values[b], depth, errors)
                    x, y = a[x], b[y]
                root = _forest(len(values), x, y)
                moved = np.flatnonzero(root != np.arange(len(values)))
                us.append(values[moved])
                vs.append(values[root[moved]])
            u, v = (np.concatenate(w) if w else np.zeros(0, np.uint64) for w in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    return linked


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    shingle: int = 3, errors: int = 2) -> DataFrame:
    """Fingerprint and component of every row.

    Texts are cut at ASCII white space after A-Z are lower-cased. Each run of
    ``shingle`` words is hashed, repeats included; shorter texts are one shingle, and
    texts without words, null among them, have fingerprint zero and are linked like
    any other. Fingerprints link at ``errors`` or fewer differing bits, and rows with
    linked fingerprints are one component.

    Equal fingerprints meet before anything is joined. Distinct ones are dealt out by
    pairs of subtries, whose links leave a task as a spanning forest.

    Columns: ``row``, ``id``, ``fp`` (64 bits), ``component_id`` (the smallest
    identifier; null if no row of the component has one), ``component_row`` (the row
    with that identifier, the first of several).
    """
    rows = keep(
        numbered(docs, id_column, text_column).mapInArrow(_fingerprints(shingle), "id long, row long, fp long"),
        "fingerprints")
    first = F.min(F.struct(F.coalesce("id", F.lit(LAST_ID)).alias("rank"), "row", "id"))
    prints = keep(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    edges = (
        subtrie_pairs(prints.select("fp"), prints.count(), errors)
        .repartition("depth", "lo", "hi").sortWithinPartitions("depth", "lo", "hi")
        .mapInArrow(_linked(errors), "u long, v long")
    )
    roots = stars(edges)
    prints = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    components = prints.groupBy("root").agg(F.min("first").alias("first"))
    named = prints.drop("first").join(components, "root").select(
        "fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("component_row"))
    return rows.join(named, "fp").select("row", "id", "fp", "component_id", "component_row")


def op10_simhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, directory, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def without_near_copies(docs: DataFrame, shingle: int = 3, errors: int = 2) -> DataFrame:
    """One document of each component, with its own columns."""
    row = "__llm_row"
    kept = near_duplicates(docs, shingle=shingle, errors=errors).where("row = component_row").select(F.col("row").alias(row))
    return numbered_rows(docs, row).join(kept, row, "left_semi").drop(row)
