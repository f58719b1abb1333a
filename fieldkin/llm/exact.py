"""Exact dedup by Patricia tries: terminal nodes own the copies of a text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.llm.common import numbered, numbered_rows, table, texts, utf8

_ROWS = "id long, row long, length long, digest binary"
_TEXTS = "length long, hash long, digest binary, content binary, id long, row long, rows long"
_OWNERS = "length long, digest binary, keep_id long, keep_row long, group_size long"


class Trie:
    """A compressed radix trie over byte strings.

    A node is ``[label, children, owner]``; children are found by the first byte of
    their label. An owner is ``(rank, rows, payload)``: the smallest rank seen, all
    rows counted, and what came with that rank.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def insert(self, content: bytes, rank: tuple, rows: int, payload: object) -> None:
        node, at = self.root, 0
        while at < len(content):
            child = node[1].get(content[at])
            if child is None:
                child = node[1][content[at]] = [content[at:], {}, None]
                node = child
                break
            label = child[0]
            if content.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _common(label, content, at)
            fork = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][content[at]] = fork
            node, at = fork, at + shared
        owner = node[2]
        if owner is None:
            node[2] = (rank, rows, payload)
        elif rank < owner[0]:
            node[2] = (rank, owner[1] + rows, payload)
        else:
            node[2] = (owner[0], owner[1] + rows, owner[2])

    def owners(self) -> Iterator[tuple]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())


def _common(label: bytes, content: bytes, at: int) -> int:
    """Equal leading bytes, by halving: slices compare in C."""
    low, high = 0, min(len(label), len(content) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == content[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = [x.lower() for x in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"),
             pa.array([len(x) for x in contents], pa.int64()),
             pa.array([hashlib.sha256(x).digest() for x in contents], pa.binary())],
            ["id", "row", "length", "digest"])


def _distinct(largest: bool):
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text of a batch, so copies meet before they are shuffled."""
        for batch in batches:
            found: dict[bytes, list] = {}
            ids, rows = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            for content, id_, row in zip(texts(batch.column("text")), ids, rows, strict=True):
                content = content.lower()
                digest = hashlib.sha256(content).digest()
                rank = _rank(id_, row, largest)
                if (known := found.get(digest)) is None:
                    found[digest] = [content, rank, id_, row, 1]
                else:
                    known[4] += 1
                    if rank < known[1]:
                        known[1:4] = rank, id_, row
            kept = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x[0]) for x in kept], pa.int64()),
                 pa.array(np.array([xxhash.xxh64_intdigest(x[0]) for x in kept], np.uint64).view(np.int64)),
                 pa.array(list(found), pa.binary()),
                 pa.array([x[0] for x in kept], pa.binary()),
                 pa.array([x[2] for x in kept], pa.int64()),
                 pa.array([x[3] for x in kept], pa.int64()),
                 pa.array([x[4] for x in kept], pa.int64())],
                ["length", "hash", "digest", "content", "id", "row", "rows"])
    return distinct


def _rank(id_: int | None, row: int, largest: bool) -> tuple:
    return (id_ is None, 0 if id_ is None else -id_ if largest else id_, row)


def _owned(largest: bool):
    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Owners of each length and hash; a finished group's subtree leaves memory."""
        trie, group = Trie(), None
        for batch in batches:
            done: list[tuple] = []
            data, offsets = utf8(batch.column("content"))
            view = memoryview(data)
            columns = [batch.column(x).to_pylist() for x in ("length", "hash", "digest", "id", "row", "rows")]
            for at, (length, hash_, digest, id_, row, rows) in enumerate(zip(*columns, strict=True)):
                if (length, hash_) != group:
                    done.extend(trie.owners())
                    trie, group = Trie(), (length, hash_)
                content = bytes(view[offsets[at] : offsets[at + 1]])
                trie.insert(content, _rank(id_, row, largest), rows, (length, digest, id_, row))
            yield _batch(done)
        yield _batch(list(trie.owners()))
    return owned


def _batch(owners: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[2][0] for x in owners], pa.int64()),
         pa.array([x[2][1] for x in owners], pa.binary()),
         pa.array([x[2][2] for x in owners], pa.int64()),
         pa.array([x[2][3] for x in owners], pa.int64()),
         pa.array([x[1] for x in owners], pa.int64())],
        ["length", "digest", "keep_id", "keep_row", "group_size"])


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     keep: str = "largest") -> DataFrame:
    """The group of equal texts of every row, and the row of each group that stays.

    Texts are equal when their bytes are, after A-Z are lower-cased; null is the empty
    text. The row with the largest (``keep="largest"``) or smallest identifier stays.
    Rows without an identifier stay only where a group has no other; of rows that
    repeat an identifier and a text, the first of the table stays.

    Texts are dealt out by length and content hash and inserted whole into one trie
    per length and hash, whose terminal nodes hold the owner and the row count. The
    tries see one row per text and Arrow batch; all rows then find their owner by
    length and digest in a join whose large keys Spark can split.

    Columns: ``row``, ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    """
    largest = keep == "largest"
    rows = numbered(docs, id_column, text_column)
    owners = (
        rows.mapInArrow(_distinct(largest), _TEXTS)
        .repartition("length", "hash").sortWithinPartitions("length", "hash")
        .mapInArrow(_owned(largest), _OWNERS)
    )
    return rows.mapInArrow(_digests, _ROWS).join(owners, ["length", "digest"]).select(
        "row", "id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Owner, group size and digest of every document; the largest doc_id stays."""
    return exact_duplicates(table(spark, directory, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def without_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    row = "__llm_row"
    kept = exact_duplicates(docs).where("kept").select(F.col("row").alias(row))
    return numbered_rows(docs, row).join(kept, row, "left_semi").drop(row)


OP9_SQL = r"""
WITH normal AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(content) AS text_sha256
FROM normal
WINDOW same AS (PARTITION BY content)
"""
