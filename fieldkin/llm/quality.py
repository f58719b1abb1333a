"""Quality classifier: averaged subword embeddings and a softmax, learned by gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.llm.common import numbered, slices, table, utf8
from fieldkin.session import keep

#: Most labelled documents that the model is learned from.
SAMPLE = 4_000
#: Rows of the embedding, a power of two within a 16-bit number, and their length.
BUCKETS, DIMENSIONS = 1 << 15, 8
#: Lengths of the character n-grams of a word, in bytes of UTF-8, its ends included.
NGRAMS = (3, 4, 5)
#: A longer word is taken as words of at most so many bytes, so every byte counts.
PIECE = 64
#: Passes over the sample, and the step of the first; it falls to zero evenly.
EPOCHS, STEP, SEED = 6, 0.1, 42
#: Bytes that are gone through at a time.
PART = 1 << 19
#: The feature of a word after itself.
REPEATED = 1
# Odd multipliers of the hashes, and the marks at the ends of a word.
STRIDE, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
POWERS = np.random.default_rng(SEED).integers(0, 2**63, PIECE + 2, np.uint64) * np.uint64(2) + np.uint64(1)
OPENS, CLOSES = np.uint64(256), np.uint64(257)
SOLID = np.array([not (9 <= x <= 13 or x == 32) for x in range(256)])
THRESHOLD = 0.5


class Model(NamedTuple):
    """An embedding per hashed feature, a weight vector and an offset per class."""

    embedding: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray


def bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * MIXER) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def occurrences(data: np.ndarray, offsets: np.ndarray, seam: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, feature)`` arrays of all words, pairs of words and n-grams of the texts.

    Words lie between ASCII white space, case kept, and are framed by two marks that
    no byte equals. A word after itself is one feature whatever the word, so repetition
    is learned from the words of the sample and seen in any others. ``seam`` holds the
    hash of the word before, for a text that is gone through in parts.
    """
    at = np.flatnonzero(SOLID[data])
    if not len(at):
        return
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[at]
    begins = np.concatenate(([True], (np.diff(at) > 1) | (row[1:] != row[:-1])))
    start = np.flatnonzero(begins)
    begins |= (np.arange(len(at)) - start[np.cumsum(begins) - 1]) % PIECE == 0
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, len(at))) + 2
    first = start + 2 * np.arange(len(start))
    framed = np.full(len(at) + 2 * len(start), OPENS)
    framed[np.arange(len(at)) + 2 * np.cumsum(begins) - 1] = data[at]
    framed[first + size - 1] = CLOSES
    owner, end = np.repeat(row[start], size), np.repeat(first + size, size)
    grams = framed
    for n in range(2, max(NGRAMS) + 1):
        grams = grams[:-1] * STRIDE + framed[n - 1 :]
        if n in NGRAMS:
            whole = np.arange(n, len(framed) + 1) <= end[: len(grams)]
            yield owner[: len(grams)][whole], bucket(grams[whole] + np.uint64(n))
    words = np.add.reduceat(framed * POWERS[np.arange(len(framed)) - np.repeat(first, size)], first)
    yield row[start], bucket(words)
    rows = row[start]
    if seam:
        words, rows = np.concatenate((seam, words)), np.concatenate((rows[:1], rows))
    near = rows[1:] == rows[:-1]
    before, after = words[:-1][near], words[1:][near]
    yield rows[1:][near], np.where(before == after, REPEATED, bucket(before * STRIDE + after))
    if seam is not None:
        seam[:] = [words[-1]]


def parts_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Iterator]]:
    """Runs of rows and their occurrences, at most about :data:`PART` bytes at a time."""
    for first, last in slices(offsets, PART):
        low, high = int(offsets[first]), int(offsets[last])
        seam: list | None = [] if high - low > PART else None
        while True:
            cut = high
            if high - low > PART:
                white = np.flatnonzero(~SOLID[data[low : low + PART]])
                cut = low + (int(white[-1]) + 1 if len(white) else PART - PART % PIECE)
            yield first, last, occurrences(data[low:cut], np.minimum(offsets[first : last + 1], cut) - low if seam is None
                                           else np.array([0, cut - low]), seam)
            if cut == high:
                break
            low = cut


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        counts: dict[int, np.ndarray] = {}
        features: list = [np.zeros(0, np.int16)] * batch.num_rows
        shares: list = [np.zeros(0, np.float32)] * batch.num_rows
        for first, last, found in parts_of(data, offsets):
            for row, feature in found:
                for n in range(last - first):
                    low, high = np.searchsorted(row, (n, n + 1))
                    counts.setdefault(first + n, np.zeros(BUCKETS, np.int64))
                    counts[first + n] += np.bincount(feature[low:high], minlength=BUCKETS)
            # A long text comes in several parts, as the last of its run.
            for n in [x for x in counts if x < first or last - first > 1]:
                features[n], shares[n] = _shares(counts.pop(n))
        for n, found in counts.items():
            features[n], shares[n] = _shares(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("label"), pa.array(features, pa.list_(pa.int16())),
             pa.array(shares, pa.list_(pa.float32()))], ["row", "label", "features", "shares"])


def _shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different features of a text and each one's share of all its occurrences."""
    present = np.flatnonzero(counts)
    return present.astype(np.int16), (counts[present] / max(counts.sum(), 1)).astype(np.float32)


def sample_of(docs: DataFrame, labels: DataFrame, learnable: Column, id_column: str, text_column: str,
              label_column: str, rows: int = SAMPLE) -> DataFrame:
    """``(row, label, features, shares)`` of at most ``rows`` labelled documents.

    A document whose labels contradict each other teaches nothing. Which rows are
    taken is decided by a hash of identifier and row, so it is the same in every run.
    """
    label = F.col(label_column).cast("int")
    clear = (
        labels.where(label.isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).cast("long").alias("id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other").drop("other")
    )
    rows_of = numbered(docs.where(learnable), id_column, text_column)
    chosen = rows_of.select("id", "row").join(clear, "id").orderBy(F.xxhash64("id", "row"), "row").limit(rows)
    chosen = keep(chosen.select("row", "label"), "chosen")
    texts_of = rows_of.select("row", "text").join(chosen, "row")
    # A number of its own keeps small partitions apart: features cost more than their bytes show.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts_of.repartition(parts, "row").mapInArrow(
        _featured, "row long, label int, features array<smallint>, shares array<float>")


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def fit(features: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, classes: int,
        epochs: int = EPOCHS, step: float = STEP, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the cross entropy, one text a step.

    A text is the mean of its features' embeddings. The step of the embeddings is
    divided by the squared length of the shares, so that a text of many features
    moves its mean as far as one of few.
    """
    random = np.random.default_rng(seed)
    embedding = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((classes, DIMENSIONS))
    # Without any evidence the classes are as frequent as in the sample.
    offsets = np.log((np.bincount(labels, minlength=classes) + 1) / (len(labels) + classes))
    targets = np.eye(classes)
    done, total = 0, max(epochs * len(labels), 1)
    for _ in range(epochs):
        for at in random.permutation(len(labels)):
            now = step * (1 - done / total)
            done += 1
            ids, share = features[at], shares[at]
            if not len(ids):
                continue
            mean = share @ embedding[ids]
            wrong = softmax(weights @ mean + offsets) - targets[labels[at]]
            back = wrong @ weights
            weights -= now * np.outer(wrong, mean)
            offsets -= now * 0.1 * wrong
            embedding[ids] -= np.outer(share, back * (now / (share @ share)))
    return Model(embedding, weights, offsets)


def learn(sample: DataFrame, classes: int = 2, **how) -> Model:
    """The model of a bounded sample, whose features are gathered on the driver."""
    found = sample.orderBy("row").select("label", "features", "shares").toArrow()
    labels = found.column("label").to_numpy().astype(np.int64)
    ids = [np.asarray(x.values, np.int64) for x in found.column("features")]
    shares = [np.asarray(x.values, np.float32) for x in found.column("shares")]
    return fit(ids, shares, labels, classes, **how)


def _scored(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probabilities of the classes: the means of what each feature adds to their scores."""
        model = shared.value
        reach = (model.embedding @ model.weights.T).T.copy()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            sums, sizes = np.zeros((batch.num_rows, len(reach))), np.zeros(batch.num_rows, np.int64)
            for first, last, found in parts_of(data, offsets):
                for row, feature in found:
                    sizes[first:last] += np.bincount(row, minlength=last - first)
                    for k, part in enumerate(reach):
                        sums[first:last, k] += np.bincount(row, part[feature], last - first)
            scores = softmax(sums / np.maximum(sizes, 1)[:, None] + model.offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(list(scores), pa.list_(pa.float64()))],
                ["row", "id", "probabilities"])
    return scored


def held_out(doc_id: Column) -> Column:
    """Rows that the model may not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            label_column: str = "quality", rows: int = SAMPLE, classes: int = 2) -> DataFrame:
    """The probability of each class for every whole text.

    Labels are whole numbers from 0; they are learned from at most ``rows`` labelled
    documents that are not held out. A text is the mean of the embeddings of its
    hashed words, pairs of words and character n-grams, repeats included, and a
    softmax follows. The score of a text depends on nothing but the text.

    Null and empty texts, and those of white space alone, have no features: they score
    as frequent as the class is in the sample. With nothing to learn from, all classes
    are equally likely. Rows without an identifier are scored too and teach nothing;
    repeated rows are scored each. Identifiers have to be whole numbers.

    Columns: ``row``, ``id``, ``held_out``, ``probabilities``.
    """
    inside = F.col(label_column).cast("int").between(0, classes - 1)
    sample = sample_of(docs, labels.where(inside), ~held_out(F.col(id_column)), id_column, text_column, label_column, rows)
    shared = docs.sparkSession.sparkContext.broadcast(learn(sample, classes))
    found = numbered(docs, id_column, text_column).mapInArrow(
        _scored(shared), "row long, id long, probabilities array<double>")
    return found.withColumn("held_out", held_out(F.col("id")))


def op13_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    """The probability of good quality of every document."""
    found = quality(table(spark, directory, "documents"), table(spark, directory, "labels"))
    score = F.col("probabilities")[1]
    return found.select(
        F.col("id").alias("doc_id"), "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
