"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.llm.common import held_out, numbered, table
from fieldkin.session import keep

#: Labelled rows that voters and classifier are learned from, and terms that are kept.
SAMPLE, TERMS = 20_000, 1_000
#: Lengths of word beginnings that are terms beside whole words.
STEMS = (4, 5, 6)
#: The log-likelihood ratio that a term needs, and how often its rows must be toxic.
EVIDENCE, PRECISION = 16.0, 0.5
#: Votes are bits of a number, so there are at most 65,536 patterns of votes.
LEXICONS, VOTERS = 13, 16
#: Characters whose letters are counted at a time.
CHUNK = 1 << 12
THRESHOLD = 0.3


class Scorer(NamedTuple):
    """The learned terms: their lexicon voter, and the classifier's weights."""

    voter: dict[str, int]
    index: dict[str, int]
    weights: np.ndarray
    bias: float


def terms_of(text: str) -> set[str]:
    """The words of a text in lower case, and their beginnings, marked by a hyphen."""
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    out = set(words)
    for size in STEMS:
        out.update([x[:size] + "-" for x in words if len(x) >= size])
    return out


def shouts(text: str) -> bool:
    """Whether over half of the letters of the whole text are capitals."""
    letters = capitals = 0
    for at in range(0, len(text), CHUNK):
        part = text[at : at + CHUNK]
        if part.isascii():
            content = part.encode()
            small = len(content) - len(content.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
            large = len(content) - len(content.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            letters, capitals = letters + small + large, capitals + large
        else:
            letters += sum(map(str.isalpha, part))
            capitals += sum(map(str.isupper, part))
    return capitals * 2 > letters > 0


def votes_of(text: str, terms: set[str], voter: dict[str, int]) -> int:
    """One bit per voter that takes the text for toxic.

    Lexicon voters look for a term of theirs. Pattern voters look for two different
    lexicons, for shouting, and for runs of exclamation marks next to a lexicon term.
    """
    fired = {voter[x] for x in terms}
    votes = sum(1 << x for x in fired)
    if len(fired) >= 2:
        votes |= 1 << LEXICONS
    if shouts(text):
        votes |= 1 << (LEXICONS + 1)
    if fired and "!!" in text:
        votes |= 1 << (LEXICONS + 2)
    return votes


def _family(text: str) -> int:
    """The smallest hash of the runs of three words: near copies mostly share it."""
    words = text.lower().split()
    runs = (" ".join(words[x : x + 3]) for x in range(max(len(words) - 2, 1)))
    return min(xxhash.xxh64_intdigest(x) for x in runs) >> 1


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_family(x or "") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ("row", "text", "toxic")), pa.array(keys, pa.int64())],
            ["row", "text", "toxic", "family"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, all_ = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            terms = terms_of(text or "")
            all_.update(terms)
            if label:
                toxic.update(terms)
        if len(all_) > 1 << 20:
            yield _counted(toxic, all_)
            toxic, all_ = Counter(), Counter()
    yield _counted(toxic, all_)


def _counted(toxic: Counter, all_: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(all_), pa.string()), pa.array([toxic[x] for x in all_], pa.int64()),
         pa.array(list(all_.values()), pa.int64())], ["term", "toxic", "rows"])


def sample_of(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str,
              rows: int = SAMPLE) -> DataFrame:
    """At most about ``rows`` labelled rows that are not held out, one per family of near copies.

    Identifiers are chosen by a hash below a threshold that follows their number; of
    repeated labels the larger counts. What is handed to all tasks is bounded by ``rows``.
    """
    known = labels.where(f"{label_column} is not null").where(~held_out(F.col(id_column))).select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("toxic"))
    known = known.where("id is not null")
    count = known.count()
    share = min(rows / count, 1.0) if count else 1.0
    low = F.lit(min(-(2**63) + int(2**64 * share), 2**63 - 1))
    known = known.where(F.xxhash64("id", F.lit("toxicity")) <= low).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = numbered(docs, id_column, text_column).join(F.broadcast(known), "id")
    found = keep(texts.select("row", "text", "toxic").mapInArrow(
        _families, "row long, text string, toxic int, family long"), "labelled")
    first = found.groupBy("family").agg(F.min("row").alias("row")).select("row")
    return found.join(first, "row", "left_semi")


def toxic_terms(sample: DataFrame) -> list[str]:
    """The terms that speak for toxicity, the strongest first."""
    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, rows = totals
    if not toxic or toxic == rows:
        return []
    counts = sample.select("text", "toxic").mapInArrow(_counts, "term string, toxic long, rows long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("rows").alias("n"))
    base = toxic / rows

    def part(count, share):
        return F.when(count > 0, count * F.log(share)).otherwise(0.0)

    t, n = F.col("t"), F.col("n")
    ratio = 2 * (part(t, t / n / base) + part(n - t, (n - t) / n / (1 - base)))
    strong = counts.where((t / n >= PRECISION) & (ratio >= EVIDENCE)).orderBy(ratio.desc(), "term").limit(TERMS)
    return [x["term"] for x in strong.collect()]


def lexicons(terms: list[str]) -> dict[str, int]:
    """The lexicon voter of each term: terms with a common beginning are in the same one."""
    voters: dict[str, int] = {}
    for term in terms:
        voters.setdefault(term[: STEMS[0]].rstrip("-"), len(voters) % LEXICONS)
    return {x: voters[x[: STEMS[0]].rstrip("-")] for x in terms}


class LabelModel:
    """Accuracies and correlations of voters, from their agreement and from labels.

    Given the label, each voter depends on one other voter at most: the tree of pairs
    with the most information about each other. Expectation and maximisation run over
    counts of vote patterns; labelled patterns count with their labels.
    """

    def __init__(self, patterns: dict[int, int], labelled: dict[tuple[int, int], int], rounds: int = 25) -> None:
        codes = sorted({*patterns, *(x for x, _ in labelled)} or {0})
        self.bits = (np.array(codes)[:, None] >> np.arange(VOTERS)) & 1
        weight = np.array([patterns.get(x, 0) for x in codes], float)
        known = np.array([[labelled.get((x, y), 0) for y in (0, 1)] for x in codes], float)
        # Rows with a label are among the patterns too; there they count by their label only.
        weight = np.maximum(weight - known.sum(axis=1), 0)
        soft = known + 1e-9
        self.parent = [-1] * VOTERS
        for step in range(rounds):
            self._fit(soft, structure=step in (0, 5))
            soft = known + weight[:, None] * self.posterior(self.bits)
        self.table = dict(zip(codes, self.posterior(self.bits)[:, 1].tolist(), strict=True))

    def _fit(self, soft: np.ndarray, structure: bool) -> None:
        self.prior = np.log((soft.sum(axis=0) + 1) / (soft.sum() + 2))
        if structure:
            self.parent = self._tree(soft)
        self.logs = np.zeros((2, VOTERS, 2, 2))  # label, voter, parent's vote, own vote
        for voter, parent in enumerate(self.parent):
            above = self.bits[:, parent] if parent >= 0 else np.zeros(len(self.bits), int)
            for label in (0, 1):
                for vote in (0, 1):
                    rows = soft[:, label] * (above == vote)
                    fired = rows @ self.bits[:, voter]
                    share = (fired + 0.1) / (rows.sum() + 0.2)
                    self.logs[label, voter, vote] = np.log([1 - share, share])

    def _tree(self, soft: np.ndarray) -> list[int]:
        information = np.zeros((VOTERS, VOTERS))
        for a in range(VOTERS):
            for b in range(a):
                for label in (0, 1):
                    joint = np.zeros((2, 2))
                    np.add.at(joint, (self.bits[:, a], self.bits[:, b]), soft[:, label])
                    joint = (joint + 0.01) / (joint.sum() + 0.04)
                    alone = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                    information[a, b] += soft[:, label].sum() / soft.sum() * (joint * np.log(joint / alone)).sum()
        information += information.T
        parent, inside = [-1] * VOTERS, [0]
        while len(inside) < VOTERS:
            gain = information[np.ix_(inside, range(VOTERS))].copy()
            gain[:, inside] = -1
            at, child = np.unravel_index(gain.argmax(), gain.shape)
            parent[int(child)] = inside[int(at)]
            inside.append(int(child))
        return parent

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        logs = np.tile(self.prior, (len(bits), 1))
        for voter, parent in enumerate(self.parent):
            above = bits[:, parent] if parent >= 0 else np.zeros(len(bits), int)
            for label in (0, 1):
                logs[:, label] += self.logs[label, voter, above, bits[:, voter]]
        logs -= logs.max(axis=1, keepdims=True)
        shares = np.exp(logs)
        return shares / shares.sum(axis=1, keepdims=True)


def with_labels(posterior: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The posterior once a row's own label has voted too.

    The label's accuracy is how far the other voters agree with it, so a wrong label
    doesn't outweigh them, but decides where few of them have a say.
    """
    agreed = np.where(labels, posterior, 1 - posterior)
    accuracy = min(max(float(agreed.mean()) if len(agreed) else 0.5, 0.5), 0.99)
    for_toxic = np.where(labels, accuracy, 1 - accuracy) * posterior
    return for_toxic / (for_toxic + np.where(labels, 1 - accuracy, accuracy) * (1 - posterior))


def logistic(rows: list[list[int]], targets: np.ndarray, size: int, penalty: float = 0.05,
             rounds: int = 3_000) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on soft labels, by accelerated gradients."""
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    column = np.array([c for x in rows for c in x], np.int64)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(rows)), 1))  # long texts don't shout
    weights = look = np.zeros(size + 1)
    rate = 4.0 / 2.0
    for step in range(rounds):
        sums = np.bincount(owner, weights=look[column] * scale[owner], minlength=len(rows)) + look[size]
        error = 1 / (1 + np.exp(-sums)) - targets
        slope = np.zeros(size + 1)
        slope[:size] = np.bincount(column, weights=(error * scale)[owner], minlength=size)
        slope[size] = error.sum()
        slope = slope / max(len(rows), 1)
        slope[:size] += penalty / max(len(rows), 1) * look[:size]
        new = look - rate * slope
        look = new + step / (step + 3) * (new - weights)
        weights = new
    return weights[:size], float(weights[size])


def _voted(scorer: Scorer, extra: list[str], with_terms: bool):
    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(scorer.voter)
        for batch in batches:
            votes, found = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                terms = terms_of(text) & known
                votes.append(votes_of(text, terms, scorer.voter))
                found.append(sorted(scorer.index[x] for x in terms))
            columns = [*(batch.column(x) for x in extra), pa.array(votes, pa.int32())]
            names = [*extra, "votes"]
            if with_terms:
                columns.append(pa.array(found, pa.list_(pa.int32())))
                names.append("terms")
            yield pa.RecordBatch.from_arrays(columns, names)
    return voted


def _scored(scorer: Scorer):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(scorer.voter)
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                found = [scorer.weights[scorer.index[x]] for x in terms_of(text or "") & known]
                total = sum(found) / max(len(found), 1) ** 0.5 + scorer.bias
                scores.append(1 / (1 + float(np.exp(-total))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(scores, pa.float64())], ["id", "row", "score"])
    return scored


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "toxic") -> Scorer:
    """Voters from a bounded labelled sample, their accuracies from all rows, and a classifier."""
    sample = keep(sample_of(docs, labels, id_column, text_column, label_column), "sample")
    terms = toxic_terms(sample)
    scorer = Scorer(lexicons(terms), {x: i for i, x in enumerate(terms)}, np.zeros(len(terms)), 0.0)
    learned = sample.select("text", "toxic").mapInArrow(
        _voted(scorer, ["toxic"], True), "toxic int, votes int, terms array<int>").collect()
    patterns = numbered(docs, id_column, text_column).select("text").mapInArrow(
        _voted(scorer, [], False), "votes int").groupBy("votes").count()
    labelled = Counter((x["votes"], int(x["toxic"] > 0)) for x in learned)
    model = LabelModel({x["votes"]: x["count"] for x in patterns.collect()}, labelled)
    targets = with_labels(
        np.array([model.table[x["votes"]] for x in learned]), np.array([x["toxic"] > 0 for x in learned], bool))
    weights, bias = logistic([x["terms"] for x in learned], targets, len(terms))
    return scorer._replace(weights=weights, bias=bias)


def toxicity(docs: DataFrame, scorer: Scorer, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The toxicity of every whole text, from 0 to 1.

    Null and empty texts have the score of a text without a learned term. Repeated
    rows are scored each.

    Columns: ``id``, ``row``, ``score``.
    """
    return numbered(docs, id_column, text_column).mapInArrow(_scored(scorer), "id long, row long, score double")


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """The toxicity of every document, learned from three quarters of the labelled ones."""
    docs, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    return toxicity(docs, train(docs, labels)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
