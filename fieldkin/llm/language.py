"""Language ID by cross-parsing: the language whose text explains a text in the fewest phrases."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldkin.llm.common import held_out, numbered, numbered_rows, slices, table

UNDETERMINED = "und"
#: Symbols of the alphabet: what is no letter, letters no training text has, then every
#: letter of the training texts.
SEPARATOR, UNKNOWN = 0, 1
#: Moves by a language's most frequent letters are in a dense table, at most so wide and
#: in all of so many entries; the others are searched for. What is found is the same.
DENSE, ENTRIES = 64, 1 << 26
#: A phrase never crosses a block of so many symbols, so all blocks are parsed side by side.
BLOCK = 512
#: Characters parsed at a time in a task.
SLICE = 1 << 20


class SuffixAutomaton:
    """All substrings of a sequence of symbols, as moves between states."""

    def __init__(self, symbols: list[int], alphabet: int) -> None:
        moves, link, length, last = [{}], [-1], [0], 0
        for symbol in symbols:
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            state = last
            while state != -1 and symbol not in moves[state]:
                moves[state][symbol] = new
                state = link[state]
            if state != -1:
                target = moves[state][symbol]
                if length[target] == length[state] + 1:
                    link[new] = target
                else:
                    copy = len(moves)
                    moves.append(dict(moves[target]))
                    link.append(link[target])
                    length.append(length[state] + 1)
                    while state != -1 and moves[state].get(symbol) == target:
                        moves[state][symbol] = copy
                        state = link[state]
                    link[target] = link[new] = copy
            last = new
        self.states, self.alphabet = len(moves), alphabet
        #: State, symbol and next state of every move.
        self.state = np.repeat(np.arange(len(moves)), [len(x) for x in moves])
        self.symbol = np.array([x for out in moves for x in out], np.int64)
        self.target = np.array([x for out in moves for x in out.values()], np.int64)

    @property
    def table(self) -> np.ndarray:
        """A dense table of the moves (-1: none)."""
        table = np.full((self.states, self.alphabet), -1, np.int32)
        table[self.state, self.symbol] = self.target
        return table


class Model:
    """One automaton per language, and the symbol of every code point."""

    def __init__(self, samples: dict[str, str], chars: int) -> None:
        self.languages = list(samples)
        seen = Counter(c for x in samples.values() for c in x if c.isalpha())
        counts: Counter = Counter()
        for letter, count in seen.items():
            counts[_folded(letter)] += count
        known = sorted(counts, key=lambda c: (-counts[c], c))
        self.symbols = np.zeros(0x110000, np.int32)
        for point in range(0x110000):
            if chr(point).isalpha():
                self.symbols[point] = UNKNOWN
        for at, letter in enumerate(known):
            for form in {letter, letter.upper(), letter.title()}:
                if len(form) == 1:
                    self.symbols[ord(form)] = at + 2
        number = {letter: at + 2 for at, letter in enumerate(known)}
        for letter in seen:
            self.symbols[ord(letter)] = number[_folded(letter)]
        self.size = len(known) + 2
        texts = [_collapsed(self.symbols[_points(x)])[:chars] for x in samples.values()]
        self.bits = [math.log2(max(len(x), 2)) for x in texts]
        automata = [SuffixAutomaton(x.tolist(), self.size) for x in texts]
        states = sum(x.states for x in automata)
        self.width = min(max(ENTRIES // max(states, 1), 2), DENSE, self.size)
        # A state is kept as the place of its row, so a move is one addition and one look-up.
        self.moves = np.full(states * self.width, -1, np.int32)
        #: Per language the column of every symbol; column 1 is for those without one.
        self.columns = np.full((len(texts), self.size), UNKNOWN, np.int32)
        roots, keys, targets, row = [], [], [], 0
        for at, (text, automaton) in enumerate(zip(texts, automata, strict=True)):
            often = np.argsort(-np.bincount(text[text > UNKNOWN], minlength=self.size), kind="stable")
            often = often[often > UNKNOWN][: self.width - 2]
            self.columns[at, SEPARATOR] = SEPARATOR
            self.columns[at, often] = np.arange(len(often)) + 2
            column = self.columns[at, automaton.symbol]
            place, target = ((x + row) * self.width for x in (automaton.state, automaton.target))
            dense = column != UNKNOWN
            self.moves[place[dense] + column[dense]] = target[dense]
            keys.append(place[~dense] * self.size + automaton.symbol[~dense])
            targets.append(target[~dense])
            roots.append(row * self.width)
            row += automaton.states
        self.roots = np.array(roots, np.int32)
        self.keys, self.targets = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, targets))
        order = np.argsort(self.keys)
        self.keys, self.targets = self.keys[order], self.targets[order].astype(np.int32)

    def _moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each language and lane, -1 where there is none."""
        columns = self.columns[:, symbol]
        move = self.moves.take(state + columns)
        if len(self.keys):
            language, lane = np.nonzero(columns == UNKNOWN)
            wanted = state[language, lane].astype(np.int64) * self.size + symbol[lane]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            move[language, lane] = np.where(self.keys[at] == wanted, self.targets[at], -1)
        return move

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per language and text."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[owner] + number * BLOCK
        length = np.minimum(sizes[owner] - number * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # lanes longer than a step
        roots = self.roots[:, None]
        first = self._moved(np.repeat(roots, self.size, axis=1), np.arange(self.size))
        first = np.where(first < 0, roots, first).astype(np.int32)
        state = np.repeat(roots, len(owner), axis=1)
        count = np.ones(state.shape, np.int32)
        for step in range(int(length.max(initial=0))):
            lanes = int(active[step])
            symbol = symbols[start[:lanes] + step]
            move = self._moved(state[:, :lanes], symbol)
            ends = move < 0
            count[:, :lanes] += ends
            state[:, :lanes] = np.where(ends, first[:, symbol], move)
        total = np.zeros((len(self.languages), len(sizes)), np.int64)
        for at in range(len(self.languages)):
            total[at] = np.bincount(owner, weights=count[at], minlength=len(sizes)).astype(np.int64)
        return total

    def predict(self, values: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Language, score and number of letters of each text."""
        points = _points("".join(x or "" for x in values))
        offsets = np.concatenate(([0], np.cumsum([len(x or "") for x in values]))).astype(np.int64)
        symbols = self.symbols[points]
        letters = np.concatenate(([0], np.cumsum(symbols != SEPARATOR)))
        letters = letters[offsets[1:]] - letters[offsets[:-1]]
        starts = np.zeros(len(symbols) + 1, bool)
        starts[offsets] = True
        stays = _keeps(symbols, starts[:-1])
        offsets = np.concatenate(([0], np.cumsum(stays)))[offsets]
        symbols = symbols[stays]
        if not self.languages:
            return [UNDETERMINED] * len(values), [0.0] * len(values), letters.tolist()
        # Phrases times the bits that name a place in the sample: the cross entropy of the text.
        cost = self.phrases(symbols, offsets) * np.array(self.bits)[:, None]
        best = cost.argmin(axis=0)
        gap = np.minimum(cost - cost.min(axis=0), 60.0)
        score = 1 / np.exp2(-gap).sum(axis=0)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters > 0, score, 0.0).tolist(), letters.tolist()


def _folded(letter: str) -> str:
    return letter.lower() if len(letter.lower()) == 1 else letter


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _keeps(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All but separators that follow a separator of the same text."""
    keeps = symbols != SEPARATOR
    keeps[1:] |= symbols[:-1] != SEPARATOR
    return keeps | starts


def _collapsed(symbols: np.ndarray) -> np.ndarray:
    return symbols[_keeps(symbols, np.arange(len(symbols)) == 0)]


def train(docs: DataFrame, language_column: str = "lang", id_column: str = "doc_id", text_column: str = "text",
          rows: int = 64, chars: int = 60_000) -> Model:
    """Automata of a bounded sample of the labelled rows that are not held out.

    Of each language the ``rows`` with the smallest hashes are taken, whole, until they
    have ``chars`` characters, however many languages there are. Only a row that is
    longer by itself is cut, to ``chars``, so a language has less than twice as many.
    Rows are chosen by a hash below a threshold that follows the number of
    labelled rows, so what is ranked and collected does not grow with the table.
    """
    labelled = docs.where(~held_out(F.col(id_column))).select(
        F.col(language_column).cast("string").alias("language"),
        F.col(text_column).cast("string").alias("text"),
        F.xxhash64(F.col(id_column).cast("string"), F.lit("language")).alias("hash"),
    ).where("language is not null and text is not null")
    counts = {x["language"]: x["count"] for x in labelled.groupBy("language").count().collect()}
    if not counts:
        return Model({}, chars)
    low = F.lit(None).cast("long")
    for language, count in counts.items():
        below = min(-(2**63) + int(2**64 * 4 * rows / count), 2**63 - 1)
        low = F.when(F.col("language") == language, F.lit(below)).otherwise(low)
    rank = F.row_number().over(Window.partitionBy("language").orderBy("hash", "text"))
    before = Window.partitionBy("language").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        labelled.where(F.col("hash") <= low)
        .select("language", "hash", F.substring("text", 1, chars).alias("text"))
        .withColumn("rank", rank).where(F.col("rank") <= rows)
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < chars)
    )
    samples: dict[str, list[str]] = {x: [] for x in sorted(counts, key=lambda x: (-counts[x], x))}
    for row in chosen.orderBy("language", "rank").collect():
        samples[row["language"]].append(row["text"])
    return Model({k: "\n".join(v) for k, v in samples.items()}, 2 * chars + rows)


def _predicted(model: Broadcast):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = object.__new__(Model)
        vars(parser).update(model.value)
        for batch in batches:
            values = batch.column("text").to_pylist()
            bounds = np.concatenate(([0], np.cumsum([len(x or "") for x in values])))
            languages: list[str] = []
            scores: list[float] = []
            letters: list[int] = []
            for start, end in slices(bounds, SLICE):
                names, found, counts = parser.predict(values[start:end])
                languages += names
                scores += found
                letters += counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(languages, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(letters, pa.int64())], ["id", "row", "language", "score", "letters"])
    return predicted


def languages(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The language of every whole text.

    A text is turned into letters and single separators, cut into blocks, and each
    block is parsed from left to right into the longest phrases that a language's
    sample contains. Phrases weigh the bits that name a place in the sample, and the
    language with the least weight wins; of equal ones that with more labelled rows. Null texts
    and texts without letters are ``und`` with score 0. The score is the winner's share
    of the likelihood. Rows that repeat are predicted alike. Without a learned language
    every text is ``und``.

    Columns: ``row``, ``id``, ``language``, ``score``, ``letters`` (of the whole text).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    return numbered(docs, id_column, text_column).mapInArrow(
        _predicted(shared), "id long, row long, language string, score double, letters long")


def op1_language_id(spark: SparkSession, directory: str) -> DataFrame:
    """The predicted language of every document, learned from three quarters of them."""
    docs = table(spark, directory, "documents")
    return languages(docs, train(docs)).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"),
        F.col("language").alias("lang_pred"), "score")


def with_language(docs: DataFrame) -> DataFrame:
    """The documents that are in some language; those without a letter go, whatever was learned."""
    row = "__llm_row"
    found = languages(docs, train(docs)).where("letters > 0").select(F.col("row").alias(row))
    return numbered_rows(docs, row).join(found, row, "left_semi").drop(row)
