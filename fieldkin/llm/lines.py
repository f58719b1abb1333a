"""Substring dedup by lines: of equal lines in the corpus the earliest stays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.llm.common import LAST_ID, numbered, table
from fieldkin.session import keep

#: What separates units: one line end, or two.
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
#: Sentences within a unit are units too from so many characters in normal form on.
SENTENCE_CHARS = 48
#: Ends of sentences, those of scripts without white space among them.
ENDS = ".!?。！？"
_SENTENCE = re.compile(rf"[^{ENDS}]*+[{ENDS}]++[ \t\n\r\x0b\f]*+|[^{ENDS}]++")


def normal(unit: str) -> bytes:
    """A-Z lower-cased, runs of ASCII white space one space, none at the ends."""
    return b" ".join(unit.encode("utf-8", "surrogatepass").lower().split())


def sentences(unit: str) -> list[str]:
    """A unit cut behind the ends of its sentences and the white space after them."""
    return _SENTENCE.findall(unit)


def placed(text: str, separator: str, least_words: int, sentence_chars: int | None) -> Iterator[tuple[int, bytes]]:
    """Place and normal form of each unit, and of the sentences in units of several.

    A place is twice the offset in characters, and one more for a sentence.
    """
    at = 0
    for unit in text.split(separator):
        content = normal(unit)
        if content and content.count(b" ") + 1 >= least_words:
            yield 2 * at, content
        if sentence_chars is not None and len(parts := sentences(unit)) > 1:
            inner = at
            for part in parts:
                content = normal(part)
                # Bytes first: a text has no more characters than bytes.
                if len(content) >= sentence_chars and len(content.decode("utf-8", "surrogatepass")) >= sentence_chars:
                    yield 2 * inner + 1, content
                inner += len(part)
        at += len(unit) + len(separator)


def _units(separator: str, least_words: int, sentence_chars: int | None):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest and place of every unit."""
        for batch in batches:
            rows, ids, places, digests = [], [], [], []
            for row, id_, text in zip(*(batch.column(x).to_pylist() for x in ("row", "id", "text")), strict=True):
                for place, content in placed(text or "", separator, least_words, sentence_chars):
                    rows.append(row)
                    ids.append(LAST_ID if id_ is None else id_)
                    places.append(place)
                    digests.append(hashlib.sha256(content).digest()[:16])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int64()),
                 pa.array(digests, pa.binary())], ["row", "rank", "place", "digest"])
    return units


def without(text: str, separator: str, gone: set[int]) -> tuple[int, int, list[int], str]:
    """Number of units, removed units and sentences, their spans, and the text that stays."""
    units = text.split(separator)
    at, removed, spans, stays = 0, 0, [], []
    for unit in units:
        if 2 * at in gone:
            removed += 1
            spans += [at, at + len(unit)]
        else:
            inner, left = at, []
            for part in sentences(unit) if gone else [unit]:
                if 2 * inner + 1 in gone:
                    removed += 1
                    spans += [inner, inner + len(part)]
                else:
                    left.append(part)
                inner += len(part)
            stays.append("".join(left))
        at += len(unit) + len(separator)
    return len(units), removed, spans, separator.join(stays)


def _cut(separator: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"units": [], "removed": [], "chars": [], "spans": [], "kept": []}
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                units, removed, spans, kept = without(text or "", separator, set(places or ()))
                out["units"].append(units)
                out["removed"].append(removed)
                out["chars"].append(sum(spans[1::2]) - sum(spans[::2]))
                out["spans"].append(spans)
                out["kept"].append(kept)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
                ["id", "row", *out])
    return cut


def without_repeats(docs: DataFrame, unit: str = "line", id_column: str = "doc_id", text_column: str = "text",
                    least_words: int = 0, sentence_chars: int | None = SENTENCE_CHARS) -> DataFrame:
    """The text of every row without lines (or paragraphs) and sentences that occur before it.

    Units are the non-empty lines, and the sentences of ``sentence_chars`` characters or
    more in lines of several (None: lines alone), since a passage may start and end
    within lines. They are equal when they are after A-Z are lower-cased and white space
    is made one space, a line and a sentence too. Of equal units the one with the
    smallest identifier stays, then that of the first row and the first in its text; rows
    without an identifier come last. A removed line takes its line end with it, a
    removed sentence the white space behind it. Blank lines stay; ``least_words`` keeps
    lines of fewer words as well. Null is the empty text, a single empty unit.

    Owners are found by digests that combine before the shuffle, and joined back in a
    join whose large keys Spark can split; texts are dealt out by row.

    Columns: ``row``, ``id``, ``units`` (lines), ``removed`` (lines, and sentences of
    lines that stay), ``chars`` (removed characters), ``spans`` (starts and ends of what
    was removed in characters of the original, in turn), ``kept`` (the remaining text).
    """
    separator = SEPARATORS[unit]
    rows = numbered(docs, id_column, text_column)
    found = keep(rows.mapInArrow(_units(separator, least_words, sentence_chars),
                                 "row long, rank long, place long, digest binary"), "units")
    place = F.struct("rank", "row", "place")
    owners = found.groupBy("digest").agg(F.min(place).alias("owner"), F.count("*").alias("copies")).where("copies > 1")
    # Written, so that the join reads both sides from shuffles of its own and can split either.
    owners = keep(owners, "owners")
    repeats = found.join(owners, "digest").where(place != F.col("owner"))
    gone = repeats.groupBy("row").agg(F.collect_list("place").alias("places"))
    return rows.join(gone, "row", "left").select("id", "row", "text", "places").mapInArrow(
        _cut(separator), "id long, row long, units long, removed long, chars long, spans array<long>, kept string")


def op2_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Removed lines and sentences of every document, their places, and the digest of what stays."""
    found = without_repeats(table(spark, directory, "documents"))
    pairs = F.expr("transform(sequence(0, size(spans) div 2 - 1), i -> concat_ws(':', spans[2 * i], spans[2 * i + 1]))")
    return found.select(
        F.col("id").alias("doc_id"), F.col("units").alias("n_lines"), F.col("removed").alias("n_removed"),
        F.col("chars").alias("removed_chars"),
        F.when(F.size("spans") > 0, F.array_join(pairs, ",")).otherwise("").alias("spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS units FROM documents),
numbered AS (
  SELECT doc_id, unnest(range(1, len(units) + 1)) AS place, units FROM split),
lines AS (
  SELECT doc_id, place, units[place] AS line,
         (sum(length(units[place]) + 1) OVER (PARTITION BY doc_id ORDER BY place))::BIGINT - length(units[place]) - 1 AS start
  FROM numbered),
cut AS (
  SELECT *, regexp_extract_all(line, '[^{ENDS}]*[{ENDS}]+[ \t\x0B\f\r]*|[^{ENDS}]+') AS parts FROM lines),
pieces AS (
  SELECT doc_id, place, start AS line_start, unnest(range(1, len(parts) + 1)) AS piece, parts FROM cut),
sentences AS (
  SELECT doc_id, place, piece, parts[piece] AS part, len(parts) AS many, line_start
         + (sum(length(parts[piece])) OVER (PARTITION BY doc_id, place ORDER BY piece))::BIGINT - length(parts[piece]) AS start
  FROM pieces),
units AS (
  SELECT doc_id, place, 0 AS piece, start, line AS unit, true AS counts FROM lines
  UNION ALL SELECT doc_id, place, piece, start, part, many > 1 FROM sentences),
contents AS (
  SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[ \t\x0B\f\r]+', ' ', 'g')) AS content
  FROM units),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, start, piece) > 1 AS again
  FROM contents
  WHERE counts AND CASE WHEN piece = 0 THEN content <> '' ELSE length(content) >= {SENTENCE_CHARS} END),
marked AS (
  SELECT u.doc_id, u.place, u.piece, u.start, u.unit, coalesce(r.again, false) AS again,
         coalesce(bool_or(r.again AND u.piece = 0) OVER (PARTITION BY u.doc_id, u.place), false) AS line_gone
  FROM units u LEFT JOIN ranked r USING (doc_id, place, piece)),
gone AS (
  SELECT * FROM marked WHERE again AND (piece = 0 OR NOT line_gone)),
removed AS (
  SELECT doc_id, count(*) AS n, sum(length(unit))::BIGINT AS chars,
         string_agg(start || ':' || (start + length(unit)), ',' ORDER BY start) AS spans
  FROM gone GROUP BY doc_id),
stays AS (
  SELECT doc_id, place, coalesce(string_agg(unit, '' ORDER BY piece) FILTER (piece > 0 AND NOT again), '') AS line
  FROM marked WHERE NOT line_gone GROUP BY doc_id, place),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM stays GROUP BY doc_id)
SELECT s.doc_id, len(s.units) AS n_lines, coalesce(r.n, 0) AS n_removed, coalesce(r.chars, 0) AS removed_chars,
       coalesce(r.spans, '') AS spans, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
