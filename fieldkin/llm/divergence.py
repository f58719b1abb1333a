"""Source divergence audit: which sources of a language use their words unlike the others."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldkin.llm.common import table, texts
from fieldkin.session import keep

#: Documents of a language that a term needs, and ranks of terms per source.
LEAST_DOCUMENTS, TERM_RANKS = 3, 200
#: Shares are whole numbers of this many parts.
PARTS = 1_000_000_000
#: Entries that a task adds up before it hands them on.
HELD = 1 << 19
#: Parts that the sources of a language are dealt into where they meet all others.
SALTS = 16

# Letters and everything beyond ASCII belong to terms; A-Z become a-z, all else a space.
_FOLDED = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms_of(content: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return content.translate(_FOLDED).split()


def collapsed(docs: DataFrame, text: str = "text", group: str = "lang", source: str = "source") -> DataFrame:
    """``(row, lang, found)``: one row per different text of a language.

    ``found`` lists the sources that hold it and how often, ``row`` is the number of
    its first row. Only digests are shuffled, and they are counted before that, so a
    text that fills a third of the table is a few entries per task.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("digest"),
    )
    counted = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    return counted.groupBy("lang", "digest").agg(
        F.min("row").alias("row"), F.collect_list(F.struct("source", "n")).alias("found")).drop("digest")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term, added up per language and source."""
    uses: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)

    def entries() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in uses.items():
            terms = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64()),
                 pa.array([documents[lang, source][x] for x in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        uses.clear()
        documents.clear()

    more = 0  # what the texts since the last count may have added
    for batch in batches:
        langs, founds = batch.column("lang").to_pylist(), batch.column("found").to_pylist()
        for lang, found, content in zip(langs, founds, texts(batch.column("text")), strict=True):
            words = terms_of(content)
            if not words:
                continue
            once = Counter(words)
            for entry in found:
                key, times = (lang, entry["source"]), entry["n"]
                if times == 1:
                    uses[key].update(words)
                    documents[key].update(once.keys())
                else:
                    for term, n in once.items():
                        uses[key][term] += n * times
                        documents[key][term] += times
                more += len(once)
            if more > HELD // 8:
                more = 0
                if sum(map(len, uses.values())) > HELD:
                    yield from entries()
    yield from entries()


def _share(count: Column | str, total: str, kept: str) -> str:
    return f"1 + (cast({count} + 1 AS decimal(20, 0)) * cast({PARTS} AS decimal(10, 0))) div ({total} + {kept})"


def _distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def audit(docs: DataFrame, text: str = "text", group: str = "lang", source: str = "source",
          least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """Divergence of every source of a language from every other, and its most telling terms.

    Terms are runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased. A
    language keeps the terms that ``least`` of its documents have. Each source, and the
    language as a whole, gives each kept term a smoothed share in whole numbers of
    :data:`PARTS`; a distance is the squared difference of two shares over the
    second, rounded down. Part ``pair`` adds it up over all kept terms for each other
    source of the language, part ``term`` lists the terms that a source uses more than
    its language. Nulls of text, language and source are empty texts; a source
    without terms takes part, repeated rows count as often as they occur, and an empty
    table has no groups.

    Equal texts of a language are one text with a number per source, cut into terms
    once. A term that neither of two sources has adds the same to their sum, so only
    terms in use are gone through: those of one source by how many share a count,
    those of both one by one.

    Columns: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.
    """
    owners = keep(collapsed(docs, text, group, source), "texts")
    stored = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    # A number of its own keeps small partitions apart: cutting texts costs more than their bytes show.
    stored = stored.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    terms = owners.join(stored, "row").select("lang", "found", "text").mapInArrow(
        _counted, "lang string, source string, term string, n long, docs long")
    counted = terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = keep(
        counted.groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("total"),
            F.collect_list(F.struct("source", "n")).alias("found"),
        ).where(F.col("docs") >= least).drop("docs"), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    totals = kept.select("lang", F.inline("found")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = keep(
        owners.select("lang", F.explode("found").alias("f")).select("lang", "f.source").distinct()
        .join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"),
                F.coalesce("total", F.lit(0).cast("long")).alias("total"),
                F.coalesce("lang_total", F.lit(0).cast("long")).alias("lang_total"))
        # The share of a term that the source hasn't; null where no term is kept.
        .withColumn("none", F.expr(f"CASE WHEN kept > 0 THEN {_share('0', 'total', 'kept')} END")),
        "groups")
    used = keep(
        kept.select("lang", "term", F.col("total").alias("term_total"), F.inline("found"))
        .join(groups, ["lang", "source"])
        .select("lang", "source", "term", "none", F.expr(_share("n", "total", "kept")).alias("p"),
                F.expr(_share("term_total", "lang_total", "kept")).alias("q")), "shares")
    own = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = (
        used.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                   F.expr(_distance("p", "q")).alias("value"))
        .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= ranks)
    )
    pairs = _pairs(used, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(own)).unionAll(telling)


def _pairs(used: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, other, value)`` of every ordered pair of sources of a language."""
    apart = "source <> other"
    others = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    salted = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def dealt(data: DataFrame, *columns: str) -> DataFrame:
        return data.withColumn("salt", F.pmod(F.hash(*columns), F.lit(SALTS))).join(salted, ["lang", "salt"]).where(apart)

    nothing = f"({_distance('none', 'other_none')})"
    # Terms that neither has, as if it were all of them.
    base = dealt(groups, "source").select(
        "lang", "source", "other", F.expr(f"coalesce(kept * {nothing}, 0)").alias("value"))
    # Terms of one source: what they add beyond that, for both orders of the pair.
    shares = used.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("terms"))
    one = dealt(shares, "source", "p").select("lang", F.inline(F.expr(f"""array(
        struct(source, other, terms * ({_distance('p', 'other_none')} - {nothing}) AS value),
        struct(other AS source, source AS other,
               terms * ({_distance('other_none', 'p')} - {_distance('other_none', 'none')}) AS value))""")))
    # Terms of both: the true distance instead of those two.
    holders = used.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("held")).where(
        F.size("held") > 1)
    both = (
        holders.select("lang", "held", F.inline("held"))
        .select("lang", "source", "p", "none", F.explode("held").alias("o"))
        .select("lang", "source", "p", "none", F.col("o.source").alias("other"), F.col("o.p").alias("other_p"),
                F.col("o.none").alias("other_none"))
        .where(apart)
        .select("lang", "source", "other", F.expr(
            f"{_distance('p', 'other_p')} - {_distance('p', 'other_none')} - {_distance('none', 'other_p')} + {nothing}"
        ).alias("value"))
    )
    # Halves of 32 bits are added up apart: no partial sum overflows, and none needs a decimal.
    parts = base.unionAll(one).unionAll(both).select(
        "lang", "source", "other", F.shiftright("value", 32).alias("high"),
        F.col("value").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))
    added = parts.groupBy("lang", "source", "other").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return added.select("lang", "source", "other", F.expr(
        "cast(cast(high AS decimal(20, 0)) * 4294967296 + low AS long)").alias("value"))


def op11_source_divergence(spark: SparkSession, directory: str) -> DataFrame:
    """All pairs of sources of a language, and the 200 most telling terms of each source."""
    return audit(table(spark, directory, "documents"))


OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content
  FROM documents),
words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(content, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sources AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + ({PARTS}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v))::BIGINT AS p,
         (1 + ({PARTS}::HUGEINT * (k.n + 1)) // (l.total + l.v))::BIGINT AS q
  FROM sources s JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
