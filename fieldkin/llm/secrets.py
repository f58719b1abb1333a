"""Secret scans: candidates by pattern, judged by how many owners of the corpus hold them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldkin.llm.common import table
from fieldkin.session import keep

# Kinds in the order in which equal starts are listed, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "opaque": OPAQUE}
BASE = ("assign", "access", "hex")
#: Characters of an assigned value, different characters of a live-looking one, and
#: owners or repositories that make a value a widely copied example.
ASSIGNED, VARIETY, MANY_OWNERS, MANY_REPOSITORIES = 12, 6, 3, 5


def candidates(docs: DataFrame, repository: Column, owner: Column, text_column: str = "text") -> DataFrame:
    """Every candidate of every whole text: place in code points, digest of the value, no value.

    The text around the matches tells their places: a match ends where the pieces
    before it and the matches so far end. Places are sums over the matches of one
    text, so no text is cut or searched twice for the same kind.

    Columns: ``row``, ``repository``, ``owner``, ``rank`` (place of the kind), ``kind``,
    ``start``, ``end`` (exclusive), ``digest``, ``varied``.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), repository.alias("repository"), owner.alias("owner"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    found = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in PATTERNS.items()])
    found = found.where(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in PATTERNS]))
    kinds = [
        F.struct(
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            F.when(F.size(kind) > 0, F.arrays_zip(
                F.transform(F.split("text", pattern, -1), F.length).alias("gap"), F.col(kind).alias("match"))).alias("parts"))
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
    ]
    parts = (
        found.select("row", "repository", "owner", F.inline(F.array(*kinds)))
        .select("row", "repository", "owner", "rank", "kind", F.posexplode("parts").alias("place", "part"))
        .select("row", "repository", "owner", "rank", "kind", "place", "part.gap", "part.match")
        .where("match is not null")
    )
    so_far = Window.partitionBy("row", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    mixed = F.col("match").rlike("[0-9]") & F.col("match").rlike("[a-z]") & F.col("match").rlike("[A-Z]")
    return (
        parts.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
        .withColumn("start", F.col("end") - F.length("match")).withColumn("value", value)
        .where((F.col("kind") != "assign") | (F.length("value") >= ASSIGNED))
        .where((F.col("kind") != "opaque") | mixed)
        .select("row", "repository", "owner", "rank", "kind", "start", "end", F.sha2("value", 256).alias("digest"),
                (F.size(F.array_distinct(F.split("value", ""))) >= VARIETY).alias("varied"))
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct ``owners`` and ``repositories`` of each value, over the whole corpus.

    Equal holders of a value meet before they are shuffled, so a value that a third of
    all rows hold reaches the shuffle once per holder and task.
    """
    holders = found.select("digest", "repository", "owner").distinct()
    owners = holders.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("owners"))
    return holders.groupBy("digest").agg(F.count("*").alias("repositories")).join(owners, "digest")


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, repository: Column, owner: Column, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """Secrets of every row, and which of them look live.

    Base spans are assigned values, access keys and hexadecimal runs. A value that many
    owners or repositories hold is a copied example; one that a single owner holds and
    that has enough different characters looks live. Opaque strings with digits and
    letters of both cases are added where they look live and overlap no base span, so
    what the corpus copies widely isn't taken for a secret.

    Null texts have no spans; null repositories and owners are one holder; repeated
    rows are reported each, and count once for a holder.

    Columns: ``row``, ``id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_opaque``,
    ``n_live``, ``n_example``, ``base_spans``, ``spans``.
    """
    found = keep(candidates(docs, F.coalesce(repository, F.lit("")), F.coalesce(owner, F.lit("")), text_column), "candidates")
    # Written, so that the join reads both sides from shuffles of its own and can split either.
    judged = found.join(keep(ownership(found), "ownership"), "digest").select(
        "row", "rank", "kind", "start", "end",
        ((F.col("owners") == 1) & F.col("varied")).alias("live"),
        ((F.col("owners") >= MANY_OWNERS) | (F.col("repositories") >= MANY_REPOSITORIES)).alias("example"))
    span = F.struct("start", "rank", "kind", "end", "live", "example")
    base = F.collect_list(F.when(F.col("kind").isin(*BASE), span))
    added = F.collect_list(F.when((F.col("kind") == "opaque") & F.col("live"), span))
    per_row = judged.groupBy("row").agg(base.alias("base"), added.alias("added"))
    apart = F.filter("added", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    per_row = per_row.select("row", "base", F.concat("base", apart).alias("spans"))

    def number(column: str, test) -> Column:
        return F.coalesce(F.size(F.filter(column, test)), F.lit(0)).cast("long")

    def of(kind: str):
        return lambda x: x["kind"] == kind

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"))
    return rows.join(per_row, "row", "left").select(
        "row", "id",
        *[number("spans", of(kind)).alias(f"n_{kind}") for kind in PATTERNS],
        number("spans", lambda x: x["live"]).alias("n_live"),
        number("spans", lambda x: x["example"]).alias("n_example"),
        F.coalesce(_listed(F.col("base")), F.lit("")).alias("base_spans"),
        F.coalesce(_listed(F.col("spans")), F.lit("")).alias("spans"))


def op7_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    """Secrets of every document; a source is an owner, its documents of a language a repository."""
    docs = table(spark, directory, "documents")
    repository = F.concat_ws("/", F.col("source"), F.col("lang"))
    return secrets(docs, repository, F.col("source")).select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
        "spans", "n_opaque", "n_live", "n_example")


_QUOTED = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
_MATCHES = "\n  UNION ALL ".join(
    f"SELECT doc_id, repository, owner, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{_QUOTED[kind]}') AS found, "
    f"string_split_regex(text, '{_QUOTED[kind]}') AS gaps FROM texts"
    for rank, kind in enumerate(PATTERNS))
OP7_SQL = f"""
WITH texts AS (
  SELECT doc_id, concat_ws('/', source, lang) AS repository, coalesce(source, '') AS owner, coalesce(text, '') AS text
  FROM documents),
matches AS (
  {_MATCHES}),
parts AS (
  SELECT doc_id, repository, owner, rank, kind, unnest(range(1, len(found) + 1)) AS place, found, gaps
  FROM matches WHERE len(found) > 0),
placed AS (
  SELECT doc_id, repository, owner, rank, kind, found[place] AS match,
         (sum(length(gaps[place]) + length(found[place])) OVER (PARTITION BY doc_id, rank ORDER BY place
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS stop
  FROM parts),
valued AS (
  SELECT *, stop - length(match) AS start,
         CASE WHEN kind = 'assign' THEN regexp_extract(match, '{_QUOTED["assign"]}', 2) ELSE match END AS value
  FROM placed),
kept AS (
  SELECT *, len(list_distinct(string_split(value, ''))) >= {VARIETY} AS varied FROM valued
  WHERE (kind <> 'assign' OR length(value) >= {ASSIGNED})
    AND (kind <> 'opaque' OR (regexp_matches(match, '[0-9]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]')))),
owned AS (
  SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM kept GROUP BY value),
judged AS (
  SELECT k.*, o.owners = 1 AND k.varied AS live, o.owners >= {MANY_OWNERS} OR o.repositories >= {MANY_REPOSITORIES} AS example
  FROM kept k JOIN owned o ON o.value = k.value),
shown AS (
  SELECT *, kind || ':' || start::VARCHAR || ':' || stop::VARCHAR AS span FROM judged j
  WHERE kind <> 'opaque' OR (live AND NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.doc_id = j.doc_id AND b.kind <> 'opaque' AND b.start < j.stop AND j.start < b.stop)))
SELECT t.doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'opaque'), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans,
       count(*) FILTER (kind = 'opaque') AS n_opaque, count(*) FILTER (live) AS n_live, count(*) FILTER (example) AS n_example
FROM texts t LEFT JOIN shown s ON s.doc_id = t.doc_id
GROUP BY t.doc_id
"""
