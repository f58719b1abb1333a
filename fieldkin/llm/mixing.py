"""Mixing sources to target weights: token budgets down a tree, then seeded prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldkin.llm.common import numbered_rows, table
from fieldkin.session import keep

#: Weights of the tree's first two levels; sources of a language share equally.
DOMAIN_WEIGHTS = {"main": 5, "body": 3, "tail": 2}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
OTHER_WEIGHT = 1
#: Tokens wanted, in percent of all; epochs that a source may be read; the order's seed.
TARGET_PERCENT, EPOCHS, SEED = 80, 3, 17
#: Hexadecimal digits of the order's hash that cut a source into buckets.
BUCKET_DIGITS = 3

_TREE = ["domain", "language", "source"]


def domain_of(source: Column) -> Column:
    """``main`` for src0, ``body`` for src1 to src9, ``tail`` for all others."""
    return (
        F.when(source == "src0", "main").when(source.rlike("^src[1-9]$"), "body").otherwise("tail")
    )


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _weight(weights: dict[str, int], name: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("long")


def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def shared_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``budget`` of each node: its parent's ``total`` by ``weight``, up to ``capacity``.

    What a node can't take goes to its siblings by their weights. Nodes come in the
    order of capacity by weight. One is filled if its share of what the filled ones
    before it leave is its capacity or more; behind the first that isn't, none is, and
    these divide the rest by weight, rounded down.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("capacity").cast("double") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("taken"),
        (F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    ).withColumn(
        "full", _whole(F.col("capacity")) * F.col("open") <= _whole(F.col("weight")) * (F.col("total") - F.col("taken")))
    cut = F.min(F.when(~F.col("full"), F.struct("taken", "open"))).over(siblings)
    rest = (_whole(F.col("weight")) * (F.col("total") - F.col("cut.taken"))) / F.col("cut.open")
    return ranked.withColumn("cut", cut).withColumn(
        "budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(rest).cast("long"))
    ).drop("taken", "open", "full", "cut")


def leaf_budgets(leaves: DataFrame, target_percent: int = TARGET_PERCENT, epochs: int = EPOCHS,
                 domain_weights: dict[str, int] | None = None,
                 language_weights: dict[str, int] | None = None) -> DataFrame:
    """``budget`` in tokens of each leaf with ``domain``, ``language``, ``source``, ``tokens``.

    The target goes from the root to domains, languages and sources. A node's capacity
    is what its leaves hold in all epochs. A node's budget never exceeds its capacity,
    so what a leaf can't supply is made up by its siblings first, and only what none
    of them can supply by the siblings of its ancestors.
    """
    domain_weights = DOMAIN_WEIGHTS if domain_weights is None else domain_weights
    language_weights = LANGUAGE_WEIGHTS if language_weights is None else language_weights
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    domains = leaves.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    total = F.least(F.floor(_whole(all_tokens) * target_percent / 100), all_tokens * epochs).cast("long")
    domains = domains.select(
        "domain", "capacity", total.alias("total"), _weight(domain_weights, F.col("domain")).alias("weight"))
    domains = shared_out(domains, [], "domain").select("domain", F.col("budget").alias("total"))
    languages = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    languages = languages.join(domains, "domain").withColumn("weight", _weight(language_weights, F.col("language")))
    languages = shared_out(languages, ["domain"], "language").select(
        "domain", "language", F.col("budget").alias("total"))
    sources = leaves.join(languages, ["domain", "language"]).withColumn("weight", F.lit(1).cast("long"))
    return shared_out(sources, ["domain", "language"], "source").select(*_TREE, "tokens", "budget")


def mixture(docs: DataFrame, domain: Column | None = None, id_column: str = "doc_id", text_column: str = "text",
            language_column: str = "lang", source_column: str = "source", target_percent: int = TARGET_PERCENT,
            epochs: int = EPOCHS, seed: int = SEED, domain_weights: dict[str, int] | None = None,
            language_weights: dict[str, int] | None = None) -> DataFrame:
    """The rows of a mixture of whole token budgets, one row per epoch that a row is read in.

    Each leaf of the domain-language-source tree is read for as many whole epochs as
    its budget holds. In the next epoch its rows come in the order of a hash of seed,
    epoch and identifier, and the longest prefix that fits what is left is taken.

    The prefix is found without ordering a leaf: token sums per leaf and leading
    digits of the hash give the bucket in which the budget ends, and only that bucket
    is ordered. Sums combine before they are shuffled.

    Null languages and sources are the name ``''``; null texts have no tokens and are
    read with whole epochs, and in the last one where they come before its end. Rows
    that repeat an identifier are ordered as in the table. Leaves without tokens get none.

    Columns: ``row``, ``id``, ``domain``, ``language``, ``source``, ``tokens``, ``epoch`` (from 0).
    """
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    rows = keep(docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        (domain_of(source) if domain is None else domain).alias("domain"),
        F.coalesce(F.col(language_column).cast("string"), F.lit("")).alias("language"),
        source.alias("source"),
        token_count(F.col(text_column).cast("string")).alias("tokens"),
    ), "tokens")
    leaves = rows.groupBy(*_TREE).agg(F.sum("tokens").alias("tokens"))
    budgets = keep(leaf_budgets(leaves, target_percent, epochs, domain_weights, language_weights).select(
        *_TREE,
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
    ), "budgets")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.col("id").cast("string")))
    ordered = rows.join(budgets, _TREE).withColumn("digest", F.when(F.col("rest") > 0, digest))
    ordered = ordered.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    sums = ordered.where("rest > 0").groupBy(*_TREE, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*_TREE).orderBy("bucket"))
    # Written, so that its small size is known before the documents would be shuffled by it.
    ends = keep(
        sums.withColumn("after", running).where("after > rest")
        .groupBy(*_TREE).agg(F.min(F.struct("bucket", (F.col("after") - F.col("tokens")).alias("before"))).alias("end")),
        "ends")
    placed = ordered.join(ends, _TREE, "left")
    inside = placed.where("bucket = end.bucket")
    within = F.col("end.before") + F.sum("tokens").over(
        Window.partitionBy(*_TREE).orderBy("digest", "id", "row").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("last", within <= F.col("rest"))
    outside = placed.where("bucket is null or end is null or bucket <> end.bucket").withColumn(
        "last", F.coalesce(F.col("bucket") < F.col("end.bucket"), F.lit(False)))
    return outside.unionByName(inside).withColumn("times", F.col("whole") + F.col("last").cast("int")).where(
        "times > 0").select("row", "id", *_TREE, "tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))


def op5_mixing(spark: SparkSession, directory: str) -> DataFrame:
    """Documents and epochs of the mixture by the default weights."""
    return mixture(table(spark, directory, "documents")).select(
        F.col("id").alias("doc_id"), "domain", F.col("language").alias("lang"), "source", "tokens",
        F.col("epoch").cast("long").alias("epoch"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mixture with their own columns, and the epoch each row is read in.

    The last two columns are ``mix_epoch`` and ``mix_tokens``; they replace columns of that name.
    """
    row = "__llm_row"
    docs = docs.drop("mix_epoch", "mix_tokens")
    chosen = mixture(docs).select(F.col("row").alias(row), F.col("epoch").alias("mix_epoch"), F.col("tokens").alias("mix_tokens"))
    return numbered_rows(docs, row).join(chosen, row).drop(row)


def _level(name: str, parents: str, nodes: str, column: str) -> str:
    return f"""
{name}_ranked AS (
  SELECT *, coalesce(sum(capacity) OVER before, 0)::HUGEINT AS taken,
         (sum(weight) OVER (PARTITION BY {parents}) - coalesce(sum(weight) OVER before, 0))::HUGEINT AS opened
  FROM {nodes}
  WINDOW before AS (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {column}
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_full AS (
  SELECT *, capacity::HUGEINT * opened <= weight * (total - taken) AS filled FROM {name}_ranked),
{name}_cut AS (
  SELECT *, min(taken) FILTER (NOT filled) OVER (PARTITION BY {parents}) AS cut_taken,
         max(opened) FILTER (NOT filled) OVER (PARTITION BY {parents}) AS cut_open FROM {name}_full),
{name} AS (
  SELECT *, CASE WHEN filled THEN capacity ELSE (weight * (total - cut_taken)) // cut_open END AS budget FROM {name}_cut)"""


OP5_SQL = rf"""
WITH rows AS (
  SELECT doc_id,
         CASE WHEN coalesce(source, '') = 'src0' THEN 'main'
              WHEN regexp_matches(coalesce(source, ''), '^src[1-9]$') THEN 'body' ELSE 'tail' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	

]+'))::BIGINT AS tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, {EPOCHS} * sum(tokens)::HUGEINT AS capacity
  FROM rows GROUP BY ALL),
domain_nodes AS (
  SELECT domain, sum(capacity)::HUGEINT AS capacity, (SELECT sum(tokens) * {TARGET_PERCENT} // 100 FROM leaves)::HUGEINT AS total,
         CASE domain WHEN 'main' THEN 5 WHEN 'body' THEN 3 WHEN 'tail' THEN 2 ELSE 1 END::HUGEINT AS weight
  FROM leaves GROUP BY domain),
{_level('domains', "''", 'domain_nodes', 'domain')},
lang_nodes AS (
  SELECT l.domain, l.lang, l.capacity, d.budget AS total,
         CASE l.lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END::HUGEINT AS weight
  FROM (SELECT domain, lang, sum(capacity)::HUGEINT AS capacity FROM leaves GROUP BY ALL) l
  JOIN domains d ON d.domain = l.domain),
{_level('langs', 'domain', 'lang_nodes', 'lang')},
source_nodes AS (
  SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, g.budget AS total, 1::HUGEINT AS weight
  FROM leaves l JOIN langs g ON g.domain = l.domain AND g.lang = l.lang),
{_level('sources', 'domain, lang', 'source_nodes', 'source')},
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM sources),
ordered AS (
  SELECT r.*, p.whole, p.rest,
         sum(r.tokens) OVER (PARTITION BY r.domain, r.lang, r.source
           ORDER BY md5('{SEED}|' || p.whole::VARCHAR || '|' || r.doc_id::VARCHAR), r.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
  FROM rows r JOIN plan p ON p.domain = r.domain AND p.lang = r.lang AND p.source = r.source)
SELECT doc_id, domain, lang, source, tokens,
       unnest(range((whole + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch
FROM ordered
"""
