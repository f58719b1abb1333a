"""Schema inference and profiles of heterogeneous nested documents.

Documents are VARIANT values, because a path may hold several types. Levels are
unfolded by generators in one pass over the scan: at each level a node yields
itself and its members. Arrays add no path of their own, and their members record
nothing unless they sit under a key. Nothing is shuffled before the counts.

How many documents have a path is also decided inside the row. Members of plain
objects occur once per document; for documents in which a path can repeat, their
distinct paths are gathered first. So documents need no identifier and are never
counted distinctly.

How deep documents go is not asked first. Counts unfold a few levels, and containers
that are still open at the last one leave a mark in the counts; only collections with
a mark are measured and counted again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.functions import values as V
from fieldkin.operators.catalog import local_rows, with_families
from fieldkin.operators.profile import assemble
from fieldkin.session import keep
from fieldkin.sources.model import DOCUMENT, Entity, SourceSet

_INEXACT = "double"
#: Class of a container that the levels of a plan did not reach into.
_DEEPER = "deeper"
#: Levels unfolded at first: documents that nest so many containers are read once.
LEVELS = 4

# Schema text of an array of objects without containers or unusual keys.
_FLAT_OBJECTS = r"^ARRAY<OBJECT<(?:\w+: [A-Z_]+(?:\(\d+,\d+\))?(?:, )?)*+>>$"
_FLAT_KEY = r"(\w+): "

# Nodes of a document that wait for their rows.
_NODES = (
    "array<struct<path: string, v: variant, once: boolean, root: boolean, keyed: boolean, "
    "kind: string, deeper: boolean>>"
)

PLACE_SCHEMA = pa.schema([
    ("collection", pa.int32()), ("source_ord", pa.int32()), ("source_id", pa.string()),
    ("namespace", pa.string()), ("entity", pa.string()),
])

FIELD = ("source_ord", "source_id", "namespace", "entity", "path")


def _below(path: Column, key: Column) -> Column:
    """Path of a member; an array element (no key) keeps the path of its array."""
    return (
        F.when(key.isNull(), path)
        .when(path.isNull() | (path == ""), key)
        .otherwise(F.concat(path, F.lit("."), key))
    )


def nesting(documents: DataFrame, column: str) -> int:
    """How deep the containers of the deepest document are nested.

    Read off the type of a document, which names each container, in one pass over the
    scan that hands back one number; documents of one shape share a type, which is
    gone through once. A type that leaves out what differs within an array is of no
    use: there the brackets of the JSON text count, outside of its strings. The number
    decides how many levels a plan unfolds, so documents of any depth are unfolded whole.
    """
    schema = F.schema_of_variant(F.col(column))
    text = F.replace(F.replace(F.to_json(column), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), r"[^\[\]{}]", "")
    # A first bracket tells the two kinds of text apart.
    shapes = documents.select(
        F.when(schema.contains("VARIANT"), F.concat(F.lit("["), bare)).otherwise(schema).alias("type")).distinct()
    named = F.regexp_replace(F.regexp_replace("type", "`[^`]*`", ""), "[^<>]", "")
    brackets = F.when(F.col("type").startswith("["), F.substring("type", 2, 1 << 30)).otherwise(named)
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(state: Column, bracket: Column) -> Column:
        now = state["now"] + F.when(bracket.isin("[", "{", "<"), 1).when(bracket.isin("]", "}", ">"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    deep = F.aggregate(F.split(brackets, ""), none, count, lambda state: state["most"])
    return shapes.agg(F.max(deep)).first()[0] or 0


def _unfold(documents: DataFrame, column: str, depth: int) -> DataFrame:
    """``(path, v, once, root, kind, deeper)``: each document, without a path, and its keyed nodes.

    A level replaces each open row by its members; a row without any stays as it is. What
    has members rides along in ``above`` of its first one and gets its row at the end, so
    finished nodes don't pass through the levels twice. ``once`` nodes cannot repeat within
    their document: no array is above them, and no key of the document contains a dot.
    ``deeper`` nodes, keyed or not, are containers with members below the last level.
    ``kind`` is the class of what was seen to have members, so that it needn't be read again.
    """
    document = F.col(column)
    dotted = F.contains(F.schema_of_variant(document), F.lit("`"))
    none = F.array().cast(_NODES)
    rows = documents.select(
        F.lit(None).cast("string").alias("path"), document.alias("v"), (~dotted).alias("once"),
        F.lit(True).alias("root"), F.lit(True).alias("keyed"), F.lit(True).alias("open"), none.alias("above"),
    )
    for _ in range(depth):
        members = F.when(F.col("open"), F.col("v"))
        member, has_key = F.col("pos").isNotNull(), F.col("key").isNotNull()
        kind = F.when(has_key, F.lit("object")).otherwise(F.lit("array")).alias("kind")
        itself = F.array(F.struct("path", "v", "once", "root", "keyed", kind, F.lit(False).alias("deeper")))
        rows = (
            rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(members.outer()))
            .select(
                F.when(member, _below(F.col("path"), F.col("key"))).otherwise(F.col("path")).alias("path"),
                F.when(member, F.col("value")).otherwise(F.col("v")).alias("v"),
                (F.col("once") & (~member | has_key)).alias("once"),
                (F.col("root") & ~member).alias("root"),
                F.when(member, has_key).otherwise(F.col("keyed")).alias("keyed"),
                member.alias("open"),
                F.when(F.col("pos") > 0, none).when(member & F.col("keyed"), F.concat("above", itself))
                .otherwise(F.col("above")).alias("above"),
            )
        )
    schema = F.schema_of_variant("v")
    filled = schema.rlike("^(OBJECT|ARRAY)<") & ~schema.isin("OBJECT<>", "ARRAY<VOID>")
    deeper = F.when(F.col("open"), filled).otherwise(F.lit(False))
    kind = F.lit(None).cast("string").alias("kind")
    last = F.array(F.struct("path", "v", "once", "root", "keyed", kind, deeper.alias("deeper")))
    return rows.select(F.inline(F.concat("above", last))).where("keyed OR deeper").drop("keyed")


def _paths_within(value: Column, path: Column, depth: int) -> Column:
    """The distinct paths below one node, by a fold over its levels."""
    nodes = "array<struct<path: string, v: variant, keyed: boolean>>"

    def node(at: Column, v: Column, keyed: bool) -> Column:
        return F.struct(at.alias("path"), v.alias("v"), F.lit(keyed).alias("keyed"))

    def children(parent: Column) -> Column:
        at, v = parent["path"], parent["v"]
        members = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        elements = F.try_variant_get(v, "$", "array<variant>")
        return F.coalesce(
            F.transform(members, lambda m: node(_below(at, m["key"]), m["value"], True)),
            F.transform(elements, lambda e: node(at, e, False)),
            F.array().cast(nodes),
        )

    def descend(state: Column, _: Column) -> Column:
        keyed = F.filter(state["open"], lambda n: n["keyed"])
        below = F.struct(
            F.flatten(F.transform(state["open"], children)).cast(nodes).alias("open"),
            F.array_union(state["paths"], F.transform(keyed, lambda n: n["path"])).alias("paths"),
        )
        return F.when(F.size(state["open"]) > 0, below).otherwise(state)

    start = F.struct(
        F.array(node(path, value, False)).cast(nodes).alias("open"),
        F.array().cast("array<string>").alias("paths"),
    )
    levels = F.array_repeat(F.lit(0), depth + 1)
    return F.aggregate(levels, start, descend, lambda state: state["paths"])


def document_paths(documents: DataFrame, column: str) -> DataFrame:
    """``(path, v)`` of every keyed node of every document, one row each."""
    nodes = _unfold(documents, column, nesting(documents, column))
    return nodes.where(~F.col("root")).select("path", "v")


def _with_class(nodes: DataFrame) -> DataFrame:
    """Adds ``class``: the type of ``v``, with inexact numbers and deeper nodes told apart.

    ``_schema`` is read where the class or the paths of an array of containers need it.
    """
    schema, kind = F.col("_schema"), F.col("kind")
    listed = (kind == "array") & F.col("once") & ~F.col("root")
    name = (
        F.when(F.col("deeper"), F.lit(_DEEPER))
        .when(kind.isNotNull(), kind)
        .when(schema == "STRING", F.lit("string"))
        .when(schema.startswith("OBJECT"), F.lit("object"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .when(schema == "VOID", F.lit("null"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema.startswith("DATE") | schema.startswith("TIMESTAMP"), F.lit("date"))
        .when(schema.isin("BINARY", "UUID"), F.lower(schema))
        .when(schema.isin("DOUBLE", "FLOAT"), F.lit(_INEXACT))
        .when(schema.isNotNull(), F.lit("number"))
    )
    read = F.when(kind.isNull() | listed, F.schema_of_variant("v"))
    return nodes.withColumn("_schema", read).withColumn("class", name)


def _with_text(nodes: DataFrame) -> DataFrame:
    """Adds ``text``: scalars as texts, strings that aren't short by their key."""
    kind, whole = F.col("class"), F.col("_schema") == "BIGINT"
    scalar = kind.isin("string", "number", _INEXACT, "boolean", "date")
    text = F.when(whole, F.try_variant_get("v", "$", "bigint").cast("string")).when(
        scalar, F.try_variant_get("v", "$", "string"))
    long = (kind == "string") & (F.length("text") >= V.FINGERPRINT_LENGTH)
    read = nodes.withColumn("text", text).withColumn("_long", F.when(long, F.col("text")))
    return V.with_text_key(read, "_long").withColumn("text", F.coalesce("_long", "text"))


def _type() -> Column:
    """Catalog type name of a class."""
    return F.when(F.col("class") == _INEXACT, F.lit("number")).otherwise(F.col("class"))


def _with_key(counted: DataFrame) -> DataFrame:
    """Adds the key of a counted text, by its class. Long strings already carry theirs."""
    text, kind = F.col("text"), F.col("class")
    moment = F.when(kind == "date", text.try_cast("timestamp_ntz"))
    short = F.when((kind == "string") & (F.length(text) < V.FINGERPRINT_LENGTH), text)
    read = V.with_text_key(counted.withColumn("_short", short), "_short").withColumns({
        "_inexact": F.when(kind == _INEXACT, text.try_cast("double")),
        "_millis": V.epoch_millis(moment, T.TimestampNTZType()),
    })
    form = (
        F.when(kind == "string", F.coalesce("_short", text))
        .when(kind == "boolean", text)
        .when(kind == "number", V.decimal_form(text))
        .when(kind == _INEXACT, V.number_form(F.col("_inexact")))
        .when(kind == "date", V.millis_form(F.col("_millis")))
    )
    return read.withColumn(
        "key", F.when(kind != "null", F.coalesce(form, F.lit(V.NO_FINGERPRINT)))
    )


def _settled(
    counted: Callable[[list[int], int], DataFrame],
    collections: Iterable[int],
    depth: Callable[[list[int]], int],
) -> DataFrame:
    """Counts of the collections that reach all their levels, written to the shared folder.

    ``counted`` gives counts, with ``collection`` and ``class``, of some collections over
    a number of levels. Those with a deeper node are counted again over four times as many.
    """
    parts, left, levels = [], list(collections), LEVELS
    while left:
        found = keep(counted(left, levels), "document-counts")
        marked = found.where(F.col("class") == _DEEPER).select("collection").distinct()
        deep = [row.collection for row in marked.collect()]
        parts.append(found.where(~F.col("collection").isin(deep)) if deep else found)
        if deep:
            levels = max(depth(deep), levels + 1)
        left = deep
    return reduce(DataFrame.unionAll, parts)


def infer_fields(documents: DataFrame, column: str) -> DataFrame:
    """Dotted paths of a collection, each with the sorted set of its types."""
    def counted(_: list[int], levels: int) -> DataFrame:
        nodes = _with_class(_unfold(documents, column, levels)).where(~F.col("root"))
        return nodes.groupBy(F.lit(0).alias("collection"), "path", "class").agg(F.count("*").alias("n"))

    return _settled(counted, [0], lambda _: nesting(documents, column)).groupBy("path").agg(
        F.array_sort(F.collect_set(_type())).alias("types"))


def _occurrences(documents: DataFrame, column: str, depth: int) -> DataFrame:
    """``(path, text, class, once)`` of every node, and rows without class for presence.

    ``text`` is a scalar as it stands; of a string that isn't short, its key.

    ``once`` nodes stand for their document. Where paths can repeat, below an array
    of containers or anywhere in a document with dotted keys, the distinct paths are
    gathered and presence has rows of its own. No path stands for the document.
    The schema of an array of plain objects already lists the keys of all of them;
    for anything else the values are gone through.
    """
    nodes = _with_text(_with_class(_unfold(documents, column, depth)))
    once, root = F.col("once"), F.col("root")
    schema, path = F.col("_schema"), F.col("path")
    outer_array = ~root & once & schema.rlike("^ARRAY<(OBJECT|ARRAY|VARIANT)")
    keys = F.regexp_extract_all(schema, F.lit(_FLAT_KEY), F.lit(1))
    gathered = (
        F.when(outer_array & schema.rlike(_FLAT_OBJECTS), F.transform(
            keys, lambda key: _below(path, key)
        ))
        .when((root & ~once) | outer_array, _paths_within(F.col("v"), path, depth))
        .otherwise(F.array().cast("array<string>"))
    )
    itself = F.array(F.lit(None).cast("string"))
    seen = F.col("seen")
    # A projection of its own is compiled; Spark interprets these functions in a generator.
    # Outer, since Spark asks of an inner one first whether the list is empty, working it out again.
    listed = nodes.withColumn("listed", F.concat(gathered, itself))
    return listed.withColumn("seen", F.explode_outer("listed")).select(
        F.coalesce(seen, "path").alias("path"),
        F.when(seen.isNull(), F.col("text")).alias("text"),
        F.when(seen.isNull() & ~root, F.col("class")).alias("class"),
        once.alias("once"),
    )


def _collections(sources: SourceSet) -> list[tuple[int, str, Entity]]:
    return [
        (i, source.source_id, entity)
        for i, source in sources.of_kind(DOCUMENT)
        for entity in source.entities
    ]


def _counts(sources: SourceSet, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``count`` makes of the nodes of all collections, each unfolded to its end."""
    entities = [entity for _, _, entity in _collections(sources)]

    def counted(collections: list[int], levels: int) -> DataFrame:
        return count(reduce(DataFrame.unionAll, [
            _occurrences(entities[n].data, entities[n].document, levels).select(
                F.lit(n).alias("collection"), "path", "text", "class", "once"
            )
            for n in collections
        ]))

    def depth(collections: list[int]) -> int:
        return max(nesting(entities[n].data, entities[n].document) for n in collections)

    return _settled(counted, range(len(entities)), depth)


def _placed(counted: DataFrame, sources: SourceSet) -> DataFrame:
    places = local_rows(counted.sparkSession, [
        (n, i, source_id, entity.namespace, entity.name)
        for n, (i, source_id, entity) in enumerate(_collections(sources))
    ], PLACE_SCHEMA)
    return counted.join(places, "collection")


def _presence() -> list[Column]:
    """How many values were counted, and how many documents have the path."""
    return [
        F.count("class").alias("n"),
        F.count_if(F.col("once") | F.col("class").isNull()).alias("present"),
    ]


def document_presence(sources: SourceSet) -> DataFrame:
    """``(source…, path, type, n, present)``: what a catalog needs of the collections.

    Paths and types are counted; values are neither read as text nor shuffled.
    """
    counted = _counts(
        sources, lambda nodes: nodes.groupBy("collection", "path", "class").agg(*_presence()))
    return _placed(counted, sources).select(*FIELD, _type().alias("type"), "n", "present")


def document_counts(sources: SourceSet) -> DataFrame:
    """``(source…, path, type, key, n, present)`` over all document collections.

    ``n`` counts the values of a key, ``present`` the documents with the path.
    Values are counted as short texts; what those texts mean is worked out once
    per distinct one, after the count.

    Fields and values are both derived from these counts, which are written: a
    collection is read once for both.
    """
    def count(nodes: DataFrame) -> DataFrame:
        return nodes.groupBy("collection", "path", "class", "text").agg(*_presence())

    return _placed(_with_key(_counts(sources, count)), sources).select(
        *FIELD, _type().alias("type"), "key", "n", "present"
    )


def _field_id() -> Column:
    return F.xxhash64("source_id", "namespace", "entity", "path")


def document_fields(sources: SourceSet, counts: DataFrame) -> DataFrame:
    """Inferred fields of the document collections, in the shape of a catalog.

    ``_id`` is the primary key of a collection; declared unique keys mark every
    path that takes part in them.
    """
    unique = F.col("path") == "_id"
    for _, source in sources.of_kind(DOCUMENT):
        for entity in source.entities:
            paths = sorted(entity.columns_of("unique") | entity.columns_of("primary"))
            if paths:
                unique = unique | (
                    (F.col("source_id") == source.source_id)
                    & (F.col("namespace") == entity.namespace)
                    & (F.col("entity") == entity.name)
                    & F.col("path").isin(paths)
                )
    # Types first: few rows are left for the sets.
    typed = counts.groupBy(*FIELD, "type").agg(F.sum(F.when(F.col("n") >= 0, F.col("present"))).alias("present"))
    paths = typed.groupBy(*FIELD).agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.sum("present").alias("present"))
    collection = FIELD[:-1]
    is_document = F.size("types") == 0
    documents = paths.where(is_document).select(
        *collection, F.col("present").alias("documents")
    )
    fields = (
        paths.where(~is_document)
        .join(documents, list(collection))
        .withColumns({
            "field_id": _field_id(),
            "primary_key": F.col("path") == "_id",
            "unique": unique,
            "declared_nullable": F.array_contains("types", "null")
            | (F.col("present") < F.col("documents")),
        })
    )
    return with_families(fields)


def document_value_counts(counts: DataFrame) -> DataFrame:
    """``(field_id, key, n, comparable)`` of document values, whatever their types."""
    return (
        counts.where(F.col("n") > 0)
        .select(_field_id().alias("field_id"), "key", "n", "present")
        .groupBy("field_id", "key")
        .agg(F.sum(F.when(F.col("present") >= 0, F.col("n"))).alias("n"))
        .select("field_id", "key", "n", V.is_comparable(F.col("key")).alias("comparable"))
    )


def document_profile(sources: SourceSet) -> DataFrame:
    """Profiles of every inferred field of the document collections."""
    counts = document_counts(sources)
    fields = document_fields(sources, counts)
    return assemble(fields, document_value_counts(counts), F.col("declared_nullable"))
