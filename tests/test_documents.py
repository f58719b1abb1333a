"""Inference and profiles of heterogeneous documents."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldkin.operators import documents as D
from fieldkin.sources.model import DOCUMENT, Entity, Key, Source, SourceSet
from fieldkin.sources.readers import (
    DOCUMENT_COLUMN, documents_from_json, documents_from_rows, load_all, read_json_lines,
)


def collection(spark, *docs):
    texts = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
    return documents_from_json(spark.createDataFrame(texts, "value string"))


def inferred(spark, *docs, **options):
    rows = D.infer_fields(collection(spark, *docs), DOCUMENT_COLUMN, **options).collect()
    return {r.path: r.types for r in rows}


def profiles(spark, *docs, keys=()):
    def source(source_id, data, declared=()):
        return Source(source_id, DOCUMENT, (
            Entity("db", "things", data, keys=declared, document=DOCUMENT_COLUMN),))

    sources = SourceSet([
        source("a", collection(spark, *docs), keys), source("b", collection(spark, {"x": 1})),
    ])
    rows = D.document_profile(sources).where("source_id = 'a'").collect()
    return {r.path: r for r in rows}


def test_nested_mixed_fields(spark):
    got = inferred(
        spark,
        {"customer": {"active": True, "address": {"city": "SP"}}, "tags": [{"name": "new"}]},
        {"customer": {"active": False, "address": {"city": 42}}, "tags": []},
    )
    assert got == {
        "customer": ["object"], "customer.active": ["boolean"], "customer.address": ["object"],
        "customer.address.city": ["number", "string"], "tags": ["array"],
        "tags.name": ["string"],
    }


def test_array_members_record_nothing_of_their_own(spark):
    assert inferred(spark, {"tags": ["a", 1, None]}) == {"tags": ["array"]}
    assert inferred(spark, {"m": [[{"k": None}], [[{"k": 1.5}]]]}) == {
        "m": ["array"], "m.k": ["null", "number"],
    }


def test_empty_documents_and_containers(spark):
    assert inferred(spark, {}, {"a": {}, "b": []}) == {"a": ["object"], "b": ["array"]}


def test_documents_of_any_depth_are_unfolded(spark):
    deep, path = 1, []
    for level in range(40):
        deep = {f"k{level}": deep, 'x"]}[{\\': "]]}"} if level % 3 else [{f"k{level}": deep}]
        path.insert(0, f"k{level}")
    documents = collection(spark, {"r": deep}, {"a": {"b": {"c": {"d": 1}}}})
    assert D.nesting(documents, DOCUMENT_COLUMN) == 41 + 14
    got = {r.path: r.types for r in D.infer_fields(documents, DOCUMENT_COLUMN).collect()}
    assert got[".".join(["r", *path])] == ["number"] and got["a.b.c.d"] == ["number"]
    assert profiles(spark, {"r": deep})[".".join(["r", *path])].distinct_count == 1


@pytest.mark.parametrize("levels", range(D.LEVELS - 3, D.LEVELS + 1))
def test_documents_about_as_deep_as_the_levels_of_a_plan(spark, levels):
    inner = [{"k": 1}, [{"k": 1}], [[{"k": 1}]], [], [[]], {}, [None], {"k": []}]
    documents, wanted = [], set()
    for i, value in enumerate(inner):
        path = [f"r{i}", *["d"] * levels, *(["k"] if "k" in json.dumps(value) else [])]
        for key in reversed([f"r{i}", *["d"] * levels]):
            value = {key: value}
        documents.append(value)
        wanted |= {".".join(path[:n]) for n in range(1, len(path) + 1)}
    assert set(inferred(spark, *documents)) == wanted


def test_a_collection_is_read_once_and_a_deep_one_again(spark):
    def read(*docs):
        """How many scans each of the written counts has."""
        seen = []

        def spy(data, name):
            plan = data._jdf.queryExecution().optimizedPlan().toString()
            seen.append(plan.count("LocalRelation") + plan.count("LogicalRDD"))
            return kept(data, name)

        kept, D.keep = D.keep, spy
        try:
            profiles(spark, *docs)
        finally:
            D.keep = kept
        return seen

    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}
    assert read({"a": {"b": 1}}) == [2], "both collections, one read of each"
    assert read({"a": {"b": 1}}, deep) == [2, 1], "then the deep one alone"


def test_profile_counts_values_and_distinct_values(spark):
    got = profiles(
        spark,
        {"customer": {"id": "C-1"}, "total": 10},
        {"customer": {"id": " c-2"}, "total": 12},
        {"customer": {"id": "C-1"}, "total": None},
    )
    assert set(got) == {"customer", "customer.id", "total"}
    ident, total = got["customer.id"], got["total"]
    assert (ident.sampled_value_count, ident.distinct_sample_count, ident.nullable) == (3, 2, False)
    assert (total.sampled_value_count, total.distinct_sample_count, total.nullable) == (2, 2, True)
    assert (total.types, total.type_families) == (["null", "number"], ["number"])
    assert ident.value_fingerprints == sorted(
        hashlib.sha256(v.encode()).hexdigest() for v in ("c-1", "c-2")
    )
    assert (got["customer"].sampled_value_count, got["customer"].type_families) == (0, ["unknown"])


def test_numbers_and_texts_of_equal_form_count_as_one_value(spark):
    got = profiles(spark, {"v": 42}, {"v": "42"}, {"v": 42.0}, {"v": 4.2e1})["v"]
    assert (got.sampled_value_count, got.distinct_count) == (4, 1)
    assert got.type_families == ["number", "text"]


def test_number_texts(spark):
    got = profiles(spark, '{"v": 1.50}', '{"v": 1e300}', '{"v": 0.1}', '{"v": 100}')["v"]
    assert set(got.value_fingerprints) == {
        hashlib.sha256(v.encode()).hexdigest() for v in ("1.5", "1e+300", "0.1", "100")
    }


def test_presence_counts_documents_not_occurrences(spark):
    # Two members in one document do not make up for another without any.
    got = profiles(spark, {"tags": [{"n": "x"}, {"n": "y"}]}, {"tags": [{}]})
    assert got["tags.n"].nullable and not got["tags"].nullable
    got = profiles(spark, {"tags": [{}, {"n": "x"}]}, {"tags": [{"n": 1}, {"n": 2}]})
    assert not got["tags.n"].nullable
    assert got["tags.n"].sampled_value_count == 3


@pytest.mark.parametrize("extra", [
    {}, {"deep": {"x": 1}}, {"é": 1}, {"odd: key, b": 2}, {"list": [1]}, {"dec": 1.25},
])
def test_presence_in_flat_and_other_arrays(spark, extra):
    got = profiles(
        spark, {"t": [{"a": 1, "b_2": None, **extra}, {"a": "x"}]}, {"t": [{"b_2": 1}, {"b_2": 2}]},
    )
    assert got["t.a"].nullable and got["t.a"].sampled_value_count == 2
    assert got["t.b_2"].types == ["null", "number"]
    for key in extra:
        assert got[f"t.{key}"].nullable
    both = profiles(spark, {"t": [{**extra, "a": 1}, {"a": 2}]}, {"t": [{}, {"a": 1, **extra}]})
    assert not any(both[f"t.{key}"].nullable for key in ("a", *extra))


def test_presence_where_a_dotted_key_meets_a_nested_path(spark):
    got = profiles(spark, {"a": {"b": 1}, "a.b": 2}, {"a": {}})
    assert got["a.b"].nullable and got["a.b"].sampled_value_count == 2


def test_keys_of_a_collection(spark):
    got = profiles(
        spark, {"_id": 1, "slug": "s", "n": {"slug": 1}},
        keys=(Key("slug_1", "unique", ("slug",)),),
    )
    assert (got["_id"].primary_key, got["_id"].unique) == (True, True)
    assert (got["slug"].primary_key, got["slug"].unique) == (False, True)
    assert not got["n.slug"].unique


def test_at_most_one_hundred_fingerprints_all_values_counted(spark):
    got = profiles(spark, *({"id": i} for i in range(150)))["id"]
    assert (got.sampled_value_count, got.distinct_sample_count, got.distinct_count) == (150, 100, 150)
    assert len(got.value_fingerprints) == 100


def test_documents_from_typed_rows_keep_dates(spark):
    rows = spark.sql("""
        SELECT named_struct('at', timestamp_ntz'2024-01-01 00:00:07.179575', 'on', date'2024-01-02')
          AS seen, array(named_struct('p', 1.50BD)) AS items
    """)
    data = documents_from_rows(rows)
    types = {r.path: r.types for r in D.infer_fields(data, DOCUMENT_COLUMN).collect()}
    assert types["seen.at"] == types["seen.on"] == ["date"]
    sources = SourceSet(
        Source(s, DOCUMENT, (Entity("db", "c", data, document=DOCUMENT_COLUMN),)) for s in "ab"
    )
    got = {r.path: r.value_fingerprints for r in D.document_profile(sources).collect()}
    wanted = {"seen.at": "2024-01-01T00:00:07.179Z", "seen.on": "2024-01-02T00:00:00.000Z",
              "items.p": "1.5"}
    for path, form in wanted.items():
        assert got[path] == [hashlib.sha256(form.encode()).hexdigest()]


def test_json_lines_source(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n{"a": "x", "b": [true]}\n')
    data = read_json_lines(spark, str(tmp_path / "c.jsonl"))
    assert data.count() == 2
    loaded = load_all(spark, DOCUMENT, {"c": str(tmp_path / "c.jsonl")})["c"]
    types = {r.path: r.types for r in D.infer_fields(loaded, DOCUMENT_COLUMN).collect()}
    assert types == {"a": ["number", "string"], "b": ["array"]}
    with pytest.raises(ValueError):
        load_all(spark, "graph", {"c": "x"})


def test_unfolding_needs_no_python_and_no_shuffle_before_the_count(spark):
    data = D.document_paths(collection(spark, {"a": [{"b": 1}]}), DOCUMENT_COLUMN)
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert data.select(F.count("*")).first()[0] == 2


def test_finished_nodes_pass_a_level_once_and_presence_is_compiled(spark):
    nodes = D._occurrences(collection(spark, {"a": [{"b": 1}]}), DOCUMENT_COLUMN, 3)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    generators = [line.lstrip(" +-:") for line in plan.splitlines() if "Generate " in line]
    assert len(generators) == 3 + 2, "the levels, the nodes that waited, and presence"
    assert all(line.startswith("*(") for line in generators), "none is interpreted"
    assert "size(concat" not in plan, "the paths of a document are listed once"


def test_short_and_long_texts_count_by_their_form(spark):
    texts = [
        "", " ", "Ab", " aB\t", "x" * 63, "X" * 63, "y" * 64, " " * 70 + "Ab", "Z" * 65 + "\n", "z" * 65,
        "\u0130" * 40, "W" * 1024, "v" * 1025, "8" * 64, hashlib.sha256(b"ab").hexdigest(),
    ]
    got = profiles(spark, *({"t": text} for text in texts))["t"]
    forms = [form for text in texts if 0 < len(form := text.strip().lower()) <= 1024]
    assert got.sampled_value_count == len(forms) and got.distinct_count == len(set(forms))
    assert set(got.value_fingerprints) == {hashlib.sha256(form.encode()).hexdigest() for form in forms}


def test_values_are_counted_by_the_number_of_their_field(spark):
    counts = spark.createDataFrame(
        [(0, "s", "n", "e", "p", "string", "k", 2, 2), (0, "s", "n", "e", "p", "number", "k", 1, 1)],
        "source_ord int, source_id string, namespace string, entity string, path string, type string, "
        "key string, n bigint, present bigint")
    values = D.document_value_counts(counts)
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [field_id#" in plan, "not by the texts that name it"
    assert [(r.key, r.n, r.comparable) for r in values.collect()] == [("k", 3, True)]
