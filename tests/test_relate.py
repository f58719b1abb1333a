"""Profiles, overlap, suggestions and their agreement with brute force."""

from __future__ import annotations

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from fieldkin.operators import overlap, profile, relate
from fieldkin.operators.catalog import (
    catalog_entities, catalog_fields, catalog_keys, declared_keys, profiled_fields, row_counts,
)
from fieldkin.operators.value_counts import value_counts
from fieldkin.plans import discovery
from fieldkin.session import keep
from fieldkin.sources.model import RELATIONAL, Entity, Key, Source, SourceSet


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def source(source_id, *entities):
    return Source(source_id, RELATIONAL, entities)


def sources_of(spark, left, right, left_type="string", right_type="string", **options):
    """Two one-column tables, customers.id (a key unless told) and orders.customer_id."""
    keys = (Key("pk", "primary", ("id",)),) if options.get("key", True) else ()
    ids = options.get("identifiers", False)
    return SourceSet([
        source("crm", Entity(
            "public", "customers", table(spark, [(v,) for v in left], f"id {left_type}"),
            keys=keys, identifiers=frozenset(["id"] if ids else []))),
        source("billing", Entity(
            "public", options.get("entity", "orders"),
            table(spark, [(v,) for v in right], f"{options.get('column', 'customer_id')} {right_type}"),
            identifiers=frozenset(["customer_id"] if ids else []))),
    ])


def test_profile_of_keys_and_text(spark):
    data = table(spark, [("u1", "A@x", 1.5), ("u2", "b@x", None), ("U1 ", None, 1.5)],
                 "id string, email string, score double")
    sources = SourceSet([
        source("crm", Entity("public", "customers", data,
                             keys=(Key("pk", "primary", ("id",)), Key("u", "unique", ("email",))),
                             identifiers=frozenset(["id"]))),
        source("other", Entity("public", "none", table(spark, [], "n int, d date"))),
    ])
    rows = {r.path: r for r in profile.field_profile(spark, sources).collect()}
    ident, email, score = rows["id"], rows["email"], rows["score"]
    assert (ident.types, ident.type_families) == (["uuid"], ["identifier"])
    assert (ident.primary_key, ident.unique, ident.nullable) == (True, False, False)
    assert (ident.sampled_value_count, ident.distinct_count) == (3, 2)
    assert (email.primary_key, email.unique, email.nullable, email.null_count) == (False, True, True, 1)
    assert (score.sampled_value_count, score.distinct_count) == (2, 1)
    assert score.value_fingerprints == [hashlib.sha256(b"1.5").hexdigest()]
    for path in ("n", "d"):
        empty = rows[path]
        assert (empty.sampled_value_count, empty.distinct_count, empty.value_fingerprints) == (0, 0, [])
    assert "a@x" not in str(rows).lower()


def test_declared_key_that_holds_a_null_is_nullable(spark):
    sources = sources_of(spark, ["a", None], ["a"])
    row = profile.field_profile(spark, sources).where("path = 'id'").first()
    assert row.nullable and row.primary_key


def test_catalog_keeps_unprofiled_columns_and_key_order(spark):
    data = table(spark, [], "tenant_id int, id int, payload binary, tags array<string>, "
                            "at timestamp, m map<string,int>")
    sources = SourceSet([
        source("a", Entity("public", "orders", data, indexes=("z_idx", "a_idx"), keys=(
            Key("pk", "primary", ("tenant_id", "id")), Key("u", "unique", ("tags", "at")),
            Key("v", "unique", ("at",))))),
        source("b", Entity("public", "plain", table(spark, [], "x float"))),
    ])
    fields = catalog_fields(spark, sources)
    types = {r.path: r.types[0] for r in fields.collect()}
    assert types == {"tenant_id": "integer", "id": "integer", "payload": "binary", "tags": "array",
                     "at": "timestamp with time zone", "m": "map<string,int>", "x": "real"}
    profiled = {r.path for r in profiled_fields(spark, sources).collect()}
    assert profiled == {"tenant_id", "id", "at", "x"}
    entities = catalog_entities(spark, sources)
    keys = {r.entity: (r.key_name, r.key_fields, r.unique_fields, r.indexes)
            for r in catalog_keys(entities, declared_keys(spark, sources)).collect()}
    assert keys == {
        "orders": ("pk", ["tenant_id", "id"], ["at", "tags"], ["a_idx", "z_idx"]),
        "plain": (None, [], [], []),
    }
    assert {r.path: r.primary_key for r in fields.where("entity = 'orders'").collect()}["tenant_id"]


def test_a_foreign_key_is_suggested(spark):
    sources = sources_of(spark, ["c1", "c2"], ["C1", "c2 ", "c3"], identifiers=True)
    rows = discovery.suggest(spark, sources).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row.cardinality == "one-to-many" and row.operator == "equals"
    assert row.evidence == ["compatible_types", "name_match", "key_match", "value_overlap"]
    assert row.confidence == 0.75 and row.join_type == "inner"
    assert (row.left_source_id, row.right_path) == ("crm", "customer_id")


@pytest.mark.parametrize("right_type, values, key", [("string", ["a"], True), ("int", [7], False)])
def test_nothing_is_suggested_without_types_or_signals(spark, right_type, values, key):
    sources = sources_of(spark, [1, 2], values, "int", right_type, key=key, entity="events",
                         column="id")
    assert discovery.suggest(spark, sources).count() == 0


def test_at_most_one_hundred_suggestions_in_a_total_order(spark):
    # 15 fields named alike in two sources: more pairs than are returned.
    columns = ", ".join(f"n{i} int" for i in range(15))
    data = table(spark, [tuple([1] * 15)], columns)
    sources = SourceSet(source(s, Entity("public", "t", data)) for s in ("a", "b"))
    rows = [tuple(r) for r in discovery.suggest(spark, sources).collect()]
    assert len(rows) == len(set(map(str, rows))) == 100
    everything = discovery.relationships(spark, sources)
    assert everything.count() == 225
    again = [tuple(r) for r in discovery.suggest(spark, sources).collect()]
    assert rows == again


def _sets(spark, sources):
    counts = value_counts(sources).where(F.col("n") > 0)
    found = {}
    for r in counts.collect():
        if r.key:
            found.setdefault(r.field_id, set()).add(r.key)
    return found


def test_overlap_equals_brute_force(spark, sources):
    sets = _sets(spark, sources)
    wanted = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if common := len(sets[a] & sets[b]):
            wanted[a, b] = (common, common / len(sets[a] | sets[b]))
    rows = overlap.value_overlap(value_counts(sources)).collect()
    assert {(r.a, r.b): (r.shared, r.overlap) for r in rows} == wanted


def test_sketch_overlap_is_exact_for_fields_that_fit(spark, sources):
    sets = _sets(spark, sources)
    exact = {(r.a, r.b): r.overlap for r in overlap.value_overlap(value_counts(sources)).collect()}
    sketch = profile.fingerprint_sketch(value_counts(sources))
    for r in overlap.sketch_overlap(sketch).collect():
        if len(sets[r.a] | sets[r.b]) <= 100:
            assert r.overlap == exact[r.a, r.b]
    small = {p for p in exact if len(sets[p[0]] | sets[p[1]]) <= 100}
    assert small <= {(r.a, r.b) for r in overlap.sketch_overlap(sketch).collect()}


def test_candidates_lose_no_relationship(spark, sources):
    """Every pair of fields, scored one by one, against the candidate joins."""
    described = relate.describe(profiled_fields(spark, sources)).collect()
    overlaps = {(r.a, r.b): r.overlap for r in discovery.overlaps(spark, sources).collect()}
    wanted = set()
    for a, b in itertools.combinations(described, 2):
        if a.source_ord == b.source_ord or not set(a.type_families) & set(b.type_families):
            continue
        one, other = set(a.tokens), set(b.tokens)
        name = len(one & other) / len(one | other) if one | other else 0.0
        key = a.is_key or b.is_key
        score = 0.2 + name * 0.3 + (0.2 if key else 0.0) + overlaps.get((a.field_id, b.field_id), 0.0) * 0.3
        if score >= 0.45:
            wanted.add((a.entity, a.path, b.entity, b.path))
    got = discovery.relationships(spark, sources).collect()
    assert {(r.left_entity, r.left_path, r.right_entity, r.right_path) for r in got} == wanted
    assert len(got) == len(wanted) == 51


def test_nearly_equal_names_need_no_key(spark):
    def named(source_id, *columns):
        data = table(spark, [], ", ".join(f"{c} string" for c in columns))
        return source(source_id, Entity("public", "account_billing_city_zip_code", data))

    sources = SourceSet([named("a", "name", "other"), named("b", "name", "different")])
    got = {(r.left_path, r.right_path) for r in discovery.suggest(spark, sources).collect()}
    assert got == {("name", "name")}


def test_foreign_keys_lead(spark):
    from fieldkin.sources.warehouse import warehouse

    rows = discovery.suggest(spark, warehouse(spark, "/root/testdata/sf0.01")).collect()
    assert [(r.left_path, r.right_path, r.confidence) for r in rows[:4]] == [
        ("c_custkey", "o_custkey", 0.76), ("n_nationkey", "s_nationkey", 0.76),
        ("l_partkey", "p_partkey", 0.76), ("l_suppkey", "s_suppkey", 0.76),
    ]
    assert len(rows) == 42


def test_mixed_kinds_of_sources_relate(spark):
    from fieldkin.sources.model import DOCUMENT
    from fieldkin.sources.readers import DOCUMENT_COLUMN, documents_from_json

    docs = spark.createDataFrame(
        [('{"_id": 1, "buyer": {"customer_id": 7}}',), ('{"_id": 2, "buyer": {"customer_id": 8}}',)],
        "value string",
    )
    sources = SourceSet([
        source("crm", Entity("public", "customers", table(spark, [(7,), (8,)], "id int"),
                             keys=(Key("pk", "primary", ("id",)),))),
        Source("shop", DOCUMENT, (Entity("shop", "orders", documents_from_json(docs),
                                         document=DOCUMENT_COLUMN),)),
    ])
    rows = discovery.suggest(spark, sources).collect()
    assert [(r.left_path, r.right_path, r.cardinality) for r in rows] == [
        ("id", "buyer.customer_id", "one-to-many"),
    ]
    assert rows[0].confidence == 0.8


def test_sample_mode_is_repeatable(spark, sources):
    first = [tuple(r) for r in discovery.suggest(spark, sources, "sample").collect()]
    assert first == [tuple(r) for r in discovery.suggest(spark, sources, "sample").collect()]
    with pytest.raises(ValueError):
        discovery.overlaps(spark, sources, "guess")


def test_kept_counts_serve_every_query(spark, sources):
    found = discovery.inspect(spark, sources)
    kept = discovery.Inspection(found.fields, keep(found.counts, "counts"))
    assert "l_shipdate" not in kept.counts._jdf.queryExecution().toString()
    assert discovery.related(kept).count() == discovery.relationships(spark, sources).count()
    rows = profile.field_profile(spark, sources, kept.counts).collect()
    assert len(rows) == 45 and sum(r.sampled_value_count for r in rows) > 0


def test_plans_have_no_python_and_no_pair_loop(spark, sources):
    for data in (
        discovery.suggest(spark, sources), discovery.suggest(spark, sources, "sketch"),
        profile.field_profile(spark, sources), relate.name_similarity(
            relate.describe(profiled_fields(spark, sources))),
    ):
        plan = data._jdf.queryExecution().executedPlan().toString()
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "Pandas"):
            assert unwanted not in plan


def test_sketch_ranks_before_it_shuffles(spark, sources):
    sketch = profile.fingerprint_sketch(value_counts(sources))
    plan = sketch._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 100, Partial" in plan and "row_number(), 100, Final" in plan


def test_scans_read_each_column_once(spark, sources):
    plan = value_counts(sources)._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: struct<")[1] for line in plan.splitlines() if "ReadSchema" in line]
    read = [c.split(":")[0] for s in schemas for c in s.rstrip(">").split(",")]
    assert plan.count("l_shipdate:") == 1 and plan.count("c_acctbal:") == 1
    assert len(read) == 45


def test_source_rules(spark):
    data = Entity("public", "t", table(spark, [], "x int"))
    with pytest.raises(ValueError, match="unique"):
        SourceSet([source("a", data), source("a", data)])
    with pytest.raises(ValueError, match="required"):
        SourceSet([])
    for count in (1, 11):
        some = SourceSet(source(f"s{i}", data) for i in range(count))
        assert row_counts(some).count() == count, "limits are those of mapping requests"
        with pytest.raises(ValueError, match="2 to 10"):
            discovery.suggest(spark, some)
    for bad in ("1a", "", "a b", "x" * 65):
        with pytest.raises(ValueError):
            source(bad, data)
    assert len(SourceSet(source(f"s{i}", data) for i in range(10))) == 10


def test_sketches_read_each_column_once(spark, sources):
    def scans(mode):
        found = discovery.overlaps(spark, sources, mode)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        return plan.split("== Initial Plan ==")[0].count("FileScan")

    assert scans("sketch") <= scans("exact")
