"""Bounded queries, document predicates, lookups and text matching."""

from __future__ import annotations

import json
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldkin.operators import paths
from fieldkin.operators import query as q
from fieldkin.sources.readers import DOCUMENT_COLUMN, documents_from_json


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(1001).withColumnRenamed("id", "n")


def test_sql_results_are_capped(spark, many):
    assert q.bounded_sql(spark, "SELECT n FROM many", {"many": many}).count() == 1000
    assert q.bounded_sql(spark, "SELECT n FROM many LIMIT 7;", {"many": many}).count() == 7


def test_sql_keeps_the_inner_order(spark, many):
    rows = q.bounded_sql(spark, "SELECT n FROM many ORDER BY n DESC", {"many": many}).collect()
    assert [r.n for r in rows] == list(range(1000, 0, -1))


@pytest.mark.parametrize("text", [
    "DROP TABLE many", "CREATE TABLE x AS SELECT 1", "INSERT INTO many VALUES (1)",
    "SET spark.sql.ansi.enabled=false", "SELECT 1; SELECT 2", "-- nothing", "",
    "SELECT 1; DROP VIEW many", "SELECT 1 /* open", "SELECT 1; /* open", "SELECT 1;;",
])
def test_only_one_read_statement_is_accepted(spark, many, text):
    with pytest.raises(PySparkException):
        q.bounded_sql(spark, text, {"many": many})
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


@pytest.mark.parametrize("text", [
    "SELECT ';' AS s", "SELECT 1 -- ; not an end", "SELECT 1 /* ; */ AS one",
    "WITH a AS (SELECT 1 AS x) SELECT x FROM a;", "SELECT 1 AS `a;b`", "VALUES (1)",
    "SELECT 1; -- note", "SELECT ';' AS s; /* a ; */ -- and b\n  ",
])
def test_semicolons_in_text_and_comments_are_no_ends(spark, text):
    assert q.bounded_sql(spark, text, {}).count() == 1


def test_views_of_the_caller_are_put_back(spark, many):
    spark.range(2).createOrReplaceTempView("many")
    assert q.bounded_sql(spark, "SELECT n FROM many LIMIT 7", {"many": many, "other": many}).count() == 7
    assert spark.table("many").count() == 2 and not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("many")


def test_find_caps_sorts_and_projects(spark, many):
    assert q.find(many).count() == 1000
    assert q.find(many, limit=2000).count() == 1000
    got = q.find(many, F.col("n") >= 5, [F.col("n").alias("m")], {"n": 1}, 2).collect()
    assert [r.m for r in got] == [5, 6]


def test_find_sorts_nulls_lowest(spark):
    data = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "i int, v int")
    assert [r.i for r in q.find(data, sort={"v": 1}).collect()] == [2, 3, 1]
    assert [r.i for r in q.find(data, columns=["i"], sort={"v": -1}).collect()] == [1, 3, 2]


@pytest.mark.parametrize("options", [
    {"limit": 0}, {"limit": -1}, {"limit": 1.5}, {"limit": True}, {"sort": {"n": 2}},
])
def test_find_refuses_bad_limits_and_directions(many, options):
    with pytest.raises(ValueError):
        q.find(many, **options)


def test_aggregate_is_capped(many):
    got = q.aggregate(many, lambda d: d.groupBy("n").count(), lambda d: d.where("n < 5000"))
    assert got.count() == 1000


def test_array_predicates(spark):
    data = spark.createDataFrame(
        [(1, ["IV", "V"]), (2, ["V"]), (3, []), (4, None), (5, ["IX", "V"])],
        "i int, episodes array<string>",
    )
    ids = lambda condition: sorted(r.i for r in data.where(condition).collect())
    assert ids(q.matches(data, "episodes", "IV")) == [1]
    assert ids(q.matches(data, "i", 2)) == [2]
    assert ids(q.any_outside("episodes", ["IV", "V", "VI"])) == [5]
    assert ids(q.matches(data, "episodes", None)) == [4]
    nulls = spark.createDataFrame([(1, ["IV", None]), (2, ["IV"])], "i int, episodes array<string>")
    assert [r.i for r in nulls.where(q.any_outside("episodes", ["IV"])).collect()] == [1]
    assert [r.i for r in nulls.where(q.matches(nulls, "episodes", None)).collect()] == [1]


def test_presence_differs_from_null(spark):
    data = spark.createDataFrame([(1, '{"h": null}'), (2, "{}"), (3, '{"h": {"x": 1}}')], "i int, j string")
    data = data.withColumn("d", F.parse_json("j"))
    assert sorted(r.i for r in data.where(q.has_path("d", "$.h")).collect()) == [1, 3]
    assert [r.i for r in data.where(q.has_path("d", "$.h.x")).collect()] == [3]


@pytest.fixture(scope="module")
def worlds(spark):
    people = spark.createDataFrame(
        [("luke", "tatooine"), ("leia", "alderaan"), ("rey", "jakku"), ("yoda", None)],
        "name string, home string",
    )
    planets = spark.createDataFrame([("tatooine", 1), ("tatooine", 2), ("alderaan", 3), (None, 4)],
                                    "slug string, n int")
    return people, planets


def test_lookup_nests_matches(worlds):
    rows = q.lookup(*worlds, "home", "slug", "planet", columns=["n"]).collect()
    assert {r.name: [m.n for m in r.planet] for r in rows} == {
        "luke": [1, 2], "leia": [3], "rey": [], "yoda": [],
    }
    flat = q.lookup_rows(*worlds, "home", "slug", "planet", columns=["n"]).collect()
    assert sorted((r.name, r.planet.n if r.planet else 0) for r in flat) == [
        ("leia", 3), ("luke", 1), ("luke", 2), ("rey", 0), ("yoda", 0),
    ]


def test_lookup_gives_one_row_per_left_row_whatever_the_matches(spark):
    left = spark.createDataFrame([(1,), (2,), (1,)], "k int")
    right = spark.range(30_000).select(F.when(F.col("id") < 29_990, 1).otherwise(2).alias("k"), "id")
    rows = q.lookup(left, right, "k", "k", "m", columns=["id"]).collect()
    assert sorted((r.k, len(r.m)) for r in rows) == [(1, 29_990), (1, 29_990), (2, 10)]
    assert all([m.id for m in r.m] == sorted(m.id for m in r.m) for r in rows)
    same = right.withColumn("id", F.lit(7))
    assert sorted(len(r.m) for r in q.lookup(left, same, "k", "k", "m").collect()) == [10, 29_990, 29_990]


def test_lookup_nests_documents_and_maps(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, '{"b": 2}'), (1, '{"a": 1}'), (None, "{}")], "k int, j string").select(
        "k", F.parse_json("j").alias("d"), F.create_map(F.lit("j"), "j").alias("m"))
    rows = {r.k: r.x for r in q.lookup(left, right, "k", "k", "x").collect()}
    assert [dict(x.m) for x in rows[1]] == [{"j": '{"a": 1}'}, {"j": '{"b": 2}'}] and rows[2] == []


def test_document_paths_go_through_arrays(spark):
    documents = (
        '{"_id": 1, "tags": [{"name": "a", "n": 1}, {"name": "b", "n": 5}], "x": {"y": [1, 2, 3]}, "s": "5"}',
        '{"_id": 2, "tags": [], "x": {"y": 7}, "s": null, "t": true}',
        '{"_id": 3, "tags": [{"name": "a", "n": 5}, null, 4], "a": [[1, 2], [3]], "t": 1, "o\'s": 1, "\'\\"": 2}',
    )
    data = documents_from_json(spark.createDataFrame([(x,) for x in documents], "value string"))
    document = F.col("document")

    def ids(condition, *order):
        found = data.where(condition)
        found = found.orderBy(*order) if order else found
        return [int(r[0]) for r in found.select(paths.text_at(document, "_id")).collect()]

    for path, operator, value, want in (
        ("tags.name", "eq", "a", [1, 3]), ("tags.name", "ne", "a", [2]), ("tags.n", "gt", 4, [1, 3]),
        ("tags.n", "lte", 1.5, [1]), ("x.y", "eq", 2, [1]), ("x.y.1", "eq", 2, [1]), ("tags.0.name", "eq", "a", [1, 3]),
        ("s", "eq", 5, []), ("s", "eq", "5", [1]), ("s", "eq", None, [2, 3]), ("s", "exists", True, [1, 2]),
        ("none", "exists", False, [1, 2, 3]), ("x.y", "in", [7, 3, None], [1, 2, 3]), ("x.y", "nin", [7], [1, 3]),
        ("a", "eq", 3, []), ("t", "eq", True, [2]), ("t", "eq", 1, [3]), ("o's", "eq", 1, [3]), ("'\"", "eq", 2, [3]), ("tags", "eq", 4, [3]),
    ):
        assert sorted(ids(paths.compares(document, path, operator, value))) == want, (path, operator, value)
    assert ids(paths.element_matches(document, "tags", [("name", "eq", "a"), ("n", "gte", 5)])) == [3]
    every = F.lit(True)
    assert ids(every, paths.sort_key(document, "x.y", -1)) == [2, 1, 3]
    assert ids(every, paths.sort_key(document, "x.y", 1)) == [3, 1, 2]
    assert ids(q.matches(data, "document.tags.name", "b")) == [1]
    with pytest.raises(ValueError):
        paths.compares(document, "x", "like", "a")


def test_without_match(worlds):
    assert [r.name for r in q.without_match(*worlds, "home", "slug").collect()] == ["rey"]


def test_ordered_strings(spark):
    data = spark.createDataFrame(
        [("charizard", 2, "flying"), ("charizard", 1, "fire"), ("charizard", 1, "fire"), ("mew", 1, "psychic")],
        "name string, slot int, type_name string",
    )
    def got(**options):
        rows = q.ordered_strings(data, ["name"], "type_name", "slot", "/", "types", **options)
        return {r.name: r.types for r in rows.collect()}

    assert got(distinct=True) == {"charizard": "fire/flying", "mew": "psychic"}
    assert got()["charizard"] == "fire/fire/flying"


def test_ordered_strings_of_a_large_group_are_whole(spark):
    data = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"),
        (F.lit(7919) * F.col("id") % 5000).alias("o"),
    ).withColumn("v", F.col("o").cast("string"))
    empty = spark.createDataFrame([("none", 1, None)], "g string, o bigint, v string")
    rows = q.ordered_strings(data.unionByName(empty), ["g"], "v", "o", "'", "s").collect()
    wanted = {}
    for r in data.orderBy("o").collect():
        wanted.setdefault(r.g, []).append(r.v)
    assert {r.g: r.s for r in rows} == {**{g: "'".join(v) for g, v in wanted.items()}, "none": None}


def test_tolerant_match(spark):
    data = spark.createDataFrame([("Pikachu",), ("PIKchu",), ("Mew_",), ("Mewtwo",), (None,)], "name string")
    got = {r.name: r.match_rank for r in q.tolerant_match(data, "name", {"pikachu": "pik"}).collect()}
    assert got == {"Pikachu": 0, "PIKchu": 1}
    got = q.tolerant_match(data, "name", {"mew_": "w_"}).collect()
    assert [r.name for r in got] == ["Mew_"]


def test_ties_in_order_are_ordered_by_value(spark):
    data = spark.createDataFrame([("g", 1, v) for v in "dbcae"], "g string, o int, v string")
    assert q.ordered_strings(data, ["g"], "v", "o", "", "s").first().s == "abcde"
    assert q.ordered_strings(data, ["g"], "v", "v", "", "s").first().s == "abcde"


def test_result_envelope(spark, many):
    data = spark.createDataFrame([(1, None), (2, "é\n")], "a int, `b.c` string")
    found = q.result_envelope(data, "document").first()
    assert (found.kind, found.returned_count) == ("document", 2)
    assert sorted((json.loads(r) for r in found.rows), key=str) == [
        {"a": 1, "b.c": None}, {"a": 2, "b.c": "é\n"},
    ]
    assert q.result_envelope(many, "relational").first().returned_count == 1000
    assert tuple(q.result_envelope(data.where("a > 5"), "relational").first()) == ("relational", [], 0)


NUMBERS = [
    "1", "1.0", "1.0000000001", "0.99999999999999999999", "-1.5", "-1", "0", "-0.25", "0.1", "1e-1", "1e30", "-1e30",
    "1000000000000000000000000000000", "9007199254740992", "9007199254740993", "9007199254740992.0", "9007199254740994",
    "1152921504606846976", "1152921504606846977", "99999999999999999999999999999999999999", "1e38", "1e300",
    "123456789012345678901234567890123456789012", "0.00000000000000000000000000000000000001",
]


def _value_of(text: str) -> Fraction:
    """What a JSON number stands for: up to 38 plain digits exactly, anything else as a double."""
    plain = "e" not in text and len(text.strip("-").replace(".", "").lstrip("0")) <= 38
    return Fraction(text) if plain else Fraction(float(text))


@pytest.mark.parametrize("wanted", [1, 0.1, 9007199254740992.0, 2**60 + 1, 1e30, 10**38, Decimal("0.99999999999999999999")])
def test_numbers_compare_exactly(spark, wanted):
    texts = ['{"n":' + n + ',"i":' + str(i) + "}" for i, n in enumerate(NUMBERS)] + ['{"n":"1","i":90}', '{"n":true,"i":91}']
    data = documents_from_json(spark.createDataFrame([(t,) for t in texts], "value string"))
    number = F.try_variant_get(DOCUMENT_COLUMN, "$.i", "int")
    operators = {"eq": "__eq__", "gt": "__gt__", "lte": "__le__"}
    found = data.select(number.alias("i"), *(paths.compares(F.col(DOCUMENT_COLUMN), "n", o, wanted).alias(o) for o in operators))
    rows = {r["i"]: r for r in found.collect()}
    fraction = isinstance(wanted, float) and not wanted.is_integer()
    for i, text in enumerate(NUMBERS):
        exact = Fraction(Decimal(repr(wanted))) if fraction and "e" not in text else Fraction(wanted)
        for operator, method in operators.items():
            assert rows[i][operator] == getattr(_value_of(text), method)(exact), (text, operator, wanted)
    assert not any(rows[90][o] or rows[91][o] for o in operators)


def test_large_numbers_sort_exactly(spark):
    texts = ["9007199254740993", "9007199254740992", "9007199254740994", "1", "1.00000000000000000001", "0.99999999999999999999",
             "-9007199254740993", "-9007199254740992", "-1.00000000000000000001", "-1"]
    data = documents_from_json(spark.createDataFrame([('{"n":' + n + "}",) for n in texts], "value string"))
    key = paths.sort_value(F.col(DOCUMENT_COLUMN), "n", 1)
    got = q.find(data, sort=[(key, 1)], columns=[F.try_variant_get(DOCUMENT_COLUMN, "$.n", "string").alias("n")])
    assert [r["n"] for r in got.collect()] == sorted(texts, key=Fraction)
