"""Normal forms, fingerprints, type families and name tokens."""

from __future__ import annotations

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.functions import values as V
from fieldkin.functions.names import jaccard, name_tokens
from fieldkin.functions.scoring import MIN_CONFIDENCE, raw_confidence, rounded_confidence
from fieldkin.functions.types import profiled, type_families
from fieldkin.operators.catalog import profiled_fields
from fieldkin.operators.profile import measured_uniqueness
from fieldkin.sources.model import RELATIONAL, Entity, Source, SourceSet


def forms(spark, kind: T.DataType, *values):
    data = spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                                 T.StructType([T.StructField("i", T.IntegerType()),
                                               T.StructField("v", kind)]))
    rows = data.select("i", V.normal_form(F.col("v"), kind).alias("f")).orderBy("i").collect()
    return [r.f for r in rows]


def test_text_is_trimmed_of_any_white_space_and_lowered(spark):
    got = forms(spark, T.StringType(), " Customer-42 ", "customer-42", "\t ﻿ÀB　\n",
                "", "   ", None, "​x")
    assert got == ["customer-42", "customer-42", "àb", None, None, None, "​x"]


def test_text_length_limit_counts_the_trimmed_text(spark):
    got = forms(spark, T.StringType(), "a" * 1024, "a" * 1025, " " * 9 + "B" * 1024)
    assert got == ["a" * 1024, None, "b" * 1024]


def test_doubles_take_their_shortest_text(spark):
    cases = {
        10.0: "10", -0.0: "0", 0.5: "0.5", 1e7: "10000000", 12345678.5: "12345678.5",
        0.0001: "0.0001", 0.00012345: "0.00012345", 1e15: "1000000000000000",
        1.5e20: "150000000000000000000", 1e21: "1e+21", 1e22: "1e+22", 1e-7: "1e-7",
        1.5e-7: "1.5e-7", -2.5: "-2.5", 123456.789: "123456.789", 1e-6: "0.000001",
        1e300: "1e+300",
    }
    assert forms(spark, T.DoubleType(), *cases) == list(cases.values())
    assert forms(spark, T.DoubleType(), float("nan"), float("inf"), float("-inf")) == [None] * 3


def test_other_numbers_booleans_and_decimals(spark):
    assert forms(spark, T.LongType(), 42, -7) == ["42", "-7"]
    assert forms(spark, T.FloatType(), 0.1, 3.0) == ["0.1", "3"]
    assert forms(spark, T.BooleanType(), True, False) == ["true", "false"]
    assert forms(spark, T.DecimalType(10, 2), Decimal("18.00"), Decimal("18.50"),
                 Decimal("100.00")) == ["18", "18.5", "100"]
    assert forms(spark, T.DecimalType(10, 0), Decimal("100")) == ["100"]


def test_dates_are_iso_text_in_utc_whatever_the_session_zone(spark):
    stamp = dt.datetime(2024, 3, 31, 2, 30, 0, 179575)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert forms(spark, T.TimestampNTZType(), stamp) == ["2024-03-31T02:30:00.179Z"]
        assert forms(spark, T.DateType(), dt.date(1969, 12, 31)) == ["1969-12-31T00:00:00.000Z"]
        instant = spark.sql("SELECT timestamp'2024-07-01 00:00:00+00:00' AS v")
        form = V.normal_form(F.col("v"), T.TimestampType())
        assert instant.select(form).first()[0] == "2024-07-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    before = dt.datetime(1969, 12, 31, 23, 59, 59, 999900)
    assert forms(spark, T.TimestampNTZType(), before) == ["1969-12-31T23:59:59.999Z"]


def test_unsupported_types_have_no_form(spark):
    assert forms(spark, T.ArrayType(T.IntegerType()), [1]) == [None]
    assert forms(spark, T.BinaryType(), b"x") == [None]


def test_values_are_not_type_tagged(spark):
    number = forms(spark, T.LongType(), 42)[0]
    assert forms(spark, T.StringType(), "42", " TRUE ") == [number, "true"]


def test_fingerprint_is_sha256_of_the_form(spark):
    got = spark.range(1).select(V.fingerprint(F.lit("àb"))).first()[0]
    assert got == hashlib.sha256("àb".encode()).hexdigest()


@pytest.mark.parametrize("length", [1, 63, 64, 65, 1024])
def test_a_key_leads_to_the_fingerprint_of_its_form(spark, length):
    form = "x" * length
    data = spark.createDataFrame([(f" {form} ".upper(),)], "v string")
    staged = V.with_text_key(data, "v").first().v
    inline = data.select(V.compact_key(V.text_form(F.col("v")))).first()[0]
    assert staged == inline and len(staged) <= 64
    found = spark.createDataFrame([(staged,)], "k string").select(V.key_fingerprint(F.col("k")))
    assert found.first()[0] == hashlib.sha256(form.encode()).hexdigest()


def test_keys_tell_nulls_from_values_without_form(spark):
    data = spark.createDataFrame([(1, None), (2, " "), (3, "y" * 1025)], "i int, v string")
    keys = [r.v for r in V.with_text_key(data, "v").orderBy("i").collect()]
    assert keys == [None, "", ""]


def test_type_families(spark):
    names = [
        ["integer"], ["VARCHAR"], ["number", "string"], ["timestamp(3) with time zone"],
        ["uuid"], ["jsonb"], ["object", "null"], ["null", "boolean"], ["datetime", "date"],
    ]
    data = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n array<string>")
    got = data.select("i", type_families(F.col("n")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [
        ["number"], ["text"], ["number", "text"], ["date"], ["identifier"], ["unknown"],
        ["unknown"], ["boolean"], ["date"],
    ]


def test_profiled_types(spark):
    data = spark.createDataFrame([("BIGINT",), ("jsonb",), ("array",), ("uuid",)], "n string")
    assert [r[0] for r in data.select(profiled(F.col("n"))).collect()] == [True, False, False, True]


@pytest.mark.parametrize("entity, path, tokens", [
    ("orders", "customerId", ["customer", "order"]),
    ("customers", "customer_id", ["customer"]),
    ("address", "keys", ["addres", "key"]),
    ("ids", "id", ["ids"]),
    ("Key", "ID", []),
    ("números", "total2X", ["meros", "n", "total2", "x"]),
    ("a", "b.c-d", ["a", "b", "c", "d"]),
])
def test_name_tokens(spark, entity, path, tokens):
    data = spark.createDataFrame([(entity, path)], "e string, p string")
    got = data.select(name_tokens(F.col("e"), F.col("p"))).first()[0]
    assert sorted(got) == sorted(["mero" if t == "meros" else t for t in tokens])


def test_names_without_tokens_are_not_similar(spark):
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(jaccard(empty, empty)).first()[0] == 0.0


def test_the_order_of_the_sum_decides_on_the_threshold(spark):
    score = raw_confidence(F.col("n"), F.col("k"), F.col("o"))
    data = spark.createDataFrame(
        [(0.5, False, 1 / 3), (0.0, True, 1 / 6), (5 / 6, False, 0.0), (0.0, True, 0.0)],
        "n double, k boolean, o double",
    )
    kept = [r[0] for r in data.select(score >= MIN_CONFIDENCE).collect()]
    assert kept[:2] == [False, True] and kept[3] is False
    assert kept[2] == (0.2 + 5 / 6 * 0.3 + 0 >= 0.45)


def test_confidence_rounds_halves_up(spark):
    data = spark.createDataFrame([(0.125,), (0.7649,), (0.765,)], "c double")
    got = [r[0] for r in data.select(rounded_confidence(F.col("c"))).collect()]
    assert got == [0.13, 0.76, 0.77]


def test_far_moments_keep_their_milliseconds(spark):
    data = spark.range(-2000, 2000).selectExpr(
        "timestamp_micros(253402300799999999L - abs(id) * 86399999977) AS t")
    millis = V.epoch_millis(F.col("t"), T.TimestampType())
    assert data.where(millis != F.unix_millis("t")).count() == 0


def test_small_decimals_have_no_exponent_whatever_the_mode(spark):
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            data = spark.sql("SELECT cast(x as decimal(38, 18)) AS d FROM VALUES"
                             " ('0'), ('0.00000001'), ('-0.0000000120'), ('12.5'), ('-3.000') AS t(x)")
            got = [r.f for r in data.select(V.decimal_form(F.col("d")).alias("f")).collect()]
        finally:
            spark.conf.set("spark.sql.ansi.enabled", "true")
        assert got == ["0", "0.00000001", "-0.000000012", "12.5", "-3"]


def test_uniqueness_is_of_values_not_of_forms(spark):
    long = "x" * 2000
    data = spark.createDataFrame([(long, "A", 1), (long, "a", 2), ("s", None, None)], "t string, u string, n int")
    sources = SourceSet([Source("a", RELATIONAL, (Entity("public", "t", data),))])
    got = measured_uniqueness(sources, profiled_fields(spark, sources)).collect()
    assert {r.path: (r.value_count, r.distinct_count, r.measured_unique) for r in got} == {
        "t": (3, 2, False), "u": (2, 2, True), "n": (2, 2, True),
    }
