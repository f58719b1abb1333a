"""How often each value occurs in each field: the base of every profile.

One long form, ``(field_id, key, n, comparable)``, one row per distinct value of a field,
serves profiles, sketches, uniqueness and overlap. Columns are unpivoted and
counted in their own type first and turned into keys afterwards, so the text of
a number or date is made once per distinct value, not once per row. The scans of
the typed streams read disjoint columns, so no column is read twice. Counting
combines before it shuffles: a value that fills a third of all rows reaches the
shuffle once per task.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.functions import values as V
from fieldkin.operators.catalog import FieldRef, profiled_columns
from fieldkin.sources.model import Entity, SourceSet

#: A null key counts the nulls of a field, an empty key its values without form;
#: all other values are ``comparable``.
COLUMNS = ("field_id", "key", "n", "comparable")


def _integers(field: FieldRef) -> Column | None:
    column, kind = F.col(f"`{field.column}`"), field.data_type
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return column.cast("bigint")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return V.epoch_millis(column, kind)
    return None


def _doubles(field: FieldRef) -> Column | None:
    column = F.col(f"`{field.column}`")
    if isinstance(field.data_type, T.DoubleType):
        return column
    if isinstance(field.data_type, T.FloatType):
        return column.cast("string").cast("double")
    return None


def _texts(field: FieldRef) -> Column | None:
    return F.col(f"`{field.column}`") if isinstance(field.data_type, T.StringType) else None


def _decimals(field: FieldRef) -> Column | None:
    # One scale per column, so its text is as distinct as its value.
    if isinstance(field.data_type, T.DecimalType):
        return F.col(f"`{field.column}`").cast("string")
    return None


def _stream(tables: list, take) -> DataFrame | None:
    """``(field, value)`` of the columns a typed stream takes, over all tables."""
    parts = []
    for entity, fields in tables:
        taken = {str(f.field_id): c for f in fields if (c := take(f)) is not None}
        if taken:
            columns = entity.data.select(*(c.alias(name) for name, c in taken.items()))
            parts.append(columns.unpivot([], list(taken), "field", "value"))
    return reduce(DataFrame.unionAll, parts) if parts else None


def _count(stream: DataFrame) -> DataFrame:
    return stream.groupBy("field", "value").agg(F.count("*").alias("n"))


def _ids(tables: list, *kinds: type) -> list[str]:
    return [
        str(f.field_id) for _, fields in tables for f in fields
        if isinstance(f.data_type, kinds)
    ]


def _integer_key(tables: list) -> Column:
    value, field = F.col("value"), F.col("field")
    booleans = _ids(tables, T.BooleanType)
    moments = _ids(tables, T.DateType, T.TimestampType, T.TimestampNTZType)
    key = F.when(value.isNull(), F.lit(None).cast("string"))
    if booleans:
        key = key.when(field.isin(booleans), value.cast("boolean").cast("string"))
    if moments:
        key = key.when(field.isin(moments), V.millis_form(value))
    return key.otherwise(value.cast("string"))


def _double_key() -> Column:
    value = F.col("value")
    form = F.coalesce(V.number_form(value), F.lit(V.NO_FINGERPRINT))
    return F.when(value.isNotNull(), form)


def typed_columns(
    sources: SourceSet, only: Collection[int] | None = None
) -> list[tuple[Entity, list[tuple[FieldRef, Column]]]]:
    """Per entity the columns that are counted, as the values they are counted by."""
    return [
        (entity, [
            (f, c) for f in fields
            for take in (_integers, _doubles, _decimals, _texts)
            if (c := take(f)) is not None
        ])
        for entity, fields in _tables(sources, only)
    ]


def _tables(sources: SourceSet, only: Collection[int] | None) -> list:
    return [
        (entity, [f for f in fields if only is None or f.field_id in only])
        for entity, fields in profiled_columns(sources)
    ]


def _keyed(tables: list, counting) -> DataFrame:
    """Typed streams with their keys; ``counting`` says what is done to each before, or to
    text after, its keys are made."""
    value = F.col("value")
    present = value.isNotNull()
    parts = []
    for take, key, comparable in (
        (_integers, _integer_key(tables), present),
        (_doubles, _double_key(), present & (F.abs(value) < float("inf"))),
        (_decimals, V.decimal_form(value), present),
    ):
        stream = _stream(tables, take)
        if stream is not None:
            parts.append(counting(stream).select("field", key.alias("key"), "n", comparable))
    # Text is the exception: keys first, so that no long text is shuffled.
    texts = _stream(tables, _texts)
    if texts is not None:
        parts.append(counting(V.with_text_key(texts, "value")).select(
            "field", "value", "n", present & (value != V.NO_FINGERPRINT)
        ))
    return reduce(DataFrame.unionAll, parts).toDF("field", *COLUMNS[1:]).select(
        F.col("field").cast("bigint").alias("field_id"), *COLUMNS[1:]
    )


def value_counts(sources: SourceSet, only: Collection[int] | None = None) -> DataFrame:
    """``(field_id, key, n, comparable)`` of the profiled columns of relational sources.

    ``only`` names the fields to count; the columns of others are not read.
    """
    return _keyed(_tables(sources, only), _count)


def value_rows(sources: SourceSet, only: Collection[int] | None = None) -> DataFrame:
    """The same form with one row per cell (``n`` is 1): nothing is counted or shuffled."""
    return _keyed(_tables(sources, only), lambda s: s.withColumn("n", F.lit(1).cast("bigint")))
