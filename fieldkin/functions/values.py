"""Comparable text of a value, and its fingerprint.

Two values of different sources are "the same" when their normal forms are the
same text: trimmed lower-case strings, shortest decimal text for numbers,
millisecond ISO text in UTC for dates. A fingerprint is the SHA-256 of that
text, so profiles never need to show a raw value.

The *key* of a value is what the aggregations group by: the normal form itself
while it is short, its fingerprint once it is not. No key of one kind can equal
one of the other, since short means shorter than a fingerprint. Keys bound the
width of every shuffled row, and hashing is left to the distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest text that is compared, and the fingerprint's length.
MAX_VALUE_LENGTH = 1024
FINGERPRINT_LENGTH = 64

# The code points that count as white space around a text.
WHITE_SPACE = "".join(
    map(chr, (
        0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x0020, 0x00A0, 0x1680,
        0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
        0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
    ))
)

#: Key of a value that is present but cannot be fingerprinted.
NO_FINGERPRINT = ""

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
_DAY_MILLIS = 86_400_000


def text_form(value: Column) -> Column:
    """Trimmed, lower-cased text; null when empty or over the length limit."""
    trimmed = F.btrim(value, F.lit(WHITE_SPACE))
    lowered = F.when(F.length(trimmed) <= MAX_VALUE_LENGTH, F.lower(trimmed))
    return F.when(F.length(lowered).between(1, MAX_VALUE_LENGTH), lowered)


_TINY = r"^(-?)(\d)(?:\.(\d+))?E-(\d+)$"


def _plain(text: Column) -> Column:
    """Text of a decimal without an exponent, which only small ones get."""
    sign, first, rest, places = (F.regexp_extract(text, _TINY, i) for i in range(1, 5))
    zeros = F.repeat(F.lit("0"), places.try_cast("int") - 1)
    return F.when(
        F.contains(text, F.lit("E-")), F.concat(sign, F.lit("0."), zeros, first, rest)
    ).otherwise(text)


def decimal_form(value: Column) -> Column:
    """Decimal text without trailing zeros, so that equal numbers are equal."""
    text = _plain(value.cast("string"))
    return F.when(
        F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")
    ).otherwise(text)


def number_form(value: Column) -> Column:
    """Shortest text of a double: plain from 1e-6 up to 1e21, else exponent.

    Digits are those of the JVM, which before Java 19 are one too many for a few
    values; each still has a single text, so equal numbers stay equal.
    """
    size = F.abs(value)
    text = value.cast("string")
    exponent = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(?=\d)", "e+")
    return (
        F.when(F.isnan(value) | (size == float("inf")), F.lit(None).cast("string"))
        .when(
            (value == F.rint(value)) & (size < 1e15),
            value.try_cast("bigint").cast("string"),
        )
        .when((size >= 1e-3) & (size < 1e7), text)
        .when((size >= 1e7) & (size < 1e21), decimal_form(text.try_cast("decimal(38,16)")))
        .when((size >= 1e-6) & (size < 1e-3), decimal_form(text.try_cast("decimal(38,30)")))
        .otherwise(F.replace(exponent, F.lit("E"), F.lit("e")))
    )


def epoch_millis(value: Column, data_type: T.DataType) -> Column:
    """Milliseconds since the epoch of a date or timestamp, rounded down.

    Timestamps without a zone are read off field by field: a difference would go
    through the session's zone, where some local times do not exist.
    """
    if isinstance(data_type, T.TimestampType):
        return F.unix_millis(value)
    days = F.unix_date(value.cast("date")).cast("bigint") * F.lit(_DAY_MILLIS).cast("bigint")
    if isinstance(data_type, T.DateType):
        return days
    minutes = F.hour(value) * 60 + F.minute(value)
    seconds = F.extract(F.lit("SECOND"), value)
    return days + minutes * 60_000 + F.floor(seconds * 1000).cast("bigint")


def millis_form(millis: Column) -> Column:
    """ISO text with milliseconds, in UTC whatever the session time zone."""
    moment = F.timestamp_add("MILLISECOND", millis, F.expr(EPOCH)).cast("string")
    return F.concat(
        F.substring(moment, 1, 10),
        F.lit("T"),
        F.substring(moment, 12, 8),
        F.lit("."),
        F.rpad(F.substring(moment, 21, 3), 3, "0"),
        F.lit("Z"),
    )


def normal_form(value: Column, data_type: T.DataType) -> Column:
    """Normal form of a column of the given type, null when it has none."""
    if isinstance(data_type, T.StringType):
        return text_form(value)
    if isinstance(data_type, T.IntegralType):
        return value.cast("string")
    if isinstance(data_type, T.FloatType):
        return number_form(value.cast("string").cast("double"))
    if isinstance(data_type, T.DoubleType):
        return number_form(value)
    if isinstance(data_type, T.DecimalType):
        return decimal_form(value)
    if isinstance(data_type, T.BooleanType):
        return value.cast("string")
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return millis_form(epoch_millis(value, data_type))
    return F.lit(None).cast("string")


def fingerprint(form: Column) -> Column:
    """Fingerprint of a normal form: SHA-256 of its UTF-8 bytes, in hex."""
    return F.sha2(form, 256)


def compact_key(form: Column) -> Column:
    """Key of a normal form; :data:`NO_FINGERPRINT` where there is none."""
    return F.when(form.isNull(), F.lit(NO_FINGERPRINT)).otherwise(
        F.when(F.length(form) < FINGERPRINT_LENGTH, form).otherwise(fingerprint(form))
    )


def with_text_key(data: DataFrame, column: str) -> DataFrame:
    """Replace a text column by its key, null where the text is null.

    Same result as :func:`compact_key` of :func:`text_form`, in three projections
    so that each step is evaluated once per row.
    """
    text = F.col(column)
    trimmed = data.withColumn(column, F.btrim(text, F.lit(WHITE_SPACE)))
    lowered = trimmed.withColumn(
        column,
        F.when(F.length(text) <= MAX_VALUE_LENGTH, F.lower(text)).when(
            text.isNotNull(), F.lit(NO_FINGERPRINT)
        ),
    )
    return lowered.withColumn(
        column,
        F.when(F.length(text) < FINGERPRINT_LENGTH, text)
        .when(F.length(text) <= MAX_VALUE_LENGTH, fingerprint(text))
        .when(text.isNotNull(), F.lit(NO_FINGERPRINT)),
    )


def key_fingerprint(key: Column) -> Column:
    """Fingerprint behind a key."""
    return F.when(F.length(key) == FINGERPRINT_LENGTH, key).otherwise(fingerprint(key))


def is_comparable(key: Column) -> Column:
    """Whether a key stands for a value that has a fingerprint."""
    return key.isNotNull() & (key != NO_FINGERPRINT)
