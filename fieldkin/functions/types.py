"""Type names and type families.

A catalog speaks in source type names ("integer", "timestamp without time
zone", "objectid"); comparing fields of different sources needs the coarser
family. Both live here, once as Column expressions and once as driver-side
metadata helpers for schemas that are already known when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names of each family, in natural order. Anything that
# contains "timestamp" is also a date.
FAMILIES = {
    "number": (
        "smallint", "integer", "bigint", "decimal", "numeric", "real",
        "double precision", "number", "int", "int32", "int64", "double",
    ),
    "text": ("text", "character varying", "varchar", "character", "char", "string"),
    "boolean": ("boolean", "bool"),
    "date": ("date", "datetime"),
    "identifier": ("uuid", "objectid", "objectidstring"),
}

# Relational type names whose columns are profiled.
PROFILED_TYPES = (
    "boolean", "smallint", "integer", "bigint", "decimal", "numeric", "real",
    "double precision", "uuid", "text", "character varying", "character", "date",
    "timestamp without time zone", "timestamp with time zone",
)

UNKNOWN = "unknown"

_SPARK_NAMES = {
    T.BooleanType: "boolean",
    T.ByteType: "smallint",
    T.ShortType: "smallint",
    T.IntegerType: "integer",
    T.LongType: "bigint",
    T.FloatType: "real",
    T.DoubleType: "double precision",
    T.DecimalType: "numeric",
    T.StringType: "text",
    T.VarcharType: "character varying",
    T.CharType: "character",
    T.DateType: "date",
    T.TimestampNTZType: "timestamp without time zone",
    T.TimestampType: "timestamp with time zone",
    T.StructType: "object",
    T.ArrayType: "array",
    T.NullType: "null",
}


def type_name(data_type: T.DataType) -> str:
    """Catalog type name of a Spark type; types without one keep Spark's name."""
    return _SPARK_NAMES.get(type(data_type), data_type.simpleString())


def is_profiled(name: str) -> bool:
    return name.lower() in PROFILED_TYPES


def profiled(name: Column) -> Column:
    """Whether a relational column of this type gets a profile."""
    return F.lower(name).isin(*PROFILED_TYPES)


def type_family(name: Column) -> Column:
    """Family of one type name, null when it has none."""
    lowered = F.lower(name)
    family = F.when(F.contains(lowered, F.lit("timestamp")), F.lit("date"))
    for label, names in FAMILIES.items():
        family = family.when(lowered.isin(*names), F.lit(label))
    return family


def type_families(names: Column) -> Column:
    """Sorted families of an array of type names; ``[unknown]`` if none is known."""
    known = F.array_sort(
        F.array_distinct(F.array_compact(F.transform(names, type_family)))
    )
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(UNKNOWN)))


def families_compatible(left: Column, right: Column) -> Column:
    """True when both sides share a family other than ``unknown``."""
    return F.arrays_overlap(
        F.array_remove(left, UNKNOWN), F.array_remove(right, UNKNOWN)
    )
