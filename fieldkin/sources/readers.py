"""Scans: tables and document collections as DataFrames.

Nothing here reads data. Each function declares a scan, and Catalyst pushes the
columns and filters of the query that uses it down to the files or database.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldkin.sources.model import DOCUMENT, RELATIONAL

#: Name of the VARIANT column of a document collection.
DOCUMENT_COLUMN = "document"


def read_files(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """A table kept in files of any format Spark reads.

    Give the schema where it is known: without one, Spark opens files to infer it.
    """
    return spark.read.format(format).options(**options).load(path, schema=schema)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int = 1,
    **options,
) -> DataFrame:
    """A table of a database, read in parallel slices of a numeric or date column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column is not None:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return reader.load()


def documents_from_json(data: DataFrame, column: str = "value") -> DataFrame:
    """Documents held as JSON text, one per row. Malformed text fails the query."""
    return data.select(F.parse_json(F.col(column)).alias(DOCUMENT_COLUMN))


def documents_from_rows(data: DataFrame, *columns: str) -> DataFrame:
    """Documents built from typed, possibly nested columns."""
    return data.select(
        F.to_variant_object(F.struct(*(columns or data.columns))).alias(DOCUMENT_COLUMN)
    )


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents in text files, one JSON object per line."""
    return documents_from_json(spark.read.text(path).where(F.trim("value") != ""))


_LOADERS: dict[str, Callable[..., DataFrame]] = {
    RELATIONAL: read_files,
    DOCUMENT: read_json_lines,
}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """The default scan of a source kind."""
    try:
        loader = _LOADERS[kind]
    except KeyError:
        raise ValueError(f"Unknown source kind: {kind!r}.") from None
    return loader(spark, path, **options)


def load_all(
    spark: SparkSession, kind: str, paths: Mapping[str, str], **options
) -> dict[str, DataFrame]:
    """The default scan of every entity of a source, by name."""
    return {name: load(spark, kind, path, **options) for name, path in paths.items()}
