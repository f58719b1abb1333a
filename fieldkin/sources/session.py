"""Sources as the session's own catalogs describe them.

Nothing is declared by hand: tables, columns and nullability come from the catalog, and so
do keys, of catalogs that know constraints. The session catalog knows none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from fieldkin.sources.model import RELATIONAL, Entity, Key, Source

#: How a described table states its constraints.
CONSTRAINTS = "# Constraints"
KEY = re.compile(r"(PRIMARY KEY|UNIQUE) \(([^)]*)\)")
KINDS = {"PRIMARY KEY": "primary", "UNIQUE": "unique"}


def declared_keys(described: Iterable[tuple]) -> tuple[Key, ...]:
    """Primary and unique keys among the rows of a described table; other constraints are
    no keys. Rows of the section are a name and its statement, up to an empty row."""
    keys, inside = [], False
    for name, statement, *_ in described:
        if inside and not name:
            break
        if inside and (match := KEY.match(statement)):
            columns = tuple(c.strip().strip("`") for c in match[2].split(","))
            keys.append(Key(name, KINDS[match[1]], columns))
        inside = inside or name == CONSTRAINTS
    return tuple(keys)


def catalog_source(
    spark: SparkSession, source_id: str, database: str, pattern: str | None = None
) -> Source:
    """The tables of a database (``catalog.database`` as well) as a source, by name.

    Temporary views belong to no database and are left out. ``pattern`` is one of names,
    with ``*``. Only metadata is read.
    """
    entities = []
    tables = spark.catalog.listTables(database, pattern)
    for table in sorted((t for t in tables if not t.isTemporary), key=lambda t: t.name):
        name = ".".join(f"`{part}`" for part in (*database.split("."), table.name))
        columns = spark.catalog.listColumns(name)
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
        keys = declared_keys(described)
        entities.append(Entity(
            database, table.name, spark.table(name), keys=keys,
            indexes=tuple(k.name for k in keys),
            not_null=frozenset(c.name for c in columns if not c.nullable),
        ))
    return Source(source_id, RELATIONAL, tuple(entities))
