"""Sources read from the session's catalog."""

from __future__ import annotations

from fieldkin.sources.model import Key
from fieldkin.sources.session import catalog_source, declared_keys


def test_constraints_of_a_described_table():
    rows = [
        ("id", "bigint", None), ("# Constraints", "", ""),
        ("pk", "PRIMARY KEY (id, `line no`) NOT ENFORCED", ""), ("u", "UNIQUE (code) NOT ENFORCED", ""),
        ("positive", "CHECK (id > 0) ENFORCED", ""), ("fk", "FOREIGN KEY (a) REFERENCES t (b)", ""),
        ("", "", ""), ("other", "PRIMARY KEY (no)", ""),
    ]
    assert declared_keys(rows) == (Key("pk", "primary", ("id", "line no")), Key("u", "unique", ("code",)))
    assert declared_keys(rows[:1]) == ()
    assert declared_keys([]) == ()


def test_tables_of_the_session_are_a_source(spark, small):
    spark.sql(f"CREATE TABLE live_nation USING parquet LOCATION '{small}/nation.parquet'")
    spark.range(1).createOrReplaceTempView("live_view")
    try:
        source = catalog_source(spark, "live", "default", "live_*")
        again = catalog_source(spark, "live", "spark_catalog.default", "live_*")
    finally:
        spark.sql("DROP TABLE live_nation")
        spark.catalog.dropTempView("live_view")
    assert [e.name for e in source.entities] == [e.name for e in again.entities] == ["live_nation"]
    assert source.entities[0].keys == () and source.entities[0].not_null == frozenset()
    assert source.entity("live_nation").data.count() == 25
    assert catalog_source(spark, "live", "default", "live_*").entities == ()
