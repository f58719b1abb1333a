"""Value overlap between fields.

The exact overlap groups all fields by value once: every value has a *signature*,
the set of fields that contain it. Equal signatures are counted together, and
only then are field pairs formed, once per distinct signature. No pair is ever
formed per value, and a value shared by every field costs a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldkin.operators.profile import MAX_FINGERPRINTS, comparable


def value_signatures(counts: DataFrame) -> DataFrame:
    """``(fields, n)``: how many distinct values occur in exactly these fields."""
    return (
        counts.where(comparable())
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("field_id")).alias("fields"))
        .groupBy("fields")
        .agg(F.count("*").alias("n"))
    )


def _paired(signatures: DataFrame, *extra: str) -> DataFrame:
    """Every ``(a, b)`` with a <= b of a signature; ``(a, a)`` counts the field itself.

    One side is unfolded before the other, so no row ever holds more than one field's
    pairs of a signature.
    """
    first = signatures.select("fields", *extra, F.posexplode("fields").alias("at", "a"))
    rest = F.slice("fields", F.col("at") + 1, F.size("fields") - F.col("at"))
    return first.select("a", *extra, F.explode(rest).alias("b"))


def value_overlap(counts: DataFrame) -> DataFrame:
    """Exact overlap of each pair of fields that share a value.

    ``(a, b, shared, a_count, b_count, overlap)`` with ``a < b``; ``overlap`` is
    the Jaccard similarity of the two sets of distinct values.
    """
    paired = (
        _paired(value_signatures(counts), "n")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("shared"))
    )
    sizes = paired.where("a = b")
    return (
        paired.where("a < b")
        .join(sizes.select("a", F.col("shared").alias("a_count")), "a")
        .join(sizes.select("b", F.col("shared").alias("b_count")), "b")
        .select(
            "a", "b", "shared", "a_count", "b_count",
            (F.col("shared") / (F.col("a_count") + F.col("b_count") - F.col("shared")))
            .alias("overlap"),
        )
    )


def sketch_overlap(sketch: DataFrame, size: int = MAX_FINGERPRINTS) -> DataFrame:
    """Overlap of pairs that share a sketched value, from sketches alone.

    Takes the ``size`` smallest fingerprints of the union of both sketches and
    returns the share of them that both contain: unbiased, and exact for fields
    that fit their sketches. Sketches hold at most ``size`` rows per field, so
    the work depends on the number of fields only.
    """
    # The join below filters like this. Both readers of the sketch do, so it is made once.
    entries = sketch.select("field_id", "fingerprint").where(F.col("field_id").isNotNull())
    signatures = (
        entries.groupBy("fingerprint")
        .agg(F.sort_array(F.collect_set("field_id")).alias("fields"))
        .where(F.size("fields") > 1)
        .select("fields").distinct()
    )
    pairs = _paired(signatures).where("a < b").distinct()
    sides = F.explode(F.array("a", "b")).alias("field_id")
    rank = F.row_number().over(W.partitionBy("a", "b").orderBy("fingerprint"))
    return (
        pairs.select("a", "b", sides)
        .join(entries, "field_id")
        .groupBy("a", "b", "fingerprint")
        .agg(F.count("*").alias("sides"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= size)
        .groupBy("a", "b")
        .agg(
            F.count_if(F.col("sides") == 2).alias("shared"),
            F.count("*").alias("sampled"),
        )
        .where(F.col("shared") > 0)
        .withColumn("overlap", F.col("shared") / F.col("sampled"))
    )
