"""Name tokens of a field, and the similarity of two names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about what a field refers to.
SILENT_TOKENS = ("id", "key")


def name_tokens(entity: Column, path: Column) -> Column:
    """Distinct word tokens of ``entity.path``.

    Camel case is split before lower-casing, anything but ASCII letters and
    digits separates, silent words go before plurals are cut.
    """
    spaced = F.regexp_replace(
        F.concat_ws(".", entity, path), "([a-z0-9])([A-Z])", "$1 $2"
    )
    words = F.transform(F.split(spaced, "[^a-zA-Z0-9]+"), F.lower)
    telling = F.filter(words, lambda w: (w != "") & ~w.isin(*SILENT_TOKENS))
    return F.array_distinct(F.transform(telling, _singular))


def _singular(word: Column) -> Column:
    plural = (F.length(word) > 3) & F.endswith(word, F.lit("s"))
    return F.when(plural, F.left(word, F.length(word) - 1)).otherwise(word)


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two token arrays, 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
