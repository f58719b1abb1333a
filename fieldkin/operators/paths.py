"""Predicates, sort keys and projections on dotted paths of VARIANT documents.

A path goes through arrays: ``tags.name`` means the names of all elements of
``tags``, and a number names an element of an array as well as a member. A missing
path is null. Values compare within their kind only: a number never equals a text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Context, Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of kinds in sorting, lowest first.
KINDS = ("null", "number", "string", "object", "array", "boolean", "date")

_VARIANTS = "array<variant>"
_WIDE = Context(prec=80)
#: Keys of the longest path that is read by path expressions.
_LONGEST = 6


def _member(value: Column, key: str) -> Column:
    """A member of an object; keys with both kinds of quotes fit no path expression."""
    for quote in ("'", '"'):
        if quote not in key:
            return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))


def _elements(value: Column) -> Column:
    """The elements of an array, nothing for any other value."""
    return F.coalesce(F.try_variant_get(value, "$", _VARIANTS), F.array().cast(_VARIANTS))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Type names of numbers in a document.
_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def _is_number(schema: Column) -> Column:
    return schema.rlike(_NUMBER)


def _kind_of(schema: Column) -> Column:
    return (
        F.when(schema.startswith("OBJECT"), F.lit("object"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .when(schema == "STRING", F.lit("string"))
        .when(schema == "VOID", F.lit("null"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema.startswith("DATE") | schema.startswith("TIMESTAMP"), F.lit("date"))
        .when(schema.isin("BINARY", "UUID"), F.lower(schema))
        .when(schema.isNotNull(), F.lit("number"))
    )


def _kind(value: Column) -> Column:
    return _bound(F.schema_of_variant(value), _kind_of)


def _plain(keys: Sequence[str]) -> str | None:
    """One path expression for keys that name members only; None for others.

    Numbers may be places in arrays, and keys with both kinds of quotes have none.
    Longer paths are rare and would make large plans.
    """
    if len(keys) > _LONGEST or any(k.isdigit() or ("'" in k and '"' in k) for k in keys):
        return None
    return "$" + "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)


def _below(
    value: Column, keys: Sequence[str], root: bool, found: Callable[[Column], Column],
    inside: Callable[[Column, Sequence[str]], Column], nothing: Column,
) -> Column:
    """What a path finds below a value: the member itself, or what the first array on the
    way holds.

    The member is read once, by a single path expression. Only where there is none, the
    members on the way are tried as arrays, the outermost first; ``inside`` goes on in
    the elements. ``root`` tells whether the value itself may be such an array.
    """
    def use(member: Column) -> Column:
        result = F.when(member.isNotNull(), found(member))
        for n in range(0 if root else 1, len(keys)):
            elements = F.try_variant_get(value, _plain(keys[:n]), _VARIANTS)
            result = result.when(elements.isNotNull(), inside(elements, keys[n:]))
        return result.otherwise(nothing)

    return _bound(F.try_variant_get(value, _plain(keys), "variant"), use)


def values_at(document: Column, path: str) -> Column:
    """All values that a path reaches, as an array; empty where it reaches none."""
    keys = path.split(".") if path else []
    none = F.array().cast(_VARIANTS)
    if not keys:
        return F.filter(F.array(document), lambda v: v.isNotNull())
    if _plain(keys) is None:
        return _walked(document, keys)

    def reached(value: Column, keys: Sequence[str], root: bool) -> Column:
        return _below(
            value, keys, root, F.array,
            lambda elements, rest: F.flatten(F.transform(elements, lambda e: reached(e, rest, False))), none)

    return reached(document, keys, True)


def _walked(document: Column, keys: Sequence[str]) -> Column:
    """The same step by step, for keys that may be places in arrays."""
    values = F.array(document)
    for key in keys:
        index = F.lit(int(key)) if key.isdigit() else None

        def members(value: Column, key=key, index=index) -> Column:
            inner = F.concat(F.array(value), _elements(value))
            found = F.transform(inner, lambda v: _member(v, key))
            if index is not None:
                found = F.concat(found, F.array(F.get(_elements(value), index)))
            return F.filter(found, lambda v: v.isNotNull())

        values = F.flatten(F.transform(values, lambda v: members(v)))
    return F.filter(values, lambda v: v.isNotNull())


def _any(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def _any_at(document: Column, path: str, test: Callable[[Column], Column], within: bool) -> Column:
    """Whether any value that a path reaches passes; ``within`` tries its elements too."""
    keys = path.split(".") if path else []

    def passes(value: Column) -> Column:
        one = F.coalesce(test(value), F.lit(False))
        return one | _any(F.try_variant_get(value, "$", _VARIANTS), test) if within else one

    def at(value: Column, keys: Sequence[str], root: bool) -> Column:
        return _below(value, keys, root, passes,
                      lambda elements, rest: _any(elements, lambda e: at(e, rest, False)), F.lit(False))

    if not keys:
        return document.isNotNull() & passes(document)
    if _plain(keys) is None:
        reached = _walked(document, keys)
        return _any(F.concat(reached, F.flatten(F.transform(reached, _elements))) if within else reached, test)
    return at(document, keys, True)


def _parts(number: int | float | Decimal) -> tuple[float, int, Decimal, int]:
    """A wanted number: its double, its whole part, the rest to 38 digits, and what is beyond.

    A whole float stands for exactly that number, any other for its shortest decimal.
    """
    if isinstance(number, float) and not number.is_integer():
        number = Decimal(repr(number))
    exact = Fraction(number)
    try:
        double = float(exact)
    except OverflowError:
        double = math.inf if exact > 0 else -math.inf
    whole = math.trunc(exact)
    rest = math.trunc((exact - whole) * 10**38)
    beyond = (exact - whole) * 10**38 - rest
    return double, whole, Decimal(rest).scaleb(-38, _WIDE), (beyond > 0) - (beyond < 0)


def _split(text: Column) -> list[Column]:
    """The whole part of a number's plain text, and the signed rest."""
    rest = F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise(F.lit("0"))
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return [
        F.substring_index(text, ".", 1).try_cast("decimal(38,0)"),
        F.concat(sign, F.lit("0."), rest).try_cast("decimal(38,38)"),
    ]


def _order(value: Column, wanted: int | float | Decimal) -> Column:
    """-1, 0 or 1 as a number of a document is less than, equal to or above the wanted one.

    Doubles decide unless they are equal. Then a value that is a double itself differs
    by what its double differs from the wanted number, and any other, which has 38
    digits at most, is compared by whole part and rest.
    """
    double, whole, rest, beyond = _parts(wanted)
    exact = Fraction(double) if math.isfinite(double) else None
    off = 0 if exact is None else (exact > Fraction(whole) + Fraction(rest) + Fraction(beyond, 10**39)) - (
        exact < Fraction(whole) + Fraction(rest) + Fraction(beyond, 10**39))
    if isinstance(wanted, float):
        off = 0
    inexact = F.schema_of_variant(value).isin("DOUBLE", "FLOAT")
    if abs(whole) >= 10**38:
        decimal = F.lit(-1 if whole > 0 else 1)
    else:
        left = F.struct(*_split(F.try_variant_get(value, "$", "string")), F.lit(0))
        right = F.struct(F.lit(whole).cast("decimal(38,0)") if abs(whole) < 2**63 else F.lit(str(whole)).cast("decimal(38,0)"),
                         F.lit(f"{rest:f}").cast("decimal(38,38)"), F.lit(beyond))
        decimal = F.when(left < right, -1).when(left > right, 1).otherwise(0)
    near = F.try_variant_get(value, "$", "double")
    return (
        F.when(near < F.lit(double), -1).when(near > F.lit(double), 1)
        .when(inexact, F.lit(off)).otherwise(decimal)
    )


_ORDERED: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}


def _test(operator: str, wanted: object) -> Callable[[Column], Column]:
    """Compares a value of the kind of ``wanted``; any other kind doesn't match."""
    compared = _ORDERED[operator]
    if isinstance(wanted, bool):
        return lambda v: (F.schema_of_variant(v) == "BOOLEAN") & compared(F.try_variant_get(v, "$", "boolean"), F.lit(wanted))
    if isinstance(wanted, float) and math.isnan(wanted):
        raise ValueError("No comparison with a NaN.")
    if isinstance(wanted, (int, float, Decimal)):
        return lambda v: F.schema_of_variant(v).rlike(_NUMBER) & compared(_order(v, wanted), F.lit(0))
    if isinstance(wanted, str):
        return lambda v: (F.schema_of_variant(v) == "STRING") & compared(F.try_variant_get(v, "$", "string"), F.lit(wanted))
    raise ValueError(f"No comparison with a {type(wanted).__name__}.")


def _member_of(listed: Sequence[object]) -> Callable[[Column], Column]:
    """Whether a value equals one of several, none of them None."""
    texts = [x for x in listed if isinstance(x, str)]
    tests = [_test("eq", x) for x in listed if not isinstance(x, str)]

    def test(value: Column) -> Column:
        found = F.lit(False)
        if texts:
            found = (F.schema_of_variant(value) == "STRING") & F.try_variant_get(value, "$", "string").isin(texts)
        for one in tests:
            found = found | F.coalesce(one(value), F.lit(False))
        return found
    return test


def compares(document: Column, path: str, operator: str, value: object) -> Column:
    """Whether a path compares so: ``eq ne gt gte lt lte in nin exists``.

    A value matches if any value the path reaches does, or any element of an array
    it reaches; ``ne`` and ``nin`` are the opposites of ``eq`` and ``in``. None equals
    what is null or missing. Numbers compare by their exact values, whatever their
    kinds: a number of up to 38 digits by those, a float by what it stands for.
    """
    if operator == "ne":
        return ~compares(document, path, "eq", value)
    if operator == "nin":
        return ~compares(document, path, "in", value)
    if operator == "exists":
        reached = _any_at(document, path, lambda v: F.lit(True), False)
        return reached if value else ~reached
    if operator == "in":
        listed = list(value)
        found = _any_at(document, path, _member_of([x for x in listed if x is not None]), True)
        return found | compares(document, path, "eq", None) if None in listed else found
    if operator == "eq" and value is None:
        nulls = _any_at(document, path, lambda v: F.is_variant_null(v), True)
        return ~_any_at(document, path, lambda v: F.lit(True), False) | nulls
    if operator in _ORDERED:
        return _any_at(document, path, _test(operator, value), True)
    raise ValueError(f"Unknown operator: {operator!r}.")


def element_matches(
    document: Column, path: str, tests: Sequence[tuple[str, str, object]]
) -> Column:
    """Whether one element of an array at the path passes all ``(path, operator, value)``."""
    def passes(element: Column) -> Column:
        result = F.lit(True)
        for inner, operator, value in tests:
            result = result & compares(element, inner, operator, value)
        return result

    return _any_at(document, path, lambda v: _any(F.try_variant_get(v, "$", _VARIANTS), passes), False)


def _rank(value: Column) -> Column:
    """Sorts values of all kinds: by kind, then within it.

    Numbers sort by their doubles; what more than 15 digits add to a double decides
    between equal ones.
    """
    def of(read: Column) -> Column:
        schema, text, number = read["schema"], read["text"], read["number"]
        kind = _kind_of(schema)
        nearest = F.when(F.abs(number) < 2.0**63, number.cast("decimal(38,18)").cast("string")).otherwise(text)
        exact = _is_number(schema) & ~schema.isin("DOUBLE", "FLOAT") & (F.length(text) > 15)
        more = [F.when(exact, own - near) for own, near in zip(_split(text), _split(nearest))]
        flag = F.when(schema == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        return F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("kind"),
            F.coalesce(number, flag).alias("number"),
            F.coalesce(more[0], F.lit(0)).cast("decimal(38,0)").alias("whole"),
            F.coalesce(more[1], F.lit(0)).cast("decimal(38,37)").alias("rest"),
            F.when((schema == "STRING") | (kind == "date"), text).alias("text"),
        )

    return _bound(F.schema_of_variant(value), lambda schema: _bound(F.struct(
        schema.alias("schema"), F.try_variant_get(value, "$", "string").alias("text"),
        F.when(_is_number(schema), F.try_variant_get(value, "$", "double")).alias("number"),
    ), of))


def sort_value(document: Column, path: str, direction: int) -> Column:
    """What a path sorts by: the smallest value for 1, the largest for -1. Missing is null.

    An array sorts by its elements.
    """
    if direction not in (1, -1):
        raise ValueError("A sort direction must be 1 or -1.")
    keys = path.split(".") if path else []
    reached = values_at(document, path)
    single = F.filter(reached, lambda v: _kind(v) != "array")
    ranks = F.transform(F.concat(single, F.flatten(F.transform(reached, _elements))), _rank)
    lowest = _rank(F.parse_json(F.lit("null")))
    several = F.coalesce(F.array_min(ranks) if direction == 1 else F.array_max(ranks), lowest)
    whole = _plain(keys)
    if not keys or whole is None:
        return several
    return _bound(F.try_variant_get(document, whole, "variant"), lambda member: F.when(
        member.isNotNull() & F.try_variant_get(member, "$", _VARIANTS).isNull(), _rank(member)).otherwise(several))


def sort_key(document: Column, path: str, direction: int) -> Column:
    """What to order by, with its direction; see :func:`sort_value`."""
    value = sort_value(document, path, direction)
    return value.asc() if direction == 1 else value.desc()


def text_at(document: Column, path: str) -> Column:
    """The value of a path as text: one value as it is, several as a JSON array."""
    reached = values_at(document, path)
    first = F.get(reached, F.lit(0))
    scalar = ~_kind(first).isin("object", "array", "null")
    return (
        F.when(F.size(reached) == 0, F.lit(None).cast("string"))
        .when(F.size(reached) > 1, F.to_json(reached))
        .when(scalar, F.try_variant_get(first, "$", "string"))
        .when(_kind(first) != "null", F.to_json(first))
    )
