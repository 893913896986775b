"""Column expressions shared by filters and aggregates.

All are built-in expressions and stay in generated code. Null inputs give null
unless a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinals and the three scales of a call's confidence.
CONFIDENCE_ORDINAL = {"high": 3, "medium": 2, "low": 1}
CONFIDENCE_PATH = {"high": 0.9, "medium": 0.7, "low": 0.5}
CONFIDENCE_STATS = {"high": 1.0, "medium": 0.5, "low": 0.1}
CONFIDENCE_LEVEL = {"high": 0.95, "medium": 0.80, "low": 0.60}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: dict, default=None) -> Column:
    """The table's value for the column, ``default`` for others and null."""
    out = reduce(lambda acc, kv: acc.when(col(c) == kv[0], F.lit(kv[1])), table.items(), F)
    return out.otherwise(F.lit(default))


def all_of(*conditions: Column | None) -> Column:
    """Conjunction; absent conditions are left out."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals_if(c: Column | str, value) -> Column | None:
    """Equality, or nothing if the parameter is None."""
    return None if value is None else col(c) == value


def null_or_equal(c: Column | str, value) -> Column:
    """True for null and for the value, so a guard only excludes other guards."""
    return col(c).isNull() | (col(c) == value)


def glob_to_like(pattern: str) -> str:
    """``*`` and ``?`` as ``%`` and ``_``; LIKE's own signs are taken literally."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def like_any(c: Column | str, patterns: list[str]) -> Column:
    """Matches at least one LIKE pattern; no pattern matches nothing."""
    return reduce(lambda a, b: a | b, [col(c).like(p) for p in patterns], F.lit(False))


def config_active(needed: Column | str, context: Column | str) -> Column:
    """Whether every option of an array is true in a map; missing ones are false, an empty or null array is active."""
    return F.coalesce(F.forall(needed, lambda d: F.coalesce(F.element_at(context, d), F.lit(False))), F.lit(True))


def guard_is_valid(c: Column | str) -> Column:
    """An option name, negated or not."""
    return col(c).rlike(r"^!?CONFIG_[A-Z0-9_]+$")


def guard_holds(guard: Column | str, enabled: Column | str) -> Column:
    """Whether a guard holds where the options of an array are on; no guard always holds."""
    negated = col(guard).startswith("!")
    on = F.array_contains(enabled, F.regexp_replace(guard, "^!", ""))
    return F.coalesce(F.when(negated, ~on).otherwise(on), F.lit(True))


def confidence_at_least(c: Column | str, level: str) -> Column:
    return lookup(c, CONFIDENCE_ORDINAL, 0) >= CONFIDENCE_ORDINAL[level]


def path_confidence(levels: Column | str, table: dict[str, float] = CONFIDENCE_PATH) -> Column:
    """Product of the numbers of an array of levels; 0 for an empty array."""
    return F.when(F.size(levels) == 0, 0.0).otherwise(F.aggregate(levels, F.lit(1.0), lambda a, x: a * lookup(x, table, 0.5)))


def nearest_rank(values: Column | str, q: float) -> Column:
    """The element ``int(q n)`` of the sorted values, counted from 0: no interpolation.

    ``values`` is the array of one group; for unbounded groups use
    ``operators.statistics.nearest_rank``.
    """
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.least((F.size(ordered) * q).cast("int") + 1, F.size(ordered)))


def fold_glob(patterns: list[str]) -> list[str]:
    return [glob_to_like(p) for p in patterns]


def json_array_holds(text: Column | str, *values: str) -> Column:
    """Whether a JSON array of texts holds all the values; null and what is no array don't."""
    items = F.from_json(text, "array<string>")
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, values)), items)) == 0, F.lit(False))


def as_json(*columns: Column | str) -> Column:
    """The columns as one JSON object; structs and arrays nest, nulls are left out."""
    return F.to_json(F.struct(*columns))
