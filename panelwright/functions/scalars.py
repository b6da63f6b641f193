"""Guarded arithmetic, coalescing with provenance and three-state logic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a / b)


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def coalesce_with_basis(choices: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """First non-null choice, and the label of the choice it came from."""
    value = F.coalesce(*[c for _, c in choices])
    basis = F.coalesce(*[F.when(c.isNotNull(), F.lit(label)) for label, c in choices])
    return value, basis


def three_state(flag: Column, clear: Column) -> Column:
    """flagged, clear or unknown; a null condition does not hold."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(flag), F.lit("flagged")).when(yes(clear), F.lit("clear")).otherwise(F.lit("unknown"))


def either_known(a: Column, b: Column) -> Column:
    """a OR b, but null unless both are known."""
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def case_chain(rules: list[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(default)) if default is not None else out


def bin_right_open(x: Column, edges: list[float]) -> Column:
    """Index of the bin [edge, next edge) that holds x, the last open; null below the first edge."""
    rules = [(x >= e, len(edges) - 1 - i) for i, e in enumerate(reversed(edges))]
    return case_chain(rules)


def sentinel_to_null(x: Column, placeholder, marked: Column) -> Column:
    """x without the placeholder value on marked rows."""
    return F.when(~(F.coalesce(marked, F.lit(False)) & F.coalesce(x == placeholder, F.lit(False))), x)


def parse_number(text: Column) -> Column:
    """Number from text with grouping commas, or parentheses for a minus; null if it is none."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    minus = bare.rlike(r"^\(.*\)$")
    value = F.regexp_replace(bare, r"^\((.*)\)$", "$1").try_cast("double")
    return F.when(minus, -value).otherwise(value)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)


def add_token(note: Column, when: Column, token: str) -> Column:
    """note with a token appended, semicolon-separated, where the condition holds."""
    return F.concat_ws(";", note, F.when(when, F.lit(token)))


def union_tokens(*notes: Column) -> Column:
    """Distinct tokens of delimited notes in order of appearance, delimited again."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(n, F.lit("")), ";") for n in notes]))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ";")


def logit(p: Column, least: float = 1e-6) -> Column:
    q = clip(p, least, 1 - least)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-z))


def platt(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))


def age_weight(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(half_life))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k of n; null where n is 0."""
    p, zz = ratio(k.cast("double"), n), z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n)) / (1 + F.lit(zz) / n)
    return centre - half, centre + half


def shrink(total: Column, n: Column, prior: Column, k: float = 10.0) -> Column:
    """(total + k prior) / (n + k)."""
    return (total + F.lit(k) * prior) / (n + F.lit(k))


def hash_id(prefix: str, *parts: Column, digits: int = 10) -> Column:
    """prefix and the first digits of the sha1 of the parts, joined by |."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, digits))


def privacy_mask(df_columns: list[str], hidden: set[str], types: dict[str, str]) -> list[Column]:
    """All columns, those of a policy's hidden set as typed nulls."""
    return [F.lit(None).cast(types[c]).alias(c) if c in hidden else F.col(c) for c in df_columns]
