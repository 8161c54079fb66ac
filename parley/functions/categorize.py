"""P11 regex categorisation and P12 dictionary normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regex_categorize(text: Column | str, rules: list[tuple[str, list[str]]], other: str = "OTHER") -> Column:
    """First (category, patterns) whose any pattern finds a match in lower(text) wins."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    expr = None
    for cat, pats in rules:
        hit = None
        for p in pats:
            h = low.rlike(p)
            hit = h if hit is None else (hit | h)
        expr = F.when(hit, F.lit(cat)) if expr is None else expr.when(hit, F.lit(cat))
    return expr.otherwise(F.lit(other))


def member_category(value: Column | str, categories: list[tuple[str, list[str]]], other: str) -> Column:
    """Category whose explicit member list contains the value, else `other`."""
    v = _c(value)
    expr = None
    for cat, members in categories:
        if not members:
            continue
        hit = v.isin(*members)
        expr = F.when(hit, F.lit(cat)) if expr is None else expr.when(hit, F.lit(cat))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def map_alias(value: Column | str, mapping: dict[str, str]) -> Column:
    """Look the value up in a literal map; values without an entry pass through."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = _c(value)
    return F.coalesce(F.try_element_at(m, v), v)


def strip_server_prefix(name: Column | str) -> Column:
    """`server:tool` -> `tool` (cut at the first colon only)."""
    return F.regexp_replace(_c(name), r"^[^:]*:", "")
