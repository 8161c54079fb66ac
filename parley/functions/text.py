"""Text column expressions: token estimate, fenced / inline code, error-text masks.

Everything here is a Catalyst expression (regex runs in the JVM, inside codegen where
Spark supports it); no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (must give the same matches as the source semantics).
# Fenced block: opening ``` + tag line, body up to the next ``` or the end of the text.
# `\z` (absolute end) on purpose: Java `\Z` would stop before a final newline.
FENCE_RE = r"(?s)```([^\n]*)\n(.*?)(?:```|\z)"
# Inline code: one backtick span that is not part of a `` or ``` run.
INLINE_CODE_RE = r"(?<!`)`(?!`)([^`\n]+?)`(?!`)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def approx_tokens(s: Column | str) -> Column:
    """Empty (or NULL) -> 0, otherwise max(1, chars div 4)."""
    return tokens_of(F.coalesce(F.length(_c(s)), F.lit(0)))


def tokens_of(chars: Column | str) -> Column:
    """P13 from a number of characters."""
    n = _c(chars)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def fences(text: Column | str) -> Column:
    """ARRAY<STRUCT<tag, chars>> of fenced blocks with ONE pass of the pattern over the text: a
    match is three backticks, the tag up to the first newline, the body (which holds no three
    backticks) and, unless the text ends first, three more."""
    def block(m: Column) -> Column:
        tag = F.substring_index(F.substr(m, F.lit(4)), "\n", 1)
        rest = F.length(m) - F.length(tag) - 4
        closed = (rest >= 3) & F.endswith(m, F.lit("```"))
        return F.struct(tag.alias("tag"), (rest - F.when(closed, 3).otherwise(0)).cast("long").alias("chars"))

    whole = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(FENCE_RE), 0)
    return F.transform(whole, block)


def fence_bodies(text: Column | str) -> Column:
    """ARRAY<STRING> of fenced code bodies (unterminated block runs to the end)."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(FENCE_RE), 2)


def fence_tags(text: Column | str) -> Column:
    """ARRAY<STRING> of the raw tag line after each opening fence."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(FENCE_RE), 1)


def code_concat(text: Column | str) -> Column:
    """All fenced bodies joined by a blank line."""
    return F.array_join(fence_bodies(text), "\n\n")


def inline_code_count(text: Column | str) -> Column:
    """Number of single-backtick spans."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(INLINE_CODE_RE), 0)).cast("long")


def strip_ws(s: Column | str) -> Column:
    """Trim Unicode whitespace on both sides (Spark trim() only removes spaces)."""
    return F.regexp_replace(_c(s), r"(?U)^\s+|\s+$", "")
