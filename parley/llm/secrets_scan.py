"""Secret scans (DataFrame functions only).

Base rules: assignments of a password, token or key, access key ids, long hex strings. The
entropy rule looks at every other run of at least `WINDOW` characters that could be a key: a window
slides over the run, the counts of its characters are updated by the one that enters and the one
that leaves, and with them the sum of c * log2(c) from which the Shannon entropy of the window
follows. What an allow-listed mark suppresses is taken out of the run; the parts that are left, and
their pieces between separators, are scored each for itself. A run is reported as `entropy` when the
highest window entropy of any of them reaches the threshold of its character class (`FLOORS`: hex
digits of either case, letters of one or both cases, with or without digits, with separators). Base
findings are never suppressed.

Positions: each rule's matches are wrapped in marker characters by one regexp_replace, the marked
text is split at the markers and the lengths of the pieces are summed with a window over the row,
so a text with any number of matches, or a run of any length, costs linear work. Offsets count code points, end exclusive.
NULL texts read as empty; markers in a text count as one ordinary character that no rule accepts.
Every input row gives one result row, equal and missing doc_ids too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import RID, numbered, with_row_id

# fixed values: the rules of the base scan, in the order in which kinds are listed
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

WINDOW = 20
PIECE = 4096  # windows folded at a time
RUN = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
# entropy floors of the character classes, first match first, of at most log2(20) = 4.32: what 90 to 97 % of random
# 20-character strings of the alphabet reach; letters of one case and words with separators stand above clean words
# instead, and find 20-character strings less often (recall by class and length: README)
FLOORS = (("hex", "^[0-9A-Fa-f]+$", 3.0),
          ("letters of one case", "^([A-Z]?[a-z]+|[A-Z]+)$", 3.6),
          ("letters", "^[A-Za-z]+$", 3.7),
          ("letters of one case, digits", "^([0-9a-z]+|[0-9A-Z]+)$", 3.5),
          ("letters, separators", "^[^0-9]+$", 4.0),
          ("mixed", "", 3.7))
# what looks random and is none. Marks (identifiers made for examples, alphabets) suppress the letters and digits around
# them, WINDOW to each side at most; whole parts that are UUIDs, paths or rulers are not scored as one
MARKS = (r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_-]?(?:api|key|token|secret)|x{4,}"
         r"|abcdefgh|0123456789|qwertyui)")
WHOLE = ("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
         "^/?(?:[A-Za-z_-]+/)+[A-Za-z_-]*$",
         r"^(.)\1+$")
GONE = "\u0003"
OPEN, END = "\u0001", "\u0002"
KINDS = ("assign", "access", "hex", "entropy")


def _top_entropy(run: str) -> Column:
    return F.expr(_top_entropy_sql(run))


def _top_entropy_sql(run: str) -> str:
    """Highest entropy of a window over column `run`.

    The run is cut into its characters once and folded in pieces of `PIECE` windows, which overlap
    by a window less one character, so that long runs cost linear work and bounded state. The
    fold carries the count of each character of the alphabet in the window, twelve counts of five bits a
    long, and the sum of count * log2(count); a step adds the entering character and takes out the leaving one.
    """
    first, cells = ord("+"), (ord("z") - ord("+")) // 12 + 1
    term = ", ".join(repr(c * math.log2(c)) + "D" if c else "0D" for c in range(WINDOW + 2))
    place = lambda at: f"ascii({at}) - {first}"
    count = lambda x: f"cast(shiftrightunsigned(s.n[c.{x}.cell], c.{x}.at) & 31L AS int)"
    spot = lambda x: f"struct(cast(({x}) div 12 AS int) AS cell, 5 * (({x}) % 12) AS at)"
    return f"""
      transform(array(split({run}, '')), chars -> array_max(transform(sequence(0, cast(greatest(length({run}) - {WINDOW}, 0) div {PIECE} AS int)), q ->
      aggregate(
        transform(array(slice(chars, q * {PIECE} + 1, least({PIECE + WINDOW - 1}, length({run}) - q * {PIECE}))), piece ->
          transform(piece, (ch, i) -> struct(
            {spot(place("ch"))} AS enter,
            CASE WHEN i >= {WINDOW} THEN {spot(place(f"piece[i - {WINDOW}]"))} END AS leave,
            i >= {WINDOW - 1} AS whole)))[0],
        struct(array_repeat(0L, {cells}) AS n, 0D AS total, {WINDOW * math.log2(WINDOW)}D AS least),
        (s, c) -> transform(array(struct(
            {count("enter")} AS a,
            CASE WHEN c.leave IS NOT NULL THEN {count("leave")} + CASE WHEN c.leave = c.enter THEN 1 ELSE 0 END ELSE 1 END AS b)),
          k -> transform(array(s.total + array({term})[k.a + 1] - array({term})[k.a]
                 + CASE WHEN c.leave IS NOT NULL THEN array({term})[k.b - 1] - array({term})[k.b] ELSE 0D END),
            total -> struct(
              transform(s.n, (v, j) -> v + CASE WHEN j = c.enter.cell THEN shiftleft(1L, c.enter.at) ELSE 0L END
                                         - CASE WHEN j = c.leave.cell THEN shiftleft(1L, c.leave.at) ELSE 0L END) AS n,
              total AS total,
              CASE WHEN c.whole THEN least(s.least, total) ELSE s.least END AS least))[0])[0],
        s -> {math.log2(WINDOW)}D - s.least / {WINDOW}))))[0]"""


def _suspicious(run: str) -> Column:
    around = f"[A-Za-z0-9]{{0,{WINDOW}}}{GONE}[A-Za-z0-9]{{0,{WINDOW}}}"
    floor = " ".join(f"WHEN part RLIKE r'{pattern}' THEN {bits}D" for _, pattern, bits in FLOORS)
    whole = " OR ".join(f"part RLIKE r'{pattern}'" for pattern in WHOLE)
    return F.expr(f"""
      exists(
        filter(
          transform(array(CASE WHEN {run} RLIKE r'{MARKS}' THEN regexp_replace(regexp_replace({run}, r'{MARKS}', '{GONE}'), '{around}', '{GONE}')
                               ELSE {run} END),
            t -> array_distinct(concat(split(t, '{GONE}'), split(t, '[/_=+{GONE}-]'))))[0],
          part -> length(part) >= {WINDOW}),
        part -> CASE WHEN {whole} THEN false ELSE {_top_entropy_sql("part")} >= CASE {floor} END END)""")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row id, doc_id, found array<struct<start, kind, end>> in order."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + END, "\u0003\u0003")
    rows = with_row_id(docs).select(RID, F.col(id_col).alias("doc_id"), text.alias("text"))
    mark = lambda kind, pattern, inner: F.when(  # noqa: E731 - NULL without a match: most rows stop here
        F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_replace(
            "text", pattern, f"{OPEN}$0{END}{inner}{OPEN}").alias("marked")))
    marked = F.array_compact(F.array(
        mark(0, ASSIGN, "$2"), mark(1, rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", ""), mark(2, rf"[0-9a-f]{{{MIN_HEX},}}", ""),
        mark(3, RUN, "")))
    # one row per piece: outside text at even positions, "match END inner" at odd ones; the texts stay behind
    pieces = (rows.select(RID, "doc_id", F.explode_outer(marked).alias("m"))
              .select(RID, "doc_id", "m.kind", F.posexplode_outer(F.split("m.marked", OPEN)).alias("pos", "piece"))
              .withColumn("hit", F.when(F.col("pos") % 2 == 1, F.substring_index("piece", END, 1)))
              .withColumn("inner", F.when(F.col("pos") % 2 == 1, F.substring_index("piece", END, -1))))
    pieces = pieces.withColumn("good", F.when(F.col("pos") % 2 == 1, F.when(F.col("kind") == 0, F.length("inner") >= MIN_ASSIGN)
                                              .when(F.col("kind") == 3, _suspicious("hit")).otherwise(True)))
    pieces = (pieces.select(RID, "doc_id", "kind", "pos", "good", F.length(F.coalesce("hit", "piece")).cast("long").alias("len"))
              .repartition(RID))
    before = Window.partitionBy(RID, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = pieces.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)))
    found = F.sort_array(F.collect_list(F.when(F.col("good"), F.struct(
        "start", "kind", (F.col("start") + F.col("len")).alias("end")))))
    return spans.groupBy(RID).agg(F.first("doc_id").alias("doc_id"), found.alias("found"))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda f: F.concat_ws(
        ":", F.get(names, f["kind"]), f["start"].cast("string"), f["end"].cast("string"))), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of every row."""
    base = F.filter("found", lambda f: f["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long")
    return scan(docs, id_col, text_col).select(
        RID, "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        count(3).alias("n_entropy"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs without the rows in which anything was found, all columns kept."""
    rows = numbered(docs)
    found = scan(rows).where(F.size("found") > 0).select(RID)
    return rows.join(found, RID, "left_anti").drop(RID)
