"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts become word sequences in which numbers (with a unit written onto them), units that follow a
number, and names (capitalised words inside a sentence) are replaced by typed placeholders, all
other words lower-cased; white space, quotes and brackets before a name do not matter. A second template
has the names as lower-cased words; windows that meet in either count. Every window of `window` placeholders and words is hashed and joined with
the hashed windows of the benchmark items; windows that meet are lined up by item and by the
distance between the two positions (one alignment per occurrence). Within an alignment the slots
must be consistent: the same item value always stands for the same value in the document, and
different ones for different ones; windows that hold a changed slot which breaks this do not count.
A document is reported for an item when the windows that count, over all its alignments, cover at
least `coverage` of the item's windows, or `run` of them one after another, whatever the item's length. `reparameterised` says that windows meet only with
a slot value that differs.

Defined results: NULL and empty texts match nothing. Item windows with fewer than `literals` words that
are no placeholders are too unspecific to be matched and do not count for coverage, nor do windows that more than
`sharing` items of different texts hold (instructions, preambles). Items without a
window (short ones, arithmetic) are found where all their words stand as written, case aside, as one
window; items of fewer than `whole` words match nothing. Items whose text repeats are reported each. Repeated rows
and equal doc_ids are kept apart inside and reported under their doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import RID, let, numbered, with_row_id, written

# placeholders; the same characters in a text are read as separators
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
SPACES = "\t\n\x0b\f\r\u00a0\u2028\u2029\"\u201c\u201d\u201e\u00ab\u00bb()[]{}"
_SPACE = "".join(f"\\u{ord(c):04x}" for c in NAME + NUMBER + UNIT + SPACES)
SPACES_RE = rf"(?:[{_SPACE}]| [{_SPACE} ])[{_SPACE} ]*+"  # anything but a single space
UNITS = ("mm", "cm", "dm", "km", "m", "mg", "kg", "g", "ml", "cl", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "ghz",
         "w", "kw", "mw", "kwh", "v", "a", "j", "kj", "cal", "kcal", "pa", "kpa", "n", "k", "c", "f", "mph", "kmh",
         "inch", "inches", "feet", "foot", "ft", "miles", "mile", "yards", "pounds", "lb", "oz", "meters", "metres",
         "meter", "grams", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
         "dollars", "euros", "cents", "usd", "eur", "percent", "degrees")
_UNIT = "(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")"
# the tests on what stands before come second: most positions fail on the first character
NUMBER_RE = rf"[0-9](?<![\p{{L}}\p{{M}}\p{{N}}].)[0-9]*+(?i:{_UNIT})?+(?![\p{{L}}\p{{M}}\p{{N}}])"
UNIT_RE = rf"{NUMBER} (?i:{_UNIT})(?![\p{{L}}\p{{M}}\p{{N}}])"
NAME_RE = r"\p{Lu}(?<=[\p{L}\p{M}\p{N},;:] .)\p{Ll}++(?![\p{L}\p{M}\p{N}])"
BREAK_RE = rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}]++"
BROADCAST_WINDOWS = 1_000_000  # 16 bytes each


@dataclass(frozen=True)
class TemplateParams:
    window: int = 8
    literals: int = 4
    coverage: float = 0.3
    run: int = 6            # windows one after another that are enough whatever the item's length: 13 words
    whole: int = 3          # words that an item without windows needs at least
    sharing: int = 8        # different item texts that may hold a window; others (instructions, preambles) tell no item


def _clean(text: Column) -> Column:
    return F.translate(text, NAME + NUMBER + UNIT, "   ")


def _spaced(text: Column) -> Column:
    """White space, double quotes and brackets as one space: no word begins or ends there that did not before."""
    return F.regexp_replace(text, SPACES_RE, " ")


def _words(text: Column) -> Column:
    """The words as written."""
    return F.split(_clean(text), BREAK_RE)


def _template(text: Column, name: str = NAME) -> Column:
    """The words with placeholders, `name` for names; as long as _words, position by position."""
    t = F.regexp_replace(_spaced(text), NAME_RE, name)
    t = F.regexp_replace(F.regexp_replace(t, NUMBER_RE, NUMBER), UNIT_RE, f"{NUMBER} {UNIT}")
    return F.split(F.lower(t), BREAK_RE)


def _named(template: Column, words: Column) -> Column:
    """The template with names as lower-cased words: equal for copies in other cases or after other marks."""
    return F.zip_with(template, words, lambda t, said: F.when(t == NAME, said).otherwise(t))


def _windows(text: Column, n: int) -> Column:
    """array<struct<pos, hash>> of the template's windows, and of those with names once more with the names as words.

    The text is split once, names as placeholder and word; only windows at a name are visited again."""
    named = lambda x: F.startswith(x, F.lit(NAME))
    marked = let(_template(text, NAME + "$0"), lambda m: F.struct(
        m.alias("m"), F.array_compact(F.transform(m, lambda x, i: F.when(named(x), i))).alias("at")))

    def both(b: Column) -> Column:
        each = lambda value: F.transform(b["m"], lambda x: F.when(named(x), value(x)).otherwise(x))
        none = F.size(b["at"]) == 0
        return F.struct(F.when(none, b["m"]).otherwise(each(lambda x: F.lit(NAME))).alias("t"),
                        F.when(none, b["m"]).otherwise(each(lambda x: F.substring(x, 2, 1 << 30))).alias("named"),
                        b["at"].alias("at"))

    def hashed(b: Column) -> Column:
        last = F.size(b["t"]) - n
        at = lambda kind: lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(b[kind], i + 1, F.lit(n))).alias("hash"))
        around = F.array_distinct(F.flatten(F.transform(b["at"], lambda i: F.sequence(F.greatest(i - (n - 1), F.lit(0)), F.least(i, last)))))
        return F.when(last >= 0, F.concat(F.transform(F.sequence(F.lit(0), last), at("t")), F.transform(around, at("named"))))

    return let(let(marked, both), hashed)


def _worded(words: Column) -> Column:
    """Without the empty words before the first and after the last break."""
    return F.filter(words, lambda x: x != "")


def _longest_run(windows: Column, n: int) -> Column:
    """Most windows one after another among an alignment's array<struct<ipos, nth>>; windows of the item
    that cannot be matched may lie between, words that no window covers may not."""
    def step(s: Column, x: Column) -> Column:
        follows = (x["nth"] == s["last"]["nth"] + 1) & (x["ipos"] - s["last"]["ipos"] <= n)
        now = F.when(follows, s["now"] + 1).otherwise(1)
        return F.struct(x.alias("last"), now.alias("now"), F.greatest(s["most"], now).alias("most"))

    none = F.struct(F.lit(-2).alias("ipos"), F.lit(-2).alias("nth"))
    start = F.struct(none.alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.sort_array(windows), start, step, lambda s: s["most"])


def find_leaks(docs: DataFrame, items: DataFrame, p: TemplateParams = TemplateParams(),
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (input row, item) pair found: row id, doc_id, item_id, windows matched, the
    item's windows, coverage, reparameterised."""
    w = p.window
    # written once: the ids are joined in later jobs
    rows = numbered(docs.select(*[c for c in docs.columns if c == RID], F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    slot = lambda x: x.isin(NAME, NUMBER, UNIT)

    bench = written(with_row_id(items).select(F.col(RID).alias("item"), "item_id", F.col("text").alias("t"))
                    .withColumn("template", _worded(_template(F.col("t"))))
                    .withColumn("said", _worded(_words(F.lower("t")))), "items")
    # windows are matched with names as placeholders or as words; items of names alone only with names as words
    cut = lambda c: F.slice(c, F.col("ipos") + 1, F.lit(w))
    enough = lambda c: F.size(F.filter(cut(c), lambda x: ~slot(x))) >= p.literals
    all_windows = (bench.withColumn("named", _named(F.col("template"), F.col("said"))).where(F.size("template") >= w)
                    .select("item", "template", "named", F.explode(F.sequence(F.lit(0), F.size("template") - w)).alias("ipos"))
                    .select("item", "ipos", F.xxhash64(cut("template")).alias("hash"), F.xxhash64(cut("named")).alias("named"),
                            enough("template").alias("free"), enough("named").alias("literal"))
                    .withColumn("any", F.max("free").over(Window.partitionBy("item")))
                    .where(F.col("free") | (~F.col("any") & F.col("literal"))))
    # windows of very many different items are no evidence for one of them
    key = F.when(F.col("free"), F.col("hash")).otherwise(F.col("named"))
    often = (all_windows.join(bench.select("item", F.xxhash64("said").alias("said_hash")), "item")
             .groupBy(key.alias("key")).agg(F.countDistinct("said_hash").alias("texts")).where(F.col("texts") > p.sharing).select("key"))
    common = (all_windows.withColumn("key", key).join(often, "key").groupBy("item").agg(F.collect_set("ipos").alias("common")))
    item_windows = (all_windows
                    .join(common, "item", "left").where(~F.coalesce(F.array_contains("common", F.col("ipos")), F.lit(False)))
                    .withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy("ipos")))
                    .select("item", F.struct("ipos", "nth").alias("ipos"), F.explode(F.when(F.col("free"), F.array_distinct(F.array("hash", "named")))
                                                      .otherwise(F.array("named"))).alias("hash")))
    of_item = item_windows.groupBy("item").agg(F.countDistinct("ipos").alias("n_windows"))
    hashes = item_windows.select("hash").distinct()
    if item_windows.count() <= BROADCAST_WINDOWS:  # benchmarks are small; a larger one is joined by shuffle
        hashes, item_windows, of_item = F.broadcast(hashes), F.broadcast(item_windows), F.broadcast(of_item)

    # every window of every document against the item windows; only matches go on
    met = (rows.select(RID, F.inline(_windows(F.col("text"), w)))
           .join(hashes, "hash"))
    pairs = (met.join(item_windows, "hash")
             .groupBy(RID, "item", (F.col("pos") - F.col("ipos.ipos")).alias("shift")).agg(F.collect_set("ipos").alias("ipos")))

    # slots of each alignment, from the words as written on both sides; with the alignments written, their
    # size is known when the join is planned, and the texts are shuffled only if there are very many
    pairs = written(pairs, "alignments")
    hit = rows.join(pairs, RID)
    hit = hit.join(bench.select("item", "item_id", "template", "said"), "item")
    covered = F.array_distinct(F.flatten(F.transform("ipos", lambda i: F.sequence(i["ipos"], i["ipos"] + (w - 1)))))
    hit = hit.withColumn("at", F.filter(covered, lambda i: slot(F.get("template", i))))
    hit = hit.withColumn("slots", let(_words(F.lower("text")), lambda words: F.transform("at", lambda i: F.struct(
        i.alias("at"), F.struct(F.get("template", i).alias("kind"), F.get("said", i).alias("item"),
                                F.get(words, i + F.col("shift")).alias("doc")).alias("value")))))
    # a slot that is equal as written always counts; a changed one conflicts if its value stands for two, on either side
    values = F.array_distinct(F.transform("slots", lambda s: s["value"]))
    hit = hit.withColumn("conflicts", let(values, lambda all_: F.filter(all_, lambda c: (c["item"] != c["doc"]) & F.exists(
        all_, lambda o: (o["kind"] == c["kind"]) & ((o["item"] == c["item"]) != (o["doc"] == c["doc"]))))))
    hit = hit.withColumn("bad", F.transform(F.filter("slots", lambda s: F.array_contains("conflicts", s["value"])), lambda s: s["at"]))
    hit = hit.withColumn("changed", F.transform(F.filter("slots", lambda s: s["value"]["item"] != s["value"]["doc"]), lambda s: s["at"]))
    without = lambda slots: F.filter("ipos", lambda i: ~F.exists(slots, lambda x: x.between(i["ipos"], i["ipos"] + (w - 1))))
    hit = hit.select(RID, "doc_id", "item", "item_id", "ipos", without("bad").alias("counted"), without("changed").alias("same"))
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    found = (hit.groupBy(RID, "item").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"),
                                         F.size(union("counted")).alias("matched"), F.max(_longest_run(F.col("counted"), w)).alias("run"),
                                         (F.size(F.array_except(union("ipos"), union("same"))) > 0).alias("reparameterised"))
            .join(of_item, "item")
            .withColumn("coverage", F.col("matched") / F.col("n_windows"))
            .where((F.col("coverage") >= p.coverage) | (F.col("run") >= p.run))
            .select(RID, "doc_id", "item_id", F.col("matched").cast("long").alias("matched"), "n_windows", "coverage",
                    "reparameterised"))
    rest = bench.join(of_item, "item", "left_anti").where(F.size("said") >= p.whole)
    lengths = sorted(r[0] for r in rest.select(F.least(F.size("said"), F.lit(w))).distinct().collect())  # at most w
    return found.unionByName(_whole_items(rows, rest, lengths, w)) if lengths else found


def _whole_items(rows: DataFrame, items: DataFrame, lengths: list[int], w: int) -> DataFrame:
    """Rows that hold all words of an item as written; its first words, `w` at most, are joined by hash."""
    first = items.select("item", "item_id", "said", F.least(F.size("said"), F.lit(w)).alias("n"))
    first = first.withColumn("hash", F.xxhash64(F.slice("said", F.lit(1), F.col("n"))))

    def windows(words: Column, n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(
            F.lit(n).alias("n"), i.alias("pos"), F.xxhash64(F.slice(words, i + 1, F.lit(n))).alias("hash"))))

    starts = let(_words(F.lower("text")), lambda words: F.flatten(F.array_compact(F.array(*[windows(words, n) for n in lengths]))))
    firsts = first.select("item", "n", "hash")
    if firsts.count() <= BROADCAST_WINDOWS:
        firsts = F.broadcast(firsts)
    met = written(rows.select(RID, F.inline(starts)).join(firsts, ["n", "hash"])
                  .groupBy(RID, "item").agg(F.collect_list("pos").alias("pos")), "starts")
    held = let(_words(F.lower("text")), lambda words: F.exists(
        "pos", lambda i: F.slice(words, i + 1, F.size("said")) == F.col("said")))
    return (rows.join(met, RID).join(first.select("item", "item_id", "said"), "item").where(held)
            .select(RID, "doc_id", "item_id", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("n_windows"),
                    F.lit(1.0).alias("coverage"), F.lit(False).alias("reparameterised")))


def without_leaks(docs: DataFrame, items: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """docs without the rows found for any item, all columns kept."""
    rows = numbered(docs)
    found = find_leaks(rows, items, p).select(RID).distinct()
    return rows.join(found, RID, "left_anti").drop(RID)
