"""Splittable reading of a file that is one top-level JSON array of objects.

The file is read in byte ranges, as Spark's text source deals them, in pieces that end at `}`; no
valid JSON has a backslash before one, so a piece starts either outside strings or inside one. Of
every piece two numbers tell what it does to each of these two states: its unescaped quotes, and by how much
it changes the depth. A range reduces to a state map (parity of quotes, depth change if it starts outside,
depth change if it starts inside); maps of the ranges combine by running sums, one row a range, and give
the state in which each range starts. Then every piece knows its depth, running counts number what ends
where, and the pieces between two ends are put together again.

`records` frames the elements of the array. `nested_records` goes one level deeper: the elements of one
array field of each record are framed themselves, with their record and position, so that a record
which is most of the file is put together by no task.

The pieces are written to `scratch` once, with the range each came from; everything later reads that
table, so ranges planned anew after a lost executor do not mix. What is framed is JSON text; parsing
(and failing on malformed text) is from_json's part, which drops spaces between tokens from values kept as text.
A file that does not end with the array's `]` raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE_ENDS = "}"


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character of the file that is no white space opens an array."""
    first = spark.read.option("lineSep", PIECE_ENDS).text(path).limit(1).select(F.regexp_extract("value", r"^\s*(.)", 1)).first()
    return first is not None and first[0] == "["


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _depth_change(outside: Column) -> Column:
    n = F.length(outside)
    return (n - F.length(F.translate(outside, "{[", ""))) - (n - F.length(F.translate(outside, "]}", "")))


def _unescaped(text: Column) -> Column:
    """Same length, escapes blanked: every quote left begins or ends a string."""
    return F.regexp_replace(text, r"(?s)\\.", "__")


def _every_other(text: Column, start: int) -> Column:
    """What lies outside (start 0) or inside (start 1) the strings of an unescaped text."""
    return F.array_join(F.filter(F.split(text, '"'), lambda _, i: i % 2 == start), "")


def _pieces(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """(file, block, nth, value) with quotes and both depth changes; `}` ends every piece but a file's last."""
    raw = (spark.read.option("lineSep", PIECE_ENDS).text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("nth"), "value", _unescaped(F.col("value")).alias("plain")))
    quotes = F.length("plain") - F.length(F.translate("plain", '"', ""))
    closes = lambda inside: F.when((quotes + inside) % 2 == 0, 1).otherwise(0)  # noqa: E731 - the `}` itself, if outside
    return _written(raw.select("file", "block", "nth", "value", quotes.alias("quotes"),
                               (_depth_change(_every_other(F.col("plain"), 0)) - closes(0)).alias("from_outside"),
                               (_depth_change(_every_other(F.col("plain"), 1)) - closes(1)).alias("from_inside")), f"{scratch}/pieces")


def _before(column: str | Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _units(spark: SparkSession, path: str, scratch: str, level: int) -> DataFrame:
    """The file cut after every `}` that leaves it at most `level` deep: file, unit, text, the depth before and
    after, and how many records (`record`) and deeper elements (`element`) ended before it."""
    pieces = _pieces(spark, path, scratch)
    earlier = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    of_ranges = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    odd = F.col("odd") == 1
    state = (pieces.withColumn("odd", _before("quotes", earlier) % 2)
             .withColumn("if_outside", F.when(odd, F.col("from_inside")).otherwise(F.col("from_outside")))
             .withColumn("if_inside", F.when(odd, F.col("from_outside")).otherwise(F.col("from_inside"))))
    maps = state.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("flips"), F.sum("if_outside").alias("out"), F.sum("if_inside").alias("in"))
    starts = (maps.withColumn("begins", _before("flips", of_ranges) % 2)
              .withColumn("change", F.when(F.col("begins") == 1, F.col("in")).otherwise(F.col("out")))
              .withColumn("start", _before("change", of_ranges)).select("file", "block", "begins", "start"))
    at = state.join(starts, ["file", "block"])
    inside = (F.col("odd") + F.col("begins")) % 2
    chosen = lambda o, i: F.when(F.col("begins") == 1, i).otherwise(o)
    at = (at.withColumn("depth", F.col("start") + chosen(_before("if_outside", earlier), _before("if_inside", earlier)))
          .withColumn("after", F.col("depth") + chosen(F.col("if_outside"), F.col("if_inside")))
          .withColumn("closed", (F.col("quotes") + inside) % 2 == 0))
    ends = lambda c: (F.col("closed") & c).cast("long")
    at = at.withColumns({"unit_end": ends(F.col("after") <= level), "record_end": ends(F.col("after") == 1), "element_end": ends(F.col("after") == 3)})
    at = _written(at.select("file", "block", "nth", "value", "depth", "after", *[_before(f"{c}_end", earlier).alias(c) for c in ("unit", "record", "element")],
                            "unit_end", "record_end", "element_end"), f"{scratch}/placed")
    # the piece after the last `}` closes the array and nothing else does; a file cut off ends deeper
    closing = F.col("closing").cast("int")
    whole = at.withColumn("closing", (F.col("after") == -1) & F.col("value").rlike(r"^\s*(\[\s*)?\]\s*$"))
    broken = whole.groupBy("file").agg(F.sum(closing).alias("n"), F.min("after").alias("least")).where("n <> 1 OR least <> -1").select("file").first()
    if broken is not None:
        raise ValueError(f"does not end as one JSON array: {broken.file}")
    sums = at.groupBy("file", "block").agg(*[F.sum(f"{c}_end").alias(c) for c in ("unit", "record", "element")])
    offsets = sums.select("file", "block", *[_before(c, of_ranges).alias(f"{c}s") for c in ("unit", "record", "element")])
    at = at.join(offsets, ["file", "block"]).withColumns({c: F.col(c) + F.col(f"{c}s") for c in ("unit", "record", "element")})
    whole = at.groupBy("file", "unit").agg(
        F.sort_array(F.collect_list(F.struct("block", "nth", "value"))).alias("parts"),
        F.min(F.struct("block", "nth", "depth", "record", "element")).alias("first"), F.max(F.struct("block", "nth", "after", "unit_end")).alias("last"))
    text = F.array_join("parts.value", PIECE_ENDS)
    whole = whole.select("file", "unit", "first.depth", "last.after", F.col("last.unit_end").alias("complete"), "first.record", "first.element",
                         F.concat(text, F.lit(PIECE_ENDS)).alias("text"))
    # also inside the value: a parser's filter may be pushed below this one
    return whole.withColumn("text", F.when((F.col("complete") == 1) & (F.col("after") >= 1), F.col("text"))).where("complete = 1 AND after >= 1")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*\[?[\s,]*", "")


def records(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """(file, record, text) of every element of the array."""
    return _units(spark, path, scratch, 1).select("file", F.col("unit").alias("record"), _stripped(F.col("text")).alias("text"))


def nested_records(spark: SparkSession, path: str, field: str, scratch: str) -> tuple[DataFrame, DataFrame]:
    """(records, elements): file, record, text of the record with `field` emptied, count of its elements; and file, record,
    position, text of every element of `field`, an array of objects (NULL, empty or missing: no elements). Another array
    of objects directly in a record raises an error."""
    units = _units(spark, path, scratch, 3)
    opening = rf'"{field}"\s*:\s*\[\s*(?=\{{)'
    before = F.regexp_extract("text", rf"(?s)^(.*?){opening}", 1)
    level = _depth_change(_every_other(_unescaped(before), 0)) + F.col("depth")
    own = F.when(level == 2, before).otherwise(F.raise_error(F.concat(F.lit(f"an array of objects other than {field} in "), "file")))
    units = units.withColumn("before", F.when((F.col("after") == 3) & (F.col("depth") < 3), own))
    units = _written(units.withColumn("envelope", F.when(F.col("after") < 3, F.col("text")).when(F.col("before").isNotNull(), F.concat("before", F.lit(f'"{field}":[')))),
                     f"{scratch}/units")
    whole = (units.where("envelope IS NOT NULL").groupBy("file", "record")
             .agg(F.sort_array(F.collect_list(F.struct("unit", "envelope"))).alias("parts"), F.min("element").alias("first"), F.max("element").alias("last"))
             .select("file", "record", _stripped(F.array_join("parts.envelope", "")).alias("text"), "first", (F.col("last") - F.col("first")).alias("elements")))
    element = F.when(F.col("before").isNull(), F.regexp_replace("text", r"^[\s,]+", "")).otherwise(
        F.regexp_replace(F.expr("substring(text, length(before) + 1)"), rf"^{opening}", ""))
    # units end at most 3 deep. An equality would be put into the value as a constant and leave it bare in a parser's filter
    elements = (units.where("after > 2").select("file", "record", "element", F.when(F.col("after") > 2, element).alias("text"))
                .join(whole.select("file", "record", "first"), ["file", "record"])
                .select("file", "record", (F.col("element") - F.col("first")).cast("int").alias("position"), "text"))
    return whole.drop("first"), elements
