"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints at most `max_bits` = 3 bits apart: cut into two 32-bit segments, one segment of a
linked pair differs by at most one bit. Every fingerprint is indexed under each segment as it is
and under its 32 one-wildcard variants (that bit removed); rows that share a key are joined by
equality and verified on all 64 bits. A pair with an equal segment meets under the plain key, a
pair whose segment differs in bit p meets only under wildcard p (0 on the left, 1 on the right
side), so each candidate is verified once.

Equal fingerprints are collapsed before anything is joined. A segment value that very many
distinct fingerprints share (`hot_values`) would make its buckets quadratic: such fingerprints
are indexed one level deeper, where the other 32 bits (at most 3 differing) are cut into two
16-bit segments that get the same treatment. A bucket then fixes 47 of 64 bits, so it holds at
most 2^17 fingerprints whatever the input.

Components are found by alternating large-star and small-star rounds over written tables.
NULL and empty texts have fingerprint zero, linked like any other. Rows with the same doc_id, or
with none, stay separate rows; a component of rows that all lack an id has a NULL component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import RID, in_files, numbered, ship_package, texts_of, with_row_id, written

SHINGLE = 3
MAX_BITS = 3
HOT_VALUES = 2048
SHINGLE_BLOCK = 1 << 18
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set where more than half of the shingles' XXH64 values have it set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for a in range(0, n, SHINGLE_BLOCK):  # bounded memory for very long texts
        part = words[a:a + SHINGLE_BLOCK + shingle - 1]
        grams = map(join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [join(words)]
        h = np.array([digest(g, 42) for g in grams], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for b in range(8):
            ones[8 * b:8 * b + 8] += np.bincount(h[:, b], minlength=256) @ BYTE_BITS
    return sum(1 << i for i in range(64) if 2 * ones[i] > n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row id, id, fp long) for every row, in one pass without a shuffle."""
    ship_package(docs.sparkSession)
    narrow = with_row_id(docs).select(RID, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"{RID} long, doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=[RID, "doc_id", "fp"])

    return narrow.mapInArrow(run, schema)


def _bits(value: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1))


def _variants(rows: DataFrame, low: Column, width: int, base: list[Column]) -> DataFrame:
    """One row per key: (*base, wildcard, segment without it, side, fp); wildcard -1 is the plain segment.

    `low` is the position of the segment in the fingerprint; side 0 / 1 is the removed bit.
    """
    at = F.col("at").cast("int")
    rows = rows.withColumn("at", low)
    value = F.expr(f"shiftrightunsigned(fp, at) & {(1 << width) - 1}L")
    return (rows.withColumn("value", value)
            .select("fp", *base, "at", "value", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("wild"))
            .select("fp", *[c for c in base], at.alias("at"), "wild",
                    F.expr("CASE WHEN wild < 0 THEN value ELSE value & ~shiftleft(1L, wild) END").alias("rest"),
                    F.expr("CASE WHEN wild < 0 THEN -1 ELSE cast(shiftrightunsigned(value, wild) & 1L AS int) END")
                    .alias("side")))


def _joined(keys: DataFrame, on: list[str], max_bits: int) -> DataFrame:
    """Equality join on the key, verified on all bits; links (a < b)."""
    left = keys.where("side <= 0").select(F.col("fp").alias("a"), *on)
    right = keys.where("side <> 0").select(F.col("fp").alias("b"), *on)
    return (left.join(right, on)
            .where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
                   & ((F.col("wild") >= 0) | (F.col("a") < F.col("b"))))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot_values: int = HOT_VALUES) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints of `fps` (column fp, each once) within max_bits.

    Two segments with at most one differing bit cover distances up to 3.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find pairs at up to 3 differing bits")
    segs = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(32))).alias("seg"))
    segs = segs.withColumn("sv", F.expr("shiftrightunsigned(fp, seg) & 4294967295L"))
    hot = written(segs.groupBy("seg", "sv").count().where(F.col("count") > hot_values).select("seg", "sv"), "hotseg")
    # a wildcard bucket holds two values one bit apart: it is deepened if either of them is hot
    near = (hot.select("seg", "sv", F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("bit"))
            .select("seg", F.expr("CASE WHEN bit < 0 THEN sv ELSE sv ^ shiftleft(1L, bit) END").alias("sv"),
                    F.expr("CASE WHEN bit < 0 THEN -1L ELSE shiftleft(1L, bit) END").alias("mask"))
            .groupBy("seg", "sv").agg(F.expr("bit_or(mask)").alias("mask")))
    tagged = segs.join(near, ["seg", "sv"], "left").fillna({"mask": 0})  # -1: all buckets of this value
    keys = _variants(tagged, F.col("seg"), 32, ["mask"])
    deep = F.expr("mask = -1 OR (wild >= 0 AND (mask & shiftleft(1L, wild)) <> 0)")
    plain = _joined(keys.where(~deep), ["at", "wild", "rest"], max_bits)
    if hot.isEmpty():
        return plain.distinct()
    inner = keys.where(deep).select("fp", F.col("at").alias("at0"), F.col("wild").alias("wild0"),
                                    F.col("rest").alias("rest0"), F.explode(F.array(F.lit(0), F.lit(16))).alias("half"))
    sub = _variants(inner, F.expr("32 - at0 + half"), 16, ["at0", "wild0", "rest0"])
    return plain.unionByName(_joined(sub, ["at0", "wild0", "rest0", "at", "wild", "rest"], max_bits)).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node reachable.

    Alternating large-star / small-star; each round is a written table in as many files as its edges
    need, finished when a round changes nothing.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges, "cc")
    n, before = edges.count(), None
    for _ in range(max_rounds):
        # large-star: larger neighbours go to the smallest of the node and its neighbours
        e = both(edges)
        low = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (e.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # small-star: the node and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = written(in_files(small.where("a <> b").distinct(), 2 * n), "cc")  # at most two rows an edge
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        n, before = now[0], tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row id, doc_id, fp, component_id (smallest id reachable) and
    `keep`, the row id of the row that stands for its component."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fp")
    # smallest id first, then the row id among equal ids; rows without an id come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(RID).alias("rid")))
    own = written(in_files(fps.groupBy("fp").agg(first.alias("first")), fps.count()), "fpset")
    roots = components(links(own.select("fp"), max_bits))
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    of = rooted.join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("keep"))
    return fps.join(of, "fp").select(RID, "doc_id", "fp", "component_id", "keep")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component: the smallest doc_id, all columns kept."""
    rows = numbered(docs)
    kept = near_duplicates(rows, shingle, max_bits).where(F.col(RID) == F.col("keep")).select(RID)
    return rows.join(kept, RID, "left_semi").drop(RID)
