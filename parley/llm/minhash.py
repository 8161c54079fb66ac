"""MinHash near-duplicates with b-bit signatures.

A text's set holds its distinct `shingle`-word sequences (ASCII case folded; words end at ASCII
white space), as 64-bit hashes; a text with fewer words counts as one sequence, one without words
has an empty set and is linked with nothing. Of every set `bands` * `rows` minima are taken. They
serve twice: hashed band by band they are bucket keys, and the low `bits` of each, packed into
longs, are the signature that stays. Sets that share a bucket are candidates; the signatures'
equal lanes, counted by bit operations and corrected for chance (2^-bits of the unequal minima
agree), estimate the similarity; what reaches `least_estimate` is confirmed on the full sets.
240 minima in 40 bands miss a pair at similarity 0.8 with probability (1 - 0.8^6)^40 = 5e-6, at 0.85
with 6e-9; the least estimate lies over five standard deviations (0.031) under 0.8.

No bucket emits all its pairs. Texts with equal sets are one class from the start. Then every
bucket compares its members with one leader, the one with most company over all bands: a row a
member. While a bucket is left with more than `partners` pairs of different components a member,
up to `star_rounds` such rounds follow, with seeded random leaders and only for buckets that still
hold several components. Of the pairs of different components that are left, those in buckets with at most
`partners` of them a member are joined and confirmed one by one. Buckets with more, as groups of texts just under the
similarity make them, are united into their connected crowds and compared exactly inside tasks:
a crowd is cut into blocks of at most `block` sets and `block_items` hashes, a task gets two blocks, filters
by signature, counts shared hashes by matrix products and emits links alone.

Every row of the input gives one row. Rows without doc_id link others but cannot name a component:
component_id is the smallest doc_id there is, NULL if no row of the component has one, and `kept`
is false for them. Rows that repeat a doc_id stay separate rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import RID, placed, ship_package, slices, texts_of, written
from parley.llm.hashing import mix
from parley.llm.simhash import components

WORDS_AT_ONCE = 1 << 18
HASHES_AT_ONCE = 1 << 16
COLUMNS_AT_ONCE = 1 << 13
FILTER_BITS = 1 << 26
_A = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 2
    percent: int = 80            # links: 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 6
    bits: int = 2                # low bits kept of each minimum: 1, 2 or 4
    least_estimate: float = 0.63
    star_rounds: int = 2
    partners: int = 8
    block: int = 512
    block_items: int = 1 << 22
    seed: int = 1


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word sequences."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, join, found = xxhash.xxh64_intdigest, b" ".join, []
    for a in range(0, max(1, len(words) - shingle + 1), WORDS_AT_ONCE):
        part = words[a:a + WORDS_AT_ONCE + shingle - 1]
        grams = set(zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [part]
        found.append(np.unique(np.fromiter((digest(join(g)) for g in grams), dtype=np.uint64, count=len(grams))))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def minima(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """len(sets) x n minima of non-empty sets under n seeded multiplicative hashes."""
    with np.errstate(over="ignore"):
        base = mix((np.arange(2 * n, dtype=np.uint64) + np.uint64(1 + seed * 2 * n)) * _A)
    xor, odd = mix(base[:n] * _A), base[n:] | np.uint64(1)
    out = np.empty((len(sets), n), dtype=np.uint64)
    for a, b in slices([len(s) for s in sets], HASHES_AT_ONCE):
        h = np.concatenate(sets[a:b])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[a:b - 1]])]).astype(np.int64)
        for k in range(n):
            out[a:b, k] = np.minimum.reduceat((h ^ xor[k]) * odd[k], starts)
    return mix(out)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, different for equal minima in different bands."""
    keys = np.empty((len(least), bands), dtype=np.uint64)
    for band in range(bands):
        acc = np.full(len(least), (band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for r in range(rows):
            acc = mix(acc * _A + least[:, band * rows + r])
        keys[:, band] = acc
    return keys.view(np.int64)


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the minima, 64 / bits lanes a long."""
    lanes = 64 // bits
    low = least & np.uint64((1 << bits) - 1)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % lanes))).reshape(len(least), -1, lanes)
    return np.bitwise_or.reduce(low << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits)), axis=2).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1)))


def _unsigned(lists: pa.Array) -> list[np.ndarray]:
    """The sets of a batch, as they were written."""
    flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def signatures(rows: DataFrame, p: MinHashParams) -> DataFrame:
    """(row id, doc_id, n, cid, sig, keys) of every row in one pass; the last three NULL for empty sets.

    cid, 128 bits over the sorted hashes, is the same for equal sets."""
    schema = f"{RID} long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, cid binary, sig array<long>, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, p.shingle) for t in texts_of(b.column(2))]
            least = minima([s for s in sets if len(s)], p.bands * p.rows, p.seed)
            at = pa.array(np.where(has := np.array([len(s) > 0 for s in sets], dtype=bool), np.cumsum(has) - 1, 0), mask=~has)
            cid = pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), cid,
                 _lists(packed(least, p.bits)).take(at), _lists(band_keys(least, p.bands, p.rows)).take(at)],
                names=[RID, "doc_id", "n", "cid", "sig", "keys"])

    return rows.select(RID, "doc_id", "text").mapInArrow(run, schema)


def _full_sets(texts: DataFrame, p: MinHashParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts_of(b.column(0)):  # a row at a time: sets may be as large as their texts
                s = shingle_set(t, p.shingle)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s)], pa.binary()), _lists(s.view(np.int64)[None, :])],
                                                 names=["cid", "items"])

    return texts.select("text").mapInArrow(run, "cid binary, items array<long>")


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts without most of those whose row id is not wanted, so that few of the others are shuffled.

    The ids' hashes are marked in FILTER_BITS bits, cut into rows of 4 KiB: 8 MiB are broadcast at most, however many
    ids there are. All wanted texts stay; with very many ids the others stay too."""
    place = F.pmod(F.xxhash64(RID), F.lit(FILTER_BITS)) + 1
    maps = (wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("__part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bits")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return (texts.withColumn("__part", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "__part")
            .where(marked).drop("__part", "__bits"))


def estimate(a: str, b: str, p: MinHashParams) -> Column:
    """Similarity of two signature columns: share of equal lanes, corrected for chance agreement."""
    lanes = sum(1 << i for i in range(0, 64, p.bits))
    lanes -= (lanes >> 63) << 64
    fold = " | ".join(f"shiftrightunsigned(x, {i})" for i in range(p.bits))
    unequal = f"aggregate(zip_with({a}, {b}, (l, r) -> l ^ r), 0, (s, x) -> s + bit_count(({fold}) & {lanes}L))"
    chance = 2.0 ** -p.bits
    return F.expr(f"(1D - ({unequal}) / {float(p.bands * p.rows)}D - {chance}D) / {1 - chance}D")


def _possible(p: MinHashParams) -> Column:
    """Sizes that allow the similarity, and an estimate that does."""
    return ((F.lit(100) * F.least("a_n", "b_n") >= F.lit(p.percent) * F.greatest("a_n", "b_n"))
            & (estimate("a_sig", "b_sig", p) >= p.least_estimate))


def _confirmed(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    shared = F.size(F.array_intersect("a_items", "b_items"))
    both = (pairs.join(sets.withColumnsRenamed({"cid": "a", "items": "a_items"}), "a")
            .join(sets.withColumnsRenamed({"cid": "b", "items": "b_items"}), "b"))
    return (both.select("a", "b", "estimate", shared.alias("shared"), (F.size("a_items") + F.size("b_items") - shared).alias("total"))
            .where(F.lit(100) * F.col("shared") >= F.lit(p.percent) * F.col("total")))


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members with their component; only buckets that hold several."""
    if roots is not None:
        members = members.drop("root").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        members = members.withColumn("root", F.coalesce("root", "cid"))
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return written(members.join(mixed, "key"), "mh-members")


def _star_pairs(members: DataFrame, rank: Column, p: MinHashParams) -> DataFrame:
    """Each member with the leader of its bucket, the one of least rank, if that is of another component."""
    lead = members.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "cid", "root", "n", "sig")).alias("of"))
    return (members.join(lead, "key").where(F.col("root") != F.col("of.root"))
            .select(F.col("cid").alias("a"), F.col("of.cid").alias("b"), F.col("n").alias("a_n"), F.col("of.n").alias("b_n"),
                    F.col("sig").alias("a_sig"), F.col("of.sig").alias("b_sig"))
            .where(_possible(p)).withColumn("estimate", estimate("a_sig", "b_sig", p))
            .groupBy("a", "b").agg(F.first("estimate").alias("estimate")))


def _left_pairs(members: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs of different components inside a bucket."""
    side = lambda s: members.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("cid", "root", "n", "sig")])
    return (side("a").join(side("b"), "key").where((F.col("a_root") < F.col("b_root")) & _possible(p))
            .select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"), estimate("a_sig", "b_sig", p).alias("estimate"))
            .groupBy("a", "b").agg(F.first("estimate").alias("estimate")))


def _crowded(members: DataFrame, partners: int) -> DataFrame:
    """Keys of buckets with more than `partners` pairs of different components a member."""
    of_root = members.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    c = of_root.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
    return c.where(F.col("c") * F.col("c") - F.col("own") > 2 * partners * F.col("c")).select("key")


def linked_classes(classes: DataFrame, texts: DataFrame, p: MinHashParams) -> DataFrame | None:
    """(node, root) for every class of equal sets that is linked with another; None without any link.

    `classes`: cid, at (row id of one text), n, sig, keys; `texts`: row id, text."""
    keys = classes.select("cid", F.explode("keys").alias("key"))
    many = written(keys.groupBy("key").count().where("count > 1"), "mh-keys")
    shared = written(keys.join(many, "key"), "mh-shared")
    nodes = written(classes.drop("keys").join(shared.groupBy("cid").agg(F.sum("count").alias("company")), "cid"), "mh-nodes")
    wanted = nodes.select(F.col("at").alias(RID))
    sets = written(_full_sets(_likely(texts, wanted).join(wanted, RID), p), "mh-sets")  # ids occur once; a semi-join would be pushed below the filter
    members = shared.drop("count").join(nodes.drop("at"), "cid").withColumn("root", F.col("cid"))

    roots = None
    for t in range(p.star_rounds):
        members = _rooted(members, roots)
        if members.isEmpty():
            return roots
        if t > 0 and _crowded(members, p.partners).isEmpty():
            break
        rank = -F.col("company") if t == 0 else F.xxhash64(F.lit(p.seed + t), "cid")
        found = written(_confirmed(_star_pairs(members, rank, p), sets, p), "mh-links")
        roots = _joined_roots(roots, found)
    else:
        members = _rooted(members, roots)
    crowded = written(_crowded(members, p.partners), "mh-crowded")
    found = _confirmed(_left_pairs(members.join(crowded, "key", "left_anti"), p), sets, p).select("a", "b")
    if not crowded.isEmpty():
        found = found.unionByName(_crowd_links(written(members.join(crowded, "key"), "mh-crowds"), sets, p))
    return _joined_roots(roots, written(found, "mh-links"))


def _crowd_links(members: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The links (a, b) between different components inside the connected crowds of buckets."""
    hub = members.groupBy("key").agg(F.min("cid").alias("a"))
    crowd = components(members.join(hub, "key").select("a", F.col("cid").alias("b")).where("a <> b").distinct())
    nodes = members.select("cid", "root", "n", "sig").dropDuplicates(["cid"]).join(crowd.withColumnsRenamed({"node": "cid", "root": "crowd"}), "cid")
    blocks = nodes.groupBy("crowd").agg(F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum("n") / p.block_items)).cast("int").alias("blocks"))
    nodes = nodes.join(blocks, "crowd").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = nodes.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = (dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
             .select("crowd", "lo", "hi", "own", "cid", "root", "n", "sig").join(sets, "cid"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        a, b = _block_links(t, p) if len(t) else ([], [])
        cid = t.column("cid")
        return pa.table({"a": cid.take(pa.array(a, pa.int64())), "b": cid.take(pa.array(b, pa.int64()))})

    return dealt.groupBy("crowd", "lo", "hi").applyInArrow(run, "a binary, b binary")


def _block_links(t: pa.Table, p: MinHashParams) -> tuple[list[int], list[int]]:
    """Rows (a, b) of a task's two blocks that are linked and of different components."""
    column = lambda name: t.column(name).combine_chunks() if len(t) else t.column(name)
    own, n = column("own").to_numpy(zero_copy_only=False), column("n").to_numpy(zero_copy_only=False)
    root = column("root").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sig = column("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(n), -1)
    sets = _unsigned(column("items"))
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    unequal = np.zeros((len(left), len(right)), dtype=np.int64)
    lanes = np.uint64(sum(1 << i for i in range(0, 64, p.bits)))
    for word in range(sig.shape[1]):
        x = sig[left, word][:, None] ^ sig[right, word][None, :]
        for i in range(1, p.bits):
            x |= x >> np.uint64(i)
        unequal += np.bitwise_count(x & lanes)
    chance = 2.0 ** -p.bits
    size = np.minimum(n[left][:, None], n[right][None, :]) * 100 >= p.percent * np.maximum(n[left][:, None], n[right][None, :])
    maybe = ((1 - unequal / (p.bands * p.rows) - chance) / (1 - chance) >= p.least_estimate) & size
    maybe &= root[left][:, None] != root[right][None, :]
    if len(left) == len(right) and (left == right).all():
        maybe &= left[:, None] < right[None, :]
    rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return [], []
    shared = _shared([sets[i] for i in left[rows]], [sets[i] for i in right[cols]])
    total = n[left[rows]][:, None] + n[right[cols]][None, :] - shared
    r, c = np.nonzero(maybe[np.ix_(rows, cols)] & (100 * shared >= p.percent * total))
    return left[rows[r]].tolist(), right[cols[c]].tolist()


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices, some hashes at a time."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)

    def cells(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), dtype=bool)
        return of[hit], at[hit]

    (row_a, at_a), (row_b, at_b) = cells(flat_a, a), cells(flat_b, b)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for c in range(0, len(both), COLUMNS_AT_ONCE):
        width = min(COLUMNS_AT_ONCE, len(both) - c)
        parts = []
        for rows, at, n in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            m, inside = np.zeros((n, width), dtype=np.float32), (at >= c) & (at < c + width)  # sums stay whole under 2^24
            m[rows[inside], at[inside] - c] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _joined_roots(roots: DataFrame | None, found: DataFrame) -> DataFrame | None:
    if found.isEmpty():
        return roots
    edges = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if roots is not None:
        edges = edges.unionByName(roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    return components(edges.distinct())


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row id, doc_id, n_shingles, component_id, kept) of every row."""
    ship_package(docs.sparkSession)
    rows = placed(docs.drop(RID)).select(RID, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(rows, p), "mh-rows")
    classes = written(signed.where("cid IS NOT NULL").groupBy("cid").agg(
        F.min("doc_id").alias("smallest"), F.min(RID).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("keys").alias("keys")), "mh-classes")
    roots = linked_classes(classes.drop("smallest"), rows, p)
    named = classes.select("cid", "smallest")
    if roots is not None:
        of = named.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        best = of.groupBy("root").agg(F.min("smallest").alias("smallest"))
        named = of.select("cid", "root").join(best, "root").select("cid", "smallest")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return (signed.drop("sig", "keys").join(named, "cid", "left")
            .select(RID, "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
