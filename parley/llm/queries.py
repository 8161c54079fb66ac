"""Registered queries of the operators and of the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (cover_tree, decontaminate, licences, minhash, quality, secrets_scan, sentencepieces, shards, simhash,
                        token_files, topk, toxicity, whitening)
from parley.llm.common import scratch_path, table, written

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "n_windows", "coverage", "reparameterised")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as a digest, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents")
    said = F.crc32(F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepieces.MARK), F.lit(" ")).cast("binary"))
    coded = sentencepieces.encode(docs.select(F.struct("doc_id", said.alias("crc")).alias("doc_id"), "text"), PIECE_MODEL)
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxh64"), "ids")
    back = sentencepieces.decode(coded, PIECE_MODEL)
    return back.select("doc_id.doc_id", "n_tokens", "ids_xxh64",
                       (F.crc32(F.col("decoded").cast("binary")) == F.col("doc_id.crc")).alias("round_trip"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.findings(table(spark, sf_dir, "documents")).drop(secrets_scan.RID)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = table(spark, sf_dir, "documents"), quality.NetParams()
    net = quality.train(docs, table(spark, sf_dir, "labels"), p)
    return toxicity.with_prediction(quality.score(docs, net), p.mod, p.held)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written shards hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return shards.sharded(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = table(spark, sf_dir, "documents"), toxicity.FtrlParams()
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), p)
    return toxicity.with_prediction(toxicity.score(docs, model), p.mod, p.held)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop(minhash.RID)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = cover_tree.compress(table(spark, sf_dir, "embeddings"))
    coded = written(coded, "coded")
    return cover_tree.with_label_error(coded).select("vec_id", "code", "error", "label_error",
                                                     F.lit(cover_tree.digest(books)).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontaminate, op2_sentencepiece, op3_licences, op4_secrets, op5_quality, op6_simhash, op7_topk, op8_shards,
    op9_token_files, op10_toxicity, op11_minhash, op12_whitening, op13_codes, pipeline)}

TOPK_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id,
                  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MINHASH_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS MATERIALIZED (
  SELECT i.a, i.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r) i
  JOIN n x ON x.r = i.a JOIN n y ON y.r = i.b WHERE 100 * i.i >= 80 * (x.n + y.n - i.i)),
reach AS (SELECT r, r AS q FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.q = links.a),
c AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.q GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(d.doc_id = c.component_id, false) AS kept
FROM d LEFT JOIN n USING (r) JOIN c USING (r)"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds one after another, every part against every entry."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS x FROM v, range({parts}) t(p)),
c0 AS MATERIALIZED (
  SELECT p, k, x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v) USING (r) WHERE k < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT p.r, p.p, any_value(p.x) AS x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT),
                                k := c.k)) AS m FROM p JOIN c{i} c ON c.p = p.p GROUP BY p.r, p.p)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x
  FROM (SELECT p, m.k AS k, j, sum(y) AS s, count(*) AS n FROM (SELECT p, m, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{i}) GROUP BY p, m.k, j)
  GROUP BY p, k),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.k = c.k)""")
    return ",".join(steps) + f""",
o AS MATERIALIZED (SELECT r, string_agg(lower(printf('%02x', m.k)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(y, ',' ORDER BY p, k)) FROM (SELECT p, k, array_to_string(x, ',') AS y FROM c{rounds})) AS codebooks_sha256
FROM v JOIN o USING (r)"""


ORACLE_SQL: dict[str, str] = {"op3_licences": licences.scan_sql(), "op7_topk": TOPK_SQL, "op11_minhash": MINHASH_SQL,
                              "op13_codes": codes_sql()}
