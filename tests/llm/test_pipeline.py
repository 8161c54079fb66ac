"""Each stage against what its operator says, and the registered queries."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from parley.llm import decontaminate, secrets_scan, simhash, toxicity
from parley.llm.common import table
from parley.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    labels, bench = table(spark, SF, "labels"), table(spark, SF, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        kept = {r.doc_id for r in out.collect()}
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
            want = {r.doc_id for r in scores if r.score < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "decontamination":
            want = {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.find_leaks(docs, bench).collect()}
        else:
            want = {r.doc_id for r in secrets_scan.findings(docs).collect() if not r.spans}
        assert kept == want, name


def test_run_encodes_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]


def test_stages_on_empty_table(spark, docs_of):
    empty = table(spark, SF, "documents").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n.startswith("op")} and "pipeline" in names


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(ORACLE_SQL[key])
    names = [c[0] for c in want.description]
    got = QUERIES[key](spark, SF)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
