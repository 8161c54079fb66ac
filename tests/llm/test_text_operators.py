"""Decontamination, licences, secrets, SimHash and shards against brute force and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import decontaminate, licences, secrets_scan, shards, simhash
from parley.llm.common import shared_dir

ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "no id"), (4, "same"), (4, "same"), (5, "same"), (6, "word " * 30_000)]


# decontamination -----------------------------------------------------------------------------
ITEM = "A train leaves Paris with 120 people and 120 bags, then drives 45 km to Berlin where 30 people leave it for good"


def leaks(spark, docs_of, texts, items=(ITEM,), **kw):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.find_leaks(docs_of(list(enumerate(texts))), bench, decontaminate.TemplateParams(**kw))
    return {r.doc_id: r for r in found.collect()}


def test_leaks_exact_reparameterised_and_clean(spark, docs_of):
    changed = ITEM.replace("120", "77").replace("Paris", "Rome").replace("45 km", "80 miles").replace("Berlin", "Bonn")
    uneven = ITEM.replace("120 bags", "31 bags")  # one item value would stand for two
    found = leaks(spark, docs_of, ["some words before. " + ITEM + " and after", changed, "nothing to see here at all, really nothing",
                                   uneven, None, ""])
    assert not found[0].reparameterised and found[0].coverage == 1.0
    assert found[1].reparameterised and found[1].coverage == 1.0
    assert 2 not in found and 4 not in found and 5 not in found
    assert 3 not in found or found[3].coverage < found[1].coverage  # slots do not agree: only free windows count


def test_leaks_one_changed_number_to_a_value_of_the_item(spark, docs_of):
    found = leaks(spark, docs_of, [ITEM.replace("30 people", "45 people"), ITEM, ITEM.replace("120 bags", "45 bags").replace("30", "120")])
    assert found[0].reparameterised and 0.3 <= found[0].coverage < 1
    assert not found[1].reparameterised and found[1].coverage == 1
    assert 2 not in found or found[2].coverage < 1


def test_leaks_whole_words_only_and_short_items(spark, docs_of):
    assert leaks(spark, docs_of, ["two words"], items=("two words",)) == {}
    assert leaks(spark, docs_of, [], items=(ITEM,)) == {}
    assert leaks(spark, docs_of, [ITEM], items=()) == {}


def test_leaks_names_wrapped_and_case_folded(spark, docs_of):
    item = "The Treaty of Lisbon between Anna Berger, Carl Dorn and the City of Essen was signed by Franz Gruber in Hamburg after Ida Jung left"
    names = "Anna Berger, Carl Dorn, Ida Jung, Otto Klein, Paul Quast, Rita Stein"
    texts = [item.replace(" ", "\n"), item.replace(" ", "  "), item.lower(), item.upper(), item.replace("Lisbon", '"Lisbon"').replace("Essen", "(Essen)"),
             item.replace("Hamburg", "Bremen").replace(" ", "\t"), "with " + names.lower() + " in it", item.replace("Franz", "Hans")]
    found = leaks(spark, docs_of, texts, items=(item, names))
    assert {i: r.item_id for i, r in found.items()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}
    assert all(found[i].coverage == 1 and not found[i].reparameterised for i in (0, 1, 2, 3, 4, 6))
    assert found[5].reparameterised and found[7].reparameterised


def test_leaks_question_of_a_long_item(spark, docs_of):
    rng = random.Random(11)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500))
    question = "which of the seven bridges over the old river was closed for repairs during the winter"
    found = leaks(spark, docs_of, ["before " + question + " after", " ".join(question.split()[:8])], items=(passage + ". " + question + "?",))
    assert set(found) == {0} and found[0].coverage < 0.3 and not found[0].reparameterised


def test_leaks_items_without_windows(spark, docs_of):
    items = ("What is 12 + 7?", "12 + 7 = 19, 13 + 8 = 21, 14 + 9 = 23", "name the capital of this country")
    found = leaks(spark, docs_of, ["so what is 12+7 then", "what is 12 + 8", "12 + 7 = 19; 13 + 8 = 21; 14 + 9 = 23 and on",
                                   "12 + 7 = 19, 13 + 8 = 21, 14 + 9 = 24", "Name the capital of this country!", None, ""], items=items)
    assert {i: r.item_id for i, r in found.items()} == {0: 0, 2: 1, 4: 2}
    assert all(r.coverage == 1 and not r.reparameterised for r in found.values())


def test_leaks_against_brute_force(spark, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts, items = sample.collect(), bench.collect()
    contain = {(d.doc_id, b.item_id) for d in texts for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(sample, bench).collect()}
    assert contain <= got
    kept = {r.doc_id for r in decontaminate.without_leaks(sample, bench).collect()}
    assert kept == {d.doc_id for d in texts} - {i for i, _ in got}


def test_template_windows_in_one_split(spark):
    """The windows of template and names as the definition has them, from one split of the text."""
    d, n, t = decontaminate, 4, F.col("text")
    texts = [None, "", "a Paris", "in Rome", 'we saw Paris, and (Rome) "Berlin" at 5 km and 7km; then Bob  met Äda in 12 Km or 3.5 Kg of X',
             "x: Anna's dog, Bob; Cid ran 5 Km to İstanbul, Σας then Paris' «Lyon»  [Nice] {Metz} a b c", "the " * 20 + "Paris",
             "tab\t(two)\u00a0 marks\ue001 of \ue002\ue003 \u2028Ann ran  on and on", "no name here at all, 3 of 4"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    words = [(r.t, r.said) for r in df.select(d._template(t).alias("t"), d._words(F.lower(t)).alias("said")).collect()]
    hashed = spark.createDataFrame([(k, i, kind[i:i + n]) for k, (a, said) in enumerate(words) if a
                                    for kind in (a, [s if x == d.NAME else x for x, s in zip(a, said)])
                                    for i in range(len(a) - n + 1) if kind is a or d.NAME in a[i:i + n]], "k int, pos int, w array<string>")
    want = Counter((r.k, r.pos, r.hash) for r in hashed.select("k", "pos", F.xxhash64("w").alias("hash")).collect())
    got = Counter((k, x.pos, x.hash) for k, r in enumerate(df.select(d._windows(t, n).alias("w")).collect()) for x in r.w or [])
    assert got == want and len(want) > 60
    assert str(d._windows(t, n)).count("split(") == 1 and "translate(" not in str(d._windows(t, n))


# licences ------------------------------------------------------------------------------------
def test_licence_sequences(docs_of):
    s = licences.SENTENCES
    mit = f"Intro line\n\n{s['mit-grant']}\n\n{s['mit-notice']}\n\n{s['mit-warranty']}"
    texts = ["x\nReleased under the MIT License.\ny", mit, f"{s['mit-warranty']} {s['mit-notice']} {s['mit-grant']}",
             "prose without a stop\nLicensed under CC BY-NC 4.0.\nmore", None, "", "Licensed under the Apache Licence of mine.",
             f"{s['apache-obtain']}\n\n  http://example.org/LICENSE\n\n{s['apache-basis']}", "licence " * 50_000]
    got = {r.doc_id: r for r in licences.scan(docs_of(list(enumerate(texts)))).collect()}
    assert [got[i].licences for i in range(9)] == ["MIT", "MIT", "", "CC-BY-NC-4.0", "", "", "", "Apache-2.0", ""]
    assert got[2].sentences == "mit-warranty,mit-notice,mit-grant"
    assert all(re.search(licences.ANCHOR, k) for k in licences.SENTENCES.values())


def test_every_licence_rule_fires(docs_of):
    said = {**licences.SENTENCES, **licences.PARTS}
    texts = ["\n\n".join(["Intro.", *(said[k] for k in rule), "More words follow."]) for _, rule in licences.RULES]
    texts += ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not\n */",
              "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."]
    got = {r.doc_id: r.licences.split(",") for r in licences.scan(docs_of(list(enumerate(texts)))).collect()}
    assert all(name in got[i] for i, (name, _) in enumerate(licences.RULES))
    assert got[len(texts) - 2] == ["MPL-2.0"] and got[len(texts) - 1] == [""]


# secrets -------------------------------------------------------------------------------------
def brute_secrets(text):
    out = []
    for kind, pattern, good in ((0, re.compile(secrets_scan.ASSIGN), lambda m: len(m[2]) >= 8),
                                (1, re.compile(secrets_scan.ACCESS), lambda m: len(m[0]) >= 16),
                                (2, re.compile(secrets_scan.HEX), lambda m: len(m[0]) >= 32)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if good(m)]
    out.sort()
    joined = ",".join(f"{secrets_scan.KINDS[k]}:{a}:{z}" for a, k, z in out)
    return tuple(sum(k == x for _, k, _ in out) for x in range(3)), hashlib.sha256(joined.encode()).hexdigest()


def brute_entropy(run):
    import math
    w = secrets_scan.WINDOW
    return max(math.log2(w) - sum(c * math.log2(c) for c in Counter(run[i:i + w]).values()) / w for i in range(len(run) - w + 1))


def test_secrets_against_brute_force(docs_of):
    rng = random.Random(3)
    bits = ["token", "=", ": ", '"', "PASSWORD", "api_key", " ", "é", "🙂", "0123456789abcdef", "AKIA", "ABCDEF0123456789", "\n", "-", "\u0001",
            "f" * 9, "secret:", "abc", "\u0002"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += ['token: "token": abcdefghij', None, "", "x" * 100_000, "AKIA" + "A" * 12, "AKIA" + "A" * 11,
              ("token=abcdefgh " * 5000)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in secrets_scan.findings(docs_of(rows)).collect()}
    for i, t in rows:
        want = brute_secrets(t)
        assert ((got[i].n_assign, got[i].n_access, got[i].n_hex), got[i].base_sha256) == want, t[:80]


def test_entropy_runs_and_allow_list(docs_of, spark):
    runs = ["Zk3/9QmPa77xRtLw+0vBnE4yHc==", "0641917ea4e9feb9cda83477b57ac2654884f485", "thentionerandthesebleing", "a" * 30,
            "123e4567-e89b-12d3-a456-426614174000", "exampleZk3/9QmPa77xRtLw+0vB", "some/long/path/into/folders/here"]
    got = {r.doc_id: r.n_entropy for r in secrets_scan.findings(docs_of(list(enumerate(runs)))).collect()}
    assert [got[i] for i in range(len(runs))] == [1, 1, 0, 0, 0, 0, 0]
    rows = spark.createDataFrame([(r,) for r in runs], "run string")
    for r in rows.select("run", secrets_scan._top_entropy("run").alias("h")).collect():
        assert r.h == pytest.approx(brute_entropy(r.run))


def test_allow_list_stays_with_its_part(docs_of):
    key, blob = "Zk39QmPa77xRtLw0vBnE4yHc", "".join(random.Random(9).choices("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789", k=200))
    path = "a/bQxWzKvRtYpLmNcDgHjFs/of/letters"
    runs = [f"files/example/{key}", f"https/sample_dir/{key}/x", blob[:100] + "xxxx" + blob[100:], path, "x" * 100_000,
            f"sample-{'F00DBABE12345678' * 2}", f"some/example{key}", "files/example/of/paths", "0123456789abcdefghijklmnopqrstuvwxyz"]
    got = {r.doc_id: r.n_entropy for r in secrets_scan.findings(docs_of(list(enumerate(runs)))).collect()}
    assert [got[i] for i in range(len(runs))] == [1, 1, 1, 1, 0, 1, 0, 0, 0]


def test_entropy_recall_by_class(spark):
    """Share of random keys found by class and length, and no clean word."""
    rng, lower, digits = random.Random(7), "abcdefghijklmnopqrstuvwxyz", "0123456789"
    least = {("lower hex", digits + "abcdef"): (0.92, 0.98), ("upper hex", digits + "ABCDEF"): (0.92, 0.98),
             ("lower", lower): (0.5, 0.95), ("upper", lower.upper()): (0.5, 0.95), ("letters", lower + lower.upper()): (0.88, 0.98),
             ("lower, digits", lower + digits): (0.9, 0.98), ("alphanumeric", lower + lower.upper() + digits): (0.92, 0.98)}
    keys = [(name, n, "".join(rng.choice(chars) for _ in range(n))) for name, chars in least for n in (20, 40) for _ in range(200)]
    words = ["thentionerandthesebleing", "keitstlichschenverpf", "Einungtzheitgeungverlich", "internationalization", "antidisestablishmentarianism",
             "well-known-and-long-hyphenated-words", "snake_case_names_in_prose"]
    rows = spark.createDataFrame([*keys, *[("clean", 0, w) for w in words]], "name string, n int, run string")
    got = rows.groupBy("name", "n").agg(F.avg(secrets_scan._suspicious("run").cast("int")).alias("share")).collect()
    share = {(r.name, r.n): r.share for r in got}
    assert share.pop(("clean", 0)) == 0
    for (name, _), (at20, at40) in least.items():
        assert share[name, 20] >= at20 and share[name, 40] >= at40, (name, share)


def test_secrets_odd_rows(docs_of):
    got = secrets_scan.findings(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and all(r.spans == "" for r in got)
    assert secrets_scan.without_secrets(docs_of(ODD)).count() == len(ODD)
    assert secrets_scan.findings(docs_of([])).collect() == []


# SimHash -------------------------------------------------------------------------------------
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(fps), 2):
        if bin(a ^ b).count("1") <= 3:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_against_brute_force(docs_of, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()] + [(10_000 + i, t) for i, t in enumerate(
        ["", None, " \x0b ", "one", "one two", "ONE TWO", "one two three", "É é  x y", "a b c a b c a b c"])]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = brute_components(set(fps.values()))
    smallest = {}
    for i, f in sorted(fps.items()):
        smallest.setdefault(root[f], i)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == {i: smallest[root[f]] for i, f in fps.items()}


@pytest.mark.parametrize("hot", [2048, 3])
def test_links_complete(spark, hot):
    """All pairs within 3 bits, also where many values share a segment and go one level deeper."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(100)} | {centre}
    for _ in range(150):
        f = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << b
        fps.add(f)
    fps |= {centre ^ x for x in range(64)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(fps, 2) if bin(a ^ b).count("1") <= 3}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    assert {(r.a, r.b) for r in simhash.links(df, hot_values=hot).collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100
    assert simhash.components(edges.where("a < 0")).collect() == []


def test_rounds_write_few_files(spark):
    """A round's table has as many files as its edges need, not as there are shuffle partitions."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    tables = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("llm-cc-*"))
    before = tables()
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 2000 + F.col("id") % 7).alias("b"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in simhash.components(edges).collect()}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = [len(list(d.glob("part-*"))) for d in sorted(tables() - before, key=lambda d: d.stat().st_mtime)]
    root = {i + 2000 + i % 7: i for i in reversed(range(2000))}  # every a has one edge
    assert got == root | {i: root[i + 2000 + i % 7] for i in range(2000) if i > root[i + 2000 + i % 7]}
    assert len(files) > 1 and max(files[1:]) <= spark.sparkContext.defaultParallelism
    assert not [d for d in tables() - before if (d / "_SUCCESS").exists()]  # a file the driver itself would create


def test_one_of_each_keeps_one_row(docs_of):
    kept = simhash.one_of_each(docs_of(ODD)).collect()
    assert Counter(r.text for r in kept)["same"] == 1 and len([r for r in kept if not (r.text or "").strip()]) == 1
    assert kept[0].__fields__ == docs_of(ODD).columns


# row ids ---------------------------------------------------------------------------------------
@pytest.fixture
def resplit(spark):
    """Other file splits from the call on, as with executors lost or added between jobs."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda: spark.conf.set(key, "20000")
    spark.conf.set(key, before)


def test_row_ids_do_not_depend_on_splits(spark, sample, resplit):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    same = lambda df: sorted(r.doc_id for r in df.collect())
    want = [same(simhash.one_of_each(sample)), same(decontaminate.without_leaks(sample, bench)), same(secrets_scan.without_secrets(sample))]
    order = {(r.doc_id, r.shard, r.slot) for r in shards.shuffled(sample, bucket_bytes=2000).collect()}
    late = [simhash.one_of_each(sample), decontaminate.without_leaks(sample, bench), secrets_scan.without_secrets(sample)]
    late_order = shards.shuffled(sample, bucket_bytes=2000)
    resplit()
    assert [same(df) for df in late] == want
    assert {(r.doc_id, r.shard, r.slot) for r in late_order.collect()} == order


# shards --------------------------------------------------------------------------------------
@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2000])
def test_shards_hold_everything_once(sample, bucket_bytes):
    got = shards.sharded(sample, bucket_bytes=bucket_bytes).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in sample.collect())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {(r.doc_id, r.shard, r.slot) for r in shards.sharded(sample, bucket_bytes=bucket_bytes).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}  # seeded
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))] != sorted(r.doc_id for r in got)


def test_shards_odd_rows(docs_of):
    assert shards.sharded(docs_of(ODD)).count() == len(ODD)
    assert shards.sharded(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        shards.shuffled(docs_of(ODD).withColumn("slot", F.lit(1)))


def test_shards_send_no_text_to_python(sample):
    """Python numbers the records; texts stay in Spark's rows, which its sorts spill."""
    plan = shards.shuffled(sample, bucket_bytes=2000)._jdf.queryExecution().executedPlan().toString()
    to_python = [line for line in plan.splitlines() if "Python" in line or "InArrow" in line]
    assert to_python and all("ArrowEvalPython" in line and "text#" not in line for line in to_python)


def test_places_of_buckets_in_any_batches():
    first = {0: (0, 5), 1: (5, 0), 2: (5, 7)}
    bucket, number = np.repeat([0, 2], [5, 7]), np.concatenate([np.arange(1, 6), np.arange(1, 8)])
    whole = shards._places(bucket, number, first, 3)
    assert sorted(whole.tolist()) == list(range(12)) and sorted(whole[:5].tolist()) == list(range(5))
    parts = [shards._places(bucket[a:a + 4], number[a:a + 4], first, 3) for a in range(0, 16, 4)]
    assert np.concatenate(parts).tolist() == whole.tolist()
    order = shards._fisher_yates(7, 3, 2)
    assert [(whole[5:] - 5).tolist().index(i) for i in range(7)] == order.tolist()


def test_fisher_yates_is_a_permutation():
    order = shards._fisher_yates(500, 1, 2)
    assert sorted(order.tolist()) == list(range(500)) and order.tolist() != list(range(500))
    assert zlib.crc32(order.tobytes()) == zlib.crc32(shards._fisher_yates(500, 1, 2).tobytes())


def test_leaks_shared_preamble_is_no_evidence(spark, docs_of):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    preamble = " ".join(word() for _ in range(23))
    items = [preamble + " " + " ".join(word() for _ in range(20)) for _ in range(20)]
    texts = [preamble + " " + " ".join(word() for _ in range(30)) for _ in range(20)]
    texts += ["before " + items[3], " ".join(items[5].split()[-16:]) + " after", items[7].split(" ", 23)[-1]]
    found = leaks(spark, docs_of, texts, items=tuple(items))
    assert {i: r.item_id for i, r in found.items()} == {20: 3, 21: 5, 22: 7}


@pytest.mark.parametrize("n", [20, 4096 + 19, 4096 + 20, 9000])
def test_entropy_of_long_runs_equals_brute_force(spark, n):
    rng = random.Random(n)
    run = "".join(rng.choice("ab") for _ in range(n - 20)) + "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-09", 20))
    for s in (run, run[::-1], run[n // 2:] + run[:n // 2]):
        got = spark.createDataFrame([(s,)], "part string").select(secrets_scan._top_entropy("part")).first()[0]
        assert abs(got - brute_entropy(s)) < 1e-9


def test_million_character_run_is_scored_in_linear_time(docs_of):
    import time
    rng = random.Random(9)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+") for _ in range(1_000_000))
    start = time.time()
    got = secrets_scan.findings(docs_of([(1, "see " + blob + " end")])).collect()
    assert got[0].spans == f"entropy:4:{4 + len(blob)}" and time.time() - start < 60
