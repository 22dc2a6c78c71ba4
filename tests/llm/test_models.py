"""Toxicity, search and sharding: held-out accuracy, brute force, laws; the pipeline on a small table."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldgrid.llm import neardup, search, sharding, toxicity

from .test_duplicates import groups


def labelled(n, seed=0):
    r = random.Random(seed)
    calm = [f"word{i}" for i in range(300)]
    rude = ["blorf", "snark", "grumm"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(calm) for _ in range(r.randrange(20, 80))]
        bad = r.random() < 0.25
        if bad:
            w.insert(r.randrange(len(w)), r.choice(rude) + r.choice(["", "ing", "ed"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out_accuracy(spark):
    docs, labels = labelled(1500)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = toxicity.report(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_never_reads_held_out_labels_and_odd_input(spark, odd):
    docs, labels = labelled(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels] + [(None, 1, 1), (7, 1, None), (10**9, 1, 1)]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.report(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert a == b
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.report(odd, none).collect()
    assert Counter(r.doc_id for r in rows) == Counter(x.doc_id for x in odd.collect()) and {r.score for r in rows} == {0.5}
    assert toxicity.report(odd.limit(0), none).count() == 0


def best(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = set()
    for q, x in ok:
        if q % 50 == 0:
            found = sorted((-int(x @ y), j) for j, y in ok if j != q and len(y) == len(x))[:k]
            out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize(("shard", "limit"), [(8192, 1 << 30), (37, 0)])
def test_search_against_brute_force(spark, monkeypatch, shard, limit):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "QUERIES", 3 if limit == 0 else 1024)
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(0, 0.2, (420, 8)))]
    rows[50] = (50, [1.0] + [0.0] * 7)
    rows[100] = (100, [0.0] * 8)
    rows[150] = (150, [-1.0] * 8)
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2100, [0.1] * 3), (2101, [0.2] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    got = {(x.query_id, x["rank"], x.vec_id, x.score) for x in search.report(df).collect()}
    assert got == best(rows)
    assert search.report(df.limit(0)).count() == 0


def test_sharding_laws(spark, documents, odd):
    rows = sharding.shard_documents(documents).collect()
    docs = {d.doc_id: d for d in documents.collect()}
    by = defaultdict(list)
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24)) and len(rows) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    rows = sharding.shard_documents(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in odd.collect())
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_shards_match_the_mixture(spark):
    df = spark.range(6000).select("id", F.expr("CASE WHEN id % 6 < 3 THEN 'a' WHEN id % 6 < 5 THEN 'b' END").alias("source"))
    out = sharding.interleave(df, "id", "source", 10).groupBy("shard", "source").count().collect()
    share = {"a": 300, "b": 200, None: 100}
    assert len(out) == 30 and all(abs(r["count"] - share[r.source]) <= 1 for r in out)


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(400, 3)
    item = " ".join(f"bench{i}" for i in range(20))
    docs += [(1000, docs[1][1]), (1001, docs[1][1] + " x"), (1002, f"start {item} end"), (1003, "key token = abcdef123456 end of it"), (1004, ""), (1005, None), (1006, "only")]
    docs.append((1006, "only"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    frames = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now
        if name != "packing":
            assert now.columns == frames["documents"].columns
    texts = {name: {r.doc_id: r.text for r in df.collect()} for name, df in kept.items() if name != "packing"}
    toxic = {i for i, _, t in labels if t}
    gone = {i for i, _ in docs} - set(texts["toxicity"])
    assert len(gone ^ toxic) <= 0.04 * len(docs)
    want = {k for k, v in groups(texts["toxicity"]).items() if v[2]}
    assert set(texts["near_duplicates"]) == want and kept["near_duplicates"].count() == len(want)
    assert set(texts["near_duplicates"]) - set(texts["decontamination"]) == {1002}
    assert texts["secrets"][1003] == "key [secret] end of it"
    assert {r.doc_id: r.n_chars for r in kept["secrets"].collect()}[1003] == len("key [secret] end of it")
    assert set(texts["secrets"]) == set(texts["decontamination"]) == {r.doc_id for r in kept["packing"].collect()}
    final = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    by_stage = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in kept["packing"].collect()}
    assert {x[0] for x in final} == {x[0] for x in by_stage}


def test_pipeline_without_labels_and_documents_without_words_keep_all(spark, tmp_path, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none.write.parquet(f"{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, odd, f"{tmp_path}/a").count() == odd.count()
    docs = [(i, "bad words") for i in range(60)] + [(100, None), (101, " "), (None, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    spark.createDataFrame([(i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, d, f"{tmp_path}/b").collect()} == {100, 101, None}


def test_whole_pipeline_with_an_empty_labels_table(spark, tmp_path):
    spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))


def test_toxicity_bound_holds_for_rows(spark):
    docs, labels = labelled(60)
    seen = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(docs, "doc_id long, text string")
    copies = spark.createDataFrame(docs + [docs[7]] * 200, "doc_id long, text string").repartition(3)
    a, b = toxicity.train(once, seen), toxicity.train(copies, seen)
    assert (a.rows, a.bias) == (b.rows, b.bias) == (60, a.bias)
    texts = spark.createDataFrame(docs + [(7, f"other text {i}") for i in range(200)], "doc_id long, text string")
    assert toxicity.train(texts, seen, sample=50).rows == 50


def test_near_duplicate_stage_and_operator_with_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d = ([f"{x}{i}" for i in range(200)] for x in "abcd")
    near = lambda w, k: " ".join([*w[:k], "new", *w[k + 1 :]])
    rows = [(None, near(a, 5)), (None, near(a, 9)), (None, near(a, 9)), (None, None), (None, " ")]
    rows += [(1, near(b, 5)), (None, near(b, 50)), (2, near(b, 100))]
    rows += [(3, near(c, 5)), (3, near(c, 9)), (3, near(c, 9)), (3, near(d, 5)), (4, near(d, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = Counter((r.doc_id, (r.text or " ")[0]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert left == Counter([(None, "a"), (None, " "), (None, " "), (1, "b"), (3, "c"), (3, "d")])
    got = neardup.near_duplicates(docs).collect()
    assert sum(r.kept for r in got if r.doc_id is None and r.component_id is None and r.n_shingles) == 1
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and len(got) == len(rows)
    linked = spark.createDataFrame([(1, " ".join(b)), (None, " ".join(["x"] * 3 + b[3:])), (2, " ".join(["x"] * 3 + b[3:190] + ["y"] * 10))], "doc_id long, text string")
    assert Counter(r.component_id for r in neardup.near_duplicates(linked).collect()) == Counter([1, 1, 1])
