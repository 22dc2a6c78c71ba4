"""Near duplicates, repeated windows and benchmark windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldgrid.llm import decontamination, neardup, substrings, textkernel

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SIGNED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \t\nñ你.-😀\x1c\x85", max_size=25), max_size=6))
def test_words_of_slices(texts):
    for separators, pattern in ((textkernel.SPACES, SPACED), (textkernel.SIGNS, SIGNED)):
        got = []
        for lo, hi, data, offsets in textkernel.text_slices(pa.array(texts, pa.string()), 8):
            w = textkernel.words(data, offsets, separators, lower=True)
            raw = w.data.tobytes()
            got += [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
        assert got == [pattern.findall(t.translate(LOWER)) for t in texts]


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(docs, percent=85):
    sets = {k: shingles(v) for k, v in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def variants(seed, base_words, copies, changes):
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(base_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(changes)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def near_texts():
    out = variants(1, 120, 90, 7) + variants(2, 12, 40, 3) + variants(3, 400, 60, 14) + variants(4, 60, 60, 4)
    out += ["", None, "  ", "one", "One", "a b c d", "a b c d", "A b c d e", "a b c d f"] + variants(5, 200, 1, 1) * 30
    random.Random(9).shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_against_all_pairs(spark, near_texts, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    df = spark.createDataFrame(list(near_texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == groups(near_texts)


def test_near_duplicates_of_test_documents(documents):
    docs = {d.doc_id: d.text for d in documents.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents).collect()}
    assert got == groups(docs)


def test_near_duplicates_odd_input(odd):
    rows = neardup.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in odd.collect())
    by = {r.doc_id: r for r in rows}
    assert (by[6].component_id, by[6].kept, by[0].n_shingles, by[0].kept) == (5, False, 0, True)
    assert (by[None].component_id, by[None].kept) == (None, True)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(0)
    pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = [np.sort(pool[:1000]), np.sort(pool[150:1150]), np.sort(pool[:1]), np.sort(pool[:7])]
    s = neardup.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 850 / 1150) < 0.15


def expected_windows(docs):
    seen, out = {}, {}
    for k in sorted(docs, key=lambda x: (x is not None, x)):
        w = SPACED.findall(docs[k] or "")
        cut = [False] * len(w)
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (k, i)) != (k, i):
                cut[i : i + 20] = [True] * 20
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out[k] = (len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("slice_bytes", "bucket_bytes"), [(8 << 20, 6 << 20), (3000, 4000)])
def test_windows_against_brute_force(spark, documents, monkeypatch, slice_bytes, bucket_bytes):
    monkeypatch.setattr(substrings, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket_bytes)
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(55))
    word = lambda: f"v{r.randrange(40)}"
    extra = [(" ".join(word() for _ in range(r.randrange(40))) + "  " + passage + "\n" + " ".join(word() for _ in range(r.randrange(40)))) for _ in range(60)]
    extra += ["same " * 90, "same " * 25, None, "", passage]
    docs = {d.doc_id: d.text for d in documents.collect()} | {10_000 - i: t for i, t in enumerate(extra)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df).collect()}
    assert got == expected_windows(docs)


def test_windows_odd_input(spark, odd):
    rows = substrings.report(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in odd.collect())
    by = {r.doc_id: r for r in rows}
    assert (by[5].n_removed, by[6].n_removed, by[0].n_words, by[11 - 1].n_removed > 0) == (0, 26, 0, True)
    assert substrings.report(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "q " * 21), (1, "q " * 21), (1, "q " * 21)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.report(twice).collect()) == [(0, 20), (1, 21), (1, 21)]


def test_windows_of_rows_that_share_an_id_or_have_none(spark):
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    twice = own("a", 30)
    rows = [(None, twice + " " + own("b", 40) + " " + twice), (None, own("c", 90)), (None, own("d", 3)), (None, None), (None, "")]
    rows += [(None, own("e", 25))] * 3 + [(4, own("f", 30) + " " + own("f", 30)), (4, own("g", 70)), (4, own("h", 2)), (4, None), (5, own("c", 90))]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    want = [(None, 100, 30), (None, 90, 0), (None, 3, 0), (None, 0, 0), (None, 0, 0), (None, 25, 0), (None, 25, 25), (None, 25, 25)]
    assert got == Counter([*want, (4, 60, 30), (4, 70, 0), (4, 2, 0), (4, 0, 0), (5, 90, 90)])


def expected_hits(docs, items):
    found = {}
    for item, text in items:
        w = SIGNED.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            found.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for k, text in docs.items():
        w, hit, names = SIGNED.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    names |= found[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        joined = ",".join(sorted(names))
        out[k] = (len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 700])
def test_benchmark_windows_against_brute_force(spark, documents, sf_dir, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "one"), (901, "Two-Words"), (902, None), (903, "..."), (904, "a b c d e f g h i j k l m n a b c"), (905, items[0][1]), (906, "a b c")]
    docs = {d.doc_id: d.text for d in documents.collect()}
    docs |= {5000: "x one y two words ONE", 5001: "a b c d e f g h i j k l m n", 5002: "a b c " * 40, 5003: None, 5004: items[1][1] + " tail " + items[2][1]}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_items(df.withColumnRenamed("doc_id", "n_hit"), bench, block_bytes=block_bytes, into="found")
    got = {r.n_hit: (r.found.n_words, r.found.n_hit, r.found["items"]) for r in found.collect()}
    want = expected_hits(docs, items)
    assert {k: (a, b, len(c), hashlib.sha256(",".join(c).encode()).hexdigest()) for k, (a, b, c) in got.items()} == {k: v[:4] for k, v in want.items()}
    if block_bytes > 700:
        rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(df, bench).collect()}
        assert rows == want


def test_benchmark_odd_input(spark, odd):
    bench = spark.createDataFrame([(None, "one"), (1, "very long very"), (1, "very long very")], "item_id long, text string")
    rows = decontamination.report(odd, bench).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in odd.collect())
    assert {r.n_items for r in rows if r.doc_id == 10} == {1} and decontamination.report(odd.limit(0), bench).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.report(odd, bench.limit(0)).collect())


def test_texts_stay_where_they_are_while_few_are_wanted(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i % 40 if i % 9 else None, " ".join(f"w{(i % 50 + j) % 60}" for j in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "_key long, text string").repartition(3)
    wanted = docs.select("_key", F.xxhash64("text").alias("_text"), F.xxhash64("text").alias("node"), F.lit(0).cast("long").alias("half"))
    whole = neardup.full_sets(docs, "text", wanted)
    assert "BroadcastHashJoin" in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(neardup, "WANTED", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apart = neardup.full_sets(docs, "text", wanted)
        assert "SortMergeJoin" in apart._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, apart.collect())) == sorted(map(repr, whole.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
