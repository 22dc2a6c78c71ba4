"""What must not depend on how much there is of something."""

import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldgrid.llm import decontamination, neardup, packing, secrets, substrings, textkernel, toxicity
from fieldgrid.llm.common import vocabulary


def test_labels_without_a_document_take_no_room_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} other words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(1000, 6000)], "doc_id long, toxic int")
    assert [toxicity.train(docs, labels, sample=n).rows for n in (200, 30)] == [40, 30]


def test_one_id_documents_fill_a_sequence(spark):
    docs = spark.createDataFrame([(i, "") for i in range(5000)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    sizes = sorted(r["count"] for r in pieces.groupBy("sequence_id").count().collect())
    assert sizes == [5000 - 2 * 2048, 2048, 2048]


def test_sets_with_one_half_in_common_stay_apart(spark):
    rows = spark.createDataFrame([(1, 10, 3, 7, 100, [1]), (2, 20, 3, 7, 200, [2]), (3, 30, 3, 7, 100, [1]), (4, 40, 3, 8, 100, [1])], "doc_id long, _text long, n long, node long, other long, bands array<long>")
    rows = rows.withColumn("half", F.col("node"))
    classes = neardup.equal_sets(rows, "doc_id")
    assert classes.count() == 3
    twice = classes.groupBy("node").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("node")
    apart = neardup.told_apart(rows, twice)
    node = {r.doc_id: (r.node, r.half) for r in apart.collect()}
    assert node[1] == node[3] and len({node[1][0], node[2][0], node[4][0]}) == 3 and node[4] == (8, 8) and node[1][1] == 7
    assert neardup.equal_sets(apart, "doc_id").groupBy("node").count().where("count > 1").isEmpty()


def test_every_block_of_a_benchmark_counts_on_the_table_itself(spark, monkeypatch):
    counted = []
    whole = decontamination.shingle_counts
    monkeypatch.setattr(decontamination, "shingle_counts", lambda df, *rest: (counted.append(df), whole(df, *rest))[1])
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n{i}") for i in range(9)], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{i}", f"b c d e f g h i j k l m n{i}") for i in range(4)], "item_id string, text string")
    found = decontamination.find_items(docs, items, block_bytes=30)
    assert sum(r.found.n_hit > 0 for r in found.collect()) == 4 and len(counted) > 2
    assert all("MapInArrow" not in df._jdf.queryExecution().toString() for df in counted)


def test_scores_of_long_strings_take_time_in_proportion(spark):
    ratios = {a + b: ((i * 31 + j * 17) % 41) - 20 for i, a in enumerate(secrets.ALPHABET) for j, b in enumerate(secrets.ALPHABET)}
    took = []
    for n in (60_000, 240_000):
        token = (secrets.ALPHABET * (n // len(secrets.ALPHABET) + 1))[:n]
        df = spark.createDataFrame([(token,)], "text string").cache()
        df.count()
        spans = df.select(secrets.model_spans(F.col("text"), ratios, -(10**9)).alias("s"), F.lit(n).alias("n"))
        spans.collect()
        start = time.perf_counter()
        (row,) = spans.collect()
        took.append(time.perf_counter() - start)
        assert [tuple(s) for s in row.s] == [(0, 3, n)]
    assert took[1] < 12 * took[0] + 2


def test_pair_scores_are_sums_over_neighbours(spark):
    ratios = {a + b: (hash((i, j)) % 2001) - 1000 for i, a in enumerate(secrets.ALPHABET) for j, b in enumerate(secrets.ALPHABET)}
    for token in ("abcdefghijklmnop", "Zz09+/_=-AbCdEfGh1234"):
        total = sum(ratios[token[i : i + 2]] for i in range(len(token) - 1))
        for least, want in ((total, 1), (total + 1, 0)):
            (row,) = spark.createDataFrame([(token,)], "t string").select(secrets.model_spans(F.col("t"), ratios, least).alias("s")).collect()
            assert len(row.s) == want


@pytest.mark.parametrize("bad", ["", "x"])
def test_training_on_short_tokens(spark, bad):
    assert secrets.train(spark.createDataFrame([(bad, True), (bad, False)], "token string, random boolean")) == {}


def test_features_of_many_texts_take_little_memory():
    r = random.Random(1)
    texts = pa.array([" ".join(f"w{r.randrange(10**5)}" for _ in range(300)) for _ in range(1500)])

    def found(most):
        parts = []
        for row, _, data, offsets in textkernel.text_slices(texts, most):
            codes, doc = toxicity._distinct(*toxicity.features(textkernel.words(data, offsets, textkernel.SIGNS, lower=True)))
            parts.append(np.stack([codes, doc + row]))
        return np.concatenate(parts, axis=1)

    assert (found(1 << 30) == found(textkernel.SLICE_BYTES)).all()
    tracemalloc.start()
    try:
        for _, _, data, offsets in textkernel.text_slices(texts):
            toxicity._distinct(*toxicity.features(textkernel.words(data, offsets, textkernel.SIGNS, lower=True)))
        assert tracemalloc.get_traced_memory()[1] < 60e6  # 120 million by slices of 2 MB
    finally:
        tracemalloc.stop()


def test_hashes_of_spans_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(5)
    texts = [" ".join("x" * r.randrange(1, 9) + str(r.randrange(50)) for _ in range(r.randrange(90))) for _ in range(30)] + ["", "y" * 500, None]
    ((_, _, data, offsets),) = textkernel.text_slices(pa.array(texts, pa.string()))

    def found():
        w = textkernel.words(data, offsets)
        at, h = w.sequences(substrings.WINDOW)
        assert (substrings._owners(w) == np.searchsorted(w.first, at, side="right") - 1).all()
        some = at[::7]
        return [w.code, at, h, substrings._second(w, at), substrings._minimisers(w, at, np.uint64(3)), substrings._second(w, some), substrings._minimisers(w, some, np.uint64(3))]

    whole = found()
    w = textkernel.words(data, offsets)
    assert (whole[0] == textkernel._span_hash(textkernel._BYTE_CODE[data], w.start, w.end)).all()
    assert (whole[2] == textkernel._span_hash(w.code, whole[1], whole[1] + substrings.WINDOW)).all()
    monkeypatch.setattr(textkernel, "BLOCK", 23)
    assert all((a == b).all() for a, b in zip(whole, found()))


def test_windows_of_a_slice_take_little_room():
    r = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in r.integers(0, 10**6, substrings.SLICE_BYTES // 8))
    texts = pa.array([text[i : i + 4000] for i in range(0, len(text), 4000)], pa.string())
    tracemalloc.start()
    try:
        for _, _, data, offsets in textkernel.text_slices(texts, substrings.SLICE_BYTES):
            w = textkernel.words(data, offsets)
            at, _ = w.sequences(substrings.WINDOW)
            substrings._second(w, at)
            substrings._minimisers(w, at, np.uint64(3))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * substrings.SLICE_BYTES  # bytes kept for each byte of text


def test_minimisers_are_counted_in_one_pass_over_the_texts(spark, monkeypatch):
    stored = []
    whole = substrings.cut
    monkeypatch.setattr(substrings, "cut", lambda df: (stored.append(df), whole(df))[1])
    common = " ".join(f"c{i}" for i in range(24))
    own = lambda i: " ".join(f"v{i}x{j}" for j in range(30))
    rows = [f"{own(i)} {common} {i}" for i in range(400)]
    monkeypatch.setattr(substrings, "SLICE_BYTES", 4000)
    found = substrings.hot_minimisers(spark.createDataFrame([(x,) for x in rows], "text string").coalesce(1), 8)
    seen, total = Counter(), 0
    for _, _, data, offsets in textkernel.text_slices(pa.array(rows), 4000):
        w = textkernel.words(data, offsets)
        at, h = w.sequences(substrings.WINDOW)
        at = at[np.sort(np.unique(h, return_index=True)[1])]
        counts = Counter(substrings._minimisers(w, at, substrings._SEED_1).tolist())
        seen.update({k: n for k, n in counts.items() if n > max(8, len(at) / 160)})
        total += len(at)
    assert found.tolist() == sorted(k for k, n in seen.items() if n > total / 32) and len(found)
    assert len(stored) == 1 and stored[0].columns == ["key", "n"]
