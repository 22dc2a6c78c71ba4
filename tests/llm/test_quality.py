import numpy as np
import pyarrow as pa

from fieldgrid.llm import quality
from fieldgrid.llm.common import table


def texts(rng, n, good):
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "light", "winter"]
    out = []
    for _ in range(n):
        w = rng.choice(words, 60).tolist()
        out.append(" ".join(w).capitalize() + "." if good else "!! ".join(x.upper() for x in w) if rng.random() < 0.5 else " | ".join(w))
    return out


def sample(rows):
    return quality.Sample(list(quality.sparse(pa.array(rows, pa.string()))))


def test_features_are_counted_over_whole_texts(monkeypatch):
    rows = [None, "", "a", "Ab 1!\n", "word " * 5000 + "END", "ünï côdé"]
    whole = list(quality.sparse(pa.array(rows)))
    monkeypatch.setattr(quality, "STRETCH", 7)
    monkeypatch.setattr(quality, "TEXTS", 2)
    for (a, x), (b, y) in zip(whole, quality.sparse(pa.array(rows))):
        assert a.tolist() == b.tolist() and np.allclose(x, y)
    one = dict(zip(whole[3][0].tolist(), whole[3][1].tolist()))
    kind = {c: int(quality._CLASS[ord(c)]) for c in "Ab 1!\n"}
    for first, second in zip("Ab 1!", "b 1!\n"):
        assert abs(one[kind[first] * quality.CLASSES + kind[second]] - np.sqrt(1 / 5)) < 1e-6


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 4000)
        n = rng.random(8000) < share
        u = np.where(n, rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000))
        assert abs(quality.estimated_prior(p, u) - share) < 0.06
    assert quality.estimated_prior(np.zeros(0), np.zeros(3)) == 0.5


def test_steps_follow_the_written_risk(monkeypatch):
    """The slope of one step against differences of the risk as it is written down."""
    rng = np.random.default_rng(4)
    p, u = sample(texts(rng, 30, True)), sample(texts(rng, 20, True) + texts(rng, 20, False))
    draw = np.random.default_rng(13)
    i, j = draw.integers(0, len(p), quality.BATCH_POSITIVES), draw.integers(0, len(u), quality.BATCH_UNLABELLED)
    x = np.zeros(quality.SIZE + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def risk(w, prior):
        gp, gu = p.margins(i, w[:-1], w[-1]), u.margins(j, w[:-1], w[-1])
        return prior * sigmoid(-gp).mean() + max(0.0, sigmoid(gu).mean() - prior * sigmoid(gp).mean())

    weights, bias = quality.fit(p, u, 0.5, steps=1)
    moved = np.append(weights, bias)
    for at in np.flatnonzero(moved)[:: max(1, np.count_nonzero(moved) // 40)]:  # the first step goes against the slope's sign
        e = np.zeros_like(x)
        e[at] = 1e-5
        slope = (risk(x + e, 0.5) - risk(x - e, 0.5)) / 2e-5
        assert abs(slope) < 1e-9 or np.sign(slope) == -np.sign(moved[at])


def test_learns_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(7)
    good, rest = texts(rng, 300, True), texts(rng, 500, True) + texts(rng, 200, False)
    m = quality.learn(sample(good), sample(rest))
    assert abs(m.prior - 500 / 700) < 0.1
    for is_good in (True, False):
        s = sample(texts(rng, 100, is_good))
        assert ((s.margins(np.arange(100), m.weights, m.bias) >= 0) == is_good).mean() > 0.97


def test_without_labels_every_score_is_one_half(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.report(odd, labels).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert quality.report(odd.limit(0), labels).collect() == []


def test_only_trusted_rows_that_meet_a_document_are_learnt_from(spark):
    rng = np.random.default_rng(8)
    rows = [(i, t, "clash") for i, t in enumerate(texts(rng, 120, True) + texts(rng, 60, False))]
    docs = spark.createDataFrame([*rows, *rows[:5], (None, "no id", "clash"), (None, None, None)], "doc_id long, text string, score string")
    labels = [(i, 1) for i in range(100)] + [(i, 0) for i in range(90, 180)] + [(i, 1) for i in range(10_000, 12_000)] + [(None, 1), (3, None)]
    m = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), positives=50, unlabelled=70)
    assert (m.positives, m.unlabelled) == (50, 70)
    m = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert (m.positives, m.unlabelled) == (90, 182)  # labelled both ways is not trusted
    got = quality.score(docs, m)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == docs.count()


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    root = sf_dir.replace("sf0.001", "sf0.01")
    labels = table(spark, root, "labels")
    got = quality.report(table(spark, root, "documents"), labels)
    assert got.count() == table(spark, root, "documents").count()
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    above = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert right > 0.95 and above > 0.98
