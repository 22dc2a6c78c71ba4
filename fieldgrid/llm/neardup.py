"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct ``SHINGLE``-word runs.  The sketch has ``COORDINATES`` bins.  In round ``i`` every
element is hashed to one bin and leaves there the round and a random fraction; a bin keeps the least it has seen.  After
as many rounds as there are bins, round ``i`` is bound to bin ``i``, so every bin is filled whatever the set's size,
and the share of equal bins of two sets is concentrated around their similarity like that of independent samples.
Rounds stop once a set's bins are full: later ones cannot change them.

Documents with equal sets are one class.  Classes that agree in all rows of a band share a bucket:

1. Each bucket compares its classes with one hub, the class whose buckets hold most; the work is linear in the
   bucket, whatever its size.
2. Where a bucket still holds more than one component, its pairs of different components are compared, in blocks, by
   a longer sketch of one bit a coordinate, and those that may be similar enough are verified.  There is no limit on
   partners or candidates.

Every link is confirmed on the full sets.  At the threshold a pair shares no band with a probability of 2e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import cut
from .textkernel import Words, _span_hash, mix, text_slices, words

SHINGLE = 5
BANDS, ROWS = 26, 5
COORDINATES = BANDS * ROWS
PERCENT = 85
FINE = 2048  # coordinates, one bit each, by which pairs of one bucket are compared before they are verified
EDGES = 250_000  # of the component search, for each task
BLOCK = 1024  # classes of a bucket compared at once
WANTED = 2_000_000  # rows of four numbers that go to every task instead of all texts to them

_SEED = np.uint64(0x2545F4914F6CDD1D)
_OTHER = np.uint64(0x8CB92BA72F3D8DD7)
_LOW = np.uint64(0xFFFFFFFF)


def _rounds(n: int) -> np.ndarray:
    return mix(_SEED + np.arange(n, dtype=np.uint64))


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in ascending order, and where each text's begin.

    A text with fewer words than a shingle has all its words as its only element; one without words has none.
    """
    count = np.diff(w.first)
    at, h = w.sequences(SHINGLE)
    doc = np.searchsorted(w.first, at, side="right") - 1
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    h = np.concatenate([h, _span_hash(w.code, w.first[short], w.first[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def sketches(elements: np.ndarray, first: np.ndarray, bins: int = COORDINATES) -> np.ndarray:
    """Sets x bins; a set without elements keeps empty (all-ones) bins."""
    sets = len(first) - 1
    out = np.full(sets * bins, np.uint64(2**64 - 1))
    doc = np.repeat(np.arange(sets), np.diff(first))
    i = 0
    while i < 2 * bins and len(elements):
        several = min(max(1, 4096 // len(elements)), 2 * bins - i)  # rounds at once where few elements are left
        rounds = np.arange(i, i + several)[:, None]
        h = mix(elements[None, :] ^ _rounds(2 * bins)[i : i + several, None])
        place = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        place = np.where(rounds < bins, place, rounds - bins)
        np.minimum.at(out, (doc * bins + place).ravel(), ((rounds.astype(np.uint64) << np.uint64(32)) | (h & _LOW)).ravel())
        i += several
        going = ~(out.reshape(sets, bins) != np.uint64(2**64 - 1)).all(axis=1)[doc]
        if not going.all():
            elements, doc = elements[going], doc[going]
    return out.reshape(sets, bins)


def fine_sketches(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sets x ``FINE / 8`` bytes: one bit of each of ``FINE`` coordinates."""
    return np.packbits((mix(sketches(elements, first, FINE)) & np.uint64(1)).astype(np.uint8), axis=1)


def least_equal_bits(percent: int) -> int:
    """A pair of that similarity has fewer equal bits with a probability of 2e-8 (5.5 standard deviations)."""
    p = (1 + percent / 100) / 2
    return math.floor(FINE * p - 5.5 * math.sqrt(FINE * p * (1 - p)))


def _signatures(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: set sizes, 128-bit set identities and band values."""
    for _, _, data, offsets in text_slices(texts):
        elements, first = shingle_sets(words(data, offsets, lower=True))
        size = np.diff(first)
        sums = np.zeros((2, len(elements) + 1), np.uint64)
        np.cumsum(mix(elements ^ _SEED), out=sums[0, 1:])
        np.cumsum(mix(elements ^ _OTHER), out=sums[1, 1:])
        identity = (sums[:, first[1:]] - sums[:, first[:-1]]).T
        s = sketches(elements, first)
        band = np.zeros((len(size), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(size), np.uint64(b))
            for r in range(ROWS):
                h = mix(h * np.uint64(31) + s[:, b * ROWS + r])
            band[:, b] = h
        yield size, identity, band


def signatures(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, _text, n, node, other, bands``: ``node`` and ``other`` identify the set, ``_text`` the row's text."""
    schema = pa.schema([("key", pa.int64()), ("_text", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for size, identity, band in _signatures(batch.column(1)):
                k = len(size)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), batch.column(2).slice(at, k), pa.array(size), pa.array(identity[:, 0].astype(np.uint64).view(np.int64)), pa.array(np.ascontiguousarray(identity[:, 1]).view(np.int64)), bands],
                    schema=schema,
                )
                at += k

    return documents.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text)).mapInArrow(
        task, f"{key} long, _text long, n long, node long, other long, bands array<long>"
    )


def full_sets(documents: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``node, elements`` of the wanted sets, one row each, computed from whole texts.

    ``wanted`` has ``_key, _text, node, half``: key, which may be null, and hash of the text of a row that has the set,
    and the first half of the set's identity.
    ``documents`` has ``_key`` and the text.  Up to ``WANTED`` wanted rows are broadcast, so texts stay where they are;
    more are joined by shuffle.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], 0
            for _, _, data, offsets in text_slices(batch.column(2)):
                elements, first = shingle_sets(words(data, offsets, lower=True))
                raw = elements.tobytes()
                sums = np.zeros(len(elements) + 1, np.uint64)
                np.cumsum(mix(elements ^ _SEED), out=sums[1:])
                identity = (sums[first[1:]] - sums[first[:-1]]).view(np.int64).tolist()
                edges = first.tolist()
                out += [(identity[i], raw[8 * edges[i] : 8 * edges[i + 1]]) for i in range(len(edges) - 1)]
                at += len(edges) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["node", "half", "own", "elements"])

    wanted = broadcast_if_small(wanted, WANTED)
    known = documents.where("_key IS NOT NULL").join(wanted.where("_key IS NOT NULL").withColumnRenamed("_text", "_h"), "_key")
    known = known.where(F.xxhash64(text) == F.col("_h")).select("node", "half", text)
    nameless = documents.where("_key IS NULL").select(text, F.xxhash64(text).alias("_text")).dropDuplicates(["_text"])
    nameless = nameless.join(wanted.where("_key IS NULL").drop("_key"), "_text").select("node", "half", text)
    rows = known.unionByName(nameless).mapInArrow(task, "node long, half long, own long, elements binary")
    return rows.where("half = own").dropDuplicates(["node"]).select("node", "elements")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes with ``100 * intersection >= percent * union`` on their full sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(task, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node reachable, for nodes that have edges ``a, b``.

    Alternates between linking each node's larger neighbours, then its smaller ones, to the least of them, until
    nothing changes; every round is stored.  Stars of any size stay one aggregate and one join.
    """

    def toward_least(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        back = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        near = both.union(back) if larger else both.where("v < u").union(back.where("v < u"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.join(least, "u")
        moved = moved.where("v > u") if larger else moved
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out if larger else out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    now, before = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        parts = max(1, -(-state[0] // EDGES))  # few edges need few tasks, and leave few files behind each round
        large = toward_least(now, True).where("a != b").coalesce(parts)
        now = cut(toward_least(large, False).where("a != b").distinct().coalesce(parts))
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _candidates_by_hub(buckets: DataFrame) -> DataFrame:
    """Each class of a bucket with the bucket's most central class; ``buckets`` has ``bucket, node, weight``."""
    hub = buckets.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    pairs = buckets.join(hub, "bucket").where("node != hub")
    return pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()


def _candidates_across(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and whose sizes and sketches allow the similarity.

    ``buckets`` has ``bucket, node, root, n, bands``, ``sets`` the elements of every node.  A bucket beyond ``BLOCK`` classes
    is compared block by block.
    """
    least = least_equal_bits(percent)
    size = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    open_ones = cut(buckets.join(size.where("_low != _high"), "bucket"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1).slice(k, 64)]
                bits = fine_sketches(np.concatenate(own), np.cumsum([0, *map(len, own)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 64), pa.array([x.tobytes() for x in bits], pa.binary())], names=["node", "sketch"])

    needed = sets.join(open_ones.select("node").distinct(), "node", "left_semi").select("node", "elements")
    open_ones = open_ones.join(needed.mapInArrow(sketch, "node long, sketch binary"), "node")
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    placed = open_ones.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("_own", o).alias("i"), F.greatest("_own", o).alias("j"))
    )
    meeting = placed.withColumn("_meet", F.explode(others)).select("bucket", "_meet.i", "_meet.j", "_own", "node", "root", "n", "bands", "sketch")

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, bucket = int(frame["i"].iloc[0]), int(frame["j"].iloc[0]), int(frame["bucket"].iloc[0])
        left, right = frame[frame["_own"] == i], frame[frame["_own"] == j]
        s = np.frombuffer(b"".join(right["sketch"]), np.uint64).reshape(-1, FINE // 64)
        n, root, node = right["n"].to_numpy(), right["root"].to_numpy(), right["node"].to_numpy()
        bands = np.array(right["bands"].tolist(), np.int64).reshape(-1, BANDS)
        a, b = [], []
        for x, bands_x, size_x, root_x, node_x in zip(left["sketch"], left["bands"], left["n"].to_numpy(), left["root"].to_numpy(), left["node"].to_numpy()):
            fit = np.flatnonzero((root != root_x) & (100 * np.minimum(n, size_x) >= percent * np.maximum(n, size_x)))
            if i == j:
                fit = fit[node[fit] < node_x]
            if len(fit):
                fit = fit[FINE - np.bitwise_count(s[fit] ^ np.frombuffer(x, np.uint64)).sum(axis=1, dtype=np.int64) >= least]
                same = bands[fit] == np.asarray(bands_x)
                fit = fit[bands[fit, same.argmax(axis=1)] == bucket]  # once, in the first band that a pair shares
                a += [node_x] * len(fit)
                b += node[fit].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return meeting.groupBy("bucket", "i", "j").applyInPandas(task, "a long, b long")


def equal_sets(rows: DataFrame, key: str) -> DataFrame:
    """One row for each set, by both halves of its identity: ``node, other, half, n, bands`` and the row it stands for."""
    lead = F.min(F.struct(F.col(key).isNull().alias("_null"), F.col(key).alias("_key"), "_text")).alias("_lead")
    return rows.where("n > 0").groupBy("node", "other").agg(lead, *[F.first(c).alias(c) for c in ("half", "n", "bands")])


def told_apart(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """Rows whose ``node`` names several sets get one that depends on both halves; ``half`` stays what it was."""
    marked = rows.join(twice.withColumn("_twice", F.lit(True)), "node", "left")
    return marked.withColumn("node", F.when(F.col("_twice"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("_twice")


def classes_and_links(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``key, _text, n, node`` of every row, and ``node, component, lead`` of every class of equal sets.

    ``component`` is the least key in the component, ``lead`` the key and hash of the text of the row it stands for; the
    key is null if no row of the component has one.  ``percent`` is the least similarity in hundredths; bands and the
    sketch test are laid out for 80 and more.
    """
    if percent < 80:
        raise ValueError("bands are laid out for a similarity of 0.8 or more")
    rows = cut(signatures(documents, key, text).withColumn("half", F.col("node")))
    while True:
        classes = cut(equal_sets(rows, key))
        twice = classes.groupBy("node").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("node")
        if twice.isEmpty():
            break
        rows = cut(told_apart(rows, twice))
    spread = classes.select("node", F.explode("bands").alias("bucket"))
    crowd = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = spread.join(crowd, "bucket")
    weight = shared.groupBy("node").agg(F.sum("_n").alias("weight"))
    buckets = cut(shared.select("bucket", "node").join(weight, "node"))

    texts = documents.select(F.col(key).cast("long").alias("_key"), F.col(text))
    sets = cut(full_sets(texts, text, classes.select("_lead._key", "_lead._text", "node", "half").join(weight.select("node"), "node", "left_semi")))
    links = cut(similar(_candidates_by_hub(buckets), sets, percent))
    roots = components(links)
    known = classes.select("node", "n", "bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    across = _candidates_across(buckets.select("bucket", "node").join(known, "node"), sets, percent)
    more = cut(similar(across, sets, percent))
    roots = components(links.unionByName(more))
    named = classes.select("node", "_lead").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("_lead").alias("lead"))
    return rows.select(key, "_text", "n", "node"), named.join(least, "root").select("node", F.col("lead._key").alias("component"), "lead")


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``key, _text, n, component, chosen`` of every row; ``_text`` is the hash of its text.

    ``chosen`` holds for the rows, alike in key and text, of which one is kept for the component.  A row without
    words is linked with nothing and always chosen.
    """
    rows, links = classes_and_links(documents, key, text, percent)
    joined = rows.join(links, "node", "left")
    first = F.col(key).eqNullSafe(F.col("lead._key")) & (F.col("_text") == F.col("lead._text"))
    return joined.select(
        key,
        "_text",
        "n",
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col(key)).alias("component"),
        ((F.col("n") == 0) | first).alias("chosen"),
    )


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row of ``documents``.

    Texts are compared whole, A-Z as a-z.  A null or empty text, or one without words, is linked with nothing.  Rows
    with one key and one set are the same document.  A row without a key has a component like any other if the
    component has a row that has a key; else its component is null, and of such a component one row is kept.
    """
    rows = judged(documents, key, text, percent)
    keyed = F.col(key).isNotNull() | F.col("component").isNotNull() | (F.col("n") == 0)
    plain = rows.where(keyed).select(
        key, F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col(key).eqNullSafe(F.col("component")).alias("kept")
    )
    count = rows.where(~keyed).groupBy("_text", "n", "chosen").agg(F.count(F.lit(1)).alias("_c"))
    alike = count.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_c")))
    none = F.lit(None).cast("long")
    nameless = alike.select(none.alias(key), F.col("n").alias("n_shingles"), none.alias("component_id"), (F.col("chosen") & (F.col("_i") == 1)).alias("kept"))
    return plain.unionByName(nameless)
