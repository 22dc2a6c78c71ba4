"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least of the hashes of its ``MER``-word runs.
Consecutive windows that share their minimiser overlap, so they travel as one packed piece of text to the bucket that
the minimiser names; equal windows always meet there.  A bucket sorts its windows and every one but the first is
repeated.

* A task first compares the windows of its own slice of texts.  Those that start earlier in the slice settle the
  others at once, so a passage found in many documents is sent once per slice.
* A minimiser with a large share of all windows is split by a second minimiser, also a function of the window alone.
* Pieces of a slice that go to one bucket form one compressed row.
* Hashes are made a block at a time and only windows whose first hash is not alone are compared further, so a worker
  keeps little beside the windows of one slice or bucket.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textkernel import Words, _span_hash, mix, span_blocks, span_hashes, text_slices, words

WINDOW, MER = 20, 4
SLICE_BYTES = 8 << 20  # texts whose windows are compared and sent together
BUCKET_BYTES = 6 << 20  # text for each bucket; pieces overlap, so about three times as much arrives
NULL_ID = -(2**63)  # a null doc_id comes before all others

_SEED_1, _SEED_2, _OTHER = np.uint64(0x51ED270B27B4F3CF), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_HEAD = struct.Struct("<II")


def _second(w: Words, at: np.ndarray) -> np.ndarray:
    """A second, independent hash of the windows."""
    return span_hashes(w.code, at, at + WINDOW, lambda code: mix(code ^ _OTHER))


def _owners(w: Words) -> np.ndarray:
    """Text of each window, in the order of ``Words.sequences``."""
    return np.repeat(np.arange(len(w.first) - 1), np.maximum(np.diff(w.first) - WINDOW + 1, 0))


def _minimisers(w: Words, at: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Least ordered hash of the word runs inside each window; ``at`` ascends."""
    out = np.empty(len(at), np.uint64)
    for i, j in span_blocks(at, at + WINDOW):
        code, place = w.code[at[i] : at[j - 1] + WINDOW], at[i:j] - at[i]
        runs = mix(_span_hash(code, np.arange(len(code) - MER + 1), np.arange(MER, len(code) + 1)) ^ seed)
        n, step = WINDOW - MER + 1, 1
        while 2 * step <= n:  # doubling: the least of 2, 4, 8 .. neighbours
            runs = np.minimum(runs[:-step], runs[step:])
            step *= 2
        out[i:j] = np.minimum(runs[place], runs[place + n - step])
    return out


def _buckets(w: Words, at: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Key that decides where a window goes, and its bucket."""
    key = _minimisers(w, at, _SEED_1)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        split = hot[place] == key
        key = np.where(split, mix(key + _minimisers(w, at, _SEED_2)), key)
    return key, (mix(key) % np.uint64(buckets)).astype(np.int64)


def _alike(h: np.ndarray) -> np.ndarray:
    """Ascending indices of the hashes that occur more than once."""
    order = np.argsort(h)
    same = np.diff(h[order]) == 0
    return np.sort(order[np.append(same, False) | np.append(False, same)]) if len(h) else order


def _ranks(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Rank of each row's document in the order of id and tag, shifted to leave room for a place in it."""
    order = np.lexsort((tag, doc))
    new = (np.diff(doc[order]) != 0) | (np.diff(tag[order]) != 0)
    rank = np.zeros(len(doc), np.int64)
    rank[order[1:]] = np.cumsum(new)
    return rank << 32


def _repeated(h1: np.ndarray, h2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for windows that also start earlier; ``at`` is a document's rank plus the place in it."""
    order = np.lexsort((at, h2, h1))
    new = np.append(True, np.diff(h1[order]) != 0) if len(order) else np.zeros(0, bool)
    new[1:] |= np.diff(h2[order]) != 0
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = at[order] != at[head]
    return out


def _runs(doc: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive windows of one document that agree in ``same``."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        cut |= x[1:] != x[:-1]
    edge = np.flatnonzero(cut)
    return np.append(0, edge + 1), np.append(edge, len(at) - 1)


def hot_minimisers(texts: DataFrame, buckets: int) -> np.ndarray:
    """Minimisers with more windows than a quarter of a mean bucket, counted over all texts.

    Tasks report those above a twentieth of a bucket's share of their own windows, and under no key the number of all;
    the list is bounded by the number of buckets.  It balances buckets and changes no result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), SLICE_BYTES):
                w = words(data, offsets)
                at, h = w.sequences(WINDOW)
                if not len(at):
                    continue
                _, one = np.unique(h, return_index=True)  # windows that are sent
                key, n = np.unique(_minimisers(w, at[np.sort(one)], _SEED_1), return_counts=True)
                big = n > max(8, len(one) / (20 * buckets))
                keys = pa.array(np.append(key[big], np.uint64(0)).view(np.int64), mask=np.append(np.zeros(big.sum(), bool), True))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(n[big], len(one)))], names=["key", "n"])

    seen = cut(texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))  # texts are read once
    total = seen.where("key IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = seen.where(F.col("key").isNotNull() & (F.col("n") > total / (4 * buckets))).select("key").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _pack(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, pieces: list[memoryview], settled: tuple[np.ndarray, ...]) -> bytes:
    sizes = np.array([len(p) for p in pieces], "<u4")
    head = _HEAD.pack(len(pieces), len(settled[0]))
    return b"".join([head, docs.astype("<i8").tobytes(), tags.astype("<i8").tobytes(), starts.astype("<u4").tobytes(), sizes.tobytes(), settled[0].astype("<i8").tobytes(), settled[1].astype("<i8").tobytes(), settled[2].astype("<u4").tobytes(), settled[3].astype("<u4").tobytes(), *pieces])


def _unpack(blob: bytes):
    n, m = _HEAD.unpack_from(blob)
    at, out = _HEAD.size, []
    for size, kind in ((n, "<i8"), (n, "<i8"), (n, "<u4"), (n, "<u4"), (m, "<i8"), (m, "<i8"), (m, "<u4"), (m, "<u4")):
        out.append(np.frombuffer(blob, kind, size, at).astype(np.int64))
        at += size * int(kind[-1])
    return out, np.frombuffer(blob, np.uint8, offset=at)


def repeated_ranges(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, _tag, start, stop``: word ranges covered by windows that also start earlier.  Ranges may overlap.

    ``documents`` has ``key, text, _tag``: rows equal in key and tag are one document; the key comes first in the order.
    """
    total = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    hot = hot_minimisers(documents.select(text), buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            tags = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                w = words(data, offsets)
                at, h1 = w.sequences(WINDOW)
                if not len(at):
                    continue
                row, settled = _owners(w), np.zeros(len(at), bool)
                own = lambda at, row: (ids[lo + row], tags[lo + row], at - w.first[row])
                some = _alike(h1)
                here = (_ranks(ids[lo:hi], tags[lo:hi]) - w.first[:-1])[row[some]] + at[some]
                settled[some] = _repeated(h1[some], _second(w, at[some]), here)
                del h1, some, here
                first, last = _runs(row[settled], at[settled])
                first, last = np.flatnonzero(settled)[first], np.flatnonzero(settled)[last]
                done = (*own(at[first], row[first]), at[last] - w.first[row[last]] + WINDOW)
                at, row = at[~settled], row[~settled]
                mini, bucket = _buckets(w, at, hot, buckets)
                a, b = _runs(row, at, mini)
                order = np.argsort(bucket[a], kind="stable")
                a, b = a[order], b[order]
                docs, mine, places = own(at[a], row[a])
                low, high = w.start[at[a]], w.end[at[b] + WINDOW - 1]
                edges = np.append(np.flatnonzero(np.diff(bucket[a], prepend=-1)), len(a))
                none = tuple(np.zeros(0, np.int64) for _ in range(4))
                raw, out = memoryview(data), []
                for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    pieces = [raw[x:y] for x, y in zip(low[i:j].tolist(), high[i:j].tolist())]
                    out.append((int(bucket[a[i]]), pack.compress(_pack(docs[i:j], mine[i:j], places[i:j], pieces, done if k == 0 else none))))
                if not out:
                    out.append((0, pack.compress(_pack(none[0], none[0], none[0], [], done))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "blob"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, size = zstandard.ZstdDecompressor(), 0
        parts, owners = ([], [], [], []), []  # of windows: two hashes, piece, place; of pieces: document, tag

        def ranges(doc, tag, start, stop) -> pa.RecordBatch:
            known = pa.array(doc, pa.int64(), mask=doc == NULL_ID)
            return pa.RecordBatch.from_arrays([known, pa.array(tag, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["key", "tag", "start", "stop"])

        for batch in batches:
            for blob in batch.column(1):
                (docs, tags, starts, sizes, *done), data = _unpack(unpack.decompress(blob.as_py()))
                if len(done[0]):
                    yield ranges(*done)
                if len(docs):
                    w = words(data, np.append(0, np.cumsum(sizes)))
                    at, h1 = w.sequences(WINDOW)
                    piece = _owners(w)
                    found = (h1, _second(w, at), (size + piece).astype(np.int32), (starts[piece] + at - w.first[piece]).astype(np.int32))
                    for one, x in zip(parts, found):
                        one.append(x)
                    owners.append((docs, tags))
                    size += len(docs)
        if owners:

            def whole(k: int) -> np.ndarray:
                out = np.concatenate(parts[k])
                parts[k].clear()
                return out

            h1 = whole(0)
            some = _alike(h1)
            h1, h2, piece, place = h1[some], *(whole(k)[some] for k in (1, 2, 3))
            doc, tag = (np.concatenate(x) for x in zip(*owners))
            at = _ranks(doc, tag)[piece] + place
            again = np.flatnonzero(_repeated(h1, h2, at))
            again = again[np.argsort(at[again])]
            doc, tag, place = doc[piece[again]], tag[piece[again]], place[again]
            a, b = _runs(doc, place, tag)
            yield ranges(doc[a], tag[a], place[a], place[b] + WINDOW)

    sent = documents.select(F.col(key).cast("long"), text, "_tag").mapInArrow(send, "bucket int, blob binary")
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(settle, f"{key} long, _tag long, start int, stop int")


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_removed, kept_text`` of every row: its words without those in repeated windows.

    Kept words are joined by one blank.  Rows equal in ``key`` and text are the same document, so none of them removes
    the other's words at the same place; other rows of a key are documents of their own, in the order of a hash of
    their texts.  Rows with a null key come before all others, each a document, its copies too.  A null, empty or short
    text has no window and loses nothing.  Other columns of ``documents`` are not read.
    """
    rows = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    count = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    nulls, repeats = count.agg(F.max(F.col(key).isNull()), F.max(F.col(key).isNotNull())).first()
    tag = F.xxhash64(text)
    if not repeats:  # the key alone tells all others apart
        tag = F.when(F.col(key).isNull(), tag).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_tag", tag)
    found = repeated_ranges(rows, key, text)
    ranges = found.groupBy(F.col(key).alias("_key"), F.col("_tag").alias("_own")).agg(F.collect_list(F.struct("start", "stop")).alias("_cut"))
    rows = rows.withColumn("_copy", F.lit(1).cast("long"))
    if nulls:  # copies of one text meet, and all but one of them are copies
        long = F.col(key).isNull() & (F.coalesce(F.octet_length(text), F.lit(0)) >= 2 * WINDOW - 1)
        met = rows.where(long).groupBy(key, "_tag", text).agg(F.count(F.lit(1)).alias("_n"))
        met = met.select(key, text, "_tag", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
        rows = rows.where(~long).unionByName(met)
    joined = rows.join(ranges, rows[key].eqNullSafe(ranges["_key"]) & (rows["_tag"] == ranges["_own"]), "left").select(key, text, "_cut.start", "_cut.stop", "_copy")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, stops, copy = batch.column(2), batch.column(3), batch.column(4).to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                w, raw = words(data, offsets), data.tobytes()
                n_words, removed, kept = [], [], []
                for d in range(lo, hi):
                    first, last = int(w.first[d - lo]), int(w.first[d - lo + 1])
                    keep = np.ones(last - first, bool)
                    if starts[d].is_valid:
                        edge = np.zeros(last - first + 1, np.int64)
                        np.add.at(edge, starts[d].values.to_numpy(), 1)
                        np.add.at(edge, stops[d].values.to_numpy(), -1)
                        keep = np.cumsum(edge[:-1]) == 0
                    if copy[d] > 1 and last - first >= WINDOW:
                        keep[:] = False
                    low, high = w.start[first:last][keep].tolist(), w.end[first:last][keep].tolist()
                    n_words.append(last - first)
                    removed.append(last - first - len(low))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(low, high)]).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(finish, f"{key} long, n_words long, n_removed long, kept_text string")


def report(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``documents``."""
    return keep_first(documents).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
