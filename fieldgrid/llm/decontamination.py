"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window of ``window`` consecutive item words (a shorter item is one window) is contained in a document when its words
occur there in order.  As a set of word shingles it must be contained whole, so of its shingles, ordered by how rare
they are in the corpus, one is a sufficient prefix: the rarest.  Documents are probed for these prefix shingles only.
The shingle's place in the window bounds where the window can start and end in the document, and the candidate is then
compared word by word.

The benchmark is handled in blocks of at most ``block_bytes`` of text, each an index that is broadcast for one pass
over the documents.  Documents never travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import SIGNS, Words, text_slices, words

SHINGLE = 4
BLOCK_BYTES = 4 << 20  # of item text; an index takes some twenty times that


@dataclass
class Windows:
    """Distinct windows of one size: word codes, hashes in ascending order, items (``items[first[w]:first[w + 1]]``)."""

    size: int
    codes: np.ndarray
    hashes: np.ndarray
    items: np.ndarray
    first: np.ndarray

    @property
    def shingle(self) -> int:
        return min(SHINGLE, self.size)

    def shingles(self) -> np.ndarray:
        """Hash of every shingle, windows x places."""
        n, k = len(self.codes), self.size - self.shingle + 1
        if not n:
            return np.zeros((0, k), np.uint64)
        flat = Words(np.zeros(0, np.uint8), None, None, self.codes.ravel(), np.arange(n + 1) * self.size)
        return flat.sequences(self.shingle)[1].reshape(n, k)


@dataclass
class Index:
    groups: list[Windows]
    names: list[str]  # of items
    prefix: list[tuple[np.ndarray, np.ndarray]]  # by group: hashes of prefix shingles in order, their places


def block_windows(ids: list, texts: pa.Array, window: int) -> tuple[list[Windows], list[str]]:
    """All windows of some items."""
    found: dict[int, list] = {}
    for lo, _, data, offsets in text_slices(texts):
        w = words(data, offsets, SIGNS, lower=True)
        count = np.diff(w.first)
        for size in np.unique(np.minimum(count, window)):
            if size == 0:
                continue
            at, h = w.sequences(int(size))
            own = np.searchsorted(w.first, at, side="right") - 1
            keep = np.minimum(count[own], window) == size
            at, h, own = at[keep], h[keep], own[keep]
            found.setdefault(int(size), []).append((w.code[at[:, None] + np.arange(size)], h, own + lo))
    groups = []
    for size, parts in sorted(found.items()):
        codes, h, own = (np.concatenate(x) for x in zip(*parts))
        pair = np.unique(np.stack([h, own.astype(np.uint64)], 1), axis=0)
        hashes, one = np.unique(h, return_index=True)
        first = np.searchsorted(pair[:, 0], np.append(hashes, np.uint64(0)))
        first[-1] = len(pair)
        groups.append(Windows(size, codes[one], hashes, pair[:, 1].astype(np.int64), first))
    return groups, ["null" if i is None else str(i) for i in ids]


def _sorted_place(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each ``x`` in ``sorted_values``, -1 where it is not there."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def shingle_counts(documents: DataFrame, text: str, groups: list[Windows]) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in the whole corpus; shingles that never occur are left out."""
    sizes = sorted({g.shingle for g in groups})
    known = {s: np.unique(np.concatenate([g.shingles().ravel() for g in groups if g.shingle == s])) for s in sizes}
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(k), np.int64) for s, k in shared.value.items()}
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                w = words(data, offsets, SIGNS, lower=True)
                for s, k in shared.value.items():
                    at = _sorted_place(k, w.sequences(s)[1])
                    total[s] += np.bincount(at[at >= 0], minlength=len(k))
        for s, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at])], names=["size", "at", "n"])

    rows = documents.select(text).mapInArrow(count, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    out = {(r["size"], int(known[r["size"]][r["at"]])): r["n"] for r in rows.collect()}  # no more than the block holds
    shared.unpersist()
    return out


def block_index(groups: list[Windows], names: list[str], counts: dict[tuple[int, int], int]) -> Index:
    """Each window's rarest shingle; windows with a shingle that the corpus lacks cannot occur and have none."""
    prefix = []
    for g in groups:
        s = g.shingles()
        flat, back = np.unique(s.ravel(), return_inverse=True)
        n = np.array([counts.get((g.shingle, int(x)), 0) for x in flat], np.int64)[back].reshape(s.shape)
        place = np.argmin(n, axis=1)
        row = np.flatnonzero(n.min(axis=1) > 0)
        pairs = np.unique(np.stack([s[row, place[row]], place[row].astype(np.uint64)], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
        prefix.append((pairs[:, 0], pairs[:, 1].astype(np.int64)))
    return Index(groups, names, prefix)


def _occurrences(w: Words, g: Windows, prefix: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First word and window number of every occurrence of the group's windows."""
    tokens, places = prefix
    at, h = w.sequences(g.shingle)
    heads = np.unique(tokens)
    near = at[_sorted_place(heads, h) >= 0]
    own = np.searchsorted(w.first, near, side="right") - 1
    h = h[_sorted_place(heads, h) >= 0]
    begin, end = np.searchsorted(tokens, h), np.searchsorted(tokens, h, side="right")
    width = end - begin
    which = np.repeat(begin, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    start, own = np.repeat(near, width) - places[which], np.repeat(own, width)
    fits = (start >= w.first[own]) & (start + g.size <= w.first[own + 1])  # positional and length bounds
    start = np.unique(start[fits])
    if not len(start):
        return start, start
    codes = w.code[start[:, None] + np.arange(g.size)]
    all_starts, all_hashes = w.sequences(g.size)
    number = _sorted_place(g.hashes, all_hashes[np.searchsorted(all_starts, start)])
    same = (number >= 0) & (g.codes[number] == codes).all(axis=1)
    return start[same], number[same]


def _scan(texts: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For each text: number of words, covered words as a mask, names of the items with occurring windows."""
    for lo, hi, data, offsets in text_slices(texts):
        w = words(data, offsets, SIGNS, lower=True)
        cover = np.zeros(len(w.code) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for g, prefix in zip(index.groups, index.prefix):
            start, number = _occurrences(w, g, prefix)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + g.size, -1)
            own = np.searchsorted(w.first, start, side="right") - 1
            for d, n in np.unique(np.stack([own, number], 1), axis=0).tolist():
                items.setdefault(d, set()).update(index.names[i] for i in g.items[g.first[n] : g.first[n + 1]].tolist())
        hit = np.cumsum(cover[:-1]) > 0
        for d in range(hi - lo):
            yield w.first[d + 1] - w.first[d], hit[w.first[d] : w.first[d + 1]], sorted(items.get(d, ()))


_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit", pa.binary())])
_SPARK_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit", T.BinaryType()),
    ]
)


def find_items(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, into: str = "found", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add ``into``: ``n_words``, ``n_hit`` (words inside an occurring window), ``items`` (their ids as sorted strings).

    ``benchmark`` has ``item_id, text``.  Words are maximal runs of letters and digits after lower-casing A-Z; whole
    texts are read.  A null or empty text has no words and no hits; an item without words has no window; a null item id
    is named ``null``; repeated items and ids count once.  An input column named ``into`` is replaced.
    """
    benchmark = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    kept = [c for c in documents.columns if c != into]
    documents = source = documents.select(*kept)
    for b in range(blocks):
        rows = benchmark.where(block == b).orderBy("item_id", "text").collect()  # one block: bounded text
        groups, names = block_windows([r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string()), window)
        index = block_index(groups, names, shingle_counts(source, text, groups))  # of the table itself, with no probe below
        documents = _probe(documents, text, index, into, kept, last=b == blocks - 1)
    return documents


def _probe(documents: DataFrame, text: str, index: Index, into: str, kept: list[str], last: bool) -> DataFrame:
    """One pass: what the block finds joins what earlier blocks have found in the same row."""
    shared = documents.sparkSession.sparkContext.broadcast(index)
    place = kept.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(len(kept)).to_pylist() if batch.num_columns > len(kept) else [None] * batch.num_rows
            out = []
            for old, (n, hit, items) in zip(before, _scan(batch.column(place), shared.value)):
                if old is not None:
                    hit = hit | np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=n).astype(bool)
                    items = sorted({*items, *old["items"]})
                out.append({"n_words": int(n), "n_hit": int(hit.sum()), "items": items, "hit": None if last else np.packbits(hit).tobytes()})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, _TYPE)], names=[*kept, into])

    schema = T.StructType([*[documents.schema[c] for c in kept], T.StructField(into, _SPARK_TYPE)])
    return documents.mapInArrow(task, schema)


def contaminated(found: str = "found", share: int = 20) -> Column:
    """A document is contaminated when one word in ``share`` or more is hit."""
    return (F.col(f"{found}.n_hit") > 0) & (share * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``documents``."""
    found = find_items(documents.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
