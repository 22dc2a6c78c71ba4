"""Words and word sequences of whole Arrow string columns as numpy arrays.

A batch of texts is one byte buffer.  Words are found by byte class, hashed from prefix sums of a polynomial over the
bytes (modulo 2**64, each byte first replaced by a random 64-bit number), and sequences of words are hashed in the same
way over the word hashes.  No step loops over rows, words or characters in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10  # texts are handled in slices of about this many bytes; a longer text is a slice of its own
BLOCK = 128 << 10  # codes that are hashed at a time, so that room beside the result does not grow with a slice

_RNG = np.random.default_rng(20_241)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_SIGN = np.zeros(256, bool)  # everything in ASCII that is neither a digit nor a lower-case letter
_IS_SIGN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

SPACES, SIGNS = _IS_SPACE, _IS_SIGN

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), _BASE if which == "up" else _BASE_INV, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finish that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power("up", len(codes)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", len(codes) + 1)[start] + (end - start).astype(np.uint64))


def span_blocks(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end index of consecutive spans, both ends ascending, that cover about ``BLOCK`` codes together."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        yield i, j
        i = j


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, of: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Hashes of spans whose both ends ascend, a block at a time; ``of`` makes codes of the values in a block."""
    out = np.empty(len(start), np.uint64)
    for i, j in span_blocks(start, end):
        lo = start[i]
        block = codes[lo : end[j - 1]]
        out[i:j] = _span_hash(of(block) if of else block, start[i:j] - lo, end[i:j] - lo)
    return out


@dataclass
class Words:
    """Words of some texts.  ``first[d]:first[d + 1]`` are the words of text ``d``; offsets are bytes of ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def span_codes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of the texts."""
        return _span_hash(_BYTE_CODE[self.data], start, end)

    def sequences(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of ``size`` words inside one text."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = self.doc()
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        return at, span_hashes(self.code, at, at + size)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows; a null text has no bytes."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Maximal runs of bytes that are no separators; with ``lower``, A-Z count as a-z.  Bytes above 0x7F are letters."""
    data = _LOWER[data] if lower else data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    full = np.flatnonzero(np.diff(offsets))  # texts that have bytes
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    start, end = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    return Words(data, start, end, span_hashes(data, start, end, _BYTE_CODE.take), np.searchsorted(start, offsets))
