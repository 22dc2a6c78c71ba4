"""Token ids of whole texts with the ``tokenizers`` library, each distinct piece of text encoded once per worker.

Both kinds of vocabulary used here first split a text at white space and where letters, digits and signs meet, and no
token crosses such a place, so the ids of a text are the ids of its pieces in order.  Pieces are cut and told apart in
numpy and Arrow over whole slices of texts; only pieces that are new to the worker reach Python and the library.  A text
in which a cut might be wrong is encoded whole instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkernel import text_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_BYTES = 24 << 20  # of pieces and their ids that a worker keeps; beyond it those not met for longest go
SLICE = 2 << 20  # bytes of texts that are cut at once

_plain_word = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
# Byte-level vocabularies write each byte as one letter: visible Latin-1 as itself, the others from U+0100 on, in order.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_BLANK = _BYTE_LETTERS[0x20]
_doubtful = re.compile(r"[\t-\r ][^\S\t-\r ]|[^\S\t-\r ][\t-\r ]")  # ASCII white space beside other white space
_loaded: dict[tuple[str, bool], "PieceEncoder"] = {}

# Classes of bytes.  Latin-1 letters are 0xC3 and a second byte; bytes of all other characters have no class.
_SPACE, _LETTER, _DIGIT, _SIGN = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_ODD_SPACE = np.zeros(256, bool)  # first bytes of other white space, and controls that some take for it
_ODD_SPACE[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which pieces begin, and the classes of all bytes.

    A run of white space is one piece but for its last character, which stands alone or, if it is a blank, before the
    word that follows.  A text's last run is one piece.  An apostrophe stays with the letter after it.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_SECOND[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    left, right = kind[:-1], kind[1:]
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:])  # the last of its run, with something after it
    last = last[~begins[last + 1]]
    begins[1:-1] |= (left != right) & ((right == _SPACE) | ((left > _SPACE) & (right > _SPACE) & ((data[:-1] != 0x27) | (right != _LETTER))))
    begins[last] = True
    begins[last[data[last] != 0x20] + 1] = True
    return np.flatnonzero(begins[:-1]), kind


def _text(data: np.ndarray, offsets: np.ndarray, row: int) -> str:
    return data[offsets[row] : offsets[row + 1]].tobytes().decode()


class PieceEncoder:
    """``blanks_kept``: a blank before a word belongs to the word's token (byte-level kinds); else blanks vanish.

    Ids come as little-endian unsigned 32-bit integers in ``bytes``.
    """

    def __init__(self, path: str, blanks_kept: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks_kept = blanks_kept
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.clock = 0
        self._forget()

    def _forget(self) -> None:
        """The cache: pieces, when each was last met, and ``ids[first[p] : first[p + 1]]`` of each."""
        self.pieces = pa.array([], pa.binary())
        self.met, self.first, self.ids = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, pieces: list[str]) -> list[Sequence[int]]:
        """Ids of each piece.

        Words of letters go to the library's model alone; other pieces go through the whole tokenizer, many in one
        call, told apart by the vocabulary's end mark, which no piece contains.
        """
        model, fold = self.tokenizer.model.tokenize, not self.blanks_kept
        words: dict[str, list[int]] = {}
        out: list = []
        rest = []
        for n, p in enumerate(pieces):
            if _plain_word(p):  # one token run of the vocabulary, without the library's splitting
                if fold:
                    p = p.lower().lstrip(" ")
                if not p.isascii():
                    p = p.encode().decode("latin-1").translate(_BYTE_LETTERS)
                elif p[0] == " ":
                    p = _BLANK + p[1:]
                if p not in words:
                    words[p] = [t.id for t in model(p)]
                out.append(words[p])
            else:
                rest.append(n)
                out.append(None)
        parts = [rest[k : k + 200] for k in range(0, len(rest), 200)]
        joined = [self.mark.join([pieces[n] for n in part]) for part in parts]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            begins = np.append(0, ends[:-1] + 1)
            for n, b, e in zip(part, begins.tolist(), ends.tolist()):
                out[n] = ids[b:e]
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces are in the cache; new ones are encoded and added."""
        met = pc.index_in(self.pieces, value_set=pieces).fill_null(-1).to_numpy()  # the table made by it is that of the few
        known = np.flatnonzero(met >= 0)
        place = np.full(len(pieces), -1)
        place[met[known]] = known
        if len(known) < len(pieces):
            fresh = place < 0
            new = pieces.filter(pa.array(fresh))
            place[fresh] = len(self.pieces) + np.arange(len(new))
            found = self._encoded(new.cast(pa.string()).to_pylist())
            count = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), "<u4", int(count.sum())))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(count))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
        self.met[place] = self.clock
        return place

    def _trim(self) -> None:
        if self.pieces.nbytes + self.ids.nbytes + self.first.nbytes + self.met.nbytes <= CACHE_BYTES:
            return
        keep = np.flatnonzero(self.met > np.median(self.met))
        pieces, met, ids, count = self.pieces.take(pa.array(keep)), self.met[keep], _gather(self.ids, self.first, keep), np.diff(self.first)[keep]
        self._forget()
        if pieces.nbytes + 16 * len(keep) + ids.nbytes <= CACHE_BYTES // 2:
            self.pieces, self.met, self.ids, self.first = pieces, met, ids, np.append(0, np.cumsum(count))

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        n = len(offsets) - 1
        if not len(data):
            return [b""] * n
        self.clock += 1
        self._trim()
        starts, kind = _cuts(data, offsets)
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        whole = set((np.searchsorted(offsets, marks, side="right") - 1).tolist())
        if self.blanks_kept:
            space, other = kind == _SPACE, _ODD_SPACE[data]
            near = np.flatnonzero((other[1:] & space[:-1]) | (other[:-1] & space[1:]))
            after = np.flatnonzero((data[:-1] >= 0x80) & space[1:])
            after = after[other[after - 1] | other[after - 2]]
            rows = np.unique(np.searchsorted(offsets, np.append(near, after), side="right") - 1)
            whole.update(r for r in rows.tolist() if _doubtful.search(_text(data, offsets, r)))
        ends = np.append(starts, len(data)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        piece = self._places(coded.dictionary)[coded.indices.to_numpy()]
        ids = _gather(self.ids, self.first, piece)
        at = np.append(0, np.cumsum(self.first[piece + 1] - self.first[piece]))[np.searchsorted(starts, offsets)]
        flat = ids.tobytes()
        at = (4 * at).tolist()
        return [self._whole(_text(data, offsets, r)) if r in whole else flat[at[r] : at[r + 1]] for r in range(n)]

    def encode(self, texts: Sequence[str | None] | pa.Array) -> Iterator[bytes]:
        """Ids of each text in order; a null text has none."""
        texts = texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.large_string())
        for _, _, data, offsets in text_slices(texts, SLICE):
            yield from self._slice(data, offsets)


def _gather(values: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``values[first[r] : first[r + 1]]`` of all ``rows``, one after the other."""
    begin, count = first[rows], first[rows + 1] - first[rows]
    end = np.cumsum(count)
    return values[np.repeat(begin - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0)]


def encoder(path: str, blanks_kept: bool) -> PieceEncoder:
    """The worker's own encoder for a vocabulary file."""
    key = (path, blanks_kept)
    if key not in _loaded:
        _loaded[key] = PieceEncoder(path, blanks_kept)
    return _loaded[key]
