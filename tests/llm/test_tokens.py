"""Packing and record files: ids against the library's own encoding, whole round trips, limits."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldgrid.llm import packing, records, tokens
from fieldgrid.llm.common import shared_folder, vocabulary
from fieldgrid.llm.queries import QUERIES
from fieldgrid.llm.tokens import PieceEncoder

from .conftest import ODD_TEXTS

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def direct(name, texts, end):
    t = Tokenizer.from_file(vocabulary(name))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4").tobytes() for x in texts]


@pytest.mark.parametrize(("name", "kept"), [(WORD, False), (BYTE, True)])
def test_pieces_give_the_ids_of_whole_texts(name, kept, documents):
    r = random.Random(5)
    signs = ["word", "Über", "ñ", " ", "  ", "\n", "\n\n", ".", ",", "..", "'s", "12", "é", " ", "\t", "x.y", "a,b", "<|", "ß"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    texts += [t for t in ODD_TEXTS if t] + [x.text for x in documents.collect()]
    coder = PieceEncoder(vocabulary(name), kept)
    end = np.array([9], "<u4").tobytes()
    assert [x + end for x in coder.encode(texts)] == direct(name, texts, 9)


@pytest.mark.parametrize(("name", "kept"), [(WORD, False), (BYTE, True)])
def test_words_reach_the_library_once_whatever_signs_and_blanks_are_beside_them(name, kept, monkeypatch):
    words = [f"{a}{b}" for a in ("ver", "Stra", "mé", "KO") for b in ("den", "ßen", "tal", "ÜR")]
    beside = ["{}!!", "({})", "{}.\n\n", "  {}", "{}12", "\t{}'s", '"{}"', "{};"]
    texts = [" ".join(b.format(w) for w in words) for b in beside] * 3
    want = direct(name, texts, 9)
    coder, end = PieceEncoder(vocabulary(name), kept), np.array([9], "<u4").tobytes()
    calls = Counter()
    encoded, limit = coder._encoded, len(words) * 2 + 60
    monkeypatch.setattr(coder, "_whole", lambda text: pytest.fail("a plain text was encoded whole"))
    monkeypatch.setattr(coder, "_encoded", lambda pieces: calls.update(n=len(pieces)) or encoded(pieces))
    assert [x + end for x in coder.encode(texts)] == want
    assert calls["n"] <= limit  # words with and without a blank, and signs


@pytest.mark.parametrize(("name", "kept"), [(WORD, False), (BYTE, True)])
def test_small_cache_and_slices_give_the_same_ids(name, kept, monkeypatch):
    r = random.Random(11)
    signs = ["one", "Tŵo", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\u00a0", "\u3000", "\x1c", "\x85", ".", "'", "'ll", "7", "\u0301", "h\u0331", "\u0338", "=", "中", "×", "\0", "<|endoftext|>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(0, 12))) for _ in range(6000)] + ["x\t ", "x\t\n", "x\n\t", None]
    monkeypatch.setattr(tokens, "SLICE", 500)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 4000)
    coder, end = PieceEncoder(vocabulary(name), kept), np.array([9], "<u4").tobytes()
    assert [x + end for x in coder.encode(texts)] == direct(name, texts, 9)
    assert coder.pieces.nbytes < 20_000


def check_pieces(rows, ids, limit=2048):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= limit
    for doc, found in pieces.items():
        assert Counter((s, n, c, t) for s, n, c, t in found).keys()
        at = 0
        for start, n, crc, total in sorted(set(found)):
            assert (start, total) == (at, len(ids[doc]) // 4) and crc == zlib.crc32(ids[doc][4 * start : 4 * (start + n)])
            at += n
        assert at == len(ids[doc]) // 4
    return sequences


def test_packing_holds_every_id_once_with_little_padding(documents):
    docs = documents.collect()
    ids = dict(zip([d.doc_id for d in docs], direct(WORD, [d.text for d in docs], 1)))
    rows = packing.pack_documents(documents.repartition(5), vocabulary(WORD)).collect()
    sequences = check_pieces(rows, ids)
    assert len(sequences) == -(-sum(len(x) // 4 for x in ids.values()) // 2048)


def test_packing_odd_input(spark, odd):
    rows = packing.pack_documents(odd, vocabulary(WORD)).collect()
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in direct(WORD, [d.text for d in odd.collect()], 1))
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(d.doc_id for d in odd.collect())
    assert packing.pack_documents(odd.limit(0), vocabulary(WORD)).count() == 0


def ids_in(sequence, piece):
    return sequence.ids[4 * piece.offset : 4 * (piece.offset + piece.length)]


def test_sequences_hold_the_ids_that_the_pieces_speak_of(odd):
    docs = odd.collect()
    want = Counter((d.doc_id, x) for d, x in zip(docs, direct(WORD, [d.text for d in docs], 1)))
    sequences = packing.pack_sequences(odd, vocabulary(WORD), pad_id=7).collect()
    assert any(s.n_tokens < 2048 for s in sequences)
    parts = defaultdict(dict)
    for s in sequences:
        size = s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else 2048
        assert len(s.ids) == 4 * size and s.ids[4 * s.n_tokens :] == np.full(size - s.n_tokens, 7, "<u4").tobytes()
        assert (s.n_tokens, s.n_segments) == (sum(p.length for p in s.pieces), len(s.pieces))
        assert s.n_loss == s.n_tokens - sum(p.start == 0 for p in s.pieces)
        for p in s.pieces:
            parts[p.doc_id, p.doc_tokens].setdefault(p.start, []).append(ids_in(s, p))
    assert sum(map(sum, ((len(y) // 4 for y in x) for v in parts.values() for x in v.values()))) == sum(len(x) // 4 * n for (_, x), n in want.items())
    for (doc, ids), n in want.items():  # rows that share id and length are short here, and not cut
        pieces = parts[doc, len(ids) // 4]
        if sum(k for (d, x), k in want.items() if (d, len(x)) == (doc, len(ids))) > 1:
            assert pieces[0].count(ids) == n
        else:
            assert b"".join(x for start in sorted(pieces) for x in pieces[start]) == ids


@pytest.mark.parametrize(("rows", "size"), [(64, 64), (65, 2048), (2047, 2048)])
def test_a_sequence_is_filled_up_unless_its_length_is_a_power_of_two(spark, rows, size):
    docs = spark.createDataFrame([(i, None) for i in range(rows)], "doc_id long, text string").repartition(2)
    (s,) = packing.pack_sequences(docs, vocabulary(WORD)).collect()
    assert (s.n_tokens, s.n_segments, s.n_loss) == (rows, rows, 0)
    assert np.frombuffer(s.ids, "<u4").tolist() == [1] * rows + [0] * (size - rows)


def test_one_long_document_and_other_limits(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000), (2, "other words"), (None, "")], "doc_id long, text string").coalesce(1)
    (long,) = direct(WORD, ["word " * 50_000], 1)
    rows = packing.pack_sequences(docs, vocabulary(WORD), limits=(1000, 2, 999)).collect()
    assert all(s.n_tokens <= 1000 and s.n_segments <= 2 and s.n_loss <= 999 for s in rows)
    found = sorted((p.start, ids_in(s, p)) for s in rows for p in s.pieces if p.doc_id == 1)
    assert b"".join(x for _, x in found) == long
    assert packing.pack_sequences(docs.limit(0), vocabulary(WORD)).isEmpty()


def test_the_query_reads_its_rows_off_whole_sequences(odd, tmp_path, spark, monkeypatch):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    made, whole = [], packing.pack_sequences
    monkeypatch.setattr(packing, "pack_sequences", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    rows = QUERIES["op3_packing"](spark, str(tmp_path)).collect()
    (sequences,) = made
    want = Counter((p.doc_id, p.start, p.length, zlib.crc32(ids_in(s, p)), p.doc_tokens, s.sequence_id, p.offset) for s in sequences.collect() for p in s.pieces)
    assert Counter(map(tuple, rows)) == want


def test_limits_on_segments_and_loss(spark):
    r = random.Random(1)
    rows = [(i, n := r.randrange(1, 90), r.randrange(0, n + 1)) for i in range(2000)] + [(-1, 500, 10), (-2, None, None)]
    df = spark.createDataFrame(rows, "id long, tokens long, loss long").repartition(2)
    total = defaultdict(lambda: [0, 0, 0])
    out = packing.pack_examples(df, (256, 8, 100)).collect()
    assert Counter(x.id for x in out) == Counter(x[0] for x in rows)
    for x in out:
        t = total[x.sequence_id]
        t[0] += x.tokens or 0
        t[1] += 1
        t[2] += x.loss or 0
    big = [x.sequence_id for x in out if x.id == -1]
    assert total.pop(big[0]) == [500, 1, 10]
    assert all(a <= 256 and b <= 8 and c <= 100 for a, b, c in total.values())
    least = max(sum(x[1] or 0 for x in rows[:-2]) / 256, sum(x[2] or 0 for x in rows[:-2]) / 100, len(rows) / 8)
    assert len(total) <= 1.2 * least + 2


def test_record_files_round_trip(spark, documents):
    docs = sorted(documents.collect(), key=lambda d: d.doc_id)
    at = 0
    got = {r.doc_id: r for r in records.round_trip(documents, vocabulary(BYTE)).collect()}
    for d, ids in zip(docs, direct(BYTE, [d.text for d in docs], 2)):
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_records_odd_input_shards_index_and_damage(spark, odd):
    folder = f"{shared_folder(spark)}/test-records"
    manifest = records.write_records(odd, folder, vocabulary(BYTE), 2, shard_bytes=100_000)
    rows = records.read_records(spark, folder, manifest).collect()
    assert len(rows) == odd.count() and len(manifest) > 1
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in sorted(rows, key=lambda r: (r.start, r.n_tokens))]
    assert ids == sorted(ids)
    first = f"{folder}/shard-{manifest[0][0]:06d}.rec"
    all_of_it = list(records.records(first))
    assert [records.record_at(first, i) for i in range(len(all_of_it))] == all_of_it
    path = first.removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(records.records(first))
    assert records.round_trip(odd.limit(0), vocabulary(BYTE)).count() == 0


def test_wide_ids_and_plain_payloads():
    ids = np.array([1, 70_000], "<u4").tobytes()
    assert records.ids_of(records.payload_of(None, ids)) == (None, ids)
    assert records.ids_of(records.payload_of(7, b"")) == (7, b"")
