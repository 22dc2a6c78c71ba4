"""Length-delimited binary record files of token ids, with an offset index beside each file.

A record is: payload length (unsigned 64-bit), masked checksum of those 8 bytes, payload, masked checksum of the
payload; all little-endian.  The checksum is CRC-32, masked as ``rotate right by 15, plus 0xA282EAD8`` so that a
checksum of data that holds checksums stays meaningful.  The payload is a header (document id, id count, flags) and
the ids as 16-bit or 32-bit integers, compressed by zstandard when the flag says so.  ``<file>.idx`` holds the
position of each record as unsigned 64-bit integers, so a reader can fetch records in any order.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder
from .tokens import encoder

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<qIB")  # document id, number of ids, flags
_NULL_ID, _WIDE, _PACKED = 1, 2, 4
BATCH = 1024


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc: int | None, ids: bytes, compressor=None) -> bytes:
    """``ids``: little-endian unsigned 32-bit.  Ids below 65,536 are stored in 16 bits."""
    wide = np.frombuffer(ids, "<u4")
    flags = _NULL_ID if doc is None else 0
    if len(wide) and wide.max() > 0xFFFF:
        flags, body = flags | _WIDE, ids
    else:
        body = wide.astype("<u2").tobytes()
    if compressor is not None:
        flags, body = flags | _PACKED, compressor.compress(body)
    return _HEAD.pack(doc or 0, len(wide), flags) + body


def ids_of(payload: bytes, decompressor=None) -> tuple[int | None, bytes]:
    doc, n, flags = _HEAD.unpack_from(payload)
    body = payload[_HEAD.size :]
    width = 4 if flags & _WIDE else 2
    if flags & _PACKED:
        body = decompressor.decompress(body, max_output_size=max(1, n * width))
    ids = np.frombuffer(body, f"<u{width}").astype("<u4").tobytes()
    if len(ids) != 4 * n:
        raise ValueError("record does not hold the ids it announces")
    return None if flags & _NULL_ID else doc, ids


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def read_exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("file ends inside a record")
    return data


def records(uri: str) -> Iterator[bytes]:
    """Payloads of a file in order, both checksums verified."""
    system, path = _files(uri)
    with system.open_input_stream(path, buffer_size=1 << 20) as f:
        while size := f.read(8):
            if len(size) != 8 or struct.unpack("<I", read_exactly(f, 4))[0] != masked(size):
                raise ValueError(f"damaged length in {uri}")
            payload = read_exactly(f, struct.unpack("<Q", size)[0])
            if struct.unpack("<I", read_exactly(f, 4))[0] != masked(payload):
                raise ValueError(f"damaged record in {uri}")
            yield payload


def record_at(uri: str, place: int) -> bytes:
    """One payload by its place in the file, through the index."""
    system, path = _files(uri)
    with system.open_input_file(path + ".idx") as f:
        f.seek(8 * place)
        at = struct.unpack("<Q", read_exactly(f, 8))[0]
    with system.open_input_file(path) as f:
        f.seek(at)
        size = read_exactly(f, 8)
        if struct.unpack("<I", read_exactly(f, 4))[0] != masked(size):
            raise ValueError(f"damaged length in {uri}")
        payload = read_exactly(f, struct.unpack("<Q", size)[0])
        if struct.unpack("<I", read_exactly(f, 4))[0] != masked(payload):
            raise ValueError(f"damaged record in {uri}")
        return payload


class _Shard:
    """Writes a file and its index under passing names; both get their names when complete, so a retry is harmless."""

    def __init__(self, folder: str, shard: int):
        self.system, base = _files(folder)
        self.path, self.mark = f"{base}/shard-{shard:06d}.rec", uuid.uuid4().hex
        self.out = self.system.open_output_stream(f"{self.path}.{self.mark}", buffer_size=1 << 20)
        self.shard, self.at, self.rows, self.tokens, self.index = shard, 0, 0, 0, []

    def add(self, payload: bytes, tokens: int) -> None:
        self.index.append(self.at)
        data = frame(payload)
        self.out.write(data)
        self.at, self.rows, self.tokens = self.at + len(data), self.rows + 1, self.tokens + tokens

    def close(self) -> tuple[int, int, int, int]:
        self.out.close()
        with self.system.open_output_stream(f"{self.path}.idx.{self.mark}") as f:
            f.write(np.array(self.index, "<u8").tobytes())
        self.system.move(f"{self.path}.idx.{self.mark}", f"{self.path}.idx")
        self.system.move(f"{self.path}.{self.mark}", self.path)
        return self.shard, self.rows, self.tokens, self.at


def write_records(documents: DataFrame, folder: str, vocabulary: str, end_id: int, shard_bytes: int = 32 << 20) -> list[tuple]:
    """Encode all rows and write them in ascending ``doc_id`` order (null first); returns one row per file.

    Rows are encoded where they are scanned; compressed ids travel once, to the shard that holds their range of ids.
    Range ends are approximate quantiles of ``doc_id``; only those and one row per file reach the driver.
    ``(shard, rows, tokens, bytes)`` is returned by shard.
    """
    spark = documents.sparkSession
    total = documents.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    bounds: list[int] = []
    if shards > 1:
        share = [k / shards for k in range(1, shards)]
        bounds = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, max(10_000, 20 * shards))).first()[0] or []
    system, base = _files(folder)
    system.create_dir(base, recursive=True)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, pack, edges = encoder(vocabulary, True), zstandard.ZstdCompressor(level=1), np.array(bounds, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                keys = batch.column(0).slice(k, BATCH).to_pylist()
                ids = [x + end for x in coder.encode(batch.column(1).slice(k, BATCH))]
                shard = [0 if d is None else int(np.searchsorted(edges, d, side="left")) for d in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([payload_of(d, x, pack) for d, x in zip(keys, ids)], pa.binary())],
                    schema=schema,
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for shard, n, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if now is None or now.shard != shard:
                    if now is not None:
                        done.append(now.close())
                    now = _Shard(folder, shard)
                now.add(payload, n)
        if now is not None:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["shard", "rows", "tokens", "bytes"]), preserve_index=False)

    coded = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "shard int, doc_id long, n long, payload binary")
    placed = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id")
    written = placed.mapInArrow(write, "shard long, rows long, tokens long, bytes long").collect()
    manifest = sorted(tuple(r) for r in written)
    if manifest:
        spark.createDataFrame(manifest, "shard long, rows long, tokens long, bytes long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest


def read_records(spark: SparkSession, folder: str, manifest: Sequence[tuple]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record; ``start`` counts the ids of all records before it."""
    starts, at = [], 0
    for shard, _, tokens, _ in manifest:
        starts.append((shard, at))
        at += tokens

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for todo in batches:
            for shard, start in zip(todo["shard"].tolist(), todo["start"].tolist()):
                rows = []
                for payload in records(f"{folder}/shard-{shard:06d}.rec"):
                    doc, ids = ids_of(payload, unpack)
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    todo = spark.createDataFrame(starts, "shard int, start long").repartitionById(max(1, len(starts)), F.col("shard"))
    return todo.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder on shared storage and read them back.

    A null or empty text is a record with ``end_id`` alone; repeated rows are repeated records; an empty table writes
    no file and gives no rows.
    """
    folder = f"{shared_folder(documents.sparkSession)}/records-{uuid.uuid4().hex}"
    return read_records(documents.sparkSession, folder, write_records(documents, folder, vocabulary, end_id))
