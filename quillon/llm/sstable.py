"""Sorted-string-table shards of token ids.

A shard: data blocks, then the block index, the Bloom filter and a footer. All numbers are little-endian.

    block   zlib of entries: shared key length u8, own key length u8, value length u32, own key bytes, value
    index   per block: first key (8 bytes), offset u64, length u32, ids before the block in the shard u64
    bloom   bits of size u64 * 8, 7 probes by double hashing of the key's blake2b
    footer  index offset u64, index length u64, bloom offset u64, bloom length u64, entries u64, ids u64, magic

A key is the doc_id as 8 big-endian bytes with its sign bit turned, so byte order is number order. A null doc_id
has the empty key, which comes first; as a block's first key it is filled up with zeros in the index. A value
holds the ids of one document: u16 if all are below 65,536, else u32 (a leading byte says which).
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, id_and_text, texts_of
from .wordids import encoder

MAGIC = b"QLNSST01"
FOOTER = struct.Struct("<6Q8s")
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<8sQIQ")
BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 64 * 1024 * 1024
PROBES, BITS_PER_KEY = 7, 10


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _value(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65_536 else b"\4" + ids.astype("<u4").tobytes()


def _ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ShardWriter:
    """Takes documents in ascending key order; finish() puts the file in place under its final name."""

    def __init__(self, path: str):
        self.fs, self.path = _filesystem(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp)
        self.at = self.entries = self.ids = self.block_ids = 0
        self.block: list[bytes] = []
        self.block_bytes, self.last, self.first = 0, b"", b""
        self.index: list[bytes] = []
        self.keys: set[bytes] = set()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), _value(ids)
        if key < self.last:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.last, self.block_ids = key, b"", self.ids
        shared = len(os.path.commonprefix([self.last, key]))
        self.block += [ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self.block_bytes += 14 + len(value)
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(ids)
        self.keys.add(key)
        if self.block_bytes >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(b"".join(self.block), 1)
            self.index.append(INDEX.pack(self.first, self.at, len(data), self.block_ids))
            self.out.write(data)
            self.at += len(data)
            self.block, self.block_bytes = [], 0

    def finish(self) -> tuple[str, int, int]:
        self._flush()
        size = max(8, (len(self.keys) * BITS_PER_KEY + 7) // 8)
        bits = np.zeros(size * 8, bool)
        bits[[p for k in self.keys for p in _probes(k, size * 8)]] = True
        index, bloom = b"".join(self.index), np.packbits(bits, bitorder="little").tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return self.path, self.entries, self.ids


class Shard:
    """Reads a shard: get() by binary search over the block index, scan() in key order."""

    def __init__(self, path: str):
        fs, inner = _filesystem(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        index, index_len, bloom, bloom_len, self.entries, self.ids, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self.blocks = list(INDEX.iter_unpack(self.file.read_at(index_len, index)))
        self.bloom = self.file.read_at(bloom_len, bloom)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length, _ = self.blocks[i]
        data, at, last = zlib.decompress(self.file.read_at(length, offset)), 0, b""
        while at < len(data):
            shared, own, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            last = last[:shared] + data[at : at + own]
            at += own
            yield last, _ids(data[at : at + n])
            at += n

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document under this key (none: an empty list)."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return []
        firsts, first = [b[0] for b in self.blocks], key.ljust(8, b"\0")
        found = []
        for i in range(max(0, bisect.bisect_left(firsts, first) - 1), bisect.bisect_right(firsts, first)):
            found += [ids for k, ids in self._block(i) if k == key]
        return found

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids) in key order."""
        for i, block in enumerate(self.blocks):
            before = block[3]
            for key, ids in self._block(i):
                yield id_of(key), before, ids
                before += len(ids)


def write_shards(docs: DataFrame, spec: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document's ids into shards below `path`; returns the manifest (shard, path, entries, ids).

    Rows are dealt into ranges of (doc_id, hash of the text), so a doc_id with many rows spreads over
    ranges, and each task writes shards of some 64 MB in key order. A task that runs again replaces its
    files by equal ones. A null or empty text is the end id alone; rows without doc_id come first, under
    the empty key; repeated rows stay, ordered by their texts' hash. An empty table gives no shards.
    """
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, writer, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoder(spec).encode(texts_of(batch.column(1)))):
                if writer is None:
                    writer = ShardWriter(f"{path}/shard-{part:06d}-{shard:04d}.sst")
                writer.add(doc, np.concatenate([np.frombuffer(raw, "<u4"), end]))
                if writer.at >= SHARD_BYTES:
                    done.append((part * 10_000 + shard, *writer.finish()))
                    writer, shard = None, shard + 1
        if writer:
            done.append((part * 10_000 + shard, *writer.finish()))
        if done:
            cols = list(zip(*done))
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["shard", "path", "entries", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    keyed = rows.withColumn("salt", F.xxhash64("text"))
    ranged = keyed.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt")
    return ranged.select("doc_id", "text").mapInArrow(run, "shard long, path string, entries long, ids long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    rows = sorted((r.shard, r.path, r.ids) for r in manifest.collect())
    starts = np.cumsum([0] + [r[2] for r in rows]).tolist()
    todo = spark.createDataFrame([(p, s) for (_, p, _), s in zip(rows, starts)], "path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                for doc, before, ids in Shard(path).scan():
                    out.append((doc, base + before, len(ids), zlib.crc32(ids.tobytes())))
                    if len(out) == 20_000:
                        yield as_batch(out)
                        out = []
                if out:
                    yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, spec: str) -> DataFrame:
    """Writes the shards into the shared folder and reads every document back from them."""
    path = fresh_path(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, spec, path))
