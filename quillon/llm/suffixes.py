"""Removal of repeated passages: every byte under a string of `length` bytes that also starts earlier.

Suffixes are compared by difference cover. COVERS has sets D of residues mod v in which every distance mod v occurs: any
two positions have a shift below v that takes both into the cover. Strings of length w = length - v + 1 at cover
positions are ranked first; a cover position whose string stands nowhere else can't lie in a repeat. Three steps:

1. Equal texts are one text (their copies are repeats from end to end); nothing but hashes and ids is dealt for that.
2. Cover ranks: every cover position sends its fingerprint to a bucket; a bucket is sorted at a time, and each string
   found twice gets as its rank the place where it first stands. A position that goes without a rank is unique.
3. Suffixes: ranks along one diagonal (same earlier document, same distance) that touch each other prove a long
   tie: what they cover stands earlier, whatever its length. Only suffixes near a rank that no diagonal proves go
   to buckets by 96 bits of fingerprint; again one bucket is sorted at a time, and all but the first of each are repeats.

Positions travel as packed columns, a few bytes each. Within a block of texts equal strings meet before anything is
dealt, so a string that a third of all documents hold reaches its bucket once for each block. Buckets grow in number with
the bytes, so none outgrows a task. 96 and 64 bits of fingerprint count as equality (a false rank alone proves nothing:
a tie takes at least two ranks).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, id_and_text, materialise, split_by_bitmap

#: Perfect difference sets (every distance but 0 occurs once mod v).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Bytes of a slice of text, of a block of texts whose cover positions (whose suffixes) meet first, of text for a bucket.
SLICE, COVER_BLOCK, SUFFIX_BLOCK, BUCKET_BYTES = 1 << 18, 4 << 20, 2 << 20, 32 << 20
#: Rows about documents that leave a task together.
HELD = 1 << 18
NO_ID = (1 << 63) - 1
U = np.uint64
_PRIME, _FACTOR = 2_147_483_647, 48_271


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose strings are no shorter than its period, so that ranks of one diagonal touch."""
    v = max(v for v in COVERS if 2 * v - 1 <= length)
    return v, COVERS[v]


# ---------------------------------------------------------------- fingerprints


class _Powers:
    """Tables for sum(T[byte] * B^i) mod 2^64: T random, B odd, so that B^i can be divided out."""

    def __init__(self, seed: int, n: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=U)
        base = int(rng.integers(0, 1 << 63, dtype=U)) * 2 + 1
        self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, b % (1 << 64), U)])) for b in (base, pow(base, -1, 1 << 64)))


_POWERS: dict[int, _Powers] = {}


def _powers(seed: int, n: int) -> _Powers:
    if seed not in _POWERS or len(_POWERS[seed].up) < n:
        _POWERS[seed] = _Powers(seed, n)
    return _POWERS[seed]


def fingerprints(data: np.ndarray, at: np.ndarray, w: int, seed: int) -> np.ndarray:
    """64-bit fingerprints of data[a : a + w] for a in `at`."""
    p = _powers(seed, len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(p.table[data] * p.up[: len(data)], out=total[1:])
    h = (total[at + w] - total[at]) * p.down[at]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> U(shift))) * U(factor)
    return h ^ (h >> U(32))


# ---------------------------------------------------------------- packed columns


def _planes(a: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all first bytes first: planes of small numbers compress to nothing."""
    return np.ascontiguousarray(a.astype(U, copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).reshape(-1).view(U)


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a.astype(U, copy=False), prepend=U(0))


class Keys:
    """Documents in order: ids and ties (a tie tells texts of one id apart)."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray):
        self.ids, self.ties = ids, ties

    def bucket(self, buckets: int) -> np.ndarray:
        return (((self.ids ^ self.ties) % _PRIME) * _FACTOR) % _PRIME % buckets


def pack(keys: Keys, doc: np.ndarray, *columns: np.ndarray) -> tuple[bytes, list[int]]:
    """(rows of (document, columns) as bytes, the ids in them). The first column should ascend."""
    used, own = np.unique(doc, return_inverse=True)
    body = b"".join([_planes(_steps(keys.ids[used].view(U))), _planes(keys.ties[used].view(U)), _planes(own), _planes(_steps(columns[0])), *map(_planes, columns[1:])])
    return struct.pack("<qqq", len(used), len(doc), len(columns)) + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True), keys.ids[used].tolist()


def unpack(blob: bytes) -> tuple[Keys, np.ndarray, list[np.ndarray]]:
    m, n, k = struct.unpack_from("<qqq", blob)
    body = memoryview(pa.Codec("zstd").decompress(memoryview(blob)[24:], 16 * m + 8 * n * (k + 1), asbytes=True))
    at, parts = 0, []
    for size in (m, m, *[n] * (k + 1)):
        parts.append(_unplanes(body[at : at + 8 * size], size))
        at += 8 * size
    return Keys(np.cumsum(parts[0]).view(np.int64), parts[1].view(np.int64)), parts[2].astype(np.int64), [np.cumsum(parts[3]), *parts[4:]]


Part = tuple[Keys, np.ndarray, list[np.ndarray]]


def joined(parts: list[Part]) -> Part:
    """The rows of several parts, their documents numbered in the documents' order."""
    ids, ties = np.concatenate([p[0].ids for p in parts]), np.concatenate([p[0].ties for p in parts])
    both, number = np.unique(np.rec.fromarrays([ids, ties], names="i,t"), return_inverse=True)
    starts = np.cumsum([0, *[len(p[0].ids) for p in parts[:-1]]])
    doc = np.concatenate([number[s + p[1]] for s, p in zip(starts, parts, strict=True)])
    return Keys(np.ascontiguousarray(both["i"]), np.ascontiguousarray(both["t"])), doc, [np.concatenate(c) for c in zip(*[p[2] for p in parts], strict=True)]


def gathered(blobs: list[bytes]) -> Part:
    return joined([unpack(b) for b in blobs])


ROWS = "bucket long, kind int, blob binary, docs array<long>"
_NAMES = ["bucket", "kind", "blob", "docs"]


def _rows(rows: list[tuple[int, int, bytes, list[int] | None]]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _stretches(of: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each stretch of equal numbers."""
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(begin.tolist(), np.append(begin[1:], len(of))[: len(begin)].tolist(), strict=True))


def by_document(keys: Keys, doc: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple[int, int, bytes, list[int]]]:
    """Rows of kind 1: what is known of documents, dealt by document. doc and the first column ascend."""
    of = keys.bucket(buckets)[doc]
    order = np.argsort(of, kind="stable")
    return [(int(of[part[0]]), 1, *pack(keys, doc[part], *[c[part] for c in columns])) for part in (order[a:b] for a, b in _stretches(of[order]))]


def by_fingerprint(keys: Keys, doc: np.ndarray, buckets: int, h: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, bytes, None]]:
    """Rows of kind 0: suffixes dealt into buckets of fingerprints. h ascends."""
    of = ((h >> U(32)) * U(buckets)) >> U(32)
    return [(int(of[a]), 0, pack(keys, doc[a:b], h[a:b], *[c[a:b] for c in columns])[0], None) for a, b in _stretches(of.view(np.int64))]


def one_bucket_at_a_time(solve, buckets: int):
    """Over rows sorted by (bucket, kind): those of kind 0 are solved bucket by bucket, which says more of documents.

    That and the rows of kind 1 leave together, once for every HELD rows and not once for every bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, now, blobs = [], 0, None, []

        def keep(part: Part) -> None:
            nonlocal held
            parts.append(part)
            held += len(part[1])

        def leave() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held:
                keys, doc, columns = joined(parts)
                order = np.lexsort((columns[0], doc))
                yield from _rows(by_document(keys, doc[order], buckets, *[c[order] for c in columns]))
            parts.clear()
            held = 0

        for batch in batches:
            for bucket, kind, blob in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if blobs and bucket != now:
                    keep(solve(*gathered(blobs)))
                    blobs = []
                now = bucket
                if kind:
                    keep(unpack(blob))
                else:
                    blobs.append(blob)
                if held >= HELD:
                    yield from leave()
        if blobs:
            keep(solve(*gathered(blobs)))
        yield from leave()

    return run


def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, docs) sorted by bucket to the different ids of each bucket."""
    now, ids = None, np.zeros(0, np.int64)
    for batch in batches:
        for bucket, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])
                ids = ids[:0]
            now, ids = bucket, np.union1d(ids, docs.values.to_numpy())
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])


def _groups(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """For sorted rows: where the group of each row begins."""
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = h[1:] != h[:-1]
        for m in more:
            new[1:] |= m[1:] != m[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


# ---------------------------------------------------------------- texts in blocks


def blocks(docs: Iterator[tuple[int, int, bytes]], size: int) -> Iterator[tuple[Keys, list[bytes]]]:
    """(id, tie, text) in blocks of about `size` bytes, each in the documents' order."""
    held, n = [], 0

    def block() -> tuple[Keys, list[bytes]]:
        held.sort(key=lambda x: x[:2])
        return Keys(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)), [x[2] for x in held]

    for doc in docs:
        held.append(doc)
        n += len(doc[2])
        if n >= size:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def slabs(texts: list[bytes], w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, places in data, number of the text, position) of all strings of w bytes, a slice at a time.

    Short texts share a slice; a long one is cut into slices that overlap by w - 1 bytes.
    """
    pieces, n = [], 0

    def slab():
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        own = sizes - w + 1
        skip = np.repeat(np.cumsum(own) - own, own)
        k = np.arange(int(own.sum())) - skip
        return data, k + np.repeat(np.cumsum(sizes) - sizes, own), np.repeat(np.array([p[0] for p in pieces]), own), k + np.repeat(np.array([p[1] for p in pieces]), own)

    for i, text in enumerate(texts):
        for a in range(0, len(text) - w + 1, SLICE):
            pieces.append((i, a, text[a : a + SLICE + w - 1]))
            n += len(pieces[-1][2])
            if n >= SLICE:
                yield slab()
                pieces, n = [], 0
    if pieces:
        yield slab()


# ---------------------------------------------------------------- step 2: cover ranks


def cover_rows(length: int, buckets: int, doc_buckets: int, size: int = COVER_BLOCK):
    """Texts (id, tie, text) to rows: cover strings by fingerprint, and ranks that the block itself settles."""
    v, cover = cover_for(length)
    w = length - v + 1
    in_cover = np.zeros(v, bool)
    in_cover[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = ((i, t, x) for b in batches for i, t, x in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True))
        for keys, texts in blocks(docs, size):
            found = []
            for data, at, doc, pos in slabs(texts, w):
                own = np.flatnonzero(in_cover[pos % v])
                found.append((fingerprints(data, at[own], w, 1), doc[own].astype(np.int32), pos[own].astype(np.uint32)))
            if not found:
                continue
            h, doc, pos = (np.concatenate(c) for c in zip(*found, strict=True))
            del found
            order = np.argsort(h, kind="stable")  # within a string: in the documents' order
            h, doc, pos = h[order], doc[order], pos[order]
            first = _groups(h)
            alone = first == np.arange(len(h))
            again = np.bincount(first[~alone], minlength=len(h)) > 0
            yield from _rows(by_fingerprint(keys, doc[alone], buckets, h[alone], pos[alone], again[alone]))
            own, columns = _ranks(keys, np.flatnonzero(~alone), first, doc, pos)
            yield from _rows(by_document(keys, own, doc_buckets, *columns))

    return run


def _ranks(keys: Keys, rows: np.ndarray, first: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each of `rows` its document, and as columns its position and the place where its string first stands."""
    rows = rows[np.lexsort((pos[rows], doc[rows]))]
    f = first[rows]
    return doc[rows], [pos[rows].astype(U), pos[f].astype(U), keys.ids[doc[f]].view(U), keys.ties[doc[f]].view(U)]


def rank_bucket(keys: Keys, doc: np.ndarray, columns: list[np.ndarray]) -> Part:
    h, pos, again = columns
    del columns
    order = np.lexsort(((doc.astype(U) << U(32)) | pos, h))
    h, pos, doc, again = h[order], pos[order], doc[order].astype(np.int32), again[order] > 0
    del order
    first = _groups(h)
    many = np.bincount(first, minlength=len(h))[first] > 1
    return keys, *_ranks(keys, np.flatnonzero(many | again), first, doc, pos)


# ---------------------------------------------------------------- step 3: suffixes


def settle(keys: Keys, sizes: np.ndarray, ranks: tuple[Keys, np.ndarray, list[np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proven, open, offsets): flags of the block's positions, texts end to end with one place more for each.

    proven: a diagonal of touching ranks shows that the suffix's first `length` bytes stand earlier.
    open: the suffix lies near a rank and no diagonal proves it.
    """
    v, _ = cover_for(length)
    w = length - v + 1
    offsets = np.cumsum(np.concatenate([[0], sizes + 1]))
    of, doc, (s, fpos, fid, ftie) = ranks
    wanted = np.rec.fromarrays([keys.ids, keys.ties], names="i,t")
    have = np.rec.fromarrays([of.ids, of.ties], names="i,t")
    at = np.searchsorted(wanted, have)
    at[at == len(wanted)] = 0
    number = np.where(wanted[at] == have, at, -1)
    own = number[doc] >= 0
    doc, s, fpos, fid, ftie = number[doc[own]], s[own].astype(np.int64), fpos[own].astype(np.int64), fid[own].view(np.int64), ftie[own].view(np.int64)
    near, proven = np.zeros(offsets[-1] + 1, np.int32), np.zeros(offsets[-1] + 1, np.int32)
    lo, hi = np.maximum(s - v + 1, 0), np.minimum(s, sizes[doc] - length)
    fits = hi >= lo
    np.add.at(near, (offsets[doc] + lo)[fits], 1)
    np.add.at(near, (offsets[doc] + hi + 1)[fits], -1)
    earlier = (fid != keys.ids[doc]) | (ftie != keys.ties[doc]) | (fpos != s)
    doc, s, fid, ftie, diagonal = doc[earlier], s[earlier], fid[earlier], ftie[earlier], (fpos - s)[earlier]
    order = np.lexsort((s, diagonal, ftie, fid, doc))
    doc, s, fid, ftie, diagonal = (a[order] for a in (doc, s, fid, ftie, diagonal))
    new = np.ones(len(s) + 1, bool)
    if len(s):
        new[1:-1] = (doc[1:] != doc[:-1]) | (fid[1:] != fid[:-1]) | (ftie[1:] != ftie[:-1]) | (diagonal[1:] != diagonal[:-1]) | (s[1:] - s[:-1] > w)
        a, b = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
        long = s[b] + w - s[a] >= length
        np.add.at(proven, (offsets[doc[a]] + s[a])[long], 1)
        np.add.at(proven, (offsets[doc[b]] + s[b] + w - length + 1)[long], -1)
    proven = np.cumsum(proven[:-1], dtype=np.int32) > 0
    return proven, (np.cumsum(near[:-1], dtype=np.int32) > 0) & ~proven, offsets


def _runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the runs of set flags; no run crosses texts, for the last place of each is never set."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    doc = np.searchsorted(offsets, a, side="right") - 1
    return doc, a - offsets[doc], b - a


def texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], Iterator[tuple[int, int, bytes]]]]:
    """For each bucket of rows sorted by (bucket, kind): (blobs, texts). Texts stream; a bucket's blobs are held."""
    rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True))
    row = next(rows, None)
    while row is not None:
        bucket, blobs = row[0], []
        while row is not None and row[0] == bucket and row[1] == 0:
            blobs.append(row[2])
            row = next(rows, None)

        def texts() -> Iterator[tuple[int, int, bytes]]:
            nonlocal row
            while row is not None and row[0] == bucket:  # noqa: B023
                yield row[3], row[4], row[2]
                row = next(rows, None)

        yield blobs, texts()
        for _ in texts():
            pass


def suffix_rows(length: int, buckets: int, doc_buckets: int, size: int = SUFFIX_BLOCK):
    """Texts and their ranks to rows: open suffixes by fingerprint, and repeats that are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs, docs in texts_with(batches):
            if not blobs:
                continue
            ranks = gathered(blobs)
            for keys, texts in blocks(docs, size):
                proven, open_, offsets = settle(keys, np.array([len(t) for t in texts]), ranks, length)
                found = []
                for data, at, doc, pos in slabs(texts, length):
                    own = np.flatnonzero(open_[offsets[doc] + pos])
                    if len(own):
                        found.append((fingerprints(data, at[own], length, 2), fingerprints(data, at[own], length, 3) >> U(32), doc[own], pos[own]))
                if found:
                    h, low, doc, pos = (np.concatenate(c) for c in zip(*found, strict=True))
                    order = np.lexsort((low, h))  # stable: within a string in the documents' order
                    h, low, doc, pos = h[order], low[order], doc[order], pos[order]
                    first = _groups(h, low) == np.arange(len(h))
                    proven[offsets[doc[~first]] + pos[~first]] = True
                    yield from _rows(by_fingerprint(keys, doc[first], buckets, h[first], low[first], pos[first]))
                doc, start, n = _runs(proven, offsets)
                yield from _rows(by_document(keys, doc, doc_buckets, start, n))

    return run


def suffix_bucket(keys: Keys, doc: np.ndarray, columns: list[np.ndarray]) -> Part:
    h, low, pos = columns
    order = np.lexsort((pos, doc, low, h))
    h, low, pos, doc = h[order], low[order], pos[order], doc[order]
    again = _groups(h, low) != np.arange(len(h))
    return keys, doc[again], [pos[again], np.ones(int(again.sum()), U)]


# ---------------------------------------------------------------- results

RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut_rows(length: int, size: int = SUFFIX_BLOCK):
    """Texts and their repeats to results: spans of removed bytes and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs, docs in texts_with(batches):
            of, doc, (start, n) = gathered(blobs) if blobs else (Keys(*np.zeros((2, 0), np.int64)), np.zeros(0, np.int64), np.zeros((2, 0), U))
            order = np.lexsort((start, doc))
            start, end = start[order].astype(np.int64), (start + n)[order].astype(np.int64) + length - 1
            at = dict(zip(zip(of.ids.tolist(), of.ties.tolist(), strict=True), range(len(of.ids)), strict=True))
            cuts = np.searchsorted(doc[order], np.arange(len(of.ids) + 1))
            for keys, texts in blocks(docs, size):
                spans, kept = [], []
                for key, text in zip(zip(keys.ids.tolist(), keys.ties.tolist(), strict=True), texts, strict=True):
                    i = at.get(key)
                    a, b = (start[cuts[i] : cuts[i + 1]], end[cuts[i] : cuts[i + 1]]) if i is not None else (start[:0], end[:0])
                    if len(a):
                        reach = np.maximum.accumulate(b)
                        new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
                        a, b = a[new], reach[np.append(new[1:] - 1, len(reach) - 1)]
                    spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    kept.append(b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)))
                ids = pa.array([None if i == NO_ID and t else i for i, t in zip(keys.ids.tolist(), keys.ties.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def _solved(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """materialise(), with the job's shuffle files removed as soon as its table is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialise(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions("bucket", "kind")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans of removed bytes (ends exclusive) and kept, the other bytes: a row for each row of docs.

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a document of smaller id, or
    earlier in the same one. Strings never cross documents and are judged on the input. A null text is empty; texts
    under `length` bytes stay whole. A null id counts as larger than any other. Different texts under one id (or
    none) stand in the order of a hash; of rows equal in id and text one is the first and the others are its copies.
    kept is binary, since a cut may split a character. An empty table gives an empty one; further columns are not read.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "sha": F.unhex(F.sha2("text", 256)), "n": F.octet_length("text").cast("long")})
    # step 1: copies. Nothing of a text but its hash is dealt, and texts too short to be cut; hashing again is cheaper than a table
    meta = rows.select("doc_id", "id", "sha", "n", F.when(F.col("n") < length, F.col("text")).alias("short"))
    classes = meta.groupBy("sha").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    shared = classes.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where(f"texts > 1 or id = {NO_ID}")
    tie = F.xxhash64("sha").bitwiseAND(F.lit(NO_ID)).bitwiseOR(F.lit(1))
    special, _ = materialise(
        classes.join(shared, "id", "left").where("times > 1 or texts is not null").select("sha", "id", "times", F.when(F.col("texts").isNotNull(), tie).otherwise(F.lit(0).cast("long")).alias("tie")), "copies"
    )
    may_repeat, single = split_by_bitmap(rows.select("id", "sha", "text"), F.xxhash64("sha"), special.select("sha"))
    ones = may_repeat.groupBy("sha").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    ones = ones.join(special.select("sha", "tie"), "sha", "left").select("id", F.coalesce("tie", F.lit(0).cast("long")).alias("tie"), "text")
    ones, _ = _solved(ones, "ones")
    texts = single.select("id", F.lit(0).cast("long").alias("tie"), "text").unionByName(ones)
    total = rows.agg(F.sum("n")).first()[0] or 0
    doc_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    buckets = 4 * doc_buckets
    # step 2
    covers = texts.where(F.octet_length("text") >= length).mapInArrow(cover_rows(length, buckets, doc_buckets), ROWS)
    ranks, ranks_path = _solved(_by_bucket(covers).mapInArrow(one_bucket_at_a_time(rank_bucket, doc_buckets), ROWS), "ranks")
    # step 3
    prime = lambda c: F.pmod(c, F.lit(_PRIME).cast("long"))
    of_doc = F.pmod(prime(prime(F.col("id").bitwiseXOR(F.col("tie"))) * F.lit(_FACTOR)), F.lit(doc_buckets).cast("long")).alias("bucket")

    def beside(known: DataFrame, some: DataFrame) -> DataFrame:
        """Rows of what is known of documents, then the texts, by bucket."""
        own = known.select("bucket", F.lit(0).alias("kind"), "blob", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("tie"))
        return _by_bucket(own.unionByName(some.select(of_doc, F.lit(1).alias("kind"), F.col("text").alias("blob"), "id", "tie")))

    ids = lambda known: known.select("bucket", "docs").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(ids_of, "id long")
    near, _ = split_by_bitmap(texts, F.xxhash64("id"), ids(ranks))
    suffixes = beside(ranks, near).mapInArrow(suffix_rows(length, buckets, doc_buckets), ROWS)
    repeats, _ = _solved(_by_bucket(suffixes).mapInArrow(one_bucket_at_a_time(suffix_bucket, doc_buckets), ROWS), "repeats")
    # results: texts without repeats are not dealt again
    cut, whole = split_by_bitmap(texts, F.xxhash64("id"), ids(repeats))
    cut = beside(repeats, cut).mapInArrow(cut_rows(length), RESULT)
    no_span = F.array().cast("array<struct<start:long,end:long>>")
    doc_id = F.when((F.col("id") != NO_ID) | (F.col("tie") == 0), F.col("id"))
    whole = whole.select(doc_id.alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), no_span.alias("spans"), F.col("text").alias("kept"))
    times = meta.groupBy("sha", "doc_id", "id", "n", "short").agg(F.count(F.lit(1)).alias("c")).join(special.where("times > 1").select("sha", F.col("id").alias("first")), "sha")
    # of the rows that hold the class's first id one is the text itself
    copies = times.withColumn("c", F.col("c") - F.when(F.col("id") == F.col("first"), 1).otherwise(0)).where("c > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    gone = F.col("n") >= length
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    copies = copies.select("doc_id", F.col("n").alias("n_bytes"), F.when(gone, span).otherwise(no_span).alias("spans"), F.when(gone, F.unhex(F.lit(""))).otherwise(F.col("short")).alias("kept"))
    drop_path(spark, ranks_path)
    return cut.unionByName(whole).unionByName(copies)


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of remove_repeats()."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return removed.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
