"""Byte-level BPE by merge replay over the distinct words of a batch."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, texts_of

#: Entries that bound a worker's caches of chunks and of words, and the characters of an entry: near 300 MB.
CHUNKS, WORDS, CHARS = 600_000, 800_000, 48
#: A space between two other characters that aren't white space: no match of the pattern crosses its left side.
BORDER = re.compile(r"(?<=\S) (?=\S)")

_CODECS: dict[int, "MergeReplay"] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class MergeReplay:
    """Ids of words by replaying merges in rank order over all of them at once.

    Words lie in arrays of parts with links to the neighbours. An inverted index holds for each rank the
    positions of the pairs that merge into it; a heap yields the lowest rank that has any. Applying a merge
    touches the two pairs beside it only. Where a merge makes a pair of lower rank in its word, the word's
    later positions of the current rank wait for it, as each word by itself would have it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1 if ranks else 0)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def words(self, new: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        ranks, get = self.ranks, self.ranks.get
        parts: list[bytes] = []
        nxt: list[int] = []
        prv: list[int] = []
        word: list[int] = []
        index: dict[int, list[int]] = defaultdict(list)
        whole: dict[int, int] = {}
        for w, text in enumerate(new):
            if (r := get(text)) is not None:
                whole[w] = r
                continue
            first, n = len(parts), len(text)
            singles = [text[i : i + 1] for i in range(n)]
            parts += singles
            nxt += [*range(first + 1, first + n), -1]
            prv += [-1, *range(first, first + n - 1)]
            word += [w] * n
            for i in range(n - 1):
                if (r := get(text[i : i + 2])) is not None:
                    index[r].append(first + i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if not places:
                continue
            merged = self.bytes_of[rank]
            held = -1
            places.sort()
            for at in places:
                left = parts[at]
                if left is None or (right := nxt[at]) < 0 or len(left) + len(parts[right]) != len(merged) or left + parts[right] != merged:
                    continue
                if word[at] == held:
                    if rank not in index:
                        heapq.heappush(heap, rank)
                    index[rank].append(at)
                    continue
                parts[at], parts[right] = merged, None
                after = nxt[at] = nxt[right]
                if after >= 0:
                    prv[after] = at
                    if (r := get(merged + parts[after])) is not None:
                        if r not in index:
                            heapq.heappush(heap, r)
                        index[r].append(at)
                        if r <= rank:
                            held = word[at]
                before = prv[at]
                if before >= 0 and (r := get(parts[before] + merged)) is not None:
                    if r not in index:
                        heapq.heappush(heap, r)
                    index[r].append(before)
                    if r <= rank:
                        held = word[at]
        out: list[list[int]] = [[] for _ in new]
        for w, r in whole.items():
            out[w].append(r)
        for at, part in enumerate(parts):
            if part is not None:
                out[word[at]].append(ranks[part])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [_chunks(t) for t in texts]
        known = self.chunks
        new: set[str] = set()
        for chunks in cut:
            new.update(x for x in chunks if x not in known)
        if len(known) + len(new) > CHUNKS:
            known = self.chunks = {}
            new = set().union(*cut) if cut else set()
        split = {x: self.pattern.findall(x) for x in new}
        words = set().union(*split.values()) if split else set()
        if len(self.known) + len(words) > WORDS:
            self.known = {}
        ids = self.known
        fresh = [w for w in words if w not in ids]
        ids.update(zip(fresh, (np.array(x, "<u4").tobytes() for x in self.words([w.encode() for w in fresh]))))
        known.update((x, b"".join([ids[w] for w in ws])) for x, ws in split.items())
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for x in new:
            if len(x) > CHARS:
                del known[x]
        for w in fresh:
            if len(w) > CHARS:
                del ids[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _chunks(text: str) -> list[str]:
    """Chunks of a text that the pattern matches each for itself: cut before single inner spaces."""
    if not text:
        return []
    first, *rest = BORDER.split(text)
    return [first, *[" " + x for x in rest]]


def codec(data: bytes, pattern: str) -> MergeReplay:
    key = hash((data, pattern))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = MergeReplay(parse_ranks(data), pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text (with_ids: the ids too, as bytes).

    A null text counts as empty: no ids. Rows keep their order and number; repeated rows come out
    repeated; other columns are not read. The cache of a worker and the index of a batch are bounded.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = codec(rank_file, pattern)
            ids = use.encode(texts_of(batch.column(1)))
            cols = [
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(use.decode(x)).hexdigest() for x in ids], pa.string()), pa.array(ids, pa.binary()),
            ]
            yield pa.record_batch(cols[: len(names)], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
