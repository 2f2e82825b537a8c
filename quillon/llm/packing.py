"""Sum-of-squares online packing of token ids into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, texts_of
from .wordids import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed_by string"
WITH_IDS = SCHEMA + ", ids binary"
_SPECS: dict[str, pa.DataType] = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
#: Partly filled windows that a packer keeps; with so many, a piece that would open another is cut instead.
OPEN = 12
#: What put a piece where it is: the level rule, or the cutter that empties the last open windows.
LEVELS, CUTTER = "levels", "cutter"


class SumOfSquares:
    """Online packer with a level array: open_at[h] counts the windows filled up to h.

    A piece goes where the sum of open_at[h] ** 2 over partly filled windows comes out least (a tie: the
    fullest window). While `most` windows are open no other may be: a piece that fits in none of them is
    cut, its head fills the window that lowers the sum most, and the rest is placed by the same rule. So a
    packer holds at most most * size ids, and finish() has only these windows left: it empties the least
    filled into the gaps of the others, cutting pieces, so at most one window keeps padding.
    """

    def __init__(self, size: int, first: int, most: int = OPEN):
        self.size, self.next, self.most = size, first, most
        self.open_at = [0] * (size + 1)
        self.levels: dict[int, list[int]] = {}
        self.held: dict[int, list[tuple]] = {}

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def _level(self, n: int) -> int | None:
        """The level for a piece of n ids: 0 is a new window, None says that it has to be cut."""
        at, size = self.open_at, self.size
        best, least = (0, 2 * at[n] + 1) if len(self.held) < self.most else (None, 1 << 60)
        for h in self.levels:
            to = h + n
            if to <= size:
                change = 1 - 2 * at[h] + (2 * at[to] + 1 if to < size else 0)
                if change < least or (change == least and h > (best or 0)):
                    best, least = h, change
        return best

    def place(self, piece: tuple) -> list[tuple]:
        """Takes (doc_id, start, ids, doc_tokens); returns the rows of the windows that it closes."""
        n, size = len(piece[2]) // 4, self.size
        if n == size:
            return [(*piece, self._open(), 0, LEVELS)]
        level = self._level(n)
        if level is None:
            full = max(self.levels, key=lambda h: (self.open_at[h], h))
            doc, start, ids, total = piece
            gap = size - full
            return self._put((doc, start, ids[: 4 * gap], total), gap, full) + self.place((doc, start + gap, ids[4 * gap :], total))
        return self._put(piece, n, level)

    def _put(self, piece: tuple, n: int, level: int) -> list[tuple]:
        if level:
            windows = self.levels[level]
            window = windows.pop()
            self.open_at[level] -= 1
            if not windows:
                del self.levels[level]
        else:
            window = self._open()
            self.held[window] = []
        self.held[window].append((*piece, window, level, LEVELS))
        to = level + n
        if to == self.size:
            return self.held.pop(window)
        self.open_at[to] += 1
        self.levels.setdefault(to, []).append(window)
        return []

    def finish(self) -> list[tuple]:
        fill = {w: sum(len(r[2]) // 4 for r in rows) for w, rows in self.held.items()}
        queue = sorted(fill, key=lambda w: (-fill[w], w))
        out: list[tuple] = []
        for i, window in enumerate(queue):
            rows = self.held.pop(window, [])
            while fill[window] < self.size and len(queue) > i + 1:
                last = queue[-1]
                doc, start, ids, total, _, offset, by = self.held[last].pop()
                n = len(ids) // 4
                take = min(n, self.size - fill[window])
                rows.append((doc, start + n - take, ids[4 * (n - take) :], total, window, fill[window], CUTTER))
                fill[window] += take
                fill[last] -= take
                if take < n:
                    self.held[last].append((doc, start, ids[: 4 * (n - take)], total, last, offset, by))
                if not fill[last]:
                    self.held.pop(queue.pop())
            out += rows
        return out


def pack(docs: DataFrame, spec: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens; one row per piece.

    spec is the JSON text of a word-end vocabulary. Each input partition runs one packer over its rows in
    their order, so nothing is shuffled and memory is bounded by the OPEN windows; it pads at most one
    window. sequence_id is the partition's number * 2**40 plus a count; placed_by says whether the level
    rule or the final cutter placed a piece. A null or empty text is the end id alone; a longer text is cut
    at multiples of `size`; repeated rows and ids are packed each for itself; a null doc_id stays null; other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    names = [x.split() for x in (WITH_IDS if with_ids else SCHEMA).split(", ")]
    schema = pa.schema([(n, _SPECS[t]) for n, t in names])
    end = np.array([end_id], "<u4").tobytes()

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, total, window, offset, by = zip(*rows)
        cols = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], total, window, offset, by, ids]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = SumOfSquares(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            done: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(spec).encode(texts_of(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, size):
                    done += packer.place((doc, a, ids[4 * a : 4 * (a + size)], n))
            if done:
                yield rows_of(done)
        rest = packer.finish()
        for a in range(0, len(rest), 10_000):
            yield rows_of(rest[a : a + 10_000])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ", ".join(" ".join(x) for x in names))
