"""Near duplicates by MinHash: banding, verification on full sets, connected components.

1. A scan makes each document's shingle set, its digest and its minima. Equal sets are one class.
2. Classes that share a band bucket are linked to the bucket's least class; the components of these links
   are the candidate groups: two sets that share any bucket are in one group.
3. The full sets of candidate classes are made again from their texts. Groups are compared whole; those of
   more than CELL shingles in cells (size class, hash): only cells whose sizes can reach the similarity
   meet. Cells hold a bounded number of shingles, so no task gets an unbounded group.
4. The confirmed links' components give the result.

With 40 bands of 6 minima a pair of similarity 0.8 shares no bucket with probability 5e-6.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_and_text, materialise, split_by_bitmap, use_caches
from .stars import components

BANDS, ROWS = 40, 6
WORD = re.compile("[\x09-\x0d\x20]+")
#: Shingles of a cell (8 bytes each).
CELL = 1_000_000
#: Width of a size class; over 1 / 0.8, so sets of similarity 0.8 are in the same class or the next.
WIDTH = 1.3
_HASHES: dict[str, int] = {}


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hash functions x -> (a x + b mod 2**64) >> 32."""
    draw = np.random.default_rng(20_240_501).integers(0, 2**64, 2 * n, np.uint64)
    return draw[:n] | np.uint64(1), draw[n:]


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_HASHES) > 400_000:
        _HASHES.clear()
    out = list(map(_HASHES.get, words))
    if None in out:
        new = {w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in {w for w, h in zip(words, out) if h is None}}
        out = [new[w] if h is None else h for w, h in zip(words, out)]
        _HASHES.update((w, h) for w, h in new.items() if len(w) <= 48)
    return np.array(out, np.uint64)


def _forget() -> None:
    _HASHES.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of a text; of fewer words, of the whole sequence."""
    words = [w for w in WORD.split(ascii_lower(text)) if w] if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, in slices of bounded size."""
    low = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        for i in range(0, len(a), 16):
            low[i : i + 16] = np.minimum(low[i : i + 16], ((a[i : i + 16, None] * part + b[i : i + 16, None]) >> np.uint64(32)).min(1))
    return low


def _signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches("minhash", _forget)
        a, b = _constants(bands * rows)
        for batch in batches:
            n, keys, marks = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, k)
                n.append(len(found))
                if not len(found):
                    keys.append(None)
                    marks.append(None)
                    continue
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                low = minima(found, a, b).reshape(bands, rows)
                band = np.full(bands, 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for i in range(rows):
                    band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + low[:, i].astype(np.uint64))
                marks.append(band.view(np.int64).tolist())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "mark", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id long, mark long, n_shingles long, set_key binary, bands array<long>")


def links_within(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join what isn't joined yet: of a cell with itself (right None), or of two cells.

    Positions in left + right. Intersections come from products of 0/1 matrices over the shingles that two
    sets share, a bounded slice of columns at a time.
    """
    sets = left + (right or [])
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.full(len(values), -1)
    shared = np.flatnonzero(times > 1)
    column[shared] = np.arange(len(shared))
    at = column[at]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    n, m = len(left), len(sets)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    wide = max(64, 4_000_000 // max(1, m))
    tall = 1024
    for top in range(0, n, tall):
        rows = np.arange(top, min(top + tall, n))
        others = np.arange(n, m) if right is not None else np.arange(top, n)
        for a in range(0, len(others), tall):
            cols = others[a : a + tall]
            both = np.zeros((len(rows), len(cols)), np.float32)
            for c in range(0, len(shared), wide):
                s, e = np.searchsorted(at, [c, c + wide])
                dense = np.zeros((m, min(wide, len(shared) - c)), np.float32)
                dense[owner[s:e], at[s:e] - c] = 1
                both += dense[rows] @ dense[cols].T
            both = both.astype(np.float64)  # exact for sets of any size in the products below
            union = sizes[rows][:, None] + sizes[cols][None, :] - both
            for i, j in zip(*np.nonzero(100 * both >= percent * union)):
                x, y = int(rows[i]), int(cols[j])
                if (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
                    out.append((x, y))
    return out


def _confirm(sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) of the classes (key, grp, n_shingles, found), sets by group, in bounded cells."""
    size = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(WIDTH)).cast("int")
    cells = sets.groupBy("grp", size.alias("size")).agg(F.sum("n_shingles").alias("weight"))
    groups = cells.groupBy("grp").agg(F.sum("weight").alias("total"), F.map_from_entries(F.collect_list(F.struct("size", F.ceil(F.col("weight") / CELL).cast("int").alias("cells")))).alias("cells_of"))
    placed = sets.withColumn("size", size).join(groups, "grp")
    mine = F.pmod(F.xxhash64("key"), F.col("cells_of")[F.col("size")]).cast("int")
    count = lambda s: F.coalesce(F.try_element_at("cells_of", s), F.lit(0))
    cell = lambda s, i: F.concat_ws(".", s.cast("string"), i.cast("string"))

    def meets(lo):  # cell pairs as "size.i-size.j" with the side that this set is on
        same = F.transform(F.sequence(F.lit(0), count(F.col("size")) - 1), lambda i: F.struct(F.concat_ws("-", cell(F.col("size"), F.least(i, lo)), cell(F.col("size"), F.greatest(i, lo))).alias("pair"), (lo > i).alias("right")))
        up, down = F.col("size") + 1, F.col("size") - 1
        after = F.when(count(up) > 0, F.transform(F.sequence(F.lit(0), count(up) - 1), lambda i: F.struct(F.concat_ws("-", cell(F.col("size"), lo), cell(up, i)).alias("pair"), F.lit(False).alias("right"))))
        before = F.when(count(down) > 0, F.transform(F.sequence(F.lit(0), count(down) - 1), lambda i: F.struct(F.concat_ws("-", cell(down, i), cell(F.col("size"), lo)).alias("pair"), F.lit(True).alias("right"))))
        none = F.array().cast("array<struct<pair:string,right:boolean>>")
        return F.concat(same, F.coalesce(after, none), F.coalesce(before, none))

    whole = F.array(F.struct(F.lit("all").alias("pair"), F.lit(False).alias("right")))
    placed = placed.withColumn("cell", mine).withColumn("meet", F.explode(F.when(F.col("total") <= CELL, whole).otherwise(meets(F.col("cell")))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        use_caches("minhash comparison", int)  # needs no words any more
        pdf = pdf.sort_values("key")
        side = pdf["right"].to_numpy()
        keys = pdf["key"].tolist()
        found = [np.frombuffer(x, np.uint64) for x in pdf["found"]]
        a, b = np.flatnonzero(~side).tolist(), np.flatnonzero(side).tolist()
        pair = pdf["pair"].iloc[0]
        apart = pair != "all" and len(set(pair.split("-"))) == 2
        links = links_within([found[i] for i in a], [found[i] for i in b] if apart else None, percent) if a and (b or not apart) else []
        order = a + b
        return pd.DataFrame([(keys[order[x]], keys[order[y]]) for x, y in links], columns=["u", "v"])

    # dealt by pairs of cells: the join's partitioning by group alone would leave a large group in one task
    met = placed.select("grp", "meet.pair", "meet.right", "key", "found").repartition("grp", "pair")
    return met.groupBy("grp", "pair").applyInPandas(compare, "u binary, v binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", with_class: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked if 100 * intersection >= percent * union of their k-word shingle sets (percent >= 77,
    as size classes are WIDTH apart). component_id is the smallest doc_id of the documents reached; kept
    says that it is the document's own. Null and empty texts and those without words have no shingles and
    are linked with nothing. A null doc_id counts as larger than any other. Repeated rows come out repeated;
    an empty table gives no rows; other columns are not read, whatever their names. Sets are compared as sets
    of 64-bit shingle hashes.
    with_class adds mark (xxhash64 of the text) and root (the component's own key, null without shingles),
    which tell components apart that share a repeated doc_id.
    """
    if percent * WIDTH < 100:
        raise ValueError("size classes are too narrow for this similarity")
    rows_in = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    signed, _ = materialise(_signatures(rows_in, k, bands, rows), "minhash")
    found = signed.where("set_key is not null")
    shown_by = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")
    # one row per class carries its bands: any of its documents has the same
    least = found.groupBy("set_key").agg(F.min(shown_by).alias("by"), F.min_by("bands", shown_by).alias("bands"))
    classes, _ = materialise(least.select("set_key", F.xxhash64("set_key").alias("short"), F.col("by.doc_id").alias("least"), F.col("by.mark").alias("mark"), "bands"), "classes")
    # candidates go by half of the key: classes that share it by chance only meet once more in the verification
    shown = classes.select("short", F.explode("bands").alias("bucket"))
    pivot = shown.groupBy("bucket").agg(F.min("short").alias("v"), F.max("short").alias("most")).where("v <> most").select("bucket", "v")
    candidates = shown.join(pivot, "bucket").where("short <> v").select(F.col("short").alias("u"), "v").distinct()
    groups = components(candidates, "candidates").select(F.col("node").alias("short"), F.col("root").alias("grp"))
    members, _ = materialise(classes.join(groups, "short").select("set_key", "grp", "least", "mark"), "members")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches("minhash", _forget)
        for batch in batches:
            keys, sizes, all_found = [], [], []
            for text, want in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = shingles(text, k).tobytes()
                keep = hashlib.blake2b(x, digest_size=16).digest() == want
                keys.append(want if keep else None)
                sizes.append(len(x) // 8)
                all_found.append(x if keep else None)
            yield pa.record_batch([batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(all_found, pa.binary())], names=["grp", "key", "n_shingles", "found"])

    # the texts of documents in no candidate group stay where they are
    address = F.xxhash64(F.isnull("doc_id"), "doc_id", "mark")
    may, _ = split_by_bitmap(rows_in, address, members.select(F.col("least").alias("doc_id"), "mark"))
    wanted = members.select(F.col("least").alias("want_id"), F.col("mark").alias("want_mark"), "grp", "set_key")
    with_text = may.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("mark") == F.col("want_mark")))
    sets = with_text.select("text", "grp", "set_key").mapInArrow(again, "grp long, key binary, n_shingles long, found binary").where("key is not null")
    sets, _ = materialise(sets.dropDuplicates(["key"]), "sets")
    roots = components(_confirm(sets, percent), "links")
    whole = classes.join(roots, classes["set_key"] == roots["node"], "left").select("set_key", "least", F.coalesce("root", "set_key").alias("root"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = materialise(whole.join(least, "root").select(F.col("set_key").alias("key"), "component_id", "root"), "named")
    out = signed.join(named, signed["set_key"] == named["key"], "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    more = ["mark", "root"] if with_class else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more)
