"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import use_caches

#: n-grams of a profile, and those of a document that are compared.
PROFILE = 400
#: Languages that a model may hold; more are an error (the model is broadcast: 5 kB a language).
MAX_LANGS = 2_000
UNKNOWN = "und"
#: Characters whose n-grams are counted at once (some 30 bytes each), and one text more at most.
COUNTED = 4_000_000


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_codes(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of the words of a text, lower-cased, words being runs of letters.

    A word stands between two blanks (code point 1); no n-gram spans two words or is a blank alone. A code
    holds up to three code points of 21 bits, none of them 0, so n-grams of different lengths differ.
    """
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.concatenate([[1], np.where(_letters()[points], points, 1), [1]])
    points = points[(points != 1) | np.append(True, points[:-1] != 1)]
    if len(points) < 3:
        return np.empty(0, np.int64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    return np.concatenate([points[points != 1], (points[:-1] << 21) | points[1:], ((a << 42) | (b << 21) | c)[b != 1]])


def ranked(text: str | None, top: int = PROFILE) -> np.ndarray:
    """The codes of the most frequent n-grams, most frequent first, ties to the smaller code."""
    codes = ngram_codes(text)
    if not len(codes):
        return codes
    codes.sort()
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    counts = np.diff(np.append(at, len(codes)))
    return codes[at[np.argsort(-counts, kind="stable")[:top]]]


def count_ngrams(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, code, n) over all rows: tasks add up their own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in total.items():
                for a in range(0, len(codes), 50_000):
                    part = codes[a : a + 50_000]
                    yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[a : a + 50_000])], names=["lang", "code", "n"])
            total.clear()

        def add(lang: str, texts: list[str]) -> None:
            codes, counts = np.unique(ngram_codes("\n".join(texts)), return_counts=True)
            if lang in total:
                both = np.concatenate([total[lang][0], codes])
                codes, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate([total[lang][1], counts])).astype(np.int64)
            total[lang] = (codes, counts)

        for batch in batches:
            by: dict[str, list[str]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    if size[lang] >= COUNTED:
                        add(lang, by.pop(lang))
                        size[lang] = 0
            for lang, texts in by.items():
                add(lang, texts)
            if sum(len(x[0]) for x in total.values()) > 1_000_000:
                yield from out()
        yield from out()

    found = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = PROFILE) -> dict[str, list[int]]:
    """A profile for each language: its `top` most frequent n-grams over all rows, most frequent first.

    Rows with null language or without letters teach nothing. The profiles are bounded (top * MAX_LANGS).
    """
    counts = count_ngrams(rows.where(F.col(lang_col).isNotNull()), lang_col, text_col)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    kept = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    model: dict[str, list[int]] = {}
    for lang, codes in kept.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes")).limit(MAX_LANGS + 1).collect():
        model[lang] = list(codes)
    if len(model) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return dict(sorted(model.items()))


class Judge:
    """Out-of-place distances of a text to each profile."""

    def __init__(self, model: dict[str, list[int]], top: int = PROFILE):
        self.langs, self.top = sorted(model), top
        self.codes = np.unique(np.concatenate([np.array(model[x], np.int64) for x in self.langs])) if model else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, model[x])] = np.arange(len(model[x]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        mine = ranked(text, self.top)
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        there = self.ranks[:, np.where(self.codes[at] == mine, at, len(self.codes))]
        far = np.where(there < 0, self.top, np.abs(there - np.arange(len(mine)))).sum(1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.top * len(mine)))


def predict(text: Column, model: dict[str, list[int]], top: int = PROFILE) -> Column:
    """struct(lang_pred, score) of a text column: the nearest profile (ties: the first by name) and 1 - distance / largest distance.

    A null text, one without letters and an empty model give `und` and 0.
    """

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        use_caches("languages", int)
        use = _judge(tuple((k, tuple(v)) for k, v in model.items()), top)
        return pd.DataFrame([use(t) for t in texts], columns=["lang_pred", "score"])

    return judge(text)


@functools.lru_cache(2)
def _judge(model: tuple, top: int) -> Judge:
    return Judge({k: list(v) for k, v in model}, top)


def held_out(doc_id: Column) -> Column:
    """The fold that teaches nothing: crc32 of the id's text, modulo 4, is 2 (a null id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from those not held out.

    Nothing but the text enters a prediction. Null and empty texts are `und`; repeated rows come out
    repeated; an empty table gives no rows; further columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"))
    model = learn(rows.where(~F.col("held_out")))
    return rows.select("doc_id", "held_out", predict(F.col("text"), model).alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")
