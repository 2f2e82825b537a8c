"""Secret scans: Aho-Corasick keywords, anchored expressions near hits, checksum validation."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_and_text, use_caches

KINDS = ("assign", "access", "hex", "github", "npm")
#: Keywords of each kind, in lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ANCHORED = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
HEX = re.compile("[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits, as public token formats embed it."""
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0")


VALID = {
    "assign": lambda m: len(m[2]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: checksum62(m[1]) == m[2],
    "npm": lambda m: checksum62(m[1]) == m[2],
}


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind as an index of KINDS) in order; positions are code points, the end exclusive.

    Matches of a kind are leftmost and do not overlap; one that fails its check still takes its place.
    """
    hits = sorted((end - n + 1, kind) for end, (kind, n) in _automaton().iter(ascii_lower(text)))
    out, stop = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start >= stop[kind] and (m := ANCHORED[kind].match(text, start)):
            stop[kind] = m.end()
            if VALID[kind](m):
                out.append((start, m.end(), KINDS.index(kind)))
    out += [(m.start(), m.end(), KINDS.index("hex")) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def _told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def redact(text: str, found: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for start, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


SPANS = "n_assign long, n_access long, n_hex long, n_more long, base_sha256 string, spans string"


def scan_column(text: Column) -> Column:
    """struct of the counts, the digest of the base spans and all spans of a text column (null: empty)."""

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = spans(t) if t else []
            n = [sum(k == i for *_, k in found) for i in range(len(KINDS))]
            base = _told([x for x in found if x[2] < 3])
            rows.append((*n[:3], sum(n[3:]), hashlib.sha256(base.encode()).hexdigest(), _told(found)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SPANS.split(", ")])

    return scan(text)


def redact_column(text: Column) -> Column:
    """A text column with its secrets replaced (null stays null)."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        use_caches("secrets", int)
        return pd.Series([redact(t, spans(t)) if t else t for t in texts], dtype=object)

    return clean(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_more, base_sha256, spans.

    Null and empty texts have no spans; repeated rows come out repeated; other columns are not read.
    """
    return id_and_text(docs, id_col, text_col).select("doc_id", scan_column(F.col("text")).alias("found")).select("doc_id", "found.*")
