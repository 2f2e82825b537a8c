"""URL filters: host and path rules, and a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed values: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The vocabulary: terms and their weights, in the singular (plurals are made by rule). A url is rejected when the
#: weights of its different terms reach LIMIT: a strict term alone, soft ones together. Host names are not listed.
LIMIT = 4
STRICT = ("bdsm", "bukkake", "camgirl", "cialis", "creampie", "fentanyl", "gangbang", "hardcore", "hentai", "hookup", "malware", "milf", "onlyfans", "payday", "phishing", "porn", "porno", "pornhub", "sexcam", "stripclub", "threesome", "torrent", "viagra", "warez", "webcam-girl", "xvideo", "xxx")
SOFT = (
    "adult", "bet", "betting", "bingo", "bonus", "casino", "cheap", "crack", "dating", "deal", "discount", "drug", "escort", "fetish", "free", "gambling", "hack", "hot", "jackpot", "keygen", "loan", "lottery",
    "naked", "nude", "pharmacy", "pill", "poker", "prize", "replica", "roulette", "sex", "sexy", "singles", "slot", "spam", "steroid", "webcam", "win", "winner",
)
VOCABULARY = {**dict.fromkeys(SOFT, 2), **dict.fromkeys(STRICT, LIMIT)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def forms(term: str) -> tuple[str, ...]:
    """A term and its plural: both count as the term."""
    plural = term + "es" if term.endswith(("s", "x", "ch", "sh")) else term[:-1] + "ies" if term.endswith("y") and term[-2:-1] not in tuple("aeiou") else term + "s"
    return term, plural


@functools.lru_cache(4)
def _automaton(vocabulary: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        for form in forms(term):
            found.add_word(form, (form, term, weight))
    found.make_automaton()
    return found


def hits(url: str, vocabulary: tuple[tuple[str, int], ...] = tuple(VOCABULARY.items()), limit: int = LIMIT) -> tuple[int, int, int]:
    """(strict terms, soft terms, their weights' sum) of a url: different terms with no letter or digit on either side."""
    low = ascii_lower(url)
    inside = lambda i: 0 <= i < len(low) and low[i].isascii() and low[i].isalnum()
    found = {(term, w) for end, (form, term, w) in _automaton(vocabulary).iter(low) if not inside(end + 1) and not inside(end - len(form))}
    return sum(w >= limit for _, w in found), sum(w < limit for _, w in found), sum(w for _, w in found)


def _hits_column(url: Column, vocabulary: tuple[tuple[str, int], ...], limit: int) -> Column:
    @F.pandas_udf("strict_hits long, soft_hits long, weight long")
    def count(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(u, vocabulary, limit) if u else (0, 0, 0) for u in urls], columns=["strict_hits", "soft_hits", "weight"])

    return count(url)


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, weight for every row.

    Of the rules that fit, the longest decides; without one the vocabulary does. A null url or one without
    `://` has an empty host and path, fits no rule, and its terms still count. A very long url is read whole.
    Rows come out as often as they come in; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    rows = rows.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"), _hits_column(F.col("url"), tuple(vocabulary.items()), limit).alias("hits"))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "hits.strict_hits", "hits.soft_hits", "hits.weight")


def judge_urls_sql(rules=RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> str:
    """The same in DuckDB."""
    has = lambda w: f"CAST(regexp_matches(low, '(^|[^a-z0-9])({'|'.join(forms(w))})([^a-z0-9]|$)') AS BIGINT)"
    count = lambda words: " + ".join(map(has, words)) or "0"
    strict, soft = ([w for w, x in vocabulary.items() if (x >= limit) == hard] for hard in (True, False))
    weight = " + ".join(f"{x} * ({count([w for w, y in vocabulary.items() if y == x])})" for x in sorted(set(vocabulary.values()))) or "0"
    cases = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in cases)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in cases)
    lowered = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"""
    WITH cut AS (
      SELECT page_id, {lowered("coalesce(url, '')")} AS low,
             {lowered("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages),
    hit AS (SELECT *, {count(strict)} AS strict_hits, {count(soft)} AS soft_hits, {weight} AS weight FROM cut)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN weight >= {limit} THEN 'block' ELSE 'allow' END AS verdict,
           strict_hits, soft_hits, weight
    FROM hit"""
