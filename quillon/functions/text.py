"""Text, list and JSON expressions. Every function returns a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, ratio


def ranked_text(entries: Column | str, digits: int = 6) -> Column:
    """`1:gene=value;2:...` of an array of structs (rank, gene, value), by rank; values to `digits` significant digits."""
    one = lambda e: F.concat(e["rank"].cast("string"), F.lit(":"), e["gene"].cast("string"), F.lit("="), significant(e["value"], digits))
    return F.array_join(F.transform(F.array_sort(entries), one), ";")


def significant(x: Column, digits: int = 6) -> Column:
    """The shortest plain decimal of x rounded to `digits` significant digits."""
    size = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1.0) - size)
    value = F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / F.nullif(scale, F.lit(0.0)))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.15f", F.round(value, 12)), "0+$", ""), r"\.$", "")
    return plain


def themes(x: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The names of the patterns found in a text, in either case, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(F.coalesce(col(x), F.lit("")).rlike("(?i)" + pattern), name) for name, pattern in rules]))


def extract(x: Column | str, pattern: str, group: int = 1, kind: str = "string") -> Column:
    """The first match's group; NULL without a match."""
    return F.nullif(F.regexp_extract(col(x), pattern, group), F.lit("")).try_cast(kind)


def cleaned(x: Column | str, prefix: str = "", suffix: str = "") -> Column:
    """Trimmed, with dashes of any kind as hyphens, inner blanks as one, and a prefix and suffix taken off."""
    out = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(col(x), "[‐-―−]", "-"), r"\s+", " ")), "^" + prefix, "") if prefix else F.trim(F.regexp_replace(F.regexp_replace(col(x), "[‐-―−]", "-"), r"\s+", " "))
    return F.regexp_replace(out, suffix + "$", "") if suffix else out


def prefix_share(items: Column | str, prefixes: Sequence[str]) -> Column:
    """The share of a list's items that start with one of the prefixes; NULL for an empty list."""
    starts = lambda s: F.coalesce(*[F.when(s.startswith(p), True) for p in prefixes], F.lit(False))
    return ratio(F.size(F.filter(col(items), starts)), F.size(col(items)))


def is_technical(items: Column | str, label: Column | str, words: Sequence[str], shares: Sequence[tuple[Sequence[str], float]]) -> Column:
    """Whether a label holds one of the words or a share of the items starts with technical prefixes."""
    named = F.coalesce(F.lower(col(label)).rlike("|".join(words)), F.lit(False))
    for prefixes, least in shares:
        named = named | F.coalesce(prefix_share(items, prefixes) >= least, F.lit(False))
    return named


def signed_tokens(gene: Column | str, x: Column | str) -> Column:
    """`gene__pos` or `gene__neg` by the sign; NULL at 0."""
    return F.when(col(x) > 0, F.concat(col(gene), F.lit("__pos"))).when(col(x) < 0, F.concat(col(gene), F.lit("__neg")))


def slug(x: Column | str) -> Column:
    """Lower case, other signs than letters and digits as single underscores, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def p_text(p: Column | str) -> Column:
    """A p-value for a report: `<0.001`, else three decimals; `NA` for NULL."""
    x = col(p)
    return F.when(x.isNull(), "NA").when(x < 0.001, "<0.001").otherwise(F.format_string("%.3f", x))


def json_row(*columns: str) -> Column:
    """The columns as a JSON object, missing values as null and never as NaN."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def json_map(keys: Column | str, values: Column | str) -> Column:
    """A map with its keys as text, as JSON."""
    return F.to_json(F.map_from_arrays(F.transform(col(keys), lambda k: k.cast("string")), col(values)))


def annotation_items(x: Column | str, sep: str = r"\|") -> Column:
    """`term:NES=1.2|term2:NES=..` as an array of (term, value)."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), sep), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(F.regexp_extract(s, "^(.*?)(:NES=|$)", 1).alias("term"), F.regexp_extract(s, ":NES=(.*)$", 1).try_cast("double").alias("value")))


def under_path(x: Column | str, path: str, sep: str = "/") -> Column:
    """Whether a path is the given one or below it."""
    return (col(x) == path) | col(x).startswith(path + sep)


def hash_seed(*parts: Column | str, bits: int = 32) -> Column:
    """A stable whole number of text parts, from SHA-256."""
    return F.conv(F.substr(F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256), F.lit(1), F.lit(bits // 4)), 16, 10).cast("long")


def position_path(position: Column | str, ranges: Sequence[tuple[int, int, str]]) -> Column:
    """The name of the range (first, last, both inside) that a position of an ordered list lies in; NULL outside."""
    out = F.lit(None).cast("string")
    for first, last, name in reversed(ranges):
        out = F.when(col(position).between(first, last), name).otherwise(out)
    return out


def category_order(x: Column | str, order: Sequence[str]) -> Column:
    """The place of a category in a given order, others after all of them: a key to sort by."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), col(x)), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))
