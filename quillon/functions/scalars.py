"""Row-level expressions: null policy, labels, bins and text rules. Every function returns a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean true.
TRUE_WORDS = ("true", "1", "yes", "hot", "cold")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """The value as double; NaN and infinities become NULL."""
    v = col(x).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def numeric(x: Column | str) -> Column:
    """Text to double; what can't be read becomes NULL."""
    return finite(col(x).cast("string").try_cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in double; NULL where b is 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def truthy(x: Column | str) -> Column:
    """Text booleans: true, 1, yes, hot, cold, in either case, and numbers over 0; NULL is false."""
    text = F.lower(F.trim(col(x).cast("string")))
    return F.coalesce(text.isin(*TRUE_WORDS), F.lit(False)) | F.coalesce(numeric(text) > 0, F.lit(False))


def composite_key(*parts: Column | str, sep: str = "__") -> Column:
    return F.concat_ws(sep, *[col(p).cast("string") for p in parts])


def cap_scale(x: Column | str, cap: float = 3.0, flip: bool = False, digits: int = 6) -> Column:
    """Clipped to [-cap, cap], divided by cap, its sign turned if asked."""
    y = F.greatest(F.lit(-cap), F.least(F.lit(cap), col(x).cast("double"))) / F.lit(cap)
    return F.round(-y if flip else y, digits)


def stars(q: Column | str) -> Column:
    """Significance marks of an adjusted p-value."""
    x = col(q)
    return F.when(x.isNull(), F.lit("")).when(x <= 1e-4, "****").when(x <= 1e-3, "***").when(x <= 1e-2, "**").when(x <= 0.05, "*").otherwise("")


def strength(r: Column | str, cuts: Sequence[float] = (0.10, 0.20, 0.35), names: Sequence[str] = ("negligible", "weak", "moderate", "strong"), missing: str = "not_available") -> Column:
    """The class of an effect's absolute size."""
    x = F.abs(finite(r))
    out = F.when(x.isNull(), missing)
    for cut, name in zip(cuts, names):
        out = out.when(x < cut, name)
    return out.otherwise(names[-1])


def sign_pattern(a: Column | str, b: Column | str, names: Sequence[str] = ("both_positive", "both_negative", "first_only_positive", "second_only_positive", "undefined")) -> Column:
    """How the signs of two effects go together, in five labels; a zero counts as not positive, NULL as undefined."""
    x, y = finite(a), finite(b)
    return F.when(x.isNull() | y.isNull(), names[4]).when((x > 0) & (y > 0), names[0]).when((x <= 0) & (y <= 0), names[1]).when(x > 0, names[2]).otherwise(names[3])


def direction(x: Column | str, up: str = "enriched", down: str = "depleted", none: str = "none") -> Column:
    return F.when(col(x) > 0, up).when(col(x) < 0, down).otherwise(none)


def tier(n: Column | str, cuts: Sequence[int] = (1, 3), names: Sequence[str] = ("sample_specific", "subset_specific", "cohort_recurrent")) -> Column:
    """Recurrence by the number of samples: up to the first cut, up to the second, more."""
    out = F.when(col(n).isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names):
        out = out.when(col(n) <= cut, name)
    return out.otherwise(names[-1])


def cascade(rules: Sequence[tuple[Column, str, str]], label: str, reason: str) -> Column:
    """struct(label, reason) of the first rule that holds."""
    out = F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
    for test, name, why in reversed(rules):
        out = F.when(test, F.struct(F.lit(name).alias("label"), F.lit(why).alias("reason"))).otherwise(out)
    return out


def normalise_label(x: Column | str, rules: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first substring found, in either case."""
    low = F.lower(col(x))
    out = F.lit(other) if other is not None else col(x)
    for part, name in reversed(rules):
        out = F.when(F.contains(low, F.lit(part)), name).otherwise(out)
    return out


def first_known(*xs: Column | str) -> Column:
    """The first value that is neither NULL nor blank."""
    return F.coalesce(*[F.when(F.trim(col(x)) != "", col(x)) for x in xs])


def signed_z(effect: Column | str, z: Column | str) -> Column:
    """Z with the effect's sign; 0 where the effect is 0."""
    return F.signum(col(effect).cast("double")) * F.abs(col(z).cast("double"))


def list_items(x: Column | str, sep: str = ";") -> Column:
    """The sorted distinct non-blank items of a list kept as text."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), sep), lambda s: F.trim(s)), lambda s: s != "")))


def quadratic_features(x: Column | str, y: Column | str) -> Column:
    """x, y, x^2, xy, y^2 as an array."""
    a, b = col(x).cast("double"), col(y).cast("double")
    return F.array(a, b, a * a, a * b, b * b)


def zero_replaced(parts: Sequence[str], delta: float) -> list[Column]:
    """Multiplicative replacement: zeros become delta, the others shrink by what the zeros took."""
    zeros = sum((F.when(F.col(p) == 0, 1.0).otherwise(0.0) for p in parts), F.lit(0.0))
    return [F.when(F.col(p) == 0, delta).otherwise(F.col(p).cast("double") * (1.0 - zeros * delta)) for p in parts]


def closed(parts: Sequence[str]) -> list[Column]:
    """Each part over the row's sum; NULL where the sum is 0."""
    total = sum((F.col(p).cast("double") for p in parts), F.lit(0.0))
    return [ratio(p, total) for p in parts]


def balance(plus: Sequence[Column], minus: Sequence[Column]) -> Column:
    """The isometric log-ratio balance of two groups of positive parts."""
    r, s = len(plus), len(minus)
    root = (r * s / (r + s)) ** 0.5
    mean = lambda xs: sum((F.ln(x) for x in xs), F.lit(0.0)) / float(len(xs))
    return F.lit(root) * (mean(plus) - mean(minus))


def fisher_z(r: Column | str, clip: float = 0.999999) -> Column:
    x = F.greatest(F.lit(-clip), F.least(F.lit(clip), col(r)))
    return F.lit(0.5) * F.ln((F.lit(1.0) + x) / (F.lit(1.0) - x))
