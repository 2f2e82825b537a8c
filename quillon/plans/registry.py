"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cohort import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY = ["dataset", "sample"]


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, and -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rank_sql(x: str, by: str = "dataset, sample") -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


CORR = "CASE WHEN count(*) >= 3 AND var_pop({x}) > 1e-24 AND var_pop({y}) > 1e-24 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"

#: Tails in DuckDB's SQL by Simpson's rule, independent of the library's continued fractions.
STEPS = 2000
SIMPSON = f"simpson AS (SELECT i / {STEPS}.0 AS u, CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / (3.0 * {STEPS}) AS w FROM range(0, {STEPS + 1}) r(i))"


def normal_sql(z: str) -> str:
    x = f"least(abs({z}), 12.0)"
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(0, 1 - 2 * {x} / sqrt(2 * pi()) * (SELECT sum(w * exp(-0.5 * ({x} * u) ** 2)) FROM simpson)) END"


def student_sql(t: str, v: str) -> str:
    angle = f"atan(least(abs({t}), 60.0) / sqrt({v}))"
    return f"CASE WHEN {t} IS NOT NULL AND {v} > 0 THEN greatest(0, 1 - 2 * exp(lgamma((({v}) + 1) / 2.0) - lgamma(({v}) / 2.0)) / sqrt(pi()) * {angle} * (SELECT sum(w * cos({angle} * u) ** (({v}) - 1)) FROM simpson)) END"


def chi_square_sql(x: str, v: str) -> str:
    root = f"sqrt(least({x}, 900.0))"
    return f"greatest(0, 1 - 2 * {root} / exp(({v}) / 2.0 * ln(2) + lgamma(({v}) / 2.0)) * (SELECT sum(w * ({root} * u) ** (({v}) - 1) * exp(-0.5 * ({root} * u) ** 2)) FROM simpson))"


def f_sql(f: str, d1: str, d2: str) -> str:
    angle = f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))"
    beta = f"exp(lgamma(({d1}) / 2.0) + lgamma(({d2}) / 2.0) - lgamma((({d1}) + ({d2})) / 2.0))"
    return f"greatest(0, 2 / {beta} * {angle} * (SELECT sum(w * sin({angle} * u) ** (({d2}) - 1) * cos({angle} * u) ** (({d1}) - 1)) FROM simpson))"
