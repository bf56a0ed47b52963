"""Agreement of lanes: correlations, intraclass correlation, Bland-Altman limits and tolerance rates, from centred moments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.aggregates import midranks


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two rows or a constant column, where the built-in corr would fail. Both null-free."""
    return F.when(varies(x) & varies(y), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def varies(x: Column) -> Column:
    """Are there two values that differ?"""
    return F.coalesce(F.min(x) < F.max(x), F.lit(False))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    ranked = midranks(midranks(df.select(*keys, x, y), x, "_rx", keys), y, "_ry", keys)
    return ranked.groupBy(*keys).agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def icc(raters: list[Column]) -> dict[str, Column]:
    """Two-way, absolute agreement: mean squares, and the coefficients of one rater (icc_1) and of the mean of k (icc_k).

    Null for fewer than two rows, or where the denominator is 0."""
    k, plus = len(raters), lambda xs: reduce(lambda a, b: a + b, xs)
    n, means = F.count(raters[0]), [F.avg(r) for r in raters]
    grand = plus(means) / k
    ss_r = n * k * F.var_pop(plus(raters) / k)
    ss_c = n * plus((m - grand) * (m - grand) for m in means)
    ss_e = n * plus(F.var_pop(r) for r in raters) - ss_r
    df_r = F.nullif(n - 1, F.lit(0))
    ms_r, ms_c, ms_e = ss_r / df_r, ss_c / (k - 1), ss_e / (df_r * (k - 1))
    one = F.try_divide(ms_r - ms_e, ms_r + (k - 1) * ms_e + k * (ms_c - ms_e) / F.nullif(n, F.lit(0)))
    many = F.try_divide(ms_r - ms_e, ms_r + (ms_c - ms_e) / F.nullif(n, F.lit(0)))
    return {"ms_r": ms_r, "ms_c": ms_c, "ms_e": ms_e, "icc_1": F.when(n > 1, one), "icc_k": F.when(n > 1, many)}


def limits(d: Column) -> dict[str, Column]:
    """Bland-Altman limits of differences: normal, and empirical 2.5 and 97.5 percentiles."""
    m, s = F.avg(d), F.stddev_samp(d)
    return {"mean_diff": m, "sd_diff": s, "normal_low": m - 1.96 * s, "normal_high": m + 1.96 * s, "empirical_low": F.percentile(d, F.lit(0.025)), "empirical_high": F.percentile(d, F.lit(0.975))}


def rates(d: Column, exact_below: float = 1e-9) -> dict[str, Column]:
    """Shares of equal scores and of differences within 0.25, 0.5 and 1."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return {"exact": share(F.abs(d) < exact_below), "within_25": share(F.abs(d) <= 0.25), "within_50": share(F.abs(d) <= 0.5), "within_100": share(F.abs(d) <= 1.0)}


def columns(parts: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in parts.items()]


def reliability(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with all agreement figures of lanes a and b (differences are b - a)."""
    x, y, d = F.col(a), F.col(b), F.col(b) - F.col(a)
    two = icc([x, y])
    row = df.agg(F.count("*").alias("n"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.avg(F.abs(d)).alias("mean_abs_diff"), pearson(x, y).alias("pearson"), two["icc_1"].alias("icc_1"), two["icc_k"].alias("icc_k"), *columns(limits(d)), *columns(rates(d)))
    return row.crossJoin(spearman(df, a, b))  # one row beside one row
