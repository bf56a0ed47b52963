"""Means at response, question, domain and system grain, composites of domain means, and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_weights(weights: dict[int, float]) -> None:
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1.0")


def means(df: DataFrame, by: list[str], score: str, name: str = "mean_score") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(score).alias(name), F.count(score).alias("n"))


def question_means(df: DataFrame, score: str, words: str = "word_count", system: str = "model", carry: tuple[str, ...] = ("domain_id", "level", "is_trap")) -> DataFrame:
    """One row for each system and question; what depends on the question is carried by min."""
    return df.groupBy(system, "question_id").agg(*(F.min(c).alias(c) for c in carry), F.avg(score).alias("mean_score"), F.avg(words).alias("mean_words"), F.count("*").alias("n"))


def weight_table(spark, weights: dict[int, float]) -> DataFrame:
    return spark.createDataFrame([(int(k), float(v)) for k, v in weights.items()], "domain_id long, weight double")


def composite(domain_means: DataFrame, weights: dict[int, float], on_missing: str = "exclude", system: str = "model", value: str = "mean_score") -> DataFrame:
    """Weighted sum of domain means. A system without some domain is left out, or null with on_missing="null"."""
    check_weights(weights)
    wide = domain_means.groupBy(system).pivot("domain_id", sorted(weights)).agg(F.max(value))
    total = sum((F.col(str(k)) * F.lit(float(weights[k])) for k in sorted(weights)), F.lit(0.0))
    out = wide.select(system, total.alias("composite"))
    return out.dropna(subset=["composite"]) if on_missing == "exclude" else out


def equal_composite(domain_means: DataFrame, domains: list[int], system: str = "model", value: str = "mean_score") -> DataFrame:
    """Mean of the domain means of systems that have all domains."""
    own = domain_means.where(F.col("domain_id").isin(domains))
    return own.groupBy(system).agg(F.avg(value).alias("composite"), F.count(value).alias("n")).where(F.col("n") == len(domains)).drop("n")


def pair_differences(composites: DataFrame, pairs: list[tuple[str, str]], system: str = "model", value: str = "composite") -> DataFrame:
    """first - second for each configured pair; a pair with a missing system is left out."""
    own = composites.sparkSession.createDataFrame(pairs, "first string, second string")
    a = composites.select(F.col(system).alias("first"), F.col(value).alias("a"))
    b = composites.select(F.col(system).alias("second"), F.col(value).alias("b"))
    return own.join(a, "first").join(b, "second").select("first", "second", F.concat_ws("__minus__", "first", "second").alias("pair"), (F.col("a") - F.col("b")).alias("difference"))


def distribution(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Moments, extremes and shares of scores: sample deviation, population skewness and excess kurtosis."""
    x = F.col(score)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
        F.min(x).alias("low"), F.max(x).alias("high"), share(x < 2).alias("below_2"), share(x >= 3).alias("from_3"), share(x >= 4).alias("from_4"),
    )


def run_variance(df: DataFrame, score: str, system: str = "model", high: float = 0.15) -> DataFrame:
    """(system, question): runs, mean, sample deviation and variance, and coefficient of variation (null unless the mean is positive); groups of one run are left out."""
    own = df.groupBy(system, "question_id").agg(F.min("domain_id").alias("domain_id"), F.min("level").alias("level"), F.count("*").alias("runs"), F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("sd"), F.var_samp(score).alias("variance")).where("runs > 1")
    cv = F.when(F.col("mean_score") > 0, F.col("sd") / F.col("mean_score"))
    return own.withColumn("cv", cv).withColumn("is_high", F.coalesce(cv > high, F.lit(False)))


def with_median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with the median of value in each group beside each row: an aggregate joined back, so no group is held in one task."""
    return df.join(df.groupBy(*by).agg(F.median(value).alias(name)), by)


def rank_systems(df: DataFrame, score: str, name: str = "rank", system: str = "model", by: list[str] | None = None) -> DataFrame:
    """1, 2, ... by falling score, ties by name; over one row a system."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc(score), F.asc(system))))


def sentinel_rank(df: DataFrame, value: str, name: str, sentinel: float, out: str = "place") -> DataFrame:
    """1, 2, ... by rising value, a null standing where the sentinel would, ties by name; over one row a system."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.coalesce(F.col(value), F.lit(sentinel)), name)).cast("long"))


def midranks(df: DataFrame, value: str, name: str = "midrank", by: list[str] | None = None) -> DataFrame:
    """Ranks from 1 by rising value, ties sharing their mean; a null value has no rank and counts for none. Counts by distinct
    value come first, so the window sees a row a value."""
    keys = [f"_k{i}" for i in range(len(by or []))]
    held = df.where(F.col(value).isNotNull()).groupBy(*(F.col(b).alias(k) for b, k in zip(by or [], keys, strict=True)), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*keys, "_v", (below + (F.col("_n") + 1) / 2).alias(name))
    same = reduce(lambda a, b: a & b, (df[b].eqNullSafe(held[k]) for b, k in zip(by or [], keys, strict=True)), df[value] == held["_v"])
    return df.join(held, same, "left").drop(*keys, "_v")
