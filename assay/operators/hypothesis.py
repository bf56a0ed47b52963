"""Paired comparisons: signed-rank sums, effect sizes, and false-discovery control."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions import prob


RANGES = 1024  # of p values


def common_pairs(question_means: DataFrame, system: str = "model", value: str = "mean_score") -> DataFrame:
    """(model_a, model_b, question_id, a, b) of all unordered pairs of systems, over the questions both answered."""
    a = question_means.select(F.col(system).alias("model_a"), "question_id", F.col(value).alias("a"))
    b = question_means.select(F.col(system).alias("model_b"), "question_id", F.col(value).alias("b"))
    return a.join(b, "question_id").where("model_a < model_b")


def signed_rank(pairs: DataFrame, keys: tuple[str, ...] = ("model_a", "model_b")) -> DataFrame:
    """(keys, n_common, n_used, w_plus, w_minus, tie_term, statistic): zero differences are left out, ties share ranks."""
    # Pairs are counted by size first, up and down apart; a window over these counts gives each size its midrank, and one aggregate the rest.
    d = F.col("a") - F.col("b")
    held = pairs.select(*keys, F.abs(d).alias("size"), F.signum(d).alias("sign")).groupBy(*keys, "size").agg(F.count("*").alias("t"), F.count_if(F.col("sign") > 0).alias("up"), F.count_if(F.col("sign") < 0).alias("down"))
    used = F.when(F.col("size") > 0, F.col("t")).otherwise(0)
    below = F.coalesce(F.sum(used).over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = held.withColumn("used", used).withColumn("r", below + (F.col("t") + 1) / 2)
    other = F.col("size") > 0
    ties = F.when(other, F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).otherwise(0.0)
    out = ranked.groupBy(*keys).agg(F.sum("t").alias("n_common"), F.sum("used").alias("n_used"), F.sum(F.when(other, F.col("r") * F.col("up")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(other, F.col("r") * F.col("down")).otherwise(0.0)).alias("w_minus"), F.sum(ties).alias("tie_term"))
    return out.withColumn("statistic", F.least("w_plus", "w_minus"))


def with_p(df: DataFrame) -> DataFrame:
    """Adds p_value to signed_rank's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            p = [prob.signed_rank_p(w, n, t) for w, n, t in zip(d["statistic"], d["n_used"], d["tie_term"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "p_value"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", p_value double")


def rank_biserial(plus: Column, minus: Column) -> Column:
    return F.try_divide(plus - minus, plus + minus)


def mean_difference(a: Column, b: Column) -> Column:
    """Standardized by the root of the mean variance; 0 if neither varies."""
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return F.when(pooled > 0, F.try_divide(F.avg(a) - F.avg(b), pooled)).otherwise(0.0)


def effect_label(x: Column) -> Column:
    s = F.abs(x)
    return F.when(s < 0.1, "negligible").when(s < 0.3, "small").when(s < 0.5, "medium").otherwise("large")


def bh_adjust(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Adds bh_rank, adjusted (step-up, monotone, at most 1), significant, and threshold_flag (p against its own rank's bound, no step-up).

    Tests are sorted in RANGES ranges of p, so only the ranges' counts and minima meet in one task. A null p is no test: its
    row stays, with nulls."""
    ranged = df.withColumn("_range", F.when(F.col(p).isNotNull(), F.least(F.floor(F.col(p) * RANGES), F.lit(RANGES - 1))))
    own, every = Window.partitionBy("_range"), Window.orderBy("_range")
    counts = ranged.where(F.col(p).isNotNull()).groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_m"))
    ranked = ranged.join(counts, F.col("_range") == F.col("_r"), "left").withColumn("bh_rank", (F.col("_before") + F.row_number().over(own.orderBy(F.asc(p), F.asc(key)))).cast("int"))
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("bh_rank"))
    least = ranked.where(F.col(p).isNotNull()).groupBy("_range").agg(F.min("_raw").alias("_l"))
    least = least.select(F.col("_range").alias("_s"), F.min("_l").over(every.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    ranked = ranked.join(least, F.col("_range") == F.col("_s"), "left")
    inside = F.min("_raw").over(own.orderBy(F.desc("bh_rank")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), inside, F.coalesce("_later", F.lit(1.0)))))
    return ranked.withColumn("significant", F.col("adjusted") < alpha).withColumn("threshold_flag", F.col(p) <= F.col("bh_rank") / F.col("_m") * alpha).select(*df.columns, "bh_rank", "adjusted", "significant", "threshold_flag")
