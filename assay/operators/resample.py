"""Cluster bootstraps as joins on a resample plan: (rep, question_id, mult), never a loop over replicates.

A plan says how often each replicate draws each question. Statistics depend on the data only through sums a question, so a
replicate's mean is sum(mult * sum) / sum(mult * n). Plans come from hashes (any size, no driver work, the same in every
engine), or from the Mersenne Twister and PCG-64 of the standard generators (small plans, made on the driver).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_plan(clusters: DataFrame, reps: int, seed: int, stratum: str | None = "domain_id") -> DataFrame:
    """clusters has a row a question. Within each stratum as many questions are drawn as it has, with replacement."""
    s = F.col(stratum) if stratum else F.lit(0)
    own = clusters.select(s.cast("long").alias("s"), "question_id")
    placed = own.withColumn("slot", F.row_number().over(Window.partitionBy("s").orderBy("question_id")) - 1)
    size = own.groupBy("s").agg(F.count("*").alias("size"))
    drawn = placed.join(size, "s").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    key = F.concat_ws(":", F.lit(seed), F.col("rep"), F.col("s"), F.col("slot"))
    drawn = drawn.select("rep", "s", (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.col("size")).alias("slot"))
    # Draws are counted by place before places become questions.
    counted = drawn.groupBy("rep", "s", "slot").agg(F.count("*").alias("mult"))
    return counted.join(placed, ["s", "slot"]).select("rep", "question_id", "mult")


def _counted(draws: list[list[int]]) -> list[tuple[int, int, int]]:
    out = []
    for rep, chosen in enumerate(draws):
        ids, n = np.unique(np.array(chosen, dtype=np.int64), return_counts=True)
        out += [(rep, int(i), int(k)) for i, k in zip(ids, n, strict=True)]
    return out


def mt19937_plan(spark, clusters: list[tuple[int, int]], reps: int, seed: int) -> DataFrame:
    """clusters: (domain, question). One generator; strata and their questions in ascending order."""
    rng, strata = random.Random(seed), {}
    for d, q in sorted(clusters):
        strata.setdefault(d, []).append(q)
    draws = [[rng.choice(own) for own in strata.values() for _ in own] for _ in range(reps)]
    return spark.createDataFrame(_counted(draws), "rep int, question_id long, mult long")


def pcg64_plan(spark, questions: list[int], reps: int, seed: int) -> DataFrame:
    """Unstratified: each replicate chooses as many questions as there are."""
    rng, own = np.random.default_rng(seed), np.array(sorted(questions))
    return spark.createDataFrame(_counted([rng.choice(own, size=len(own), replace=True).tolist() for _ in range(reps)]), "rep int, question_id long, mult long")


def sums(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """Sufficient statistics of each question and group: n, and a sum for each value."""
    return rows.groupBy("question_id", *by).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in values.items()))


def replicate_means(plan: DataFrame, stats: DataFrame, by: list[str], value: str) -> DataFrame:
    """(rep, by, mean)"""
    joined = plan.join(stats, "question_id")
    return joined.groupBy("rep", *by).agg((F.sum(F.col("mult") * F.col(value)) / F.sum(F.col("mult") * F.col("n"))).alias("mean"))


def row_means(rows: DataFrame, by: str | list[str], value: str, reps: int, seed: int, least: int = 1) -> DataFrame:
    """(rep, by, mean) of replicates that draw rows themselves, as many as a group has, with replacement.

    A mean depends only on how often each distinct value is drawn, and these counts are multinomial: no row is copied.
    Each group has a generator of its own, seeded by a hash of its keys. Null values are no rows; groups of fewer than ``least`` rows are left out."""
    keys = [by] if isinstance(by, str) else list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n")).withColumn("_seed", F.xxhash64(*(F.col(k).cast("string") for k in keys)))

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("value")
        x, n = own["value"].to_numpy(), own["n"].to_numpy()
        reps_here = reps if n.sum() >= least else 0
        rng = np.random.default_rng([seed, int(own["_seed"].iloc[0]) & (1 << 64) - 1])
        means = [rng.multinomial(n.sum(), n / n.sum()) @ x / n.sum() for _ in range(reps_here)]
        return pd.DataFrame({"rep": np.arange(reps_here), **{k: pd.Series([own[k].iloc[0]] * reps_here, dtype=own[k].dtype if own[k].dtype.kind in "if" else object) for k in keys}, "mean": means})

    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    return counts.groupBy(*keys).applyInPandas(draw, "rep int, " + ", ".join(f"`{k}` {types[k]}" for k in keys) + ", mean double")


def interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, reps, ci_low, ci_mid, ci_high): percentiles 2.5, 50 and 97.5 over replicates; nulls are dropped."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.count(x).alias("reps"), F.percentile(x, F.lit(0.025)).alias("ci_low"), F.percentile(x, F.lit(0.5)).alias("ci_mid"), F.percentile(x, F.lit(0.975)).alias("ci_high"))


def rank_bands(means: DataFrame, system: str = "model", value: str = "mean") -> DataFrame:
    """Ranks within each replicate, summed up: median rank, 95 % band, and how often first or among the first three."""
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc(value), F.asc(system))))
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    r = F.col("rank").cast("double")
    return ranked.groupBy(system).agg(F.percentile(r, F.lit(0.5)).alias("median_rank"), F.percentile(r, F.lit(0.025)).alias("rank_low"), F.percentile(r, F.lit(0.975)).alias("rank_high"), share(1).alias("top_1"), share(3).alias("top_3"))


def centred(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with both lanes less the mean of all scores, so that sums of squares keep their digits."""
    middle = rows.agg(((F.avg(a) + F.avg(b)) / 2).alias("_middle"))  # one row
    return rows.crossJoin(F.broadcast(middle)).withColumns({a: F.col(a) - F.col("_middle"), b: F.col(b) - F.col("_middle")})


def replicate_icc(plan: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    """(rep, n, icc_1, icc_k, pearson): agreement of two lanes in each replicate, from six sums a question."""
    x, y = F.col(a), F.col(b)
    stats = sums(centred(rows, a, b), [], sa=x, sb=y, saa=x * x, sbb=y * y, sab=x * y)
    m = F.col("mult")
    t = plan.join(stats, "question_id").groupBy("rep").agg(*(F.sum(m * F.col(c)).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    n, total = F.col("n"), F.col("sa") + F.col("sb")
    fix = total * total / (2 * n)
    ss_r = (F.col("saa") + F.col("sbb") + 2 * F.col("sab")) / 2 - fix
    ss_c = (F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / n - fix
    ms_r, ms_c = ss_r / F.nullif(n - 1, F.lit(0)), ss_c
    ms_e = (F.col("saa") + F.col("sbb") - fix - ss_r - ss_c) / F.nullif(n - 1, F.lit(0))
    vx, vy = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    r = F.when((vx > 0) & (vy > 0), F.try_divide(n * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy))))
    return t.select("rep", "n", F.try_divide(ms_r - ms_e, ms_r + ms_e + 2 * (ms_c - ms_e) / n).alias("icc_1"), F.try_divide(ms_r - ms_e, ms_r + (ms_c - ms_e) / n).alias("icc_k"), r.alias("pearson"))


def replicate_cells(plan: DataFrame, rows: DataFrame, keys: list[str], held: int = 400_000) -> DataFrame:
    """(rep, keys, w): how often each replicate draws each combination of values of the keys, which are numbers.

    A plan joined to the combinations of every question would have a row for each replicate, question and combination. Instead both meet
    partition by partition, in order of questions, and are multiplied as matrices, some ``held`` rows at a time; what is left to add
    up is a row for each replicate and combination."""
    cells = rows.groupBy("question_id", *keys).agg(F.count("*").alias("mult")).select("question_id", F.lit(None).cast("int").alias("rep"), "mult", *(F.col(k).cast("double").alias(k) for k in keys))
    drawn = plan.select("question_id", F.col("rep").cast("int").alias("rep"), F.col("mult").cast("long").alias("mult"), *(F.lit(None).cast("double").alias(k) for k in keys))

    def multiply(some: pd.DataFrame) -> pd.DataFrame | None:
        is_cell = some["rep"].isna().to_numpy()
        own, draws = some[is_cell], some[~is_cell]
        if not len(own) or not len(draws):
            return None
        questions, q = np.unique(np.concatenate([own["question_id"].to_numpy(), draws["question_id"].to_numpy()]), return_inverse=True)
        values, cell = np.unique(own[keys].to_numpy(np.float64), axis=0, return_inverse=True)
        reps, rep = np.unique(draws["rep"].to_numpy(np.int64), return_inverse=True)
        left, right = np.zeros((len(reps), len(questions))), np.zeros((len(questions), len(values)))
        right[q[: len(own)], cell.ravel()] = own["mult"].to_numpy()
        left[rep, q[len(own) :]] = draws["mult"].to_numpy()
        w = left @ right
        i, j = np.nonzero(w)
        return pd.DataFrame({"rep": reps[i].astype(np.int32), **{k: values[j, n] for n, k in enumerate(keys)}, "w": w[i, j].astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            rest.append(batch)
            if sum(map(len, rest)) > held:
                whole = pd.concat(rest)
                last = whole["question_id"].iloc[-1]  # it may go on in the next batch
                done, rest = whole[whole["question_id"] != last], [whole[whole["question_id"] == last]]
                if (out := multiply(done)) is not None:
                    yield out
        if rest and (out := multiply(pd.concat(rest))) is not None:
            yield out

    form = "rep int, " + ", ".join(f"`{k}` double" for k in keys) + ", w long"
    met = cells.unionByName(drawn).repartition("question_id").sortWithinPartitions("question_id")
    return met.mapInPandas(run, form).groupBy("rep", *keys).agg(F.sum("w").alias("w"))


def replicate_reliability(plan: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    """(rep, n, all measures of agreement of lanes a and b): all follow from how often each pair of scores is drawn."""
    x, y, w, rep = F.col(a), F.col(b), F.col("w"), Window.partitionBy("rep")
    cells = replicate_cells(plan, rows, [a, b])

    def midrank(c: Column, name: str) -> Column:
        upto = F.sum("w").over(rep.orderBy(name).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return upto - (F.sum("w").over(Window.partitionBy("rep", name)) - 1) / 2

    n = F.sum("w").over(rep)
    middle = F.sum(w * (x + y)).over(rep) / (2 * n)  # sums of squares keep their digits around it
    cells = cells.withColumns({"_n": n, "_m": middle, "_rx": midrank(x, a) - (n + 1) / 2, "_ry": midrank(y, b) - (n + 1) / 2})
    u, v, d, s = F.col(a) - F.col("_m"), F.col(b) - F.col("_m"), F.col(b) - F.col(a), F.abs(F.col(b) - F.col(a))
    share = lambda c: F.sum(F.when(c, w).otherwise(0)) / F.sum(w)
    t = cells.groupBy("rep").agg(
        F.sum(w).alias("n"), *(F.sum(w * e).alias(k) for k, e in (("su", u), ("sv", v), ("suu", u * u), ("svv", v * v), ("suv", u * v), ("rxx", F.col("_rx") * F.col("_rx")), ("ryy", F.col("_ry") * F.col("_ry")), ("rxy", F.col("_rx") * F.col("_ry")), ("sabs", s))),
        F.percentile(d, F.lit(0.025), w).alias("empirical_low"), F.percentile(d, F.lit(0.975), w).alias("empirical_high"),
        share(s < 1e-9).alias("exact"), share(s <= 0.25).alias("within_25"), share(s <= 0.5).alias("within_50"), share(s <= 1.0).alias("within_100"),
    )
    c = F.col
    more = F.nullif(c("n") - 1, F.lit(0))
    mean, ss_d = (c("sv") - c("su")) / c("n"), c("suu") + c("svv") - 2 * c("suv")
    sd = F.sqrt(F.greatest(F.lit(0.0), (ss_d - c("n") * mean * mean) / more))
    # Around the middle both lanes' sums add up to 0.
    ms_r, ms_c = (c("suu") + c("svv") + 2 * c("suv")) / 2 / more, (c("su") * c("su") + c("sv") * c("sv")) / c("n")
    ms_e = (c("suu") + c("svv")) / more - ms_r - ms_c / more
    vx, vy = c("suu") - c("su") * c("su") / c("n"), c("svv") - c("sv") * c("sv") / c("n")
    r = F.when((vx > 0) & (vy > 0), F.try_divide(c("suv") - c("su") * c("sv") / c("n"), F.sqrt(F.when(vx > 0, vx)) * F.sqrt(F.when(vy > 0, vy))))
    rho = F.when((c("rxx") > 0) & (c("ryy") > 0), F.try_divide(c("rxy"), F.sqrt("rxx") * F.sqrt("ryy")))
    return t.select(
        "rep", "n", mean.alias("mean_diff"), (c("sabs") / c("n")).alias("mean_abs_diff"), sd.alias("sd_diff"), r.alias("pearson"), rho.alias("spearman"), "exact", "within_25", "within_50", "within_100",
        (mean - 1.96 * sd).alias("normal_low"), (mean + 1.96 * sd).alias("normal_high"), "empirical_low", "empirical_high",
        F.try_divide(ms_r - ms_e, ms_r + ms_e + 2 * (ms_c - ms_e) / c("n")).alias("icc_1"), F.try_divide(ms_r - ms_e, ms_r + (ms_c - ms_e) / c("n")).alias("icc_k"),
    )


def replicate_spearman(plan: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    """(rep, spearman): weighted midranks from each replicate's counts of distinct scores."""
    held = plan.join(rows.groupBy("question_id", a, b).agg(F.count("*").alias("n")), "question_id")
    held = held.groupBy("rep", a, b).agg(F.sum(F.col("mult") * F.col("n")).alias("w"))
    for x, r in ((a, "rx"), (b, "ry")):
        one = held.groupBy("rep", x).agg(F.sum("w").alias("t"))
        below = F.coalesce(F.sum("t").over(Window.partitionBy("rep").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = held.join(one.select("rep", x, (below + (F.col("t") + 1) / 2).alias(r)), ["rep", x])
    # Ranks have the mean (n + 1) / 2, ties or not.
    held = held.join(held.groupBy("rep").agg(((F.sum("w") + 1) / 2).alias("middle")), "rep")
    w, x, y = F.col("w"), F.col("rx") - F.col("middle"), F.col("ry") - F.col("middle")
    vx, vy = F.sum(w * x * x), F.sum(w * y * y)
    return held.groupBy("rep").agg(F.when((vx > 0) & (vy > 0), F.try_divide(F.sum(w * x * y), F.sqrt(vx) * F.sqrt(vy))).alias("spearman"))


def replicate_rates(plan: DataFrame, rows: DataFrame, diff: str, exact_below: float = 1e-9) -> DataFrame:
    """(rep, mean_diff, mean_abs_diff, sd_diff, normal_low, normal_high, exact, within_25, within_50, within_100) from sums a question."""
    middle = rows.agg(F.avg(diff).alias("_middle"))  # one row: squares keep their digits around it
    d, size = F.col("_d"), F.abs(F.col(diff))
    own = rows.crossJoin(F.broadcast(middle)).withColumn("_d", F.col(diff) - F.col("_middle"))
    hit = lambda c: F.when(c, 1).otherwise(0)
    stats = sums(own, [], s=d, ss=d * d, sabs=size, exact=hit(size < exact_below), within_25=hit(size <= 0.25), within_50=hit(size <= 0.5), within_100=hit(size <= 1.0))
    m = F.col("mult")
    t = plan.join(stats, "question_id").groupBy("rep").agg(*(F.sum(m * F.col(c)).alias(c) for c in ("n", "s", "ss", "sabs", "exact", "within_25", "within_50", "within_100")))
    t = t.crossJoin(F.broadcast(middle)).withColumn("mean_diff", F.col("s") / F.col("n") + F.col("_middle"))
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1))))
    t = t.withColumn("sd_diff", sd).withColumns({"normal_low": F.col("mean_diff") - 1.96 * F.col("sd_diff"), "normal_high": F.col("mean_diff") + 1.96 * F.col("sd_diff")})
    return t.select("rep", "mean_diff", (F.col("sabs") / F.col("n")).alias("mean_abs_diff"), "sd_diff", "normal_low", "normal_high", *((F.col(c) / F.col("n")).alias(c) for c in ("exact", "within_25", "within_50", "within_100")))


def replicate_limits(plan: DataFrame, rows: DataFrame, diff: str) -> DataFrame:
    """(rep, low, high): empirical 2.5 and 97.5 percentiles of differences in each replicate, by frequency."""
    held = plan.join(rows.groupBy("question_id", diff).agg(F.count("*").alias("n")), "question_id")
    held = held.groupBy("rep", diff).agg(F.sum(F.col("mult") * F.col("n")).alias("w"))
    return held.groupBy("rep").agg(F.percentile(diff, F.lit(0.025), F.col("w")).alias("low"), F.percentile(diff, F.lit(0.975), F.col("w")).alias("high"))
