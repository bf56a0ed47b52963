"""Least squares from sums: simple regressions in one pass, and fixed-effect models through a small Gramian."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import prob
from assay.operators.agreement import pearson, varies


def slope(x: Column, y: Column) -> Column:
    """Null for constant x."""
    return F.when(varies(x), F.try_divide(F.covar_pop(x, y), F.var_pop(x)))


def simple_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean_x, mean_y, slope, intercept, r, r2, se): se is the slope's standard error, null for fewer than three rows."""
    a, b = F.col(x), F.col(y)
    n, r = F.count(a), pearson(a, b)
    out = df.groupBy(*(by or [])).agg(n.alias("n"), F.avg(a).alias("mean_x"), F.avg(b).alias("mean_y"), slope(a, b).alias("slope"), r.alias("r"), (r * r).alias("r2"), F.var_pop(a).alias("_vx"), F.var_pop(b).alias("_vy"))
    left = F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("_vy"))
    se = F.when(F.col("n") > 2, F.sqrt(F.try_divide(left, (F.col("n") - 2) * F.col("_vx"))))
    return out.withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x")).withColumn("se", se).drop("_vx", "_vy")


def design(df: DataFrame, numeric: dict[str, Column], effects: list[str]) -> tuple[DataFrame, list[str]]:
    """df with columns x_0 (1), x_1 ... : numbers, then 0/1 columns of each effect's values but the first in order. Returns their names too.

    An effect has few values (domains, levels, regimes), null among them as the last; one aggregate lists them all for the driver."""
    parts, names = [F.lit(1.0)], ["intercept"]
    for k, c in numeric.items():
        parts.append(c.cast("double")), names.append(k)
    found = df.agg(*(F.collect_set(e).alias(f"v{i}") for i, e in enumerate(effects)), *(F.max(F.col(e).isNull()).alias(f"n{i}") for i, e in enumerate(effects))).first() if effects else None
    for i, e in enumerate(effects):
        for v in [*sorted(found[f"v{i}"]), *([None] if found[f"n{i}"] else [])][1:]:
            parts.append(F.col(e).eqNullSafe(F.lit(v)).cast("double")), names.append(f"{e}={v}")
    return df.withColumns({f"x_{i}": c for i, c in enumerate(parts)}), names


def gramian(df: DataFrame, p: int, y: str) -> DataFrame:
    """Long form (i, j, value) of X'X for i <= j < p, and of X'y as j = p, y'y as i = j = p: one aggregate over the rows."""
    x = [F.col(f"x_{i}") for i in range(p)] + [F.col(y)]
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = df.agg(F.array(*(F.sum(x[i] * x[j]) for i, j in cells)).alias("s"), F.count("*").alias("n"))
    index = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells))
    return sums.select("n", F.explode(F.arrays_zip(index.alias("ij"), F.col("s").alias("value"))).alias("c")).select("n", "c.ij.i", "c.ij.j", "c.value")


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    t: np.ndarray
    log10_p: np.ndarray
    dof: int
    rank: int
    n: int

    def rows(self) -> list[tuple]:
        return [(k, float(b), float(s), float(t), float(10**lp) if lp > -300 else 0.0, float(lp)) for k, b, s, t, lp in zip(self.names, self.beta, self.se, self.t, self.log10_p, strict=True)]


def solve(gram: DataFrame, names: list[str]) -> Fit:
    """Minimum-norm solution from the Gramian; its rank decides the degrees of freedom."""
    p = len(names)
    g, n = np.zeros((p + 1, p + 1)), 0
    for r in gram.collect():  # (p + 1)(p + 2) / 2 rows
        g[r.i, r.j] = g[r.j, r.i] = r.value or 0.0
        n = r.n
    xx, xy, yy = g[:p, :p], g[:p, p], g[p, p]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1))
    unit = xx / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(unit, tol=1e-10))
    inverse = np.linalg.pinv(unit, rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    beta = inverse @ xy
    dof = n - rank
    sigma2 = max(0.0, yy - beta @ xy) / dof if dof > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(inverse) * sigma2, 0))
    t = np.divide(beta, se, out=np.full(p, np.nan), where=se > 0)
    lp = np.array([prob.log_t_two_sided(x, dof) / math.log(10) if dof > 0 and not math.isnan(x) else math.nan for x in t])
    return Fit(names, beta, se, t, lp, dof, rank, n)
