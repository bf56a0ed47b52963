"""Pairing of judge lanes, with a guard for uniqueness, and coverage of what could not be paired."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateRows(ValueError):
    """A lane scored a response more than once."""


@dataclass(frozen=True)
class PairingSpec:
    """Which responses may be paired; each filter is an SQL condition or None."""

    release: str | None = None
    included: str | None = None
    in_use: str | None = "retired_at IS NULL"
    main: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        for condition in (self.release, self.included, self.in_use, self.main):
            df = df.where(condition) if condition else df
        return df


#: The three sets of filters that published analyses use.
TWO_LANE = PairingSpec(release="benchmark_release_id = release_id")
VIEW = PairingSpec(release="benchmark_release_id = release_id", in_use=None)
THREE_LANE = PairingSpec(included="is_included = 1", main="is_supplementary = 0")


def lane(judge: str, version: str, judge_col: str = "judge_model", version_col: str = "version") -> Column:
    """An evaluation's lane: its judge, and a case-blind pattern for its prompt version."""
    return (F.col(judge_col) == judge) & F.ilike(F.col(version_col), F.lit(version))


def duplicates(evals: DataFrame, keys: list[str], lanes: dict[str, tuple[str, str]]) -> DataFrame:
    """Keys that a lane holds more than once: (keys, lane, n)."""
    name = F.coalesce(*(F.when(lane(*spec), n) for n, spec in lanes.items()))
    return evals.withColumn("lane", name).where("lane IS NOT NULL").groupBy(*keys, "lane").agg(F.count("*").alias("n")).where("n > 1")


def pair_lanes(evals: DataFrame, keys: list[str], lanes: dict[str, tuple[str, str]], score_col: str = "score", guard: bool | None = None) -> DataFrame:
    """One row for each key that all lanes scored, a column a lane: one scan and one shuffle, not a self-join a lane.

    No lane may score a key twice: the query fails on the first such key it meets. With guard=True DuplicateRows is raised
    before anything is paired, which takes a scan of its own; with guard=False the highest score stands."""
    if guard:
        bad = duplicates(evals, keys, lanes).limit(5).collect()
        if bad:
            raise DuplicateRows(f"{score_col} more than once, for example {bad}")
    # Patterns are matched once a row: the judge decides first, and scores of no lane are gone before the shuffle.
    judges = sorted({judge for judge, _ in lanes.values()})
    own = evals.where(F.col("judge_model").isin(judges)).select(*keys, *(F.when(lane(*s), F.col(score_col)).alias(f"_s_{n}") for n, s in lanes.items()))
    wide = own.groupBy(*keys).agg(*(F.max(f"_s_{n}").alias(n) for n in lanes), *(F.count(f"_s_{n}").alias(f"_n_{n}") for n in lanes))
    if guard is None:
        told = lambda n: F.raise_error(F.concat(F.lit(f"{n} scored more than once: "), F.to_json(F.struct(*keys)))).cast("double")
        wide = wide.withColumns({n: F.when(F.col(f"_n_{n}") > 1, told(n)).otherwise(F.col(n)) for n in lanes})
    return wide.select(*keys, *lanes).dropna(subset=list(lanes))


def eligible(rows: DataFrame, least: int, system: str = "model") -> DataFrame:
    """The rows of systems that have at least ``least`` of them."""
    few = rows.groupBy(system).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(system)
    return rows.join(few, system, "left_semi") if least > 1 else rows


def coverage(rows: DataFrame, paired: Column, by: list[str] | None = None) -> DataFrame:
    """Rows, paired rows, their share, and whether only a part is paired."""
    n, p = F.count("*"), F.count_if(paired)
    out = rows.groupBy(*(by or [])).agg(n.alias("rows"), p.alias("paired_rows"), F.try_divide(p.cast("double"), n).alias("paired_share"))
    return out.withColumn("partial", F.col("paired_rows") < F.col("rows"))
