"""python -m assay.cli report --data DIR --out DIR: the published tables over a star, as JSON, CSV, Markdown and SVG."""

from __future__ import annotations

import argparse
import os
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import functions as F

from assay import queries as Q
from assay.operators import agreement as G
from assay.operators import pairing as P
from assay.operators import resample as B
from assay.plans import star as S
from assay.session import session
from assay.sources import files

#: Tables that need no replicates, by their query.
DIAGNOSTICS = ("verbosity_bias", "run_variance", "difficulty_gradient", "trap_delta", "score_distribution", "length_adjusted", "rank_shift", "judge_offset", "pairwise_lane_stats")


@dataclass(frozen=True)
class Settings:
    data: str
    out: str = "assay-out"
    master: str | None = None
    seed: int = Q.SEED
    reps: int = Q.REPS
    min_paired_rows: int = 1
    judge_a: str = S.LANES["score_a"][0]
    version_a: str = S.LANES["score_a"][1]
    judge_b: str = S.LANES["score_b"][0]
    version_b: str = S.LANES["score_b"][1]
    scope: str = "two-lane"

    @property
    def lanes(self) -> dict[str, tuple[str, str]]:
        return {"score_a": (self.judge_a, self.version_a), "score_b": (self.judge_b, self.version_b)}


def settings(argv: list[str] | None = None) -> Settings:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["report"])
    parser.add_argument("--data", default=os.environ.get("ASSAY_DATA"), required="ASSAY_DATA" not in os.environ)
    for name, default in asdict(Settings("")).items():
        if name != "data":
            kind = int if isinstance(default, int) else str
            parser.add_argument("--" + name.replace("_", "-"), type=kind, default=default, choices=sorted(S.SCOPES) if name == "scope" else None)
    got = vars(parser.parse_args(argv))
    del got["command"]
    return Settings(**got)


def lane_coverage(spark, s: Settings, paired: int) -> dict:
    """Rows of each lane in scope, and the share that could be paired."""
    own = S.SCOPES[s.scope].apply(S.star(spark, s.data, "answer_id", "included", "retired")).select("answer_id")
    evals = S.evaluations(spark, s.data).join(own, "answer_id", "left_semi")
    n = evals.agg(*(F.count_if(P.lane(*spec)).alias(k) for k, spec in s.lanes.items())).first().asDict()
    return {**{f"{k}_rows": v for k, v in n.items()}, "paired_rows": paired, "is_partial_overlap": any(paired < v for v in n.values()), **{f"paired_fraction_of_{k}": paired / v if v else None for k, v in n.items()}}


def report(spark, s: Settings) -> dict:
    out = Path(s.out)
    out.mkdir(parents=True, exist_ok=True)
    rows = P.eligible(S.paired_lanes(spark, s.data, s.lanes, S.SCOPES[s.scope]), s.min_paired_rows)
    plan = B.hash_plan(rows.select("domain_id", "question_id").distinct(), s.reps, s.seed)
    by_domain = B.replicate_means(plan, B.sums(rows, ["model", "domain_id"], total=F.col("pair_mean")), ["model", "domain_id"], "total")
    board = sorted(files.rows(Q.leaderboard(rows, s.reps, s.seed)), key=lambda r: (-r["observed_mean"], r["model"]))
    tables = {
        "leaderboard": board,
        "composite_leaderboard": sorted((r for r in board if r["composite_observed"] is not None), key=lambda r: (-r["composite_observed"], r["model"])),
        "domains": files.rows(Q.domain_ci(rows, s.reps, s.seed).orderBy("domain_id", F.desc("observed_mean"), "model")),
        "reliability": files.rows(G.reliability(rows, "score_a", "score_b")),
        "reliability_ci": files.rows(Q.reliability_ci(rows, s.reps, s.seed).orderBy("measure")),
        "paired_differences": files.rows(Q.differences_ci(by_domain).orderBy("pair")),
        **{name: files.rows(Q.QUERIES[name](spark, s.data)) for name in DIAGNOSTICS},
    }
    tables = files.rounded(tables)
    about = rows.agg(F.count("*").alias("total_rows"), F.count_distinct("model").alias("models"), F.count_distinct("question_id").alias("questions")).first().asDict()
    coverage = lane_coverage(spark, s, about["total_rows"])
    metadata = {**asdict(s), **about, "created_at_utc": datetime.now(UTC).isoformat(timespec="seconds"), "unit_of_inference": "question within domain", **files.git_state()}
    for name, records in tables.items():
        files.write_csv(out / f"{name}.csv", records, Q.LEADERBOARD if "leaderboard" in name else None)
    paired = rows.select("model", "question_id", "answer_id", "domain_id", "level", "regime", "score_a", "score_b", "pair_mean", "diff")
    paired.write.mode("overwrite").csv(str((out / "paired_rows").absolute().as_uri()), header=True)  # one row an answer: not for the driver
    bundle = {"metadata": metadata, "coverage": coverage, **tables}
    files.write_json(out / "report.json", bundle)
    (out / "report.md").write_text(files.markdown_report("Judged-score report", {"coverage": [coverage], **tables}))
    (out / "composite.svg").write_text(files.bar_svg([(r["model"], r["composite_observed"]) for r in tables["composite_leaderboard"]], "Weighted composite"))
    return bundle


def summary(bundle: dict) -> list[str]:
    """What the console says: warnings, then the first ten."""
    c = bundle["coverage"]
    lines = [f"warning: only a part is paired: {c['paired_rows']} rows of {c['score_a_rows']} and {c['score_b_rows']}"] if c["is_partial_overlap"] else []
    return lines + [f"{r['observed_rank']:>3} {r['model']:<24} {r['observed_mean']:.4f} [{r['ci_95_low']:.4f}, {r['ci_95_high']:.4f}] (n {r['paired_rows']})" for r in bundle["leaderboard"][:10]]


def main(argv: list[str] | None = None) -> None:
    s = settings(argv)
    print("\n".join(summary(report(session(s.master), s))))


if __name__ == "__main__":
    main()
