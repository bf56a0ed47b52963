"""The judged-score star over the driver's tables: responses with three lanes' scores, and evaluations in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.pairing import PairingSpec, pair_lanes

#: Expressions that Spark SQL and DuckDB read alike.
COLUMNS = {
    "model": "p_brand",
    "question_id": "l_suppkey",
    "domain_id": "l_suppkey % 7 + 1",
    "level": "l_suppkey % 3 + 1",
    "is_trap": "CASE WHEN l_suppkey % 10 = 3 THEN 1 ELSE 0 END",
    "regime": "CASE l_suppkey % 4 WHEN 0 THEN 'grounded' WHEN 1 THEN 'ungrounded' ELSE 'structured' END",
    "response_id": "l_orderkey * 10 + l_linenumber",
    "answer_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS STRING), CAST(l_quantity AS INT))",
    "run_number": "CAST(row_number() OVER (PARTITION BY p_brand, l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT)",
    "score_a": "CAST(l_quantity AS INT) / 8.0E0",
    "score_b": "greatest(0, least(50, CAST(l_quantity AS INT) + CAST(round(l_discount * 100) AS INT) - 5)) / 8.0E0",
    "score_c": "greatest(0, least(50, CAST(l_quantity AS INT) + CAST(round(l_tax * 100) AS INT) - 4)) / 8.0E0",
    "word_count": "CAST(floor(l_extendedprice / 50) AS INT)",
    "retired": "l_suppkey % 25 = 24",
    "included": "l_suppkey % 50 <> 49",
    "unpaired": "l_suppkey % 10 = 9",
    "flag": "l_returnflag",
}
#: For DuckDB: common table expressions that queries start from.
STAR_SQL = "star AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIRED_SQL = STAR_SQL + ", paired AS (SELECT *, (score_a + score_b) / 2 AS pair_mean, score_b - score_a AS diff FROM star WHERE NOT unpaired AND NOT retired)"
EVALS_SQL = STAR_SQL + (
    ", evals AS (SELECT model, question_id, answer_id, 'judge-a' AS judge_model, 'v2.1__Lane_A_primary' AS version, score_a AS score FROM star"
    " UNION ALL SELECT model, question_id, answer_id, 'judge-b', 'v2.1__Lane_B_comparison', score_b FROM star WHERE NOT unpaired"
    " UNION ALL SELECT model, question_id, answer_id, 'judge-c', 'v2.1__Lane_C_comparison', score_c FROM star WHERE NOT unpaired"
    " UNION ALL SELECT model, question_id, answer_id, 'judge-a', 'v1.0__laneXA_supplement', score_a FROM star WHERE flag = 'R')"
)
QMEAN_SQL = PAIRED_SQL + ", qmean AS (SELECT model, question_id, min(domain_id) AS domain_id, min(level) AS level, min(is_trap) AS is_trap, avg(pair_mean) AS mean_score, avg(word_count) AS mean_words, count(*) AS n FROM paired GROUP BY model, question_id)"

LANES = {"score_a": ("judge-a", "v2.%primary"), "score_b": ("judge-b", "v2.%comparison"), "score_c": ("judge-c", "v2.%comparison")}
#: Which answers count: those of questions in use, all, or included ones in use.
SCOPES = {"two-lane": PairingSpec(in_use="NOT retired"), "view": PairingSpec(in_use=None), "three-lane": PairingSpec(included="included", in_use="NOT retired")}
DOMAINS = list(range(1, 8))
#: Weights of domains 1 to 7 in the role-weighted composite (fixed values).
WEIGHTS = {1: 0.08, 2: 0.17, 3: 0.175, 4: 0.07, 5: 0.14, 6: 0.145, 7: 0.22}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Response rows; only the columns asked for are computed (run_number costs a window)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*(F.expr(COLUMNS[c]).alias(c) for c in (columns or COLUMNS)))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that both lanes scored, on questions in use, with their mean and difference."""
    rows = star(spark, sf_dir, *(c for c in COLUMNS if c not in ("run_number", "answer_id", "flag", "included"))).where("NOT unpaired AND NOT retired")
    return rows.withColumns({"pair_mean": (F.col("score_a") + F.col("score_b")) / 2, "diff": F.col("score_b") - F.col("score_a")})


def paired_lanes(spark: SparkSession, sf_dir: str, lanes: dict[str, tuple[str, str]], scope: PairingSpec) -> DataFrame:
    """The same from evaluations: of the answers in scope those that both lanes (score_a, score_b) scored, with what belongs to them."""
    pairs = pair_lanes(evaluations(spark, sf_dir), ["answer_id"], lanes)
    own = scope.apply(star(spark, sf_dir, "answer_id", "model", "question_id", "domain_id", "level", "is_trap", "regime", "word_count", "included", "retired"))
    return own.join(pairs, "answer_id").withColumns({"pair_mean": (F.col("score_a") + F.col("score_b")) / 2, "diff": F.col("score_b") - F.col("score_a")})


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each response and lane, and supplements on lane A that are no lane."""
    rows = star(spark, sf_dir, "model", "question_id", "answer_id", "score_a", "score_b", "score_c", "unpaired", "flag")
    lane = lambda j, v, s, when: F.when(when, F.struct(F.lit(j).alias("judge_model"), F.lit(v).alias("version"), F.col(s).alias("score")))
    here = ~F.col("unpaired")
    lanes = F.array_compact(F.array(lane("judge-a", "v2.1__Lane_A_primary", "score_a", F.lit(True)), lane("judge-b", "v2.1__Lane_B_comparison", "score_b", here), lane("judge-c", "v2.1__Lane_C_comparison", "score_c", here), lane("judge-a", "v1.0__laneXA_supplement", "score_a", F.col("flag") == "R")))
    return rows.select("model", "question_id", "answer_id", F.inline(lanes))
