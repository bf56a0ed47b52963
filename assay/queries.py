"""The engine's queries over the driver's tables, each beside the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import text as T
from assay.operators import aggregates as A
from assay.operators import agreement as G
from assay.operators import hypothesis as H
from assay.operators import pairing as P
from assay.operators import regression as R
from assay.operators import resample as B
from assay.plans import star as S
from assay.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Replicates that are published; every bootstrap query takes them.
REPS, SEED = 1000, 7


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Published to six places: engines add in different orders."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def with_cte(prelude: str, body: str) -> str:
    return f"WITH {prelude} {body}"


# Projections, filters, predicates


@query("project_alias", with_cte(S.STAR_SQL, "SELECT model AS system, question_id AS item, score_a AS score FROM star"))
def _(spark, d):
    return S.star(spark, d, "model", "question_id", "score_a").select(F.col("model").alias("system"), F.col("question_id").alias("item"), F.col("score_a").alias("score"))


@query("paired_scores", with_cte(S.PAIRED_SQL, "SELECT model, question_id, response_id, pair_mean, diff, (score_a + score_b + score_c) / 3 AS mean3 FROM paired"))
def _(spark, d):
    return S.paired(spark, d).select("model", "question_id", "response_id", "pair_mean", "diff", ((F.col("score_a") + F.col("score_b") + F.col("score_c")) / 3).alias("mean3"))


@query("filter_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status", args={"status": "F"}, orders=S.table(spark, d, "orders"))


@query("filter_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 5, 8))")
def _(spark, d):
    few = S.table(spark, d, "customer").where(F.col("c_nationkey").isin(3, 5, 8)).select(F.col("c_custkey").alias("o_custkey"))
    return S.table(spark, d, "orders").join(few, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("latest_row", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderkey DESC LIMIT 1")
def _(spark, d):
    return S.table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).orderBy(F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_orderstatus")


@query("filter_like", with_cte(S.EVALS_SQL, "SELECT version, count(*) AS n FROM evals WHERE version ILIKE '%lane_a_%' OR version ILIKE 'V2.%comparison' GROUP BY version"))
def _(spark, d):
    v = F.col("version")
    return S.evaluations(spark, d).where(F.ilike(v, F.lit("%lane_a_%")) | F.ilike(v, F.lit("V2.%comparison"))).groupBy("version").agg(F.count("*").alias("n"))


@query("filter_null", "SELECT doc_id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def _(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "source")
    return docs.join(S.table(spark, d, "labels"), "doc_id", "left").where(F.col("quality").isNull()).select("doc_id", "source")


@query("lane_or_filter", with_cte(S.EVALS_SQL, "SELECT judge_model, count(*) AS n, sum(score) AS total FROM evals WHERE (judge_model = 'judge-b' AND version ILIKE 'v2.%') OR (judge_model = 'judge-a' AND version ILIKE '%primary') GROUP BY judge_model"))
def _(spark, d):
    e = S.evaluations(spark, d)
    return e.where(P.lane("judge-b", "v2.%") | P.lane("judge-a", "%primary")).groupBy("judge_model").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("exclude_contains", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_type, 'STEEL')")
def _(spark, d):
    return S.table(spark, d, "part").where(~F.col("p_type").contains("STEEL")).select("p_partkey", "p_name")


@query("conditional_counts", with_cte(S.EVALS_SQL, "SELECT model, sum(CASE WHEN version LIKE 'v1.%' THEN 1 ELSE 0 END)::BIGINT AS supplements, count(*) FILTER (score < 2) AS low, count(*) AS n FROM evals GROUP BY model"))
def _(spark, d):
    return S.evaluations(spark, d).groupBy("model").agg(F.sum(F.when(F.col("version").like("v1.%"), 1).otherwise(0)).alias("supplements"), F.count_if(F.col("score") < 2).alias("low"), F.count("*").alias("n"))


GRID_SQL = "SELECT g.model, g.level, count(p.model) AS n, avg(p.pair_mean) AS mean_score FROM (SELECT DISTINCT model, unnest([1, 2, 3, 4])::BIGINT AS level FROM paired) g LEFT JOIN paired p ON g.model = p.model AND g.level = p.level GROUP BY ALL"


@query("dense_grid", with_cte(S.PAIRED_SQL, GRID_SQL))
def _(spark, d):
    rows = S.paired(spark, d).groupBy("model", "level").agg(F.count("*").alias("n"), F.avg("pair_mean").alias("mean_score"))
    grid = rows.select("model").distinct().select("model", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3, 4)))).alias("level"))
    return grid.join(rows, ["model", "level"], "left").na.fill(0, ["n"])


@query("word_count_coalesce", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, length(text) - length(replace(text, ' ', '')) + 1)::BIGINT AS words, coalesce(CASE WHEN doc_id % 5 = 0 THEN n_chars END, 0)::BIGINT AS known FROM documents")
def _(spark, d):
    docs = S.table(spark, d, "documents")
    words = T.space_count(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")), text=F.col("text"))
    return docs.select("doc_id", words.alias("words"), F.coalesce(F.when(F.col("doc_id") % 5 == 0, F.col("n_chars")), F.lit(0)).cast("long").alias("known"))


LEVELS_SQL = "lv AS (SELECT model, avg(CASE WHEN level = 1 THEN mean_score END) AS l1, count(CASE WHEN level = 1 THEN 1 END) AS n1, avg(CASE WHEN level = 2 THEN mean_score END) AS l2, count(CASE WHEN level = 2 THEN 1 END) AS n2, avg(CASE WHEN level = 3 THEN mean_score END) AS l3, count(CASE WHEN level = 3 THEN 1 END) AS n3 FROM qmean GROUP BY model)"


def levels(spark, d) -> DataFrame:
    means = A.question_means(S.paired(spark, d), "pair_mean")
    at = lambda i: F.when(F.col("level") == i, F.col("mean_score"))
    return means.groupBy("model").agg(*(x for i in (1, 2, 3) for x in (F.avg(at(i)).alias(f"l{i}"), F.count(at(i)).alias(f"n{i}"))))


@query("difficulty_gradient", with_cte(S.QMEAN_SQL + ", " + LEVELS_SQL, "SELECT model, round(l1, 6) AS l1, n1, round(l2, 6) AS l2, n2, round(l3, 6) AS l3, n3, round(l1 - l3, 6) AS gradient FROM lv"))
def _(spark, d):
    return rounded(levels(spark, d).withColumn("gradient", F.col("l1") - F.col("l3")), "l1", "l2", "l3", "gradient")


@query("contamination_flag", with_cte(S.QMEAN_SQL + ", " + LEVELS_SQL, "SELECT model, round(l1 - l3, 6) AS gap, CASE WHEN l1 - l3 > 0.5 THEN 'INVESTIGATE' WHEN l1 - l3 > 0.3 THEN 'monitor' ELSE 'ok' END AS flag FROM lv"))
def _(spark, d):
    gap = F.col("l1") - F.col("l3")
    return levels(spark, d).select("model", F.round(gap, 6).alias("gap"), F.when(gap > 0.5, "INVESTIGATE").when(gap > 0.3, "monitor").otherwise("ok").alias("flag"))


# Joins


@query("star_join", "SELECT r_name, n_name, count(*) AS n, max(s_acctbal) AS best FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def _(spark, d):
    t = lambda n: S.table(spark, d, n)
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("best"))


KEYS = ["model", "question_id", "answer_id"]


@query("pair_lanes_2", with_cte(S.EVALS_SQL, "SELECT a.model, a.question_id, a.answer_id, a.score AS score_a, b.score AS score_b FROM evals a JOIN evals b USING (model, question_id, answer_id) WHERE a.judge_model = 'judge-a' AND a.version ILIKE 'v2.%primary' AND b.judge_model = 'judge-b' AND b.version ILIKE 'v2.%comparison'"))
def _(spark, d):
    return P.pair_lanes(S.evaluations(spark, d), KEYS, {k: S.LANES[k] for k in ("score_a", "score_b")})


@query("pair_lanes_3", with_cte(S.EVALS_SQL, "SELECT a.model, a.question_id, a.answer_id, a.score AS score_a, b.score AS score_b, c.score AS score_c FROM evals a JOIN evals b USING (model, question_id, answer_id) JOIN evals c USING (model, question_id, answer_id) WHERE a.judge_model = 'judge-a' AND a.version ILIKE 'v2.%primary' AND b.judge_model = 'judge-b' AND c.judge_model = 'judge-c'"))
def _(spark, d):
    return P.pair_lanes(S.evaluations(spark, d), KEYS, S.LANES)


@query("composite_key_join", "SELECT count(*) AS n, sum(a.l_linenumber)::BIGINT AS lines FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_suppkey = b.s")
def _(spark, d):
    rows = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    top = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    return rows.join(top, ["l_orderkey", "l_linenumber"]).where("l_suppkey = s").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("release_scope", with_cte(S.STAR_SQL, "SELECT domain_id, count(*) AS n, count(DISTINCT question_id) AS questions FROM star WHERE included AND NOT retired GROUP BY domain_id"))
def _(spark, d):
    rows = S.star(spark, d, "question_id", "domain_id", "included", "retired")
    scope = P.PairingSpec(included="included", in_use="NOT retired")
    return scope.apply(rows).groupBy("domain_id").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("questions"))


@query("anti_join_unpaired", "SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", "source").join(S.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("coverage_by_domain", with_cte(S.STAR_SQL, "SELECT domain_id, count(*) AS responses, count(*) FILTER (NOT unpaired) AS paired, count(DISTINCT question_id) AS questions, count(DISTINCT CASE WHEN NOT unpaired THEN question_id END) AS paired_questions FROM star GROUP BY domain_id"))
def _(spark, d):
    here = ~F.col("unpaired")
    return S.star(spark, d, "domain_id", "question_id", "unpaired").groupBy("domain_id").agg(F.count("*").alias("responses"), F.count_if(here).alias("paired"), F.count_distinct("question_id").alias("questions"), F.count_distinct(F.when(here, F.col("question_id"))).alias("paired_questions"))


@query("coverage_summary", with_cte(S.STAR_SQL, "SELECT level, count(*) AS rows, count(*) FILTER (NOT unpaired) AS paired_rows, count(*) FILTER (NOT unpaired) / count(*)::DOUBLE AS paired_share, count(*) FILTER (NOT unpaired) < count(*) AS partial FROM star GROUP BY level"))
def _(spark, d):
    return P.coverage(S.star(spark, d, "level", "unpaired"), ~F.col("unpaired"), ["level"])


@query("completed_cohort", "WITH r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT o_custkey AS k, count(*) AS m FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT c_custkey, n FROM r JOIN e USING (k) JOIN customer ON k = c_custkey WHERE n = m AND n = 10")
def _(spark, d):
    orders = S.table(spark, d, "orders")
    both = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("m"))
    return both.where("n = m AND n = 10").join(S.table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "n")


@query("semi_join_scope", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    own = S.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(own, "l_orderkey", "left_semi")


def qmeans(spark, d) -> DataFrame:
    return A.question_means(S.paired(spark, d), "pair_mean")


PAIRS_SQL = "pr AS (SELECT a.model AS model_a, b.model AS model_b, a.question_id, a.domain_id, a.mean_score AS a, b.mean_score AS b FROM qmean a JOIN qmean b ON a.question_id = b.question_id AND a.model < b.model)"


@query("pairwise_common", with_cte(S.QMEAN_SQL + ", " + PAIRS_SQL, "SELECT model_a, model_b, count(*) AS n_common, round(avg(a) - avg(b), 6) AS mean_difference FROM pr GROUP BY model_a, model_b"))
def _(spark, d):
    return rounded(H.common_pairs(qmeans(spark, d)).groupBy("model_a", "model_b").agg(F.count("*").alias("n_common"), (F.avg("a") - F.avg("b")).alias("mean_difference")), "mean_difference")


SIZES_SQL = "sizes AS (SELECT p_brand AS model, CASE WHEN min(p_size) > 0 THEN avg(p_size) END AS size_b, max(CASE WHEN p_partkey % 2 = 0 THEN p_size END)::DOUBLE AS active_b FROM part GROUP BY p_brand)"


def sizes(spark, d) -> DataFrame:
    active = F.max(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))).cast("double")
    return S.table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_size").alias("size_b"), active.alias("active_b"))


MM_SQL = "mm AS (SELECT model, avg(pair_mean) AS mean_score, count(*) AS n FROM paired GROUP BY model)"


@query("size_join", with_cte(S.PAIRED_SQL + ", " + SIZES_SQL + ", " + MM_SQL, "SELECT model, size_b, mean_score FROM sizes JOIN mm USING (model) WHERE size_b IS NOT NULL"))
def _(spark, d):
    return sizes(spark, d).where("size_b IS NOT NULL").join(A.means(S.paired(spark, d), ["model"], "pair_mean"), "model").select("model", "size_b", "mean_score")


@query("coalesce_active_size", "WITH " + SIZES_SQL + " SELECT model, coalesce(active_b, size_b) AS active_or_dense_b FROM sizes")
def _(spark, d):
    return sizes(spark, d).select("model", F.coalesce("active_b", "size_b").alias("active_or_dense_b"))


@query("duplicate_guard", with_cte(S.STAR_SQL, "SELECT response_id, count(*) AS n FROM star GROUP BY response_id HAVING count(*) > 1"))
def _(spark, d):
    return S.star(spark, d, "response_id").groupBy("response_id").agg(F.count("*").alias("n")).where("n > 1")


@query("common_questions", with_cte(S.QMEAN_SQL, "SELECT question_id FROM qmean GROUP BY question_id HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM qmean)"))
def _(spark, d):
    q = qmeans(spark, d).select("model", "question_id")
    return q.groupBy("question_id").agg(F.count("*").alias("n")).join(q.agg(F.count_distinct("model").alias("n")), "n").select("question_id")


# Aggregates, composites, ranks


@query("model_means", with_cte(S.PAIRED_SQL + ", " + MM_SQL, "SELECT model, mean_score, n, row_number() OVER (ORDER BY mean_score DESC, model) AS rank FROM mm"))
def model_means(spark, d):
    out = A.rank_systems(A.means(S.paired(spark, d), ["model"], "pair_mean"), "mean_score")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("domain_model_means", with_cte(S.PAIRED_SQL, "SELECT domain_id, model, avg(pair_mean) AS mean_score, count(*) AS n FROM paired GROUP BY domain_id, model"))
def _(spark, d):
    return domain_means(spark, d)


def domain_means(spark, d) -> DataFrame:
    return A.means(S.paired(spark, d), ["domain_id", "model"], "pair_mean")


@query("question_means", with_cte(S.QMEAN_SQL, "SELECT model, question_id, domain_id, level, is_trap, mean_score, mean_words, n FROM qmean"))
def _(spark, d):
    return qmeans(spark, d)


DM_SQL = S.PAIRED_SQL + ", dm AS (SELECT model, domain_id, avg(pair_mean) AS m FROM paired GROUP BY model, domain_id)"
SUM_SQL = " + ".join(f"max(CASE WHEN domain_id = {k} THEN m END) * {w}::DOUBLE" for k, w in S.WEIGHTS.items())
COMP_SQL = DM_SQL + f", comp AS (SELECT model, 0::DOUBLE + {SUM_SQL} AS composite FROM dm GROUP BY model)"


@query("weighted_composite", with_cte(COMP_SQL, "SELECT model, round(composite, 6) AS composite, row_number() OVER (ORDER BY composite DESC, model) AS rank FROM comp WHERE composite IS NOT NULL"))
def _(spark, d):
    out = A.rank_systems(A.composite(domain_means(spark, d), S.WEIGHTS), "composite")
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "composite")


@query("composite_pivot", with_cte(COMP_SQL, "SELECT model, round(composite, 6) AS composite FROM comp"))
def _(spark, d):
    return rounded(A.composite(domain_means(spark, d), S.WEIGHTS, on_missing="null"), "composite")


@query("equal_domain_composite", with_cte(DM_SQL, "SELECT model, round(avg(m), 6) AS composite FROM dm GROUP BY model HAVING count(m) = 7"))
def _(spark, d):
    return rounded(A.equal_composite(domain_means(spark, d), S.DOMAINS), "composite")


@query("unweighted_question_mean", with_cte(S.QMEAN_SQL, "SELECT model, round(avg(mean_score), 6) AS score FROM qmean GROUP BY model"))
def _(spark, d):
    return rounded(qmeans(spark, d).groupBy("model").agg(F.avg("mean_score").alias("score")), "score")


COMPARED = [("Brand#11", "Brand#12"), ("Brand#13", "Brand#55"), ("Brand#21", "Brand#99")]
COMPARED_SQL = "VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COMPARED)


@query("composite_pair_diff", with_cte(COMP_SQL, f"SELECT f AS first, s AS second, f || '__minus__' || s AS pair, round(a.composite - b.composite, 6) AS difference FROM ({COMPARED_SQL}) v(f, s) JOIN comp a ON a.model = f JOIN comp b ON b.model = s"))
def _(spark, d):
    return rounded(A.pair_differences(A.composite(domain_means(spark, d), S.WEIGHTS), COMPARED), "difference")


@query("lane_counts", with_cte(S.EVALS_SQL, "SELECT judge_model, version, count(*) AS n, count(DISTINCT model) AS models FROM evals GROUP BY judge_model, version"))
def _(spark, d):
    return S.evaluations(spark, d).groupBy("judge_model", "version").agg(F.count("*").alias("n"), F.count_distinct("model").alias("models"))


@query("response_set_totals", with_cte(S.STAR_SQL, "SELECT count(*) AS responses, count(*) FILTER (unpaired) AS unpaired, count(DISTINCT question_id) AS questions, count(DISTINCT CASE WHEN unpaired THEN question_id END) AS unpaired_questions, count(DISTINCT model) AS models FROM star"))
def _(spark, d):
    u = F.col("unpaired")
    return S.star(spark, d, "model", "question_id", "unpaired").agg(F.count("*").alias("responses"), F.count_if(u).alias("unpaired"), F.count_distinct("question_id").alias("questions"), F.count_distinct(F.when(u, F.col("question_id"))).alias("unpaired_questions"), F.count_distinct("model").alias("models"))


@query("unpaired_lane_coverage", with_cte(S.EVALS_SQL, "SELECT e.judge_model, e.version, count(*) AS n, count(DISTINCT e.question_id) AS questions FROM evals e ANTI JOIN (SELECT * FROM evals WHERE judge_model = 'judge-b') b USING (model, question_id, answer_id) GROUP BY ALL"))
def _(spark, d):
    e = S.evaluations(spark, d)
    return e.join(e.where("judge_model = 'judge-b'").select(*KEYS), KEYS, "left_anti").groupBy("judge_model", "version").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("questions"))


@query("integrity_profile", "SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS failures, count(*) FILTER (toxic = 1) / count(*)::DOUBLE AS failure_rate, CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 3.0::DOUBLE / count(*) END AS upper_95_if_zero FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def _(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", "source").join(S.table(spark, d, "labels"), "doc_id", "left")
    n, bad = F.count("*"), F.count_if(F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return rows.groupBy("source").agg(n.alias("n"), bad.alias("failures"), (bad.cast("double") / n).alias("failure_rate"), F.when(bad == 0, 3.0 / n).alias("upper_95_if_zero"))


@query("trap_delta", with_cte(S.QMEAN_SQL, "SELECT model, round(avg(mean_score) FILTER (is_trap = 1), 6) AS trap_mean, round(avg(mean_score) FILTER (is_trap = 0), 6) AS other_mean, round(avg(mean_score) FILTER (is_trap = 1) - avg(mean_score) FILTER (is_trap = 0), 6) AS delta, count(*) FILTER (is_trap = 1) AS n_trap, count(*) FILTER (is_trap = 0) AS n_other FROM qmean GROUP BY model"))
def _(spark, d):
    at = lambda i: F.when(F.col("is_trap") == i, F.col("mean_score"))
    out = qmeans(spark, d).groupBy("model").agg(F.avg(at(1)).alias("trap_mean"), F.avg(at(0)).alias("other_mean"), (F.avg(at(1)) - F.avg(at(0))).alias("delta"), F.count(at(1)).alias("n_trap"), F.count(at(0)).alias("n_other"))
    return rounded(out, "trap_mean", "other_mean", "delta")


RV_SQL = S.PAIRED_SQL + ", rv AS (SELECT model, question_id, min(domain_id) AS domain_id, min(level) AS level, count(*) AS runs, avg(pair_mean) AS mean_score, stddev_samp(pair_mean) AS sd, var_samp(pair_mean) AS variance, CASE WHEN avg(pair_mean) > 0 THEN stddev_samp(pair_mean) / avg(pair_mean) END AS cv FROM paired GROUP BY model, question_id HAVING count(*) > 1)"


@query("run_variance", with_cte(RV_SQL, "SELECT model, count(*) AS groups, round(avg(variance), 6) AS mean_variance, round(avg(cv), 6) AS mean_cv, round(median(cv), 6) AS median_cv, count(*) FILTER (cv > 0.15) AS high_cv FROM rv GROUP BY model"))
def _(spark, d):
    v = A.run_variance(S.paired(spark, d), "pair_mean")
    out = v.groupBy("model").agg(F.count("*").alias("groups"), F.avg("variance").alias("mean_variance"), F.avg("cv").alias("mean_cv"), F.median("cv").alias("median_cv"), F.count_if("is_high").alias("high_cv"))
    return rounded(out, "mean_variance", "mean_cv", "median_cv")


@query("top_high_cv", with_cte(RV_SQL, "SELECT model, question_id, domain_id, level, runs, round(mean_score, 6) AS mean_score, round(sd, 6) AS sd, round(cv, 6) AS cv FROM rv WHERE cv > 0.15 ORDER BY round(cv, 9) DESC, model, question_id LIMIT 100"))
def _(spark, d):
    v = A.run_variance(S.paired(spark, d), "pair_mean").where("is_high").orderBy(F.desc(F.round("cv", 9)), "model", "question_id").limit(100)
    return rounded(v.select("model", "question_id", "domain_id", "level", "runs", "mean_score", "sd", "cv"), "mean_score", "sd", "cv")


@query("high_cv_crosstab", with_cte(RV_SQL, "SELECT domain_id, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, count(*) FILTER (level = 3) AS l3 FROM rv WHERE cv > 0.15 GROUP BY domain_id"))
def _(spark, d):
    v = A.run_variance(S.paired(spark, d), "pair_mean").where("is_high")
    return v.groupBy("domain_id").pivot("level", [1, 2, 3]).agg(F.count("model")).na.fill(0).withColumnsRenamed({str(i): f"l{i}" for i in (1, 2, 3)})


@query("score_distribution", with_cte(S.QMEAN_SQL, "SELECT model, n, round(m, 6) AS mean, round(med, 6) AS median, round(sd, 6) AS sd, round((s3 / n - 3 * m * s2 / n + 2 * m * m * m) / pow(s2 / n - m * m, 1.5), 6) AS skewness, round(kurt, 6) AS kurtosis, round(low, 6) AS low, round(high, 6) AS high, below_2, from_3, from_4 FROM (SELECT model, count(*) AS n, avg(mean_score) AS m, median(mean_score) AS med, stddev_samp(mean_score) AS sd, sum(mean_score * mean_score) AS s2, sum(mean_score * mean_score * mean_score) AS s3, kurtosis_pop(mean_score) AS kurt, min(mean_score) AS low, max(mean_score) AS high, avg(CASE WHEN mean_score < 2 THEN 1.0::DOUBLE ELSE 0 END) AS below_2, avg(CASE WHEN mean_score >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS from_3, avg(CASE WHEN mean_score >= 4 THEN 1.0::DOUBLE ELSE 0 END) AS from_4 FROM qmean GROUP BY model)"))
def _(spark, d):
    return rounded(A.distribution(qmeans(spark, d), ["model"], "mean_score"), "mean", "median", "sd", "skewness", "kurtosis", "low", "high")


@query("percentile_exact", with_cte(S.PAIRED_SQL, "SELECT model, round(quantile_cont(pair_mean, 0.25), 6) AS p25, round(quantile_cont(pair_mean, 0.5), 6) AS p50, round(quantile_cont(pair_mean, 0.975), 6) AS p975 FROM paired GROUP BY model"))
def _(spark, d):
    x = lambda p: F.round(F.percentile("pair_mean", F.lit(p)), 6)
    return S.paired(spark, d).groupBy("model").agg(x(0.25).alias("p25"), x(0.5).alias("p50"), x(0.975).alias("p975"))


@query("percentile_freq", with_cte(S.PAIRED_SQL, "SELECT domain_id, round(quantile_cont(diff, 0.1), 6) AS p10, round(quantile_cont(diff, 0.9), 6) AS p90 FROM paired GROUP BY domain_id"))
def _(spark, d):
    held = S.paired(spark, d).groupBy("domain_id", "diff").agg(F.count("*").alias("w"))
    x = lambda p: F.round(F.percentile("diff", F.lit(p), F.col("w")), 6)
    return held.groupBy("domain_id").agg(x(0.1).alias("p10"), x(0.9).alias("p90"))


@query("self_eval_gap", with_cte(S.PAIRED_SQL + ", " + MM_SQL + ", g AS (SELECT max(CASE WHEN model = 'Brand#55' THEN mean_score END) AS ceiling, max(CASE WHEN model <> 'Brand#55' THEN mean_score END) AS best_open, avg(CASE WHEN model <> 'Brand#55' THEN mean_score END) AS mean_open FROM mm)", "SELECT round(ceiling, 6) AS ceiling, round(best_open, 6) AS best_open, round(mean_open, 6) AS mean_open, round(ceiling - best_open, 6) AS gap_best, round(ceiling - mean_open, 6) AS gap_mean FROM g"))
def _(spark, d):
    is_top = F.col("model") == "Brand#55"
    g = A.means(S.paired(spark, d), ["model"], "pair_mean").agg(F.max(F.when(is_top, F.col("mean_score"))).alias("ceiling"), F.max(F.when(~is_top, F.col("mean_score"))).alias("best_open"), F.avg(F.when(~is_top, F.col("mean_score"))).alias("mean_open"))
    g = g.withColumns({"gap_best": F.col("ceiling") - F.col("best_open"), "gap_mean": F.col("ceiling") - F.col("mean_open")})
    return rounded(g, *g.columns)


@query("snapshot_grouping_sets", with_cte(S.STAR_SQL, "SELECT model, regime, domain_id, count(*) AS n, round(avg(score_a), 3) AS mean_score FROM star GROUP BY GROUPING SETS ((model), (model, regime), (model, domain_id))"))
def _(spark, d):
    rows = S.star(spark, d, "model", "regime", "domain_id", "score_a")
    sets = rows.groupingSets([["model"], ["model", "regime"], ["model", "domain_id"]], "model", "regime", "domain_id")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("score_a"), 3).alias("mean_score")).select("model", "regime", "domain_id", "n", "mean_score")


@query("judge_offset", with_cte(S.PAIRED_SQL, "SELECT model, count(*) AS n, round(avg(score_c), 6) AS judge_mean, round(avg(pair_mean), 6) AS baseline_mean, round(avg(score_c) - avg(pair_mean), 6) AS difference FROM paired GROUP BY model"))
def _(spark, d):
    out = S.paired(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.avg("score_c").alias("judge_mean"), F.avg("pair_mean").alias("baseline_mean"), (F.avg("score_c") - F.avg("pair_mean")).alias("difference"))
    return rounded(out, "judge_mean", "baseline_mean", "difference")


@query("rank_models", with_cte(S.QMEAN_SQL, "SELECT model, score, row_number() OVER (ORDER BY score DESC, model) AS rank FROM (SELECT model, round(avg(mean_score), 6) AS score FROM qmean GROUP BY model)"))
def _(spark, d):
    out = rounded(qmeans(spark, d).groupBy("model").agg(F.avg("mean_score").alias("score")), "score")
    return A.rank_systems(out, "score").withColumn("rank", F.col("rank").cast("long"))


@query("leaderboard_sorted", with_cte(S.PAIRED_SQL + ", " + MM_SQL, "SELECT model, mean_score FROM mm ORDER BY mean_score DESC, model"))
def _(spark, d):
    return A.means(S.paired(spark, d), ["model"], "pair_mean").select("model", "mean_score").orderBy(F.desc("mean_score"), F.asc("model"))


MIDRANK = lambda x, by="": f"rank() OVER ({by} ORDER BY {x}) + (count(*) OVER ({by + ',' if by else 'PARTITION BY'} {x}) - 1) / 2.0::DOUBLE"


@query("midrank", with_cte(S.PAIRED_SQL, f"SELECT DISTINCT pair_mean, {MIDRANK('pair_mean')} AS midrank FROM paired"))
def _(spark, d):
    return A.midranks(S.paired(spark, d).select("pair_mean"), "pair_mean").distinct()


P_SQL = S.QMEAN_SQL + ", pv AS (SELECT model || ':' || question_id AS key, mean_score / 10 AS p FROM qmean)"


def p_values(spark, d) -> DataFrame:
    return qmeans(spark, d).select(F.concat_ws(":", "model", "question_id").alias("key"), (F.col("mean_score") / 10).alias("p"))


@query("bh_adjust", with_cte(P_SQL + ", rk AS (SELECT *, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS m FROM pv)", "SELECT key, round(least(1.0::DOUBLE, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS adjusted FROM rk"))
def _(spark, d):
    return rounded(H.bh_adjust(p_values(spark, d), "p", "key").select("key", "adjusted"), "adjusted")


@query("bh_threshold_flag", with_cte(P_SQL + ", rk AS (SELECT *, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS m FROM pv)", "SELECT key, k AS bh_rank, p <= k / m::DOUBLE * 0.05::DOUBLE AS threshold_flag FROM rk"))
def _(spark, d):
    return H.bh_adjust(p_values(spark, d), "p", "key").select("key", F.col("bh_rank").cast("long").alias("bh_rank"), "threshold_flag")


# Scalars


@query("word_count_split", r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM documents")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("pair_key", "SELECT DISTINCT 'D' || (n_regionkey + 1) AS domain, n_name || '__minus__' || n_nationkey AS pair, split_part(n_name || '__minus__' || n_nationkey, '__minus__', 2) AS second FROM nation")
def _(spark, d):
    pair = F.concat_ws("__minus__", "n_name", "n_nationkey")
    return S.table(spark, d, "nation").select(F.concat(F.lit("D"), F.col("n_regionkey") + 1).alias("domain"), pair.alias("pair"), F.split_part(pair, F.lit("__minus__"), F.lit(2)).alias("second")).distinct()


@query("text_preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS preview FROM documents")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("sha256_text", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


LOCAL_SQL = "'see /Users/ann/' || doc_id || '/notes_' || source || '.md, then \"/Users/bob/x/\" and /Users/c' || ' ' || text"


@query("redact_paths", rf"""SELECT doc_id, regexp_replace({LOCAL_SQL}, '/Users/(?:[^\s"'',;)/]*/+)*([^\s"'',;)/]+)/*', '[redacted-local-path:\1]', 'g') AS clean FROM documents""")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.redact_paths(F.expr(LOCAL_SQL.replace('"', '\\"'))).alias("clean"))


@query("clean_utf8", "SELECT doc_id, text || '�' AS clean FROM documents")
def _(spark, d):
    """Every text with a byte at its end that is no character."""
    return S.table(spark, d, "documents").select("doc_id", T.clean_utf8(F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF")))).alias("clean"))


@query("contains_any", "SELECT doc_id, contains(text, 'license') OR contains(text, 'password') OR contains(text, '@') AS told FROM documents")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.contains_any(F.col("text"), ("license", "password", "@")).alias("told"))


PATH_SQL = "'/Users/ann/' || source || '/notes ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '//' ELSE '' END"


@query("path_basename", f"SELECT doc_id, regexp_extract({PATH_SQL}, '([^/]*)/*$', 1) AS name FROM documents")
def _(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.basename(F.expr(PATH_SQL)).alias("name"))


BROKEN_SQL = "CASE event_id % 5 WHEN 0 THEN substr(props, 2) WHEN 1 THEN NULL ELSE props END"


@query("json_or_null", f"SELECT event_id, CASE WHEN json_valid({BROKEN_SQL}) THEN json_extract_string({BROKEN_SQL}, '$.k')::BIGINT END AS k FROM events")
def _(spark, d):
    return S.table(spark, d, "events").select("event_id", T.parsed_json(F.expr(BROKEN_SQL), "k long")["k"].alias("k"))


UNSORTED_SQL = "'{\"z\":' || event_id || ',\"b\": {\"y\" :[1,2], \"a\":\"' || event_type || '\"}}'"


@query("canonical_json", "SELECT event_id, '{\"b\": {\"a\": \"' || event_type || '\", \"y\": [1, 2]}, \"z\": ' || event_id || '}' AS clean FROM events")
def _(spark, d):
    ship(spark)
    return S.table(spark, d, "events").select("event_id", T.canonical_json(F.expr(UNSORTED_SQL)).alias("clean"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events")
def _(spark, d):
    return S.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")


@query("kv_to_map")
def _(spark, d):
    rows = S.table(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


@query("scan_json", "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def _(spark, d):
    docs = S.table(spark, d, "events").select("event_id", F.from_json("props", "map<string, string>").alias("props"))
    return docs.select("event_id", F.explode("props").alias("key", "value"))


@query("json_sanitized")
def _(spark, d):
    ship(spark)
    made = F.to_json(F.struct(F.struct(F.concat(F.lit("/Users/x/"), F.col("source")).alias("local_path"), F.col("text").alias("body"), F.col("n_chars")).alias("doc")))
    return S.table(spark, d, "documents").select("doc_id", T.sanitize_json(made, strict=True).alias("clean"))


# Agreement


CORR = lambda x, y: f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"


@query("pearson", with_cte(S.PAIRED_SQL, f"SELECT model, count(*) AS n, round({CORR('score_a', 'score_b')}, 6) AS r FROM paired GROUP BY model"))
def _(spark, d):
    return S.paired(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.round(G.pearson(F.col("score_a"), F.col("score_b")), 6).alias("r"))


W_CORR = CORR("word_count::DOUBLE", "pair_mean")


@query("verbosity_corr", with_cte(S.PAIRED_SQL, f"SELECT model, count(*) AS n, CASE WHEN count(*) >= 3 THEN round({W_CORR}, 6) END AS r FROM paired GROUP BY model"))
def _(spark, d):
    r = G.pearson(F.col("word_count").cast("double"), F.col("pair_mean"))
    return S.paired(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(r, 6)).alias("r"))


@query("spearman", with_cte(S.PAIRED_SQL + f", rk AS (SELECT model, {MIDRANK('score_a', 'PARTITION BY model')} AS x, {MIDRANK('score_b', 'PARTITION BY model')} AS y FROM paired)", f"SELECT model, round({CORR('x', 'y')}, 6) AS spearman FROM rk GROUP BY model"))
def _(spark, d):
    return rounded(G.spearman(S.paired(spark, d), "score_a", "score_b", ["model"]), "spearman")


def icc_sql(lanes: list[str], k: int) -> str:
    row, n = f"(({' + '.join(lanes)}) / {k})", "count(*)"
    grand = f"(({' + '.join(f'avg({x})' for x in lanes)}) / {k})"
    ss_r, ss_c = f"{k} * {n} * var_pop({row})", f"{n} * ({' + '.join(f'pow(avg({x}) - {grand}, 2)' for x in lanes)})"
    return f"{n} AS n, {ss_r} / ({n} - 1) AS ms_r, {ss_c} / ({k} - 1) AS ms_c, ({n} * ({' + '.join(f'var_pop({x})' for x in lanes)}) - {ss_r}) / (({n} - 1) * ({k} - 1)) AS ms_e"


def icc_query(lanes: list[str]) -> str:
    k = len(lanes)
    return with_cte(S.PAIRED_SQL + f", ms AS (SELECT model, {icc_sql(lanes, k)} FROM paired GROUP BY model HAVING count(*) > 1)", f"SELECT model, n, round(ms_r, 6) AS ms_r, round(ms_c, 6) AS ms_c, round(ms_e, 6) AS ms_e, round((ms_r - ms_e) / (ms_r + ({k} - 1) * ms_e + {k} * (ms_c - ms_e) / n), 6) AS icc_1, round((ms_r - ms_e) / (ms_r + (ms_c - ms_e) / n), 6) AS icc_k FROM ms")


def icc_frame(spark, d, lanes: list[str]) -> DataFrame:
    parts = G.icc([F.col(x) for x in lanes])
    return rounded(S.paired(spark, d).groupBy("model").agg(F.count("*").alias("n"), *G.columns(parts)), *parts)


@query("icc_2", icc_query(["score_a", "score_b"]))
def _(spark, d):
    return icc_frame(spark, d, ["score_a", "score_b"])


@query("icc_3", icc_query(["score_a", "score_b", "score_c"]))
def _(spark, d):
    return icc_frame(spark, d, ["score_a", "score_b", "score_c"])


LIMITS_SQL = "round(avg(diff), 6) AS mean_diff, round(stddev_samp(diff), 6) AS sd_diff, round(avg(diff) - 1.96 * stddev_samp(diff), 6) AS normal_low, round(avg(diff) + 1.96 * stddev_samp(diff), 6) AS normal_high, round(quantile_cont(diff, 0.025), 6) AS empirical_low, round(quantile_cont(diff, 0.975), 6) AS empirical_high"
SHARE = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END)"
RATES_SQL = f"{SHARE('abs(diff) < 1e-9')} AS exact, {SHARE('abs(diff) <= 0.25')} AS within_25, {SHARE('abs(diff) <= 0.5')} AS within_50, {SHARE('abs(diff) <= 1.0')} AS within_100"
LIMIT_NAMES = ["mean_diff", "sd_diff", "normal_low", "normal_high", "empirical_low", "empirical_high"]


@query("bland_altman", with_cte(S.PAIRED_SQL, f"SELECT model, {LIMITS_SQL} FROM paired GROUP BY model"))
def _(spark, d):
    return rounded(S.paired(spark, d).groupBy("model").agg(*G.columns(G.limits(F.col("diff")))), *LIMIT_NAMES)


@query("agreement_rates", with_cte(S.PAIRED_SQL, f"SELECT model, {RATES_SQL} FROM paired GROUP BY model"))
def _(spark, d):
    return S.paired(spark, d).groupBy("model").agg(*G.columns(G.rates(F.col("diff"))))


@query("reliability_summary", with_cte(S.PAIRED_SQL + f", ms AS (SELECT {icc_sql(['score_a', 'score_b'], 2)} FROM paired), rk AS (SELECT {MIDRANK('score_a')} AS x, {MIDRANK('score_b')} AS y FROM paired), o AS (SELECT count(*) AS n, round(avg(score_a), 6) AS mean_a, round(avg(score_b), 6) AS mean_b, round(avg(abs(diff)), 6) AS mean_abs_diff, round({CORR('score_a', 'score_b')}, 6) AS pearson, {LIMITS_SQL}, {RATES_SQL} FROM paired)", f"SELECT o.*, round((ms_r - ms_e) / (ms_r + ms_e + 2 * (ms_c - ms_e) / ms.n), 6) AS icc_1, round((ms_r - ms_e) / (ms_r + (ms_c - ms_e) / ms.n), 6) AS icc_k, (SELECT round({CORR('x', 'y')}, 6) FROM rk) AS spearman FROM o, ms"))
def _(spark, d):
    out = G.reliability(S.paired(spark, d), "score_a", "score_b")
    return rounded(out, "mean_a", "mean_b", "mean_abs_diff", "pearson", "icc_1", "icc_k", "spearman", *LIMIT_NAMES)


LANE_PAIRS = [("a_b", "score_a", "score_b"), ("a_c", "score_a", "score_c"), ("b_c", "score_b", "score_c")]


@query("pairwise_lane_stats", with_cte(S.PAIRED_SQL + ", st AS (" + " UNION ALL ".join(f"SELECT '{k}' AS pair, {x} AS x, {y} AS y, {x} - {y} AS diff FROM paired" for k, x, y in LANE_PAIRS) + ")", f"SELECT pair, count(*) AS n, round(avg(diff), 6) AS mean_diff, round({CORR('x', 'y')}, 6) AS pearson, {SHARE('diff = 0')} AS exact, {SHARE('abs(diff) <= 0.5')} AS within_50 FROM st GROUP BY pair"))
def _(spark, d):
    pairs = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for k, x, y in LANE_PAIRS))
    rows = S.paired(spark, d).select(F.inline(pairs)).withColumn("diff", F.col("x") - F.col("y"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = rows.groupBy("pair").agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), G.pearson(F.col("x"), F.col("y")).alias("pearson"), share(F.col("diff") == 0).alias("exact"), share(F.abs("diff") <= 0.5).alias("within_50"))
    return rounded(out, "mean_diff", "pearson")


VERB_SQL = S.PAIRED_SQL + ", md AS (SELECT *, median(word_count) OVER (PARTITION BY model) AS med FROM paired)"
INFLATION = "(avg(pair_mean) FILTER (word_count > med) - avg(pair_mean) FILTER (word_count <= med)) / avg(pair_mean) FILTER (word_count <= med)"


@query("verbosity_bias", with_cte(VERB_SQL, f"SELECT model, count(*) AS n, round(avg(word_count), 6) AS mean_words, max(med)::DOUBLE AS median_words, round({W_CORR}, 6) AS r, round({INFLATION}, 6) AS inflation, abs({W_CORR}) > 0.3 AS flagged FROM md GROUP BY model"))
def _(spark, d):
    return rounded(verbosity(spark, d), "mean_words", "r", "inflation")


def verbosity(spark, d) -> DataFrame:
    rows = A.with_median(S.paired(spark, d).select("model", "word_count", "pair_mean"), ["model"], "word_count", "med")
    above = F.avg(F.when(F.col("word_count") > F.col("med"), F.col("pair_mean")))
    below = F.avg(F.when(F.col("word_count") <= F.col("med"), F.col("pair_mean")))
    r = G.pearson(F.col("word_count").cast("double"), F.col("pair_mean"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.avg("word_count").alias("mean_words"), F.max("med").alias("median_words"), r.alias("r"), F.try_divide(above - below, below).alias("inflation"), (F.abs(r) > 0.3).alias("flagged"))


@query("within_level_verbosity", with_cte(S.PAIRED_SQL, f"SELECT model, level, count(*) AS n, CASE WHEN count(*) >= 3 THEN round({W_CORR}, 6) END AS r FROM paired GROUP BY model, level"))
def _(spark, d):
    r = G.pearson(F.col("word_count").cast("double"), F.col("pair_mean"))
    rows = S.paired(spark, d)
    held = rows.groupBy("model", "level").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(r, 6)).alias("r"))
    grid = rows.select("model").distinct().select("model", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("level"))
    return grid.join(held, ["model", "level"], "left").na.fill(0, ["n"])


@query("verbosity_p")
def _(spark, d):
    from assay.functions import prob

    return _with_p(verbosity(spark, d), lambda r, n: prob.pearson_p(r, n))


def _with_p(df: DataFrame, p) -> DataFrame:
    ship(df.sparkSession)
    @F.pandas_udf("double")
    def run(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p(float(x), int(k)) if x == x else None for x, k in zip(r, n, strict=True)], dtype="float64")

    return df.withColumn("p_value", run("r", "n"))


# Regression and scaling


def ols(spark, d) -> tuple[DataFrame, list[str]]:
    return R.design(S.paired(spark, d), {"log_words": F.log1p("word_count")}, ["domain_id", "level", "regime"])


_X = ["1.0::DOUBLE", "ln(1 + word_count::DOUBLE)", *(f"(domain_id = {k})::INT::DOUBLE" for k in range(2, 8)), "(level = 2)::INT::DOUBLE", "(level = 3)::INT::DOUBLE", "(regime = 'structured')::INT::DOUBLE", "(regime = 'ungrounded')::INT::DOUBLE", "pair_mean"]


@query("ols_gramian", with_cte(S.PAIRED_SQL, " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, count(*) AS n, round(sum({_X[i]} * {_X[j]}), 3) AS value FROM paired" for i in range(13) for j in range(i, 13))))
def _(spark, d):
    rows, names = ols(spark, d)
    return R.gramian(rows, len(names), "pair_mean").withColumn("value", F.round("value", 3))


def ols_sql() -> str:
    """Common table expressions that end in inv(m): Gauss-Jordan over [X'X | X'y | 1], one pivot a step, on columns scaled to unit length.

    A column that those before it explain is left out, so coefficients equal the minimum-norm ones where the columns are independent."""
    p = len(_X) - 1
    sums = ", ".join(f"sum({_X[i]} * {_X[j]}) AS g{i}_{j}" for i in range(p + 1) for j in range(i, p + 1))
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    unit = lambda i, j: f"{g(i, j)} / (sqrt({g(i, i)}) * sqrt({g(j, j)}))"
    rows = ", ".join("[" + ", ".join([*(unit(i, j) for j in range(p)), f"{g(i, p)} / sqrt({g(i, i)})", *(("1.0" if i == j else "0.0") + "::DOUBLE" for j in range(p))]) + "]" for i in range(p))
    return (
        f"gm AS (SELECT count(*) AS n, {sums} FROM paired), s0 AS (SELECT n, {g(p, p)} AS yy, [{', '.join(f'sqrt({g(i, i)})' for i in range(p))}] AS scale, [{', '.join(g(i, p) for i in range(p))}] AS xy, [{rows}] AS m FROM gm),"
        " ge(k, m) AS (SELECT 1, m FROM s0 UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: CASE WHEN m[k][k] > 1e-9 THEN v / m[k][k] ELSE 0 END) ELSE list_transform(r, lambda v, j: CASE WHEN m[k][k] > 1e-9 THEN v - r[k] * m[k][j] / m[k][k] ELSE v END) END)"
        f" FROM ge WHERE k <= {p}), inv AS (SELECT ge.m AS m, n, yy, scale, xy FROM ge, s0 WHERE k = {p + 1}),"
        f" beta AS (SELECT i, m[i][{p + 1}] / scale[i] AS beta, m[i][{p + 1} + i] / (scale[i] * scale[i]) AS vii, n, yy, xy FROM inv, range(1, {p + 1}) t(i)),"
        f" sg AS (SELECT (any_value(yy) - sum(beta * xy[i])) / (any_value(n) - count(*) FILTER (vii > 0)) AS sigma2 FROM beta)"
    )


_TERMS = ["intercept", "log_words", *(f"domain_id={k}" for k in range(2, 8)), "level=2", "level=3", "regime=structured", "regime=ungrounded"]
_TERM_SQL = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "][i]"


@query("ols_solution", with_cte("RECURSIVE " + S.PAIRED_SQL + ", " + ols_sql(), f"SELECT {_TERM_SQL} AS term, round(beta, 5) AS beta, round(sqrt(vii * sigma2), 5) AS se, round(beta / sqrt(vii * sigma2), 3) AS t FROM beta, sg"))
def _(spark, d):
    rows = [(k, round(b, 5), round(se, 5), round(t, 3)) for k, b, se, t, *_ in ols_fit(spark, d).rows()]
    return spark.createDataFrame(rows, "term string, beta double, se double, t double")


@query("ols_p")
def _(spark, d):
    return spark.createDataFrame(ols_fit(spark, d).rows(), "term string, beta double, se double, t double, p double, log10_p double")


def ols_fit(spark, d):
    rows, names = ols(spark, d)
    return R.solve(R.gramian(rows, len(names), "pair_mean"), names)


ADJ_SQL = "RECURSIVE " + S.PAIRED_SQL + ", " + ols_sql() + ", w AS (SELECT model, pair_mean, ln(1 + word_count::DOUBLE) AS x FROM paired), b AS (SELECT (SELECT beta FROM beta WHERE i = 2) AS slope, avg(x) AS mx FROM w)"


@query("length_adjusted", with_cte(ADJ_SQL, "SELECT model, round(avg(pair_mean), 6) AS raw_mean, round(avg(pair_mean - slope * (x - mx)), 5) AS adjusted_mean FROM w, b GROUP BY model"))
def _(spark, d):
    return adjusted(spark, d).withColumns({"raw_mean": F.round("raw_mean", 6), "adjusted_mean": F.round("adjusted_mean", 5)})


def adjusted(spark, d) -> DataFrame:
    """Means less what their answers' length explains: the slope of log words in the regression with domain, level and regime effects."""
    rows = S.paired(spark, d).withColumn("x", F.log1p("word_count"))
    slope = float(ols_fit(spark, d).beta[1])
    per = rows.groupBy("model").agg(F.avg("pair_mean").alias("raw_mean"), F.avg("x").alias("x"))
    one = rows.agg(F.avg("x").alias("mean_x"))  # one row
    return per.crossJoin(F.broadcast(one)).select("model", "raw_mean", (F.col("raw_mean") - F.lit(slope) * (F.col("x") - F.col("mean_x"))).alias("adjusted_mean"))


@query("rank_shift", with_cte(ADJ_SQL + ", m AS (SELECT model, round(avg(pair_mean), 6) AS r, round(avg(pair_mean - slope * (x - mx)), 6) AS a FROM w, b GROUP BY model), k AS (SELECT model, row_number() OVER (ORDER BY r DESC, model) AS raw_rank, row_number() OVER (ORDER BY a DESC, model) AS adjusted_rank FROM m)", "SELECT model, raw_rank, adjusted_rank, raw_rank - adjusted_rank AS shift FROM k"))
def _(spark, d):
    m = adjusted(spark, d).withColumns({"raw_mean": F.round("raw_mean", 6), "adjusted_mean": F.round("adjusted_mean", 6)})
    k = A.rank_systems(A.rank_systems(m, "raw_mean", "raw_rank"), "adjusted_mean", "adjusted_rank")
    return k.select("model", F.col("raw_rank").cast("long"), F.col("adjusted_rank").cast("long"), (F.col("raw_rank") - F.col("adjusted_rank")).cast("long").alias("shift"))


@query("null_sentinel_rank", with_cte(S.PAIRED_SQL + ", " + SIZES_SQL, "SELECT model, size_b, row_number() OVER (ORDER BY coalesce(size_b, 999), model) AS place FROM sizes"))
def _(spark, d):
    return A.sentinel_rank(sizes(spark, d).select("model", "size_b"), "size_b", "model", 999.0)


@query("simple_residual_rank", with_cte(S.PAIRED_SQL + ", b AS (SELECT regr_slope(pair_mean, word_count::DOUBLE) AS slope, regr_intercept(pair_mean, word_count::DOUBLE) AS ic, avg(pair_mean) AS grand FROM paired), m AS (SELECT model, round(avg(pair_mean - (ic + slope * word_count) + grand), 6) AS residual_mean FROM paired, b GROUP BY model)", "SELECT model, residual_mean, row_number() OVER (ORDER BY residual_mean DESC, model) AS rank FROM m"))
def _(spark, d):
    rows = S.paired(spark, d)
    one = R.simple_fit(rows.withColumn("w", F.col("word_count").cast("double")), "w", "pair_mean").select("slope", "intercept", "mean_y")
    per = rows.groupBy("model").agg(F.avg("pair_mean").alias("y"), F.avg("word_count").alias("w")).crossJoin(one)
    out = per.select("model", F.round(F.col("y") - (F.col("intercept") + F.col("slope") * F.col("w")) + F.col("mean_y"), 6).alias("residual_mean"))
    return A.rank_systems(out, "residual_mean").withColumn("rank", F.col("rank").cast("long"))


LOGSIZE_SQL = S.PAIRED_SQL + ", " + SIZES_SQL + ", " + MM_SQL + ", z AS (SELECT model, log10(size_b) AS x, mean_score AS y FROM sizes JOIN mm USING (model) WHERE size_b > 0)"


def log_sizes(spark, d) -> DataFrame:
    rows = sizes(spark, d).where("size_b > 0").join(A.means(S.paired(spark, d), ["model"], "pair_mean"), "model")
    return rows.select("model", F.log10("size_b").alias("x"), F.col("mean_score").alias("y"))


@query("log_size_regression", with_cte(LOGSIZE_SQL, "SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(y, x), 6) AS r, round(regr_r2(y, x), 6) AS r2, round(sqrt((1 - regr_r2(y, x)) * var_pop(y) / ((count(*) - 2) * var_pop(x))), 6) AS se FROM z"))
def _(spark, d):
    return rounded(R.simple_fit(log_sizes(spark, d), "x", "y").select("n", "slope", "intercept", "r", "r2", "se"), "slope", "intercept", "r", "r2", "se")


@query("log_size_p")
def _(spark, d):
    from assay.functions import prob

    return _with_p(R.simple_fit(log_sizes(spark, d), "x", "y").select("n", "slope", "se", "r"), lambda r, n: prob.pearson_p(r, n))


@query("residual_extremes", with_cte(LOGSIZE_SQL + ", b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM z), e AS (SELECT model, round(y - (i + s * x), 6) AS residual FROM z, b)", "(SELECT 'top' AS side, model, residual FROM e ORDER BY residual DESC, model LIMIT 5) UNION ALL (SELECT 'bottom', model, residual FROM e ORDER BY residual, model LIMIT 5)"))
def _(spark, d):
    rows = log_sizes(spark, d)
    e = rows.crossJoin(R.simple_fit(rows, "x", "y").select("slope", "intercept")).select("model", F.round(F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x")), 6).alias("residual"))
    top = e.orderBy(F.desc("residual"), "model").limit(5).select(F.lit("top").alias("side"), "model", "residual")
    return top.unionAll(e.orderBy("residual", "model").limit(5).select(F.lit("bottom").alias("side"), "model", "residual"))


SC_SQL = DM_SQL + ", " + SIZES_SQL + ", lg AS (SELECT 'D' || domain_id AS target, metric, CASE metric WHEN 'size_b' THEN size_b WHEN 'log10_size_b' THEN log10(size_b) WHEN 'active_b' THEN coalesce(active_b, size_b) ELSE log10(coalesce(active_b, size_b)) END AS x, m AS y FROM dm JOIN sizes USING (model), (VALUES ('size_b'), ('log10_size_b'), ('active_b'), ('log10_active_b')) v(metric))"
SC_SQL += f", rk AS (SELECT *, {MIDRANK('x', 'PARTITION BY target, metric')} AS rx, {MIDRANK('y', 'PARTITION BY target, metric')} AS ry FROM lg)"


def scaling_rows(spark, d) -> DataFrame:
    s = sizes(spark, d)
    own = F.coalesce("active_b", "size_b")
    metrics = F.array(*(F.struct(F.lit(k).alias("metric"), c.alias("x")) for k, c in (("size_b", F.col("size_b")), ("log10_size_b", F.log10("size_b")), ("active_b", own), ("log10_active_b", F.log10(own)))))
    long = s.select("model", F.inline(metrics))
    targets = domain_means(spark, d).select("model", F.concat(F.lit("D"), F.col("domain_id")).alias("target"), F.col("mean_score").alias("y"))
    return targets.join(long, "model")


@query("scaling_corr", with_cte(SC_SQL, f"SELECT target, metric, count(*) AS n, round({CORR('x', 'y')}, 6) AS pearson, round({CORR('rx', 'ry')}, 6) AS spearman FROM rk GROUP BY target, metric"))
def _(spark, d):
    rows = scaling_rows(spark, d)
    p = rows.groupBy("target", "metric").agg(F.count("*").alias("n"), G.pearson(F.col("x"), F.col("y")).alias("pearson"))
    return rounded(p.join(G.spearman(rows, "x", "y", ["target", "metric"]), ["target", "metric"]), "pearson", "spearman")


@query("scaling_p")
def _(spark, d):
    from assay.functions import prob

    rows = scaling_rows(spark, d)
    return _with_p(rows.groupBy("target", "metric").agg(F.count("*").alias("n"), G.pearson(F.col("x"), F.col("y")).alias("r")), lambda r, n: prob.pearson_p(r, n))


# Paired tests


WX_SQL = ", df AS (SELECT *, a - b AS d FROM pr), rk AS (SELECT model_a, model_b, d, " + MIDRANK("abs(d)", "PARTITION BY model_a, model_b") + " AS r FROM df WHERE d <> 0), tie AS (SELECT model_a, model_b, sum(t * t * t - t)::DOUBLE AS tie_term FROM (SELECT model_a, model_b, abs(d) AS s, count(*) AS t FROM df WHERE d <> 0 GROUP BY ALL) GROUP BY ALL)"
WX_SQL += ", sm AS (SELECT model_a, model_b, count(*) AS n_used, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM rk GROUP BY ALL), sz AS (SELECT model_a, model_b, count(*) AS n_common FROM df GROUP BY ALL)"
WX_OUT = "SELECT model_a, model_b, n_common, coalesce(n_used, 0) AS n_used, coalesce(w_plus, 0)::DOUBLE AS w_plus, coalesce(w_minus, 0)::DOUBLE AS w_minus, coalesce(tie_term, 0)::DOUBLE AS tie_term, least(coalesce(w_plus, 0), coalesce(w_minus, 0))::DOUBLE AS statistic FROM sz LEFT JOIN sm USING (model_a, model_b) LEFT JOIN tie USING (model_a, model_b)"


@query("wilcoxon_stat", with_cte(S.QMEAN_SQL + ", " + PAIRS_SQL + WX_SQL, WX_OUT))
def _(spark, d):
    return H.signed_rank(H.common_pairs(qmeans(spark, d)))


@query("wilcoxon_domain", with_cte(S.QMEAN_SQL + ", " + PAIRS_SQL + ", p7 AS (SELECT * FROM pr WHERE domain_id = 7 AND model_a = 'Brand#11' AND model_b = 'Brand#55')" + WX_SQL.replace("FROM pr)", "FROM p7)"), WX_OUT))
def _(spark, d):
    q = qmeans(spark, d).where((F.col("domain_id") == 7) & F.col("model").isin("Brand#11", "Brand#55"))
    return H.signed_rank(H.common_pairs(q))


@query("wilcoxon_p")
def _(spark, d):
    ship(spark)
    tested = H.with_p(H.signed_rank(H.common_pairs(qmeans(spark, d))))
    return H.bh_adjust(tested.withColumn("key", F.concat_ws("|", "model_a", "model_b")), "p_value", "key").drop("key")


@query("smd_pooled", with_cte(S.QMEAN_SQL + ", " + PAIRS_SQL, "SELECT model_a, model_b, round(CASE WHEN var_samp(a) + var_samp(b) > 0 THEN (avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2) ELSE 0 END, 6) AS smd FROM pr GROUP BY model_a, model_b"))
def _(spark, d):
    return H.common_pairs(qmeans(spark, d)).groupBy("model_a", "model_b").agg(F.round(H.mean_difference(F.col("a"), F.col("b")), 6).alias("smd"))


@query("rank_biserial", with_cte(S.QMEAN_SQL + ", " + PAIRS_SQL + WX_SQL, "SELECT model_a, model_b, (w_plus - w_minus) / (w_plus + w_minus) AS r, 1 - 2 * least(w_plus, w_minus) / (n_used * (n_used + 1) / 2) AS r_from_t FROM sm"))
def _(spark, d):
    s = H.signed_rank(H.common_pairs(qmeans(spark, d))).where("n_used > 0")
    n = F.col("n_used")
    return s.select("model_a", "model_b", H.rank_biserial(F.col("w_plus"), F.col("w_minus")).alias("r"), (1 - 2 * F.col("statistic") / (n * (n + 1) / 2)).alias("r_from_t"))


@query("effect_label", with_cte(S.QMEAN_SQL + ", " + PAIRS_SQL + WX_SQL + ", e AS (SELECT *, abs((w_plus - w_minus) / (w_plus + w_minus)) AS r FROM sm)", "SELECT model_a, model_b, CASE WHEN r < 0.1 THEN 'negligible' WHEN r < 0.3 THEN 'small' WHEN r < 0.5 THEN 'medium' ELSE 'large' END AS label FROM e"))
def _(spark, d):
    s = H.signed_rank(H.common_pairs(qmeans(spark, d))).where("n_used > 0")
    return s.select("model_a", "model_b", H.effect_label(H.rank_biserial(F.col("w_plus"), F.col("w_minus"))).alias("label"))


# Resampling


def plan_sql(source: str, stratum: str = "domain_id", reps: int = REPS) -> str:
    """Common table expressions that end in plan(rep, question_id, mult)."""
    return (
        f"cl AS (SELECT {stratum} AS s, question_id, row_number() OVER (PARTITION BY {stratum} ORDER BY question_id) - 1 AS slot, count(*) OVER (PARTITION BY {stratum}) AS size FROM (SELECT DISTINCT domain_id, question_id FROM {source})),"
        f" dr AS (SELECT rep, s, ('0x' || substr(md5('{SEED}:' || rep || ':' || s || ':' || slot), 1, 8))::BIGINT % size AS slot FROM cl, range({reps}) t(rep)),"
        " plan AS (SELECT rep, question_id, count(*) AS mult FROM dr JOIN cl USING (s, slot) GROUP BY ALL)"
    )


def clusters(spark, d) -> DataFrame:
    return S.paired(spark, d).select("domain_id", "question_id").distinct()


@query("bootstrap_plan", with_cte(S.PAIRED_SQL + ", " + plan_sql("paired"), "SELECT rep::INT AS rep, question_id, mult FROM plan"))
def _(spark, d):
    return B.hash_plan(clusters(spark, d), REPS, SEED)


BM_SQL = S.PAIRED_SQL + ", " + plan_sql("paired") + ", st AS (SELECT question_id, model, count(*) AS n, sum(pair_mean) AS total FROM paired GROUP BY ALL), bm AS (SELECT rep, model, sum(mult * total) / sum(mult * n) AS mean FROM plan JOIN st USING (question_id) GROUP BY ALL)"
CI_SQL = lambda x: f"count({x}) AS reps, round(quantile_cont({x}, 0.025), 6) AS ci_low, round(quantile_cont({x}, 0.5), 6) AS ci_mid, round(quantile_cont({x}, 0.975), 6) AS ci_high"


def rep_means(spark, d, by: list[str] | None = None, plan: DataFrame | None = None) -> DataFrame:
    rows = S.paired(spark, d)
    keys = by or ["model"]
    return B.replicate_means(plan or B.hash_plan(clusters(spark, d), REPS, SEED), B.sums(rows, keys, total=F.col("pair_mean")), keys, "total")


@query("bootstrap_model_ci", with_cte(BM_SQL, f"SELECT model, {CI_SQL('mean')} FROM bm GROUP BY model"))
def _(spark, d):
    return rounded(B.interval(rep_means(spark, d), ["model"], "mean"), "ci_low", "ci_mid", "ci_high")


@query("bootstrap_rank_bands", with_cte(BM_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY round(mean, 9) DESC, model) AS k FROM bm)", f"SELECT model, quantile_cont(k::DOUBLE, 0.5) AS median_rank, round(quantile_cont(k::DOUBLE, 0.025), 6) AS rank_low, round(quantile_cont(k::DOUBLE, 0.975), 6) AS rank_high, {SHARE('k <= 1')} AS top_1, {SHARE('k <= 3')} AS top_3 FROM r GROUP BY model"))
def _(spark, d):
    return rounded(B.rank_bands(rep_means(spark, d).withColumn("mean", F.round("mean", 9))), "rank_low", "rank_high")


BD_SQL = S.PAIRED_SQL + ", {plan}, st AS (SELECT question_id, model, domain_id, count(*) AS n, sum(pair_mean) AS total FROM paired GROUP BY ALL), bd AS (SELECT rep, model, domain_id, sum(mult * total) / sum(mult * n) AS m FROM plan JOIN st USING (question_id) GROUP BY ALL), bc AS (SELECT rep, model, " + SUM_SQL + " AS composite FROM bd GROUP BY rep, model), ds AS (SELECT f || '__minus__' || s AS pair, a.composite - b.composite AS difference FROM (" + COMPARED_SQL + ") v(f, s) JOIN bc a ON a.model = f JOIN bc b ON b.model = s AND a.rep = b.rep)"
DIFF_SQL = f"SELECT pair, {CI_SQL('difference')}, quantile_cont(difference, 0.025) <= 0 AND quantile_cont(difference, 0.975) >= 0 AS includes_zero FROM ds WHERE difference IS NOT NULL GROUP BY pair"


def rep_differences(spark, d, plan: DataFrame) -> DataFrame:
    return differences_ci(rep_means(spark, d, ["model", "domain_id"], plan))


def differences_ci(m: DataFrame) -> DataFrame:
    """Intervals of the compared systems' differences of composites, from replicates' domain means."""
    c = rep_composites(m)
    own = m.sparkSession.createDataFrame(COMPARED, "first string, second string")
    a = c.select("rep", F.col("model").alias("first"), F.col("composite").alias("a"))
    b = c.select("rep", F.col("model").alias("second"), F.col("composite").alias("b"))
    both = own.join(a, "first").join(b, ["second", "rep"]).select(F.concat_ws("__minus__", "first", "second").alias("pair"), (F.col("a") - F.col("b")).alias("difference"))
    ci = B.interval(both.where("difference IS NOT NULL"), ["pair"], "difference")
    return rounded(ci.withColumn("includes_zero", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)), "ci_low", "ci_mid", "ci_high")


@query("bootstrap_pair_diff_ci", with_cte(BD_SQL.replace("{plan}", plan_sql("paired")), DIFF_SQL))
def _(spark, d):
    return rep_differences(spark, d, B.hash_plan(clusters(spark, d), REPS, SEED))


@query("bootstrap_unstratified_diff", with_cte(BD_SQL.replace("{plan}", plan_sql("paired", "0")), DIFF_SQL))
def _(spark, d):
    return rep_differences(spark, d, B.hash_plan(clusters(spark, d), REPS, SEED, stratum=None))


BI_SQL = S.PAIRED_SQL + ", " + plan_sql("paired") + ", st AS (SELECT question_id, count(*) AS n, sum(score_a) AS sa, sum(score_b) AS sb, sum(score_a * score_a) AS saa, sum(score_b * score_b) AS sbb, sum(score_a * score_b) AS sab FROM paired GROUP BY ALL), t AS (SELECT rep, sum(mult * n)::DOUBLE AS n, sum(mult * sa) AS sa, sum(mult * sb) AS sb, sum(mult * saa) AS saa, sum(mult * sbb) AS sbb, sum(mult * sab) AS sab FROM plan JOIN st USING (question_id) GROUP BY rep), f AS (SELECT *, (sa + sb) * (sa + sb) / (2 * n) AS fx FROM t), m AS (SELECT *, ((saa + sbb + 2 * sab) / 2 - fx) / (n - 1) AS r, (sa * sa + sb * sb) / n - fx AS c FROM f), e AS (SELECT *, (saa + sbb - fx - r * (n - 1) - c) / (n - 1) AS e FROM m), i AS (SELECT rep, (r - e) / (r + (c - e) / n) AS icc_k FROM e)"


@query("bootstrap_icc_ci", with_cte(BI_SQL, f"SELECT {CI_SQL('icc_k')} FROM i"))
def _(spark, d):
    reps = B.replicate_icc(B.hash_plan(clusters(spark, d), REPS, SEED), S.paired(spark, d), "score_a", "score_b")
    return rounded(B.interval(reps, [], "icc_k"), "ci_low", "ci_mid", "ci_high")


@query("bootstrap_reliability")
def _(spark, d):
    return rep_reliability(S.paired(spark, d))


def rep_reliability(rows: DataFrame, reps: int = REPS, seed: int = SEED) -> DataFrame:
    plan = B.hash_plan(rows.select("domain_id", "question_id").distinct(), reps, seed)
    ship(rows.sparkSession)
    return B.replicate_reliability(plan, rows, "score_a", "score_b")


RELIABILITY = ["mean_diff", "mean_abs_diff", "pearson", "spearman", "exact", "within_25", "within_50", "within_100", "normal_low", "normal_high", "empirical_low", "empirical_high", "icc_1", "icc_k"]
RATE_SQL = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
REL_SQL = S.PAIRED_SQL + ", " + plan_sql("paired") + (
    ", st AS (SELECT question_id, count(*) AS n, sum(diff) AS sd, sum(diff * diff) AS sdd, sum(abs(diff)) AS sabs, sum(score_a) AS sa, sum(score_b) AS sb, sum(score_a * score_a) AS saa, sum(score_b * score_b) AS sbb, sum(score_a * score_b) AS sab,"
    f" {RATE_SQL('abs(diff) < 1e-9')} AS e0, {RATE_SQL('abs(diff) <= 0.25')} AS e1, {RATE_SQL('abs(diff) <= 0.5')} AS e2, {RATE_SQL('abs(diff) <= 1.0')} AS e3 FROM paired GROUP BY ALL)"
    ", t AS (SELECT rep, " + ", ".join(f"sum(mult * {c})::DOUBLE AS {c}" for c in ("n", "sd", "sdd", "sabs", "sa", "sb", "saa", "sbb", "sab", "e0", "e1", "e2", "e3")) + " FROM plan JOIN st USING (question_id) GROUP BY rep)"
    ", f AS (SELECT *, (sa + sb) * (sa + sb) / (2 * n) AS fx, sqrt((sdd - sd * sd / n) / (n - 1)) AS dev FROM t)"
    ", m AS (SELECT *, ((saa + sbb + 2 * sab) / 2 - fx) / (n - 1) AS r, (sa * sa + sb * sb) / n - fx AS c FROM f), e AS (SELECT *, (saa + sbb - fx - r * (n - 1) - c) / (n - 1) AS e FROM m)"
    ", hs AS (SELECT rep, score_a, score_b, sum(mult * k) AS w FROM plan JOIN (SELECT question_id, score_a, score_b, count(*) AS k FROM paired GROUP BY ALL) USING (question_id) GROUP BY ALL)"
    ", ra AS (SELECT rep, score_a, sum(w) OVER (PARTITION BY rep ORDER BY score_a) - w / 2.0 + 0.5 AS x FROM (SELECT rep, score_a, sum(w)::DOUBLE AS w FROM hs GROUP BY ALL))"
    ", rb AS (SELECT rep, score_b, sum(w) OVER (PARTITION BY rep ORDER BY score_b) - w / 2.0 + 0.5 AS y FROM (SELECT rep, score_b, sum(w)::DOUBLE AS w FROM hs GROUP BY ALL))"
    ", rk AS (SELECT rep, w::DOUBLE AS w, x - (sum(w) OVER (PARTITION BY rep) + 1) / 2.0 AS x, y - (sum(w) OVER (PARTITION BY rep) + 1) / 2.0 AS y FROM hs JOIN ra USING (rep, score_a) JOIN rb USING (rep, score_b))"
    ", sp AS (SELECT rep, sum(w * x * y) / (sqrt(sum(w * x * x)) * sqrt(sum(w * y * y))) AS spearman FROM rk GROUP BY rep)"
    ", cu AS (SELECT rep, diff, sum(w) OVER (PARTITION BY rep ORDER BY diff) AS upto, sum(w) OVER (PARTITION BY rep) AS n FROM (SELECT rep, diff, sum(mult * k)::DOUBLE AS w FROM plan JOIN (SELECT question_id, diff, count(*) AS k FROM paired GROUP BY ALL) USING (question_id) GROUP BY ALL))"
    ", pc AS (SELECT rep, " + ", ".join(f"min(diff) FILTER (upto > floor((n - 1) * {p})) AS lo{k}, min(diff) FILTER (upto > ceil((n - 1) * {p})) AS hi{k}, any_value((n - 1) * {p} - floor((n - 1) * {p})) AS f{k}" for k, p in ((0, "0.025::DOUBLE"), (1, "0.975::DOUBLE"))) + " FROM cu GROUP BY rep)"
    ", every AS (SELECT rep, sd / n AS mean_diff, sabs / n AS mean_abs_diff, (n * sab - sa * sb) / (sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb)) AS pearson, spearman, e0 / n AS exact, e1 / n AS within_25, e2 / n AS within_50, e3 / n AS within_100,"
    " sd / n - 1.96 * dev AS normal_low, sd / n + 1.96 * dev AS normal_high, lo0 + (hi0 - lo0) * f0 AS empirical_low, lo1 + (hi1 - lo1) * f1 AS empirical_high, (r - e) / (r + e + 2 * (c - e) / n) AS icc_1, (r - e) / (r + (c - e) / n) AS icc_k FROM e JOIN sp USING (rep) JOIN pc USING (rep))"
)


@query("bootstrap_reliability_ci", with_cte(REL_SQL, " UNION ALL ".join(f"SELECT '{k}' AS measure, count({k}) AS reps, round(quantile_cont({k}, 0.025), 4) AS ci_95_low, round(quantile_cont({k}, 0.975), 4) AS ci_95_high FROM every" for k in RELIABILITY)))
def _(spark, d):
    return reliability_ci(S.paired(spark, d))


def reliability_ci(rows: DataFrame, reps: int = REPS, seed: int = SEED) -> DataFrame:
    every = F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).cast("double").alias("value")) for k in RELIABILITY))
    ci = B.interval(rep_reliability(rows, reps, seed).select(F.inline(every)), ["measure"], "value")
    return ci.select("measure", "reps", F.round("ci_low", 4).alias("ci_95_low"), F.round("ci_high", 4).alias("ci_95_high"))


LB_SQL = BM_SQL + ", " + BD_SQL[BD_SQL.index("{plan}, ") + 8 :].replace("st AS (SELECT question_id, model, domain_id", "sd AS (SELECT question_id, model, domain_id").replace("JOIN st USING", "JOIN sd USING") + (
    ", ob AS (SELECT model, count(*) AS paired_rows, avg(pair_mean) AS mean FROM paired GROUP BY model), dm AS (SELECT model, domain_id, avg(pair_mean) AS m FROM paired GROUP BY model, domain_id)"
    f", comp AS (SELECT model, 0::DOUBLE + {SUM_SQL} AS composite FROM dm GROUP BY model)"
    ", o AS (SELECT *, row_number() OVER (ORDER BY round(mean, 9) DESC, model) AS k FROM ob), oc AS (SELECT *, row_number() OVER (ORDER BY round(composite, 9) DESC, model) AS k FROM comp WHERE composite IS NOT NULL)"
    ", r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY round(mean, 9) DESC, model) AS k FROM bm), rc AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY round(composite, 9) DESC, model) AS k FROM bc WHERE composite IS NOT NULL)"
    ", " + ", ".join(
        f"{name} AS (SELECT model, round(quantile_cont({x}, 0.025), 4) AS low, round(quantile_cont({x}, 0.975), 4) AS high, round(quantile_cont(k::DOUBLE, 0.5), 2) AS mid, round(quantile_cont(k::DOUBLE, 0.025), 2) AS k_low, round(quantile_cont(k::DOUBLE, 0.975), 2) AS k_high, round(avg(CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS top_1, round(avg(CASE WHEN k <= 3 THEN 1.0::DOUBLE ELSE 0 END), 4) AS top_3 FROM {of} GROUP BY model)"
        for name, of, x in (("ra", "r", "mean"), ("ca", "rc", "composite"))
    )
)
BAND = {"median_bootstrap_rank": "mid", "rank_95_low": "k_low", "rank_95_high": "k_high", "top_1_rate": "top_1", "top_3_rate": "top_3"}
LB_OUT = (
    "SELECT o.model, paired_rows, round(mean, 4) AS observed_mean, ra.low AS ci_95_low, ra.high AS ci_95_high, o.k AS observed_rank, " + ", ".join(f"ra.{c} AS {n}" for n, c in BAND.items())
    + ", round(composite, 4) AS composite_observed, ca.low AS composite_ci_95_low, ca.high AS composite_ci_95_high, oc.k AS composite_observed_rank, " + ", ".join(f"ca.{c} AS composite_{n}" for n, c in BAND.items())
    + " FROM o LEFT JOIN ra USING (model) LEFT JOIN oc USING (model) LEFT JOIN ca USING (model)"
)


def band(reps: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """(model, interval, median rank, rank band, how often first and among the first three) over replicates."""
    own = reps.where(F.col(value).isNotNull()).select("rep", "model", F.round(value, 9).alias("_ranked"), value)
    ci = B.interval(own, ["model"], value).select("model", F.round("ci_low", 4).alias(f"{prefix}ci_95_low"), F.round("ci_high", 4).alias(f"{prefix}ci_95_high"))
    ranks = B.rank_bands(own, value="_ranked")
    return ci.join(ranks.select("model", F.round("median_rank", 2).alias(f"{prefix}median_bootstrap_rank"), F.round("rank_low", 2).alias(f"{prefix}rank_95_low"), F.round("rank_high", 2).alias(f"{prefix}rank_95_high"), F.round("top_1", 4).alias(f"{prefix}top_1_rate"), F.round("top_3", 4).alias(f"{prefix}top_3_rate")), "model")


def rep_composites(m: DataFrame) -> DataFrame:
    """(rep, model, composite) of each replicate's domain means (rep, model, domain_id, mean); null where a domain is missing."""
    wide = m.groupBy("rep", "model").pivot("domain_id", S.DOMAINS).agg(F.max("mean"))
    return wide.select("rep", "model", sum((F.col(str(k)) * F.lit(w) for k, w in S.WEIGHTS.items()), F.lit(0.0)).alias("composite"))


def leaderboard(rows: DataFrame, reps: int = REPS, seed: int = SEED) -> DataFrame:
    """The 20 columns that are published for each system of the paired rows."""
    plan = B.hash_plan(rows.select("domain_id", "question_id").distinct(), reps, seed)
    own = B.replicate_means(plan, B.sums(rows, ["model"], total=F.col("pair_mean")), ["model"], "total")
    by_domain = B.replicate_means(plan, B.sums(rows, ["model", "domain_id"], total=F.col("pair_mean")), ["model", "domain_id"], "total")
    seen = rows.groupBy("model").agg(F.count("*").alias("paired_rows"), F.avg("pair_mean").alias("mean"))
    whole = A.composite(A.means(rows, ["domain_id", "model"], "pair_mean"), S.WEIGHTS)
    rank = lambda df, c, name: A.rank_systems(df.withColumn("_ranked", F.round(c, 9)), "_ranked", name).withColumn(name, F.col(name).cast("long"))
    out = rank(seen, "mean", "observed_rank").select("model", "paired_rows", F.round("mean", 4).alias("observed_mean"), "observed_rank").join(band(own, "mean"), "model", "left")
    composites = rank(whole, "composite", "composite_observed_rank").select("model", F.round("composite", 4).alias("composite_observed"), "composite_observed_rank")
    out = out.join(composites, "model", "left").join(band(rep_composites(by_domain), "composite", "composite_"), "model", "left")
    return out.select(*LEADERBOARD)


LEADERBOARD = ["model", "paired_rows", "observed_mean", "ci_95_low", "ci_95_high", "observed_rank", *BAND, *(f"composite_{c}" for c in ("observed", "ci_95_low", "ci_95_high", "observed_rank", *BAND))]


@query("bootstrap_leaderboard", with_cte(LB_SQL, LB_OUT))
def _(spark, d):
    return leaderboard(S.paired(spark, d))


@query("composite_leaderboard", with_cte(LB_SQL, f"SELECT * FROM ({LB_OUT}) WHERE composite_observed IS NOT NULL ORDER BY composite_observed DESC, model"))
def _(spark, d):
    return leaderboard(S.paired(spark, d)).where("composite_observed IS NOT NULL").orderBy(F.desc("composite_observed"), "model")


@query("bootstrap_domain_ci", with_cte(LB_SQL, "SELECT domain_id, model, round(any_value(v.m), 4) AS observed_mean, round(quantile_cont(bd.m, 0.025), 4) AS ci_95_low, round(quantile_cont(bd.m, 0.975), 4) AS ci_95_high FROM dm v JOIN bd USING (domain_id, model) GROUP BY domain_id, model"))
def _(spark, d):
    return domain_ci(S.paired(spark, d))


def domain_ci(rows: DataFrame, reps: int = REPS, seed: int = SEED) -> DataFrame:
    keys = ["domain_id", "model"]
    plan = B.hash_plan(rows.select("domain_id", "question_id").distinct(), reps, seed)
    ci = B.interval(B.replicate_means(plan, B.sums(rows, keys, total=F.col("pair_mean")), keys, "total"), keys, "mean")
    seen = A.means(rows, keys, "pair_mean").select("domain_id", "model", F.round("mean_score", 4).alias("observed_mean"))
    return seen.join(ci.select("domain_id", "model", F.round("ci_low", 4).alias("ci_95_low"), F.round("ci_high", 4).alias("ci_95_high")), ["domain_id", "model"])


def row_ci(spark, d, by: list[str], least: int = 1) -> DataFrame:
    """Rows themselves are drawn, all of them. No SQL: 1000 draws of every row are too many for an engine that makes each one a row."""
    ship(spark)
    means = B.row_means(S.paired(spark, d), by, "pair_mean", REPS, SEED, least)
    return rounded(B.interval(means, by, "mean"), "ci_low", "ci_mid", "ci_high")


@query("bootstrap_rows_ci")
def _(spark, d):
    return row_ci(spark, d, ["level"])


@query("bootstrap_rows_model_ci")
def _(spark, d):
    return row_ci(spark, d, ["model"])


@query("bootstrap_rows_cell_ci")
def _(spark, d):
    return row_ci(spark, d, ["model", "domain_id"], least=3)


BQ_SQL = S.QMEAN_SQL + ", " + plan_sql("paired") + ", m AS (SELECT rep, model, domain_id, sum(mult * mean_score) / sum(mult) AS mean FROM plan JOIN qmean USING (question_id) GROUP BY ALL)"


@query("bootstrap_question_ci", with_cte(BQ_SQL, f"SELECT model, domain_id, {CI_SQL('mean')} FROM m GROUP BY model, domain_id"))
def _(spark, d):
    q = qmeans(spark, d).select("question_id", "model", "domain_id", "mean_score").withColumn("n", F.lit(1))
    m = B.replicate_means(B.hash_plan(clusters(spark, d), REPS, SEED), q, ["model", "domain_id"], "mean_score")
    return rounded(B.interval(m, ["model", "domain_id"], "mean"), "ci_low", "ci_mid", "ci_high")


@query("eligible_models", with_cte(S.PAIRED_SQL + ", " + MM_SQL, "SELECT model, n FROM mm WHERE n >= 100"))
def _(spark, d):
    return P.eligible(S.paired(spark, d), 100).groupBy("model").agg(F.count("*").alias("n"))


# Provenance and export


@query("release_closure", "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer SEMI JOIN n ON c_nationkey = n_nationkey), o AS (SELECT o_orderkey FROM orders SEMI JOIN c ON o_custkey = c_custkey), l AS (SELECT l_orderkey FROM lineitem SEMI JOIN o ON l_orderkey = o_orderkey) SELECT 'nation' AS name, count(*) AS n FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l")
def _(spark, d):
    from assay.sources.export import closure

    t = {n: S.table(spark, d, n) for n in ("nation", "customer", "orders", "lineitem")}
    kept = closure({**t, "nation": t["nation"].where("n_regionkey = 2")}, [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    out = None
    for n in t:
        one = kept[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


FP_KEY = "model || '|' || question_id || '|' || run_number || '|' || (score_a * 8)::INT || '|' || (score_b * 8)::INT"


@query("rowset_fingerprint", with_cte(S.STAR_SQL, f"SELECT model, sha256(string_agg(d, '' ORDER BY r)) AS fingerprint, sum(n)::BIGINT AS n FROM (SELECT model, substr(h, 1, 3) AS r, sha256(string_agg(h || ':' || n, '' ORDER BY h || ':' || n)) AS d, sum(n) AS n FROM (SELECT model, sha256({FP_KEY}) AS h, count(*) AS n FROM star GROUP BY ALL) GROUP BY ALL) GROUP BY model"))
def _(spark, d):
    from assay.sources.export import fingerprint

    rows = S.star(spark, d, "model", "question_id", "run_number", "score_a", "score_b")
    rows = rows.withColumns({"a8": (F.col("score_a") * 8).cast("int"), "b8": (F.col("score_b") * 8).cast("int")})
    return fingerprint(rows, ["model", "question_id", "run_number", "a8", "b8"], ["model"])


@query("row_counts", with_cte(S.PAIRED_SQL, "SELECT count(*) AS total_rows, count(DISTINCT model) AS models, count(DISTINCT question_id) AS questions FROM paired"))
def _(spark, d):
    return S.paired(spark, d).agg(F.count("*").alias("total_rows"), F.count_distinct("model").alias("models"), F.count_distinct("question_id").alias("questions"))
