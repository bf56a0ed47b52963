"""Hand-derived cases for the engine's operators."""

import functools
import json
import math
import os
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import prob
from assay.functions import text as T
from assay.operators import aggregates as A
from assay.operators import agreement as G
from assay.operators import hypothesis as H
from assay.operators import pairing as P
from assay.operators import regression as R
from assay.operators import resample as B
from assay.plans.star import WEIGHTS
from assay.sources import export, files, sqlite


def values(spark, xs, name="x"):
    return spark.createDataFrame([(float(x),) for x in xs], f"{name} double")


@pytest.mark.parametrize(("xs", "p", "want"), [([3.7], 0.0, 3.7), ([3.7], 1.0, 3.7), ([1, 2, 3, 4, 5], 0.5, 3), ([1, 2, 3, 4], 0.5, 2.5), ([1, 2, 3, 4], 0.25, 1.75), ([1, 2, 3, 4], 0.75, 3.25)])
def test_percentile(spark, xs, p, want):
    assert values(spark, xs).agg(F.percentile("x", F.lit(p))).first()[0] == want


@pytest.mark.parametrize(("xs", "want"), [([1, 3, 2], [1, 3, 2]), ([5, 5, 5], [2, 2, 2]), ([1, 2, 2, 4], [1, 2.5, 2.5, 4]), ([5, 1, 5, 3], [3.5, 1, 3.5, 2]), ([42], [1])])
def test_midranks(spark, xs, want):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    assert [r.midrank for r in A.midranks(df, "x").orderBy("i").collect()] == want


@pytest.mark.parametrize(("rows", "one", "many"), [([(1, 2), (3, 2), (2, 4), (4, 4)], 8 / 17, 0.64), ([(1, 1), (2, 2), (3, 3), (4, 4)], 1, 1), ([(1, 2)], None, None)])
def test_icc(spark, rows, one, many):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double")
    parts = G.icc([F.col("a"), F.col("b")])
    got = df.agg(parts["icc_1"].alias("one"), parts["icc_k"].alias("many")).first()
    for x, want in ((got.one, one), (got.many, many)):
        assert x is None if want is None else math.isclose(x, want)


def test_constant_and_short_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(G.pearson(F.col("x"), F.col("y"))).first()[0] is None
    assert df.limit(1).agg(G.pearson(F.col("y"), F.col("y"))).first()[0] is None
    assert df.limit(0).agg(G.pearson(F.col("y"), F.col("y"))).first()[0] is None


def domain_rows(spark, rows):
    return spark.createDataFrame([(m, d, float(x)) for m, xs in rows.items() for d, x in enumerate(xs, 1) if x is not None], "model string, domain_id long, mean_score double")


def test_composite(spark):
    assert abs(sum(WEIGHTS.values()) - 1) < 1e-9
    rows = domain_rows(spark, {"a": [4, 3, 2, 1, 5, 2, 3], "b": [4.3029, 2.825, 2.1086, 2.5054, 2.8991, 2.0, 2.1632], "c": [1, 1, 1, 1, 1, 1, None]})
    got = {r.model: r.composite for r in A.composite(rows, WEIGHTS).collect()}
    assert math.isclose(got["a"], 2.9) and abs(got["b"] - 2.540643) < 1e-4 and "c" not in got
    assert {r.model: r.composite for r in A.composite(rows, WEIGHTS, on_missing="null").collect()}["c"] is None
    with pytest.raises(ValueError, match="must sum to 1.0"):
        A.composite(rows, {1: 0.5})


def test_pair_differences(spark):
    c = spark.createDataFrame([("a", 3.0), ("b", 1.5), ("c", 2.0)], "model string, composite double")
    got = {r.pair: r.difference for r in A.pair_differences(c, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "z")]).collect()}
    assert got == {"a__minus__b": 1.5, "b__minus__c": -0.5, "c__minus__a": -1.0}


LANES = {"a": ("ja", "%primary"), "b": ("jb", "%comparison")}


def evaluations(spark, more=()):
    rows = [(201, "ja", "v2_primary", 3.5), (201, "jb", "v2_Comparison", 3.0), (202, "ja", "v2_primary", 4.0), (202, "jb", "v2_comparison", 4.5), (203, "ja", "v2_primary", 2.5), (203, "jb", "v2_comparison", 2.5), (204, "ja", "v2_primary", 1.0), *more]
    return spark.createDataFrame(rows, "response_id long, judge_model string, version string, score double")


def test_pairing_and_guard(spark):
    got = {r.response_id: (r.a, r.b) for r in P.pair_lanes(evaluations(spark), ["response_id"], LANES, guard=True).collect()}
    assert got == {201: (3.5, 3.0), 202: (4.0, 4.5), 203: (2.5, 2.5)}
    twice = evaluations(spark, [(201, "ja", "v3_primary", 3.7)])
    with pytest.raises(P.DuplicateRows):
        P.pair_lanes(twice, ["response_id"], LANES, guard=True)
    assert [r.response_id for r in P.duplicates(twice, ["response_id"], LANES).collect()] == [201]


def test_filters_differ(spark):
    rows = spark.createDataFrame([(1, 1, 1, None, 1, 0), (2, 1, 1, "2026", 1, 0), (3, 2, 1, None, 0, 0)], "id int, benchmark_release_id int, release_id int, retired_at string, is_included int, is_supplementary int")
    ids = lambda spec: sorted(r.id for r in spec.apply(rows).collect())
    assert (ids(P.TWO_LANE), ids(P.VIEW), ids(P.THREE_LANE)) == ([1], [1, 2], [1])


def test_bootstrap_plans(spark):
    clusters = [(d, d * 10 + q) for d in (1, 2) for q in range(5)]
    df = spark.createDataFrame(clusters, "domain_id long, question_id long")
    rows = lambda p: sorted(map(tuple, p.select("rep", "question_id", "mult").collect()))
    a = rows(B.hash_plan(df, 20, 42))
    assert a == rows(B.hash_plan(df.repartition(7), 20, 42)) != rows(B.hash_plan(df, 20, 43))
    for rep in range(20):
        assert sum(m for r, q, m in a if r == rep and q < 20) == 5 == sum(m for r, q, m in a if r == rep and q >= 20)
    rng, want = random.Random(9), {}
    for rep in range(3):
        for d in (1, 2):
            own = [q for e, q in clusters if e == d]
            for _ in own:
                k = rep, rng.choice(own)
                want[k] = want.get(k, 0) + 1
    assert {(r, q): m for r, q, m in rows(B.mt19937_plan(spark, clusters, 3, 9))} == want
    assert sum(m for *_, m in rows(B.pcg64_plan(spark, [q for _, q in clusters], 4, 1))) == 40


def test_replicates_equal_expanded_rows(spark):
    rng = random.Random(1)
    data = [(q, q % 2 + 1, float(rng.randint(0, 8)), float(rng.randint(0, 8))) for q in range(12) for _ in range(3)]
    df = spark.createDataFrame(data, "question_id long, domain_id long, a double, b double").withColumn("d", F.col("b") - F.col("a"))
    plan = B.hash_plan(df.select("domain_id", "question_id").distinct(), 5, 3)
    icc = {r.rep: r for r in B.replicate_icc(plan, df, "a", "b").collect()}
    rho = {r.rep: r.spearman for r in B.replicate_spearman(plan, df, "a", "b").collect()}
    lim = {r.rep: (r.low, r.high) for r in B.replicate_limits(plan, df, "d").collect()}
    times = {}
    for r in plan.collect():
        times.setdefault(r.rep, {})[r.question_id] = r.mult
    for rep, m in times.items():
        rows = [(a, b) for q, _, a, b in data for _ in range(m.get(q, 0))]
        one = spark.createDataFrame(rows, "a double, b double")
        parts = G.icc([F.col("a"), F.col("b")])
        assert math.isclose(icc[rep].icc_k, one.agg(parts["icc_k"]).first()[0], rel_tol=1e-9)
        assert math.isclose(rho[rep], G.spearman(one, "a", "b").first().spearman, rel_tol=1e-9)
        assert np.allclose(lim[rep], np.percentile([b - a for a, b in rows], [2.5, 97.5]))


def test_row_replicates_draw_all_rows(spark):
    rng = random.Random(4)
    data = [(1 + i % 3, rng.randint(0, 50) / 8) for i in range(600)]
    df = spark.createDataFrame(data, "level long, x double")
    got = sorted(map(tuple, B.row_means(df, "level", "x", 1000, 7).collect()))
    assert got == sorted(map(tuple, B.row_means(df.repartition(5), "level", "x", 1000, 7).collect())) and len(got) == 3000
    brute = np.random.default_rng(1)
    for level in (1, 2, 3):
        own = np.array([x for k, x in data if k == level])
        want = own[brute.integers(0, len(own), (4000, len(own)))].mean(axis=1)
        means = np.array([m for _, k, m in got if k == level])
        assert abs(means.mean() - own.mean()) < 0.03 and abs(means.std() / want.std() - 1) < 0.1
        assert np.allclose(np.percentile(means, [2.5, 97.5]), np.percentile(want, [2.5, 97.5]), atol=0.06)


def test_registered_row_bootstrap_draws_all_paired_rows(spark):
    from assay.plans import star
    from assay.queries import QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    rows = star.paired(spark, d).select("level", "pair_mean").collect()
    for r in QUERIES["bootstrap_rows_ci"](spark, d).collect():
        own = np.array([x.pair_mean for x in rows if x.level == r.level])
        half = 1.96 * own.std() / np.sqrt(len(own))
        assert r.reps == 1000 and np.allclose([r.ci_low, r.ci_mid, r.ci_high], own.mean() + np.array([-half, 0, half]), atol=half / 4)


def test_tails():
    assert math.isclose(prob.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-12)
    assert math.isclose(prob.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(prob.t_two_sided(1.0, 1), 0.5, rel_tol=1e-12)
    assert prob.log_t_two_sided(60.0, 5000) < -1000 and prob.pearson_p(1.0, 9) == 0.0 and prob.pearson_p(0.5, 2) is None
    assert prob.signed_rank_exact(0, 5) == 2 / 32 and prob.signed_rank_p(0, 0, 0) == 1.0
    assert math.isclose(prob.signed_rank_p(3, 6, 0), 0.15625) and prob.format_p(0.0) == "< 1e-300" and prob.format_p(0.25) == "0.2500"


def test_signed_rank_and_bh(spark):
    rows = [("a", "b", q, x, y) for q, (x, y) in enumerate([(1, 2), (3, 1), (5, 5), (4, 1), (2, 3)])] + [("a", "c", q, 1.0, 1.0) for q in range(3)]
    df = spark.createDataFrame([(m, n, q, float(x), float(y)) for m, n, q, x, y in rows], "model_a string, model_b string, question_id long, a double, b double")
    got = {r.model_b: r for r in H.with_p(H.signed_rank(df)).collect()}
    assert (got["b"].w_plus, got["b"].w_minus, got["b"].tie_term, got["b"].n_used) == (7.0, 3.0, 6.0, 4)
    assert (got["c"].statistic, got["c"].p_value, got["c"].n_used) == (0.0, 1.0, 0)
    p = [0.01, 0.04, 0.03, 0.005]
    adj = H.bh_adjust(spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "k string, p double"), "p", "k").orderBy("k").collect()
    assert np.allclose([r.adjusted for r in adj], [0.02, 0.04, 0.04, 0.02])


def test_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = [(float(w), "xy"[i % 2], float(1 + 0.5 * np.log1p(w) + 2 * (i % 2) + rng.normal() * 0.1)) for i, w in enumerate(rng.integers(5, 500, 80))]
    df = spark.createDataFrame(rows, "w double, g string, y double")
    d, names = R.design(df, {"log_w": F.log1p("w")}, ["g"])
    fit = R.solve(R.gramian(d, len(names), "y"), names)
    x = np.array([[1, np.log1p(w), g == "y"] for w, g, _ in rows], float)
    assert np.allclose(fit.beta, np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0]) and fit.rank == 3
    twin = d.withColumn("x_3", F.col("x_2"))
    assert R.solve(R.gramian(twin, 4, "y"), [*names, "again"]).rank == 3


def test_redaction(spark):
    texts = ["see /Users/ann/a/b.txt, ok", "/Users/x/y/ /Users/z", "none", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.redact_paths(F.col("t"))).collect()]
    assert got == ["see [redacted-local-path:b.txt], ok", "[redacted-local-path:y] [redacted-local-path:z]", "none", None]
    assert T.sanitize({"Local_Path": ["/a/b"]}, False)["Local_Path"][0]["basename"] == "b"
    assert T.sanitize({"body": "x", "n": 1}, True)["body"]["char_count"] == 1 and T.sanitize({"k": "y" * 1201}, True)["k"]["redacted"]
    from assay.session import ship

    ship(spark)
    rows = spark.createDataFrame([('{"b": "/Users/q/z", "a": [1, null]}',), ("not json /Users/q",), ("null",), (None,)], "t string")
    out = [r[0] for r in rows.select(T.sanitize_json(F.col("t"))).collect()]
    assert out == ['{"a": [1, null], "b": "[redacted-local-path:z]"}', "not json [redacted-local-path:q]", "null", None]


def test_registered_redaction_reads_whole_texts(spark, tmp_path):
    from assay.queries import QUERIES

    far = "word " * 5000 + "/Users/eve/deep/secret.txt end"
    spark.createDataFrame([(1, far, "web"), (2, "short", "web")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.clean for r in QUERIES["redact_paths"](spark, str(tmp_path)).collect()}
    assert got[1].endswith(" " + "word " * 5000 + "[redacted-local-path:secret.txt] end") and got[2].endswith(" short")
    assert all("/Users/" not in x and x.startswith("see [redacted-local-path:notes_web.md], then ") for x in got.values())


def test_fingerprint(spark):
    rows = [(1, 2.0), (2, 3.0), (3, None)]
    of = lambda r: export.fingerprint(spark.createDataFrame(r, "a int, b double"), ["a", "b"]).first().fingerprint
    assert of(rows) == of(rows[::-1]) != of([(1, 2.5), *rows[1:]])


def test_sqlite_and_files(spark, tmp_path):
    from assay.session import ship

    ship(spark)
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x REAL)")
        db.execute("CREATE TABLE empty (id INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(1, 101)])
    df = sqlite.read_table(spark, path, "t")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double")] and df.agg(F.sum("id")).first()[0] == 5050
    assert sqlite.read_table(spark, path, "empty").count() == 0
    sqlite.write_tables({"t": df.limit(3)}, str(tmp_path / "y.db"))
    assert sqlite.read_table(spark, str(tmp_path / "y.db"), "t").count() == 3
    files.write_csv(tmp_path / "a.csv", [{"a": 1, "b": None}])
    files.write_csv(tmp_path / "e.csv", [])
    assert (tmp_path / "a.csv").read_text() == "a,b\n1,\n" and (tmp_path / "e.csv").read_text() == ""
    files.write_json(tmp_path / "a.json", files.rounded({"b": 2.675, "a": float("nan")}, 2))
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": None, "b": 2.67}
    packed, digest = files.gzip_file(tmp_path / "a.json")
    assert files.file_sha256(packed) == digest
    assert "| a |" in files.markdown_table([{"a": 1}]) and "<circle" in files.scatter_svg([("m", 1.0, 2.0)], (1.0, 1.0)) and "<rect" in files.bar_svg([("m", 1.0)])
    (tmp_path / "m.json").write_text('{"m1": {"v": 1}, "m2": {"v": null}}')
    assert {r.name: r.v for r in files.read_json_map(spark, str(tmp_path / "m.json"), "v: long").collect()} == {"m1": 1, "m2": None}
    assert files.read_key_values(spark.createDataFrame([("k", "v")], "key string, value string")) == {"k": "v"}


def test_release_export(spark, tmp_path):
    from assay.session import ship
    from assay.sources import release

    ship(spark)
    frame = lambda rows, form: spark.createDataFrame(rows, form)
    tables = {
        "benchmark_releases": frame([(1, "v1", "/Users/ann/m.json", None), (2, "v2", "x", "y")], "id long, release_label string, manifest_path string, notes string"),
        "release_questions": frame([(1, 1, 10), (2, 1, 11), (3, 2, 12)], "id long, release_id long, question_id long"),
        "questions": frame([(10, 5, None, '{"path": "/Users/q/a.pdf"}', None), (11, 5, 7, None, "see /Users/q/b.txt"), (12, 6, 8, None, None)], "id long, domain_id long, category_id long, source_refs string, ground_truth string"),
        "domains": frame([(5, "a"), (6, "b")], "id long, name string"),
        "question_categories": frame([(7, "k"), (8, "l")], "id long, name string"),
        "responses": frame([(100, 1, 50, '{"text_content": "long"}'), (101, 2, 51, None)], "id long, benchmark_release_id long, model_id long, raw_metadata string"),
        "models": frame([(50, "m"), (51, "n")], "id long, notes string"),
        "evaluations": frame([(200, 1, 100, 70, "not json /Users/z/q")], "id long, benchmark_release_id long, response_id long, rubric_id long, error_flags string"),
        "prompt_templates": frame([(1, "t"), (2, None)], "id long, template_text string"),
        "accounts": frame([(1,)], "id long"),
    }
    built = {k: [r.asDict() for r in v.collect()] for k, v in release.build(tables, 1).items()}
    ids = {k: sorted(r["id"] for r in v) for k, v in built.items()}
    assert ids == {"benchmark_releases": [1], "release_questions": [1, 2], "questions": [10, 11], "domains": [5], "question_categories": [7], "responses": [100], "models": [50], "evaluations": [200], "prompt_templates": [1, 2]}
    assert built["benchmark_releases"][0]["manifest_path_redacted"] == "[redacted-local-path:m.json]" and "manifest_path" not in built["benchmark_releases"][0]
    q = {r["id"]: r for r in built["questions"]}
    assert json.loads(q[10]["source_refs"])["path"]["basename"] == "a.pdf" and q[11]["ground_truth"] == "see [redacted-local-path:b.txt]" and q[11]["source_refs"] is None
    assert json.loads(built["responses"][0]["raw_metadata_redacted"])["text_content"]["char_count"] == 4 and built["evaluations"][0]["error_flags"] == "not json [redacted-local-path:q]"
    told = release.export(tables, "v1", tmp_path / "r.db")
    with sqlite3.connect(tmp_path / "r.db") as db:
        held = dict(db.execute("SELECT key, value FROM publication_export_metadata"))
        assert held["rows_responses"] == "1" and held["release_id"] == "1" and db.execute("SELECT evaluation_id FROM scored_responses").fetchall() == [(200,)]
        assert db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'accounts'").fetchone() == (0,)
    assert told["packed_sha256"] == files.file_sha256(told["packed"])
    with pytest.raises(ValueError, match="0 releases"):
        release.export(tables, "v9", tmp_path / "s.db")


def test_release_layout_has_all_tables():
    from assay.sources import release

    assert len(release.LAYOUT) == 18 and not release.LAYOUT["prompt_templates"].release and not release.LAYOUT["prompt_templates"].used
    assert all(t in release.LAYOUT for m in release.LAYOUT.values() for t, _ in m.used)


def test_transform_and_conform(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    got = export.transform(df, {"y": F.upper}, {"y": "z"})
    assert [tuple(r) for r in got.collect()] == [(1, "A"), (2, None)] and got.columns == ["x", "z"]
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("z", StringType()), StructField("x", LongType())])
    assert export.conform(got, schema).dtypes == [("z", "string"), ("x", "bigint")]
    with pytest.raises(ValueError, match="missing"):
        export.conform(df, schema)


def test_constants_that_binary_cannot_hold_have_no_correlation(spark):
    for value, n in ((0.3, 3), (0.1, 7), (0.1, 10), (1e6 + 0.1, 5)):
        df = spark.createDataFrame([(value, float(i)) for i in range(n)], "x double, y double").repartition(3)
        got = df.agg(G.pearson(F.col("x"), F.col("y")).alias("r"), R.slope(F.col("x"), F.col("y")).alias("s")).first()
        assert got.r is None and got.s is None


def test_moments_keep_their_digits_beside_large_means(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 300)
    y, z = 0.5 * x + rng.normal(0, 1, 300), 0.2 * x + rng.normal(0, 1, 300)
    large = 1e8
    df = spark.createDataFrame([(i % 40, float(a + large), float(b + large), float(c + large)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))], "question_id long, a double, b double, c double").repartition(4)
    fit = R.simple_fit(df, "a", "b").first()
    slope, cut = np.polyfit(x, y, 1)
    left = y - slope * x - cut
    se = math.sqrt((left @ left) / 298 / ((x - x.mean()) @ (x - x.mean())))
    assert math.isclose(fit.slope, slope, rel_tol=1e-5) and math.isclose(fit.r, np.corrcoef(x, y)[0, 1], rel_tol=1e-5) and math.isclose(fit.se, se, rel_tol=1e-4)
    parts = G.icc([F.col(c) for c in "abc"])
    got = df.agg(*G.columns(parts)).first()
    m = np.stack([x, y, z], axis=1)
    rows, cols, grand = m.mean(axis=1), m.mean(axis=0), m.mean()
    ms_r, ms_c = 3 * ((rows - grand) ** 2).sum() / 299, 300 * ((cols - grand) ** 2).sum() / 2
    ms_e = ((m - rows[:, None] - cols[None, :] + grand) ** 2).sum() / (299 * 2)
    assert math.isclose(got.icc_1, (ms_r - ms_e) / (ms_r + 2 * ms_e + 3 * (ms_c - ms_e) / 300), rel_tol=1e-4) and math.isclose(got.icc_k, (ms_r - ms_e) / (ms_r + (ms_c - ms_e) / 300), rel_tol=1e-4)
    plan = spark.createDataFrame([(0, i, 1) for i in range(40)], "rep int, question_id long, mult long")  # every question once
    rep = B.replicate_icc(plan, df, "a", "b").first()
    two = G.icc([F.col("a"), F.col("b")])
    want = df.agg(*G.columns(two), G.pearson(F.col("a"), F.col("b")).alias("pearson")).first()
    assert all(math.isclose(rep[k], want[k], rel_tol=1e-4) for k in ("icc_1", "icc_k", "pearson"))


def test_replicate_rates_against_drawn_rows(spark):
    rng = random.Random(2)
    rows = [(q, rng.choice([-1.5, -0.5, 0.0, 0.0, 0.25, 1.0])) for q in range(12) for _ in range(5)]
    plan = [(rep, q, n) for rep in range(4) for q, n in enumerate(np.bincount([rng.randrange(12) for _ in range(12)], minlength=12).tolist()) if n]
    df = spark.createDataFrame(rows, "question_id long, d double")
    got = {r.rep: r for r in B.replicate_rates(spark.createDataFrame(plan, "rep int, question_id long, mult long"), df, "d").collect()}
    for rep in range(4):
        d = np.array([x for _, q, n in (p for p in plan if p[0] == rep) for k, x in rows if k == q for _ in range(n)])
        want = {"mean_diff": d.mean(), "mean_abs_diff": abs(d).mean(), "sd_diff": d.std(ddof=1), "normal_low": d.mean() - 1.96 * d.std(ddof=1), "exact": (d == 0).mean(), "within_25": (abs(d) <= 0.25).mean(), "within_50": (abs(d) <= 0.5).mean(), "within_100": (abs(d) <= 1).mean()}
        assert all(math.isclose(got[rep][k], v, abs_tol=1e-9) for k, v in want.items())


@pytest.mark.parametrize("held", [50, 400_000])
def test_replicate_reliability_against_its_parts(spark, held, monkeypatch):
    from assay.session import ship

    ship(spark)
    monkeypatch.setattr(B, "replicate_cells", functools.partial(B.replicate_cells, held=held))
    rng = random.Random(2)
    rows = [(q, rng.randint(0, 8) / 4, 0.0) for q in range(30) for _ in range(6)]
    rows = [(q, a, min(2.0, max(0.0, a + rng.choice([-0.5, -0.25, 0, 0, 0, 0.25, 1.0])))) for q, a, _ in rows]
    df = spark.createDataFrame([(q, a, b, b - a) for q, a, b in rows], "question_id long, a double, b double, d double")
    plan = B.hash_plan(df.select("question_id", F.lit(1).alias("domain_id")).distinct(), 6, 3)
    got = {r.rep: r.asDict() for r in B.replicate_reliability(plan, df, "a", "b").collect()}
    parts = [B.replicate_icc(plan, df, "a", "b"), B.replicate_spearman(plan, df, "a", "b"), B.replicate_limits(plan, df, "d").withColumnsRenamed({"low": "empirical_low", "high": "empirical_high"}), B.replicate_rates(plan, df, "d")]
    assert len(got) == 6
    for part in parts:
        for r in part.collect():
            assert all(math.isclose(got[r.rep][k], v, abs_tol=1e-9) for k, v in r.asDict().items()), r


def test_null_values_have_no_midrank_and_null_p_no_rank(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None), ("a", 1.0), (None, 5.0), (None, 5.0)], "k string, x double")
    assert sorted(map(tuple, A.midranks(df, "x", by=["k"]).collect()), key=str) == sorted([("a", 2.0, 2.0), ("a", None, None), ("a", 1.0, 1.0), (None, 5.0, 1.5), (None, 5.0, 1.5)], key=str)
    p = [0.001, 0.04, 0.04, None, 1.0, 0.0, 0.5]
    adj = {r.k: r for r in H.bh_adjust(spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "k string, p double"), "p", "k").collect()}
    assert (adj["3"].bh_rank, adj["3"].adjusted) == (None, None) and [adj[k].bh_rank for k in "5012"] == [1, 2, 3, 4]
    order = sorted((x, i) for i, x in enumerate(p) if x is not None)
    for k, (_, i) in enumerate(order):
        assert math.isclose(adj[str(i)].adjusted, min([1.0, *(q * 6 / (j + 1) for j, (q, _) in enumerate(order) if j >= k)]))


def test_lanes_that_scored_twice_fail_the_query(spark):
    twice = evaluations(spark).unionAll(evaluations(spark))
    assert P.pair_lanes(evaluations(spark), ["response_id"], LANES).count() == P.pair_lanes(twice, ["response_id"], LANES, guard=False).count() > 0
    with pytest.raises(Exception, match="scored more than once"):
        P.pair_lanes(twice, ["response_id"], LANES).collect()


def test_rows_bootstrap_of_several_keys(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("m" + str(i % 2), i % 3, float(x)) for i, x in enumerate(rng.normal(3, 1, 90))] + [("few", 0, 1.0), ("few", 0, 2.0)], "model string, domain_id long, x double")
    ci = {(r.model, r.domain_id): r for r in B.interval(B.row_means(df, ["model", "domain_id"], "x", 1000, 3, least=3), ["model", "domain_id"], "mean").collect()}
    assert len(ci) == 6 and ("few", 0) not in ci
    for (m, d), r in ci.items():
        own = np.array([x.x for x in df.where((F.col("model") == m) & (F.col("domain_id") == d)).collect()])
        half = 1.96 * own.std() / math.sqrt(len(own))
        assert abs(r.ci_mid - own.mean()) < 0.2 * half and abs((r.ci_high - r.ci_low) / 2 - half) < 0.2 * half


def test_sentinel_and_utf8(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None), ("c", 2000.0), ("d", 5.0)], "n string, x double")
    assert [r.n for r in A.sentinel_rank(df, "x", "n", 999.0).orderBy("place").collect()] == ["a", "d", "b", "c"]
    raw = spark.createDataFrame([(bytearray(b"ok \xff\xc3\xa9"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(T.clean_utf8(F.col("b"))).collect()] == ["ok \ufffdé", None]


def test_regression_with_an_effect_that_has_nulls(spark):
    rows, names = R.design(spark.createDataFrame([(1.0, "a", 2.0), (2.0, "b", 3.0), (3.0, None, 9.0), (4.0, None, 10.0), (5.0, "a", 6.0)], "w double, e string, y double"), {"w": F.col("w")}, ["e"])
    assert names == ["intercept", "w", "e=b", "e=None"]
    fit = R.solve(R.gramian(rows, 4, "y"), names)
    assert np.allclose(fit.beta, [1, 1, 0, 5], atol=1e-6)


def test_redaction_by_rules():
    value = {"a": ["/Users/x/y.txt and more", {"Quote": ["q", {"path": "noslash"}], "n": 1}], "source_path": [["/a/b/"], 3], "long": "z" * 1201}
    loose, strict = T.sanitize(value, False), T.sanitize(value, True)
    assert loose["a"][0] == "[redacted-local-path:y.txt] and more" and loose["a"][1]["Quote"][0] == "q" and loose["long"] == "z" * 1201
    assert strict["a"][1]["Quote"][0]["char_count"] == 1 and strict["a"][1]["Quote"][1]["path"]["basename"] is None and strict["long"]["char_count"] == 1201
    assert loose["source_path"][0][0]["basename"] == "b" and loose["source_path"][1] == 3 and set(strict["long"]) == {"redacted", "reason", "char_count", "sha256"}
    assert T.sanitize("/Users/a/b", True) == "[redacted-local-path:b]" and T.sanitize(None, True) is None and T.sanitize([], True) == []


def test_queries_without_sql_against_plain_readings(spark):
    """On the smallest tables: p values from coefficients found by numpy, JSON read by the standard library, maps as dictionaries."""
    from assay.queries import QUERIES as Q

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    from assay.plans import star as S

    rows = [r.asDict() for r in S.paired(spark, data).collect()]
    by = {}
    for r in rows:
        by.setdefault(r["model"], []).append(r)
    for r in Q["verbosity_p"](spark, data).collect():
        own = by[r.model]
        rho = np.corrcoef([x["word_count"] for x in own], [x["pair_mean"] for x in own])[0, 1]
        assert math.isclose(r.r, rho, rel_tol=1e-9) and math.isclose(r.p_value, prob.pearson_p(rho, len(own)), rel_tol=1e-6)
    means = {}
    for r in rows:
        means.setdefault((r["model"], r["question_id"]), []).append(r["pair_mean"])
    means = {k: float(np.mean(v)) for k, v in means.items()}
    models, found = sorted(by), {(r.model_a, r.model_b): r for r in Q["wilcoxon_p"](spark, data).collect()}
    for a in models:
        for b in models:
            d = [means[(a, q)] - means[(b, q)] for m, q in means if m == a and (b, q) in means] if a < b else []
            d = [x for x in d if x]
            if not d:
                continue
            size = sorted(map(abs, d))
            rank = lambda x, size=size: sum(y < abs(x) for y in size) + (sum(y == abs(x) for y in size) + 1) / 2
            plus, minus = sum(rank(x) for x in d if x > 0), sum(rank(x) for x in d if x < 0)
            ties = sum(size.count(v) ** 3 - size.count(v) for v in set(size))
            r = found[(a, b)]
            assert math.isclose(r.w_plus, plus) and math.isclose(r.w_minus, minus) and math.isclose(r.p_value, prob.signed_rank_p(min(plus, minus), len(d), ties), rel_tol=1e-9)
    p = sorted((r.p_value, f"{r.model_a}|{r.model_b}") for r in found.values())
    adjusted = {k: min([1.0, *(q * len(p) / (j + 1) for j, (q, _) in enumerate(p) if j >= i)]) for i, (_, k) in enumerate(p)}
    assert all(math.isclose(r.adjusted, adjusted[f"{r.model_a}|{r.model_b}"]) for r in found.values())
    fit = Q["ols_p"](spark, data).collect()
    y = np.array([r["pair_mean"] for r in rows])
    columns = [np.ones(len(rows)), np.log1p([r["word_count"] for r in rows])]
    for e in ("domain_id", "level", "regime"):
        columns += [np.array([float(r[e] == v) for r in rows]) for v in sorted({r[e] for r in rows})[1:]]
    beta, _, rank, _ = np.linalg.lstsq(np.stack(columns, axis=1), y, rcond=None)
    assert math.isclose(fit[1].beta, beta[1], rel_tol=1e-6) and len(fit) == len(columns)
    left = y - np.stack(columns, axis=1) @ beta
    x = columns[1] - np.delete(np.stack(columns, axis=1), 1, axis=1) @ np.linalg.lstsq(np.delete(np.stack(columns, axis=1), 1, axis=1), columns[1], rcond=None)[0]
    se = math.sqrt((left @ left) / (len(y) - rank) / (x @ x))
    assert math.isclose(fit[1].se, se, rel_tol=1e-6) and math.isclose(fit[1].t, beta[1] / se, rel_tol=1e-6)
    one = Q["log_size_p"](spark, data).first()
    assert math.isclose(one.p_value, prob.pearson_p(one.r, one.n)) and math.isclose(one.slope / one.se, one.r * math.sqrt((one.n - 2) / (1 - one.r**2)), rel_tol=1e-9)
    for r in Q["scaling_p"](spark, data).collect():
        assert r.r is None or math.isclose(r.p_value, prob.pearson_p(r.r, r.n))
    region = {r.r_name: str(r.r_regionkey) for r in S.table(spark, data, "region").collect()}
    assert Q["kv_to_map"](spark, data).first().settings == region
    docs = {r.doc_id: r for r in S.table(spark, data, "documents").collect()}
    for r in Q["json_sanitized"](spark, data).collect():
        clean, d = json.loads(r.clean)["doc"], docs[r.doc_id]
        assert clean["local_path"]["basename"] == d.source and clean["n_chars"] == d.n_chars and clean["body"]["char_count"] == len(d.text)
    ci = Q["bootstrap_rows_ci"](spark, data).collect()
    for r in ci:
        own = np.array([x["pair_mean"] for x in rows if x["level"] == r.level])
        half = 1.96 * own.std() / math.sqrt(len(own))
        assert r.reps == 1000 and abs(r.ci_mid - own.mean()) < 0.2 * half and abs(r.ci_high - r.ci_low - 2 * half) < 0.25 * half


def test_command_line_report(spark, tmp_path, capsys):
    from assay import cli
    from assay import queries as Q

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    s = cli.settings(["report", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "r"), "--reps", "20", "--seed", "3", "--min-paired-rows", "100"])
    assert (s.reps, s.seed, s.min_paired_rows, s.scope) == (20, 3, 100, "two-lane")
    bundle = cli.report(spark, s)
    board = bundle["leaderboard"]
    assert board and list(board[0]) == Q.LEADERBOARD and len(Q.LEADERBOARD) == 20 and all(r["paired_rows"] >= 100 for r in board)
    assert bundle["coverage"]["is_partial_overlap"] and cli.summary(bundle)[0].startswith("warning") and len(cli.summary(bundle)) <= 11
    assert {r["measure"] for r in bundle["reliability_ci"]} == set(Q.RELIABILITY) and bundle["metadata"]["reps"] == 20
    head = (tmp_path / "r" / "leaderboard.csv").read_text().splitlines()[0]
    assert head == ",".join(Q.LEADERBOARD) and (tmp_path / "r" / "report.md").read_text().count("## ") >= 8 and list((tmp_path / "r" / "paired_rows").glob("*.csv"))


def test_plans_have_no_cross_product(spark):
    import os

    from assay.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    for name in ("bootstrap_model_ci", "wilcoxon_stat", "pair_lanes_3"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
