"""The pipeline's stages on the smallest tables, each against its plain reading; and the registry."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages(spark):
    import corpus_pipeline as C
    from assay.llm.common import materialize

    from tests.llm.test_operators import brute_groups

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = docs.collect()
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == list(C.COLUMNS)
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not any(c.isalpha() for c in r.text)}
        if name == "near_duplicates":
            want = {i for i, n, c in brute_groups([(r.doc_id, r.text) for r in before], 5) if i == c}
            assert {r.doc_id for r in after} == want
        if name == "decontaminate":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if any(x in r.text for x in items)}
        if name == "mix":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(sum(r.doc_id == x.doc_id for r in after) for x in after) <= 3
        if name == "tokens":
            assert len(after) == len(before) and sum(r.n_tokens for r in after) == max(r.start + r.n_tokens for r in after)
        before = after


def test_near_duplicates_are_dropped_by_row(spark):
    import corpus_pipeline as C

    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcde")
    near = a.replace("a39", "other")
    rows = [(1, a), (None, near), (None, b), (5, a), (5, c), (6, c), (None, d), (None, d), (7, e), (7, e), (8, None), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    left = C.drop_near_duplicates(spark, docs.repartition(3), DATA)
    want = [(1, a), (None, b), (5, c), (None, d), (7, e), (8, None), (9, ""), (9, ""), (None, None)]
    assert left.columns == list(C.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    assert C.drop_near_duplicates(spark, docs.limit(0), DATA).count() == 0


FORM = "doc_id long, text string, lang string, source string, n_chars int"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "two words"), (5, "Été à l'œuvre, ok"), (5, "Été à l'œuvre, ok"), (None, None), (6, "long words here " * 9000), (7, "1 2 3"), (6, "six again, another text")]


def odd_documents(spark):
    rows = [(i, t, ("en", None)[k % 2], ("web", None, "code")[k % 3], len(t or "")) for k, (i, t) in enumerate(ODD)]
    rows += [(100 + i, f"the quick brown fox {i} jumps over the lazy dog number {i * 7}", "en", "web", 50) for i in range(20)]
    return spark.createDataFrame(rows, FORM).repartition(3)


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontaminate", "mix", "tokens"])
def test_stages_on_odd_rows_and_on_nothing(spark, name):
    import corpus_pipeline as C

    from tests.llm.test_operators import brute_groups

    stage, docs = dict(C.STAGES)[name], odd_documents(spark)
    rows = sorted(map(tuple, docs.collect()), key=str)
    left = sorted(map(tuple, stage(spark, docs, DATA).collect()), key=str)
    none = stage(spark, docs.limit(0), DATA)
    assert none.count() == 0
    if name == "tokens":
        assert none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted((r[0] for r in left), key=str) == sorted((r[0] for r in rows), key=str)
        return
    assert tuple(none.columns) == C.COLUMNS
    if name == "language":  # what has no letter goes, repeated rows and null ids stay
        assert left == [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    if name == "decontaminate":
        assert left == rows
    if name == "near_duplicates":
        group = brute_groups([(k, r[1]) for k, r in enumerate(rows)], 5)
        first = {}
        for k, n, c in sorted(group, key=lambda g: (rows[g[0]][0] is None, rows[g[0]][0] or 0)):
            first.setdefault(c if n else ("empty", k), k)
        assert [(r[0], r[1]) for r in left] == sorted(((rows[k][0], rows[k][1]) for k in first.values()), key=str) or sorted((r[:2] for r in left), key=str) == sorted((rows[k][:2] for k in first.values()), key=str)
    if name == "mix":
        assert set(left) <= set(rows) and all(left.count(r) <= 3 * rows.count(r) for r in set(left)) and not any(r[1] is None or not r[1].split() for r in left)


def test_run_on_nothing(spark, tmp_path):
    import corpus_pipeline as C

    odd_documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__ as e

    names = [k for k in e.queries() if k.startswith("op") or k == "pipeline"]
    assert sorted(int(k[2:].split("_")[0]) for k in names if k != "pipeline") == list(range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(e.queries())
