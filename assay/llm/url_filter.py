"""URL filters: host rules first, then a weighted vocabulary.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's; the longest fitting
rule decides. For the rest an Aho-Corasick automaton finds strict and soft terms in the lower-cased URL; a hit counts only
if no ASCII letter or digit touches it on either side. One strict hit, or ``soft_needed`` distinct soft ones, blocks.

Cases: a null URL, or one without ``://``, has empty host and path and fits no rule; a null URL is allowed; ids may be null
or repeat, rows are judged one by one; long URLs are read whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import ship, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
STRICT = ("casino", "gambling", "malware", "phishing", "pills", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "adult", "bets", "bonus", "cheap", "click", "deal", "farm", "free", "jackpot", "loan", "lottery", "poker", "prize", "track", "win")


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def matcher(strict: tuple[str, ...], soft: tuple[str, ...], soft_needed: int):
    """url -> (distinct strict terms, distinct soft terms, blocked)."""
    import ahocorasick

    find = ahocorasick.Automaton()
    for kind, terms in ((0, soft), (1, strict)):
        for t in terms:
            find.add_word(t.lower(), (kind, t.lower()))
    if len(find):
        find.make_automaton()

    def judge(url: str | None) -> tuple[int, int, bool]:
        text = (url or "").translate(_FOLD)
        seen: tuple[set[str], set[str]] = (set(), set())
        for end, (kind, term) in find.iter(text) if len(find) else ():
            start = end - len(term)
            if not (start >= 0 and _alnum(text[start])) and not (end + 1 < len(text) and _alnum(text[end + 1])):
                seen[kind].add(term)
        return len(seen[1]), len(seen[0]), bool(seen[1]) or len(seen[0]) >= soft_needed

    return judge


_FOLD = str.maketrans(UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = 2) -> DataFrame:
    """Rows (id, url, host, path, rule, verdict, n_strict, n_soft)."""
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = matcher(tuple(strict), tuple(soft), soft_needed)
        for batch in batches:
            a, b, c = [], [], []
            for x, y, z in map(judge, batch.column(1).to_pylist()):
                a.append(x), b.append(y), c.append(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.bool_())], ["id", "url", "n_strict", "n_soft", "blocked"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.mapInArrow(count, "id long, url string, n_strict long, n_soft long, blocked boolean")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return rows.select("id", "url", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")


def op9_url_filter(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _oracle() -> str:
    hits = lambda terms: " + ".join(f"(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])'))::BIGINT" for t in terms)
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda of: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{of(h, p, v)}'" for h, p, v in by_length) + " END"
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (
  SELECT *, {hits(STRICT)} AS n_strict, {hits(SOFT)} AS n_soft,
    {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS told
  FROM u)
SELECT page_id, host, path, rule,
  coalesce(told, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM c"""


ORACLE = _oracle()
