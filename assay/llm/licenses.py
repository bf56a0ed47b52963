"""License scans by diagonal voting. DataFrame operations only.

All rolling k-word grams of a text are joined by hash (and then by their words) to their positions in license templates. A
hit votes for the diagonal (position in the text - position in the template); each diagonal gathers its distinct template
positions. Diagonals at most ``max_shift`` apart are merged, which bridges inserted or missing words, and a merged group is
verified: its label holds if at least ``min_share`` of the template's grams were hit within it. The fixed phrases are
templates too: a phrase stands where all its grams vote for one diagonal.

The templates are a parameter; their grams are a few thousand at most, as ``MAX_GRAMS`` checks, and so may be broadcast.
Each text also sends one marker row through the join, which carries its number of words, so texts are read once.

Cases: null and empty texts have no words and no labels; texts shorter than a gram have no hits; null ids and repeated ids
are kept row for row, a row being known by its id and its text's hash; equal rows are counted, judged once and given back
that often; an empty table gives an empty table; extra columns are not read; texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import table

K = 3
MAX_GRAMS = 100_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels: every place counts.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Longer wordings; parts of them are enough.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: A gram that no text can hold: it marks a text's own row.
MARK = "\u0001"


def words(text: Column) -> Column:
    """The text's words in order; A-Z count as a-z. (The Kelvin sign is a letter of its own, though lower() makes it k.)"""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.filter(F.split(low, NO_WORD), lambda w: w != "")


def plain(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.lower()) if w]


def gram_table(spark, phrases, templates, k: int) -> DataFrame:
    """(gram, hash, template, label, base, at, n): a row for each gram of each template, at its position; n is the template's number of grams."""
    rows = []
    for t, (text, label, base) in enumerate([*((p, x, True) for p, x in phrases), *((p, x, False) for x, p in templates)]):
        w = plain(text)
        if len(w) < k:
            raise ValueError(f"template of fewer than {k} words: {text}")
        rows += [(" ".join(w[i : i + k]), t, label, base, i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError("too many templates to broadcast")
    rows.append((MARK, -1, "", False, 0, 1))
    return spark.createDataFrame(rows, "gram string, template int, label string, base boolean, at int, n int").withColumn("hash", F.xxhash64("gram"))


def grams(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, row, hash, gram, pos) of all grams, and a marker row whose pos is the number of words."""
    text = F.col(text_col).cast("string")
    split = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), words(text).alias("w"))
    rolling = "transform(slice(w, 1, greatest(size(w) - {k1}, 0)), (x, i) -> struct(concat_ws(' ', x, {rest}) as gram, cast(i as int) as pos))".format(k1=k - 1, rest=", ".join(f"w[i + {j}]" for j in range(1, k)))
    marked = F.concat(F.expr(rolling), F.array(F.struct(F.lit(MARK).alias("gram"), F.size("w").alias("pos"))))
    return split.select("id", "row", F.inline(marked)).withColumn("hash", F.xxhash64("gram"))


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, k: int = K, max_shift: int = 3, min_share: float = 0.5) -> DataFrame:
    """Rows (id, n_words, places array<struct<label, start>>, spans array<struct<label, start, end, share>>), starts and ends in words."""
    known = F.broadcast(gram_table(df.sparkSession, phrases, templates, k)).withColumnRenamed("gram", "told")
    hits = grams(df, id_col, text_col, k).join(known, "hash").where(F.col("gram") == F.col("told"))
    # A vote for each diagonal; a marker's "diagonal" is its number of words.
    shift = F.col("pos") - F.col("at")
    votes = hits.groupBy("id", "row", "template", "label", "base", "n", shift.alias("shift")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("votes"))
    of = Window.partitionBy("id", "row", "template").orderBy("shift")
    parted = votes.withColumn("new", (F.col("shift") - F.lag("shift").over(of) > F.when(F.col("base") | (F.col("template") < 0), 0).otherwise(max_shift)).cast("int"))
    parted = parted.withColumn("band", F.coalesce(F.sum("new").over(of), F.lit(0)))
    bands = parted.groupBy("id", "row", "template", "label", "base", "n", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hit"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("shift").alias("shift"), F.max("votes").alias("votes")
    )
    share = F.col("hit") / F.col("n")
    mark, place = F.col("template") < 0, F.col("base") & (F.col("hit") == F.col("n"))
    span = ~F.col("base") & (F.col("template") >= 0) & (share >= min_share)
    out = bands.groupBy("id", "row").agg(
        F.max(F.when(mark, F.col("shift"))).cast("long").alias("n_words"),
        F.max(F.when(mark, F.col("votes"))).alias("times"),
        F.sort_array(F.collect_list(F.when(place, F.struct(F.col("label"), F.col("shift").cast("long").alias("start"))))).alias("places"),
        F.sort_array(F.collect_list(F.when(span, F.struct(F.col("label"), F.col("low").cast("long").alias("start"), (F.col("high") + k).cast("long").alias("end"), share.alias("share"))))).alias("spans"),
    )
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("id", "n_words", "places", "spans")


def op6_license_scan(spark, sf_dir) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    starts, labels = F.transform("places", lambda p: p.start), F.transform("places", lambda p: p.label)
    said = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        said(labels).alias("base_labels"),
        said(F.concat(labels, F.transform("spans", lambda s: s.label))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """The same in DuckDB, which the driver runs beside it."""
    rows = []
    for t, (text, label, base) in enumerate([*((p, x, True) for p, x in PHRASES), *((p, x, False) for x, p in TEMPLATES)]):
        w = plain(text)
        rows += [f"('{' '.join(w[i : i + K])}', {t}, '{label}', {base}, {i}, {len(w) - K + 1})" for i in range(len(w) - K + 1)]
    return (
        r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM documents),
t(gram, template, label, base, tpos, n) AS (VALUES """
        + ", ".join(rows)
        + """),
g AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
v AS (SELECT doc_id, template, label, base, n, pos - tpos AS shift, list(DISTINCT tpos) AS ats FROM g JOIN t USING (gram) GROUP BY ALL),
c AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY shift) AS band
  FROM (SELECT *, coalesce((shift - lag(shift) OVER (PARTITION BY doc_id, template ORDER BY shift) > CASE WHEN base THEN 0 ELSE 3 END)::INT, 0) AS fresh FROM v)),
b AS (
  SELECT doc_id, template, label, base, n, band, len(list_distinct(flatten(list(ats)))) AS hit, min(shift) AS start FROM c GROUP BY ALL),
r AS (
  SELECT doc_id, count(*) FILTER (base AND hit = n) AS n_base, min(start) FILTER (base AND hit = n) AS first_word, max(start) FILTER (base AND hit = n) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND hit = n) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((base AND hit = n) OR (NOT base AND hit / n >= 0.5)) AS labels,
    max(hit / n) FILTER (NOT base AND hit / n >= 0.5) AS best
  FROM b GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN r USING (doc_id)"""
    )


ORACLE = _oracle()
