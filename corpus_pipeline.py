"""A training-corpus pipeline over ``documents``: five stages, each a table of documents but the last, which is token files' contents.

1. language: texts that fit no learned language go. 2. near_duplicates: of each group one row stays, that with the
smallest id (five-word shingles, similarity 0.8). 3. decontaminate: documents with a benchmark item's passage go. 4. mix: each
document stands as often as the mix of sources reads its first word. 5. tokens: ids are written to files in order of
doc_id and read back.

Cases: each stage keeps null ids, repeated rows and the columns of documents as its operator defines, but near_duplicates keeps
one of repeated rows, and decides by row, not by id; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import decontaminate, language, mixing, neardup, token_files
from assay.llm.common import discard, materialize, scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(df: DataFrame, names) -> DataFrame:
    return df.select(*(F.col(f"kept_{c}").alias(c) for c in names))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    found = language.identify(docs, model, keep=tuple(docs.columns))
    return _kept(found.where("NOT rejected"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id, a null id last; of equal ids the first row.

    Ids may be null or repeated, so rows are told apart by a number, which being written fixes. A group's first row is an aggregate's minimum, so no
    task holds a group."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = neardup.near_duplicates(rows, id_col="_row")
    groups = found.select(F.col("id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_row").alias("at"))
    first = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("group").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.at").alias("_row")), "_row", "left_semi").select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return _kept(found.where(F.size("leaks") == 0), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixing.replicate(docs, mixed)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_tokens(docs, folder)
    return token_files.summary(spark, folder)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_documents),
    ("mix", mix_sources),
    ("tokens", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)  # what an earlier stage wrote
        docs = kept
    last = materialize(STAGES[-1][1](spark, docs, sf_dir), "last")
    discard(docs)
    return last


#: Character models, sketches and token files are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
