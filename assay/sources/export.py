"""Release-scoped extraction by id closure, order-free fingerprints, and per-column transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closure(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Keep the rows whose parents are kept. Links are (child, child's column, parent, parent's column), parents before children."""
    out = dict(tables)
    for child, column, parent, key in links:
        ids = out[parent].select(F.col(key).alias("_id"))
        out[child] = out[child].join(ids, F.col(column) == F.col("_id"), "left_semi")
    return out


def fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, fingerprint, n): row order does not matter and every value does.

    Rows' SHA-256s and how often each occurs are sorted in 4096 ranges of their first three digits, and hashed range by range;
    the fingerprint is the SHA-256 of these hashes in order. So no task holds all rows, and repeated rows are one."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    keys = by or []
    counted = df.select(*keys, row.alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("n"))
    ranges = counted.groupBy(*keys, F.substring("h", 1, 3).alias("r")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "h", "n"))), ""), 256).alias("d"), F.sum("n").alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), "")
    return ranges.groupBy(*keys).agg(F.sha2(whole, 256).alias("fingerprint"), F.sum("n").alias("n"))


def transform(df: DataFrame, changes: dict[str, Callable[[Column], Column]], renamed: dict[str, str] | None = None) -> DataFrame:
    """Apply a function to each named column, then rename."""
    return df.withColumns({c: f(F.col(c)) for c, f in changes.items()}).withColumnsRenamed(renamed or {})


def conform(df: DataFrame, schema) -> DataFrame:
    """The schema's columns in its order and types; ValueError names those that are missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
