"""Connected components of a table of links, by minimum labels with shortcuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import discard, materialize, ship


def _forest(batches: Iterator[pa.RecordBatch], most: int | None = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Replace a partition's links by (node, smallest node it reaches within them), up to ``most`` nodes at a time."""

    def flush(up: dict[int, int]) -> pa.RecordBatch:
        pairs = [(x, root(up, x)) for x in up]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    def root(up: dict[int, int], x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    up: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = root(up, a), root(up, b)
            if p != q:
                up[max(p, q)] = min(p, q)
        if most and len(up) > most:
            yield flush(up)
            up = {}
    if up:
        yield flush(up)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of all links of a bounded table in one partition."""
    names: dict[int, int] = {}
    parts = list(_forest(batches, most=None))
    for batch in parts:
        for x, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            names[x] = names[r] = r
    yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.int64()), pa.array(list(names.values()), pa.int64())], ["node", "comp"])


def components(links: DataFrame, at_once: int = 1_000_000) -> DataFrame:
    """Rows (node, comp) for all nodes of the links (a, b), a != b; comp is the smallest node of its component.

    No links give no rows. Up to ``at_once`` links are joined in one task, which needs some 100 MB. More of them are
    contracted partition by partition first; then labels spread over what is left until none changes, each pass also
    following labels of labels, so that long chains take a logarithmic number of passes."""
    ship(links.sparkSession)
    pairs = links.select("a", "b")
    if pairs.limit(at_once + 1).count() <= at_once:
        return materialize(pairs.coalesce(1).mapInArrow(_whole, "node long, comp long"), "components")
    kept = materialize(pairs.mapInArrow(_forest, "a long, b long"), "forest")
    both = materialize(kept.union(kept.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = materialize(step.join(jump, "next").select("node", "old", F.least("next", "far").alias("comp")), "labels")
        changed = moved.where("old != comp").limit(1).count()
        discard(labels)
        labels = moved
        if not changed:
            discard(kept), discard(both)
            out = materialize(labels.select("node", "comp"), "components")
            discard(labels)
            return out
