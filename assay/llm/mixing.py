"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame operations only.

1. Each source's target: the sources share the total by weight; a target stops at ``max_epochs`` times its source's size and
   the excess is reshared by weight until none is above.
2. Each source's documents, shuffled by a hash, stand one after another as a tape of tokens that is cut into blocks of
   ``block_tokens`` (the last may be shorter). The tape is read from its start as often as the target asks.
3. The schedule: slot i of the mix takes the i-th van der Corput point (i's bits reversed) through the cumulative targets,
   counted in whole slots, and so falls to one source; the slot's rank among its source's slots says which block, in
   which epoch, it reads. So every stretch of the mix holds the sources nearly in their shares.
   A source's last slot is cut short where its target ends, so that the taken tokens are the rounded target.
4. Slots and document pieces are joined by (source, block): what a document gives, how often, and in which slot first.

A source may hold any share of the rows: running sums go over hash ranges of a source first and then inside each, ranks
over ranges of slots, so that no task sorts a whole source.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source, ordered last; null or repeated ids
and repeated rows are separate documents with their own places on the tape, told apart by (id, source, size, text hash) and,
where all are equal, by a running number; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_of(id_: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, place): place is the shuffle's sort key, equal only for equal rows."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), place_of(F.col(id_col), text, seed).alias("place"))


def targets(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """One row a source: (source, order, source_size, target). The frame has as many rows as there are sources."""
    every = Window.orderBy(F.lit(1))
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    one = one.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("ord") % len(weights) + 1).cast("int")))
    one = one.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    # Sources are capped in order of cap / weight. With the first k capped, the rest share at a level; the fewest k that fit decide,
    # and give the highest level of all that fit.
    before = Window.orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, -1)
    full = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumns({"total": F.sum("source_size").over(full), "w_all": F.sum("w").over(full), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    one = one.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    one = one.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(full))
    return one.select("source", "ord", "source_size", F.when(F.col("ratio") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def reverse_bits(i: Column, bits: int) -> Column:
    """i's lowest ``bits`` bits in reverse order: the van der Corput point times 2 ** bits."""
    x = i
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")


def schedule(spark, plan: list[tuple[int, int]], slots_a_range: int = 1 << 14) -> DataFrame:
    """(slot, ord, rank): plan gives each source's (ord, number of slots). 2 ** bits points cover all slots; a point past the last share is no slot."""
    total = sum(n for _, n in plan)
    bits = max(0, (total - 1).bit_length())
    at = reverse_bits(F.col("slot"), bits)
    shares, below = [], 0
    for o, n in plan:
        shares.append((o, below))
        below += n
    points = spark.range(1 << bits).select(F.col("id").alias("slot")).withColumn("at", at).where(F.col("at") < total)
    # Each source's share starts at ``low``: the widest start at or under the point, by a search in the sorted starts.
    lows = F.array(*(F.lit(x[1]) for x in shares))
    points = points.withColumn("k", F.expr(f"cast({_bisect([x[1] for x in shares])} as int)") if len(shares) <= 64 else F.size(F.filter(lows, lambda x: x <= F.col("at"))) - 1)
    points = points.withColumn("ord", F.element_at(F.array(*(F.lit(x[0]).cast("long") for x in shares)), F.col("k") + 1)).withColumn("part", F.shiftright("slot", slots_a_range.bit_length() - 1))
    held = points.groupBy("ord", "part").agg(F.count("*").alias("n"))
    held = held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = points.withColumn("nth", F.row_number().over(Window.partitionBy("ord", "part").orderBy("slot")) - 1)
    return inside.join(held, ["ord", "part"]).select("slot", "ord", (F.col("before") + F.col("nth")).alias("rank"))


def _bisect(starts: list[int], low: int = 0, high: int | None = None) -> str:
    """SQL for the index of the last start at or under ``at``, as nested comparisons."""
    high = len(starts) if high is None else high
    if high - low <= 1:
        return str(low)
    mid = (low + high) // 2
    return f"CASE WHEN at < {starts[mid]} THEN {_bisect(starts, low, mid)} ELSE {_bisect(starts, mid, high)} END"


def tape(sized: DataFrame, one: DataFrame, rows_a_range: int = 20_000) -> DataFrame:
    """(source's ord, id, place, source, size, copies, first): where on its source's tape the first of each document's equal copies starts."""
    rows = sized.count()
    ranges = 1 << max(0, min(16, (rows // rows_a_range).bit_length()))
    # Ids, texts and sources that are all equal are one document many times over: they share a place and are numbered there.
    same = sized.groupBy("id", "source", "size", "place").agg(F.count("*").alias("copies"))
    part = F.shiftright(F.conv(F.substring("place", 1, 4), 16, 10).cast("int"), 16 - (ranges - 1).bit_length())  # ranges of places, in order
    same = same.join(one.select(F.col("source").alias("s"), "ord"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", part)
    held = same.groupBy("ord", "part").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    held = held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("ord", "part").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = same.withColumn("inside", inside).join(held, ["ord", "part"])
    return placed.select("ord", "id", "place", "source", "size", "copies", (F.col("before") + F.col("inside")).alias("first"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, block_tokens: int = 4096, seed: int = 7) -> DataFrame:
    """Rows (id, source, place, size, source_size, target, taken, uses, first_slot): one for each document.

    taken counts the document's words that the mix reads, repeats included; uses counts the slots that read its first word,
    which is how often a mix of whole documents takes it; first_slot is the first of these slots, the document's place in the mix."""
    spark = df.sparkSession
    sized = materialize(sizes(df, id_col, text_col, source_col, seed), "sizes")
    one = materialize(targets(sized, weights, max_epochs), "targets")
    plan, spare = [], []
    for r in one.orderBy("ord").collect():  # a row a source
        goal = min(round(r.target), max_epochs * r.source_size)
        blocks = -(-r.source_size // block_tokens)
        epochs, rest = divmod(goal, r.source_size) if r.source_size else (0, 0)
        n = epochs * blocks + -(-rest // block_tokens)
        plan.append((r.ord, n))
        spare.append((r.ord, max(1, blocks), n - 1, rest % block_tokens if rest % block_tokens else block_tokens))
    plan = [x for x in plan if x[1]]
    about = spark.createDataFrame(spare or [(0, 1, 0, 0)], "ord long, blocks long, last long, cut long")
    slots = schedule(spark, plan) if plan else spark.createDataFrame([], "slot long, ord long, rank long")
    slots = slots.join(about, "ord")
    # How often each block is read whole, and the tokens of its one reading that is cut short, if any.
    short = (F.col("rank") == F.col("last")) & (F.col("cut") < block_tokens)
    reads = slots.groupBy("ord", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.sum(F.when(short, 0).otherwise(1)).alias("whole"), F.max(F.when(short, F.col("cut")).otherwise(0)).alias("cut"), F.min("slot").alias("slot"))
    docs = tape(sized, one)
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    first, last = F.expr(f"start div {block_tokens}"), F.expr(f"(start + greatest(size, 1) - 1) div {block_tokens}")
    pieces = docs.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start") - F.col("block") * block_tokens, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block_tokens, F.lit(block_tokens))
    pieces = pieces.withColumns({"low": low, "high": high, "opens": F.expr(f"start div {block_tokens}") == F.col("block")})
    read = pieces.join(reads, ["ord", "block"], "left")
    got = F.coalesce(F.col("whole"), F.lit(0)) * (F.col("high") - F.col("low")) + F.greatest(F.least(F.col("high"), F.coalesce(F.col("cut"), F.lit(0))) - F.col("low"), F.lit(0))
    use = F.when(F.col("opens") & (F.col("size") > 0), F.coalesce(F.col("whole"), F.lit(0)) + (F.coalesce(F.col("cut"), F.lit(0)) > F.col("low")).cast("long")).otherwise(0)
    taken = read.groupBy("id", "source", "place", "copy", "size").agg(F.sum(got).cast("long").alias("taken"), F.sum(use).cast("long").alias("uses"), F.min(F.when(use > 0, F.col("slot"))).alias("first_slot"))
    return taken.join(one.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def replicate(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """df's rows, each as often as the mix uses it; of rows that are equal to the mix, the first in order of their other columns take what cannot be shared out evenly.

    Rows that are equal in all columns are counted before they are repeated, CHUNK repeats at a time, so that no task holds or makes a large
    group of them. Columns must be of types that can be grouped (no maps)."""
    names, text = df.columns, F.col(text_col).cast("string")
    whole = mixed.groupBy("place", "source").agg(F.sum("uses").alias("total"), F.count("*").alias("rows")).where("total > 0")
    whole = whole.select(F.col("place").alias("_place"), F.col("source").alias("_src"), "total", "rows")
    marked = df.select(F.struct(*names).alias("row"), place_of(F.col(id_col), text, seed).alias("place"), F.col(source_col).cast("string").alias("src"))
    found = marked.join(whole, (F.col("place") == F.col("_place")) & F.col("src").eqNullSafe(F.col("_src"))).select("row", "place", "src", "total", "rows")
    one = found.where("rows = 1").select("row", F.col("total").alias("times"))
    same = found.where("rows > 1").groupBy("place", "src", "row", "total", "rows").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("place", "src").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("held"), F.col("total") % F.col("rows") - F.col("before")))
    same = same.withColumn("before", before).select("row", (F.col("held") * F.expr("total div rows") + extra).alias("times")).where("times > 0")
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {CHUNK}"))))
    parts = parts.select("row", F.least(F.lit(CHUNK), F.col("times") - F.col("part") * CHUNK).alias("times"), "part").repartition(F.xxhash64("row"), "part")
    return one.unionAll(parts.select("row", "times")).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_nth")).select("row.*")


def op10_source_mixing(spark, sf_dir) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


#: What is taken follows from a tape's length and target alone; the first slot from the schedule, point by point.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 3 AS cap, (source_size * 3) / w AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN ratio < lv THEN cap::DOUBLE ELSE w * lv END AS target
  FROM (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS lv FROM l)),
p AS (
  SELECT d.*, t.source_size, t.target, least(round_even(target, 0)::BIGINT, 3 * t.source_size) AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST) - slots AS low, sum(slots) OVER () AS every
  FROM (SELECT source, goal, source_size, CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * ((source_size + 4095) // 4096) + (goal % source_size + 4095) // 4096 END AS slots
        FROM (SELECT source, target, source_size, least(round_even(target, 0)::BIGINT, 3 * source_size) AS goal FROM t))),
b AS (SELECT any_value(every)::BIGINT AS every, (SELECT min(k) FROM range(0, 62) x(k) WHERE (1::BIGINT << k) >= any_value(n.every)) AS bits FROM n),
v AS (
  SELECT i, (SELECT coalesce(sum(((i >> k) & 1) << (bits - 1 - k)), 0) FROM range(0, 62) x(k) WHERE k < bits) AS point, every
  FROM b, range(0, (SELECT CASE WHEN every > 0 THEN 1::BIGINT << bits ELSE 0 END FROM b)) y(i)),
s2 AS (SELECT n.source, v.i AS slot, row_number() OVER (PARTITION BY n.source ORDER BY v.i) - 1 AS rank FROM v JOIN n ON point >= low AND point < low + slots WHERE point < v.every)
SELECT doc_id, size, p.source_size, target,
  CASE WHEN p.source_size = 0 THEN 0 ELSE (p.goal // p.source_size) * size + greatest(least(start + size, p.goal % p.source_size) - start, 0) END::BIGINT AS taken,
  CASE WHEN size > 0 AND NOT (p.goal // p.source_size = 0 AND start >= p.goal % p.source_size) THEN slot END AS first_slot
FROM p JOIN n ON p.source IS NOT DISTINCT FROM n.source LEFT JOIN s2 ON s2.source IS NOT DISTINCT FROM p.source AND s2.rank = start // 4096"""
