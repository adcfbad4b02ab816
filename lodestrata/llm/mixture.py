"""Mixing sources to target weights by a time-varying curriculum. DataFrame operations only.

Each source has a weight schedule over the training time t in [0, 1]. Its
integral is the source's cumulative demand of words; a document that begins
after c of its source's taken words is placed where that demand reaches c. Range-sorting
by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frozen, table
from .prefix import buckets, running

#: Weights by rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and a document, is taken so many times at most.
MAX_EPOCHS = 3
#: Slope of the linear schedule 1 + slope * (2t - 1) by rank, repeating: heavy sources fade, light ones rise.
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    # white space runs to one blank each, ends trimmed: one more word than blanks
    plain = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    n = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    return F.coalesce(F.when(plain == "", F.lit(0)).otherwise(n), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = MAX_EPOCHS, total: Column | None = None) -> DataFrame:
    """(source, source_size, rank, weight, target) from a table (source, source_size) of one row for each source.

    Sources rank by code point, null last; weights repeat by rank. Each source
    gets its weight's part of the total, but stops at ``cap`` times its size, the excess
    being shared again by weight until none is above: sources
    stop in the order of cap * size / weight, so running sums along that order tell which do.
    The table has a row for each source and no text, so windows over all of it are cheap.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.lit(float(weights[-1]))
    for i in range(len(weights) - 2, -1, -1):
        w = F.when(F.col("rank") % len(weights) == i, F.lit(float(weights[i]))).otherwise(w)
    every = Window.partitionBy()
    rows = ranked.withColumn("weight", w).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    rows = rows.withColumn("total", (total if total is not None else F.sum("source_size").over(every)).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    along = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("limit").over(along), F.lit(0.0))
    share = F.col("all_weight") - F.coalesce(F.sum("weight").over(along), F.lit(0.0))
    # the level per weight if all before this source stopped; the first source below its limit sets it for the rest
    rows = rows.withColumn("level", left / share)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("k"), "rank", "level"))).over(every)
    rows = rows.withColumn("_free", free)
    target = F.coalesce(F.least(F.col("limit"), F.col("_free.level") * F.col("weight")), F.col("limit"))
    return rows.select("source", "source_size", "rank", "weight", target.alias("target"))


def position(c: Column, total: Column, slope: Column) -> Column:
    """Where the integral of 1 + slope * (2t - 1) reaches the part c / total: slope * t^2 + (1 - slope) * t = c / total, solved for t in [0, 1]."""
    x = F.when(total > 0, F.least(c / total, F.lit(1.0))).otherwise(F.lit(0.0))
    b = 1 - slope
    # written so that it holds for slope 0 as well
    return 2 * x / (b + F.sqrt(b * b + 4 * slope * x))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, h, size, source_size, rank, target, epochs, taken, start) for each row of docs (doc_id, source, text).

    Texts are reduced to their word counts and hashes ``h`` before anything is
    shuffled. A source's rows stand in the order of md5(doc_id), so reruns agree;
    rows that repeat doc_id and text stand as one. Each is taken floor(target / source_size)
    times, and once more as long as the running sum of sizes, rounded to the
    nearer end of the row that crosses it, stays within the rest. Then the one row
    of each source whose change brings the sum nearest to the target is changed.
    ``start`` is the source's words before the row, in its first round. A null
    source is a source of its own, null texts have size 0, null doc_ids count as the
    empty text; an empty table gives none.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("h"),
    )
    own = frozen(own)
    sized = own.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long")
    goal = targets(sized, weights, cap).withColumn("whole", F.least(whole, F.lit(cap))).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = frozen(goal.withColumnRenamed("source", "_s"))
    same = F.col("source").eqNullSafe(F.col("_s"))
    keys = own.groupBy("source", "doc_id", "h").agg(F.sum("size").alias("w")).withColumn("k", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # the first 32 bits of the order, cut evenly into as many buckets as the rows ask for
    cut = F.shiftright(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * buckets(own.count()), 32)
    placed = running(keys, ["source"], cut, [F.col("k"), F.col("doc_id"), F.col("h")], F.col("w"), "start")
    # goals have a row for each source: Spark broadcasts them while they are few
    placed = placed.join(goal, same).withColumn("once", (F.col("start") + F.col("w") / 2 <= F.col("rest")) & (F.col("whole") < cap) & (F.col("rest") > 0))
    placed = frozen(placed)
    off = placed.groupBy("_s").agg((F.max("rest") - F.sum(F.when(F.col("once"), F.col("w")).otherwise(F.lit(0)))).alias("off"))
    off = off.select(F.col("_s").alias("_o"), "off")
    gap = F.abs(F.col("w") - F.abs(F.col("off")))
    choice = placed.join(off, F.col("_s").eqNullSafe(F.col("_o"))).filter((F.col("once") == (F.col("off") < 0)) & (F.col("w") > 0) & (F.col("whole") < cap) & (gap < F.abs(F.col("off"))))
    choice = choice.groupBy("_o").agg(F.min(F.struct(gap.alias("gap"), "k", "doc_id", "h")).alias("f"))
    choice = choice.select(F.col("_o").alias("_c"), F.col("f.doc_id").alias("_fd"), F.col("f.h").alias("_fh"), F.lit(True).alias("_flip"))
    hit = F.col("_s").eqNullSafe(F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("h") == F.col("_fh"))
    decided = placed.join(choice, hit, "left").withColumn("epochs", F.col("whole") + (F.col("once") != F.coalesce("_flip", F.lit(False))).cast("long"))
    decided = decided.select(F.col("_s"), F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "source_size", "rank", "target", "epochs", "start")
    match = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    return own.join(decided, match).withColumn("taken", F.col("epochs") * F.col("size")).drop("_s", "_d", "_h")


def round_position(epoch: Column, slopes: tuple = SLOPES) -> Column:
    """The position of a row of the plan when it is taken in that round, counted from 0."""
    by_rank = F.lit(float(slopes[-1]))
    for i in range(len(slopes) - 2, -1, -1):
        by_rank = F.when(F.col("rank") % len(slopes) == i, F.lit(float(slopes[i]))).otherwise(by_rank)
    return position((epoch * F.col("source_size") + F.col("start")).cast("double"), F.col("target"), by_rank)


def training_order(docs: DataFrame, slopes: tuple = SLOPES, **options) -> DataFrame:
    """The plan's rows with ``positions``, one in [0, 1] for each round that takes the row, range-sorted by the first of them.

    Rows that no round takes have an empty list and stand at the end, by doc_id.
    """
    rounds = F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)
    at = F.when(F.col("epochs") > 0, F.transform(rounds, lambda e: round_position(e, slopes))).otherwise(F.array().cast("array<double>"))
    rows = plan(docs, **options).withColumn("positions", at).withColumn("_at", F.get("positions", F.lit(0)))
    keys = (F.col("_at").asc_nulls_last(), F.col("doc_id").asc())
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")


def curriculum(docs: DataFrame, slopes: tuple = SLOPES, out: str = "position", **options) -> DataFrame:
    """The training order: docs with a row for each time that a document is taken and its position ``out`` in [0, 1], range-sorted by that.

    The texts are shuffled twice: to the plan, and to their positions. A column of docs that is called like ``out`` is replaced.
    """
    decided = plan(docs, **options).filter("epochs > 0").groupBy("source", "doc_id", "h").agg(*[F.first(c).alias(c) for c in ("source_size", "rank", "target", "epochs", "start")])
    every = decided.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)))
    at = round_position(F.col("epoch"), slopes)
    every = every.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("h").alias("_h"), at.alias("_at"))
    rows = docs.drop(out).withColumn("_own", F.xxhash64(F.col("text").cast("string")))
    match = F.col("source").cast("string").eqNullSafe(F.col("_s")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_own") == F.col("_h"))
    placed = rows.join(every, match).drop("_s", "_d", "_h", "_own")
    return placed.repartitionByRange("_at", "doc_id").sortWithinPartitions("_at", "doc_id").withColumnRenamed("_at", out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what the curriculum takes of every document, in training order: ``taken`` is its size in each round that has a position for it.

    ``position`` and ``last_position`` are those of its first and last round, null where no round takes it.
    """
    rows = training_order(table(spark, sf_dir, "documents")).withColumn("taken", F.col("size") * F.size("positions"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.size("positions") - 1).alias("last_position"))


def positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 with the positions of every taken round as one column."""
    return training_order(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "positions")


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents as often as the mix takes them, in the order of their training positions."""
    return curriculum(docs, out="_position").drop("_position")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS lim FROM s
), l AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(lim) OVER o, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level FROM l WHERE level * weight <= lim ORDER BY lim / weight, rank LIMIT 1
), t AS (
  SELECT source, source_size, least(lim, (SELECT level FROM f) * weight) AS target FROM l
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size + 1e-12) AS BIGINT), 3) ELSE 0 END AS whole FROM t
), p AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), q AS (
  SELECT *, (start + size / 2.0::DOUBLE <= rest AND whole < 3 AND rest > 0) AS once FROM p
), r AS (
  SELECT *, max(rest) OVER (PARTITION BY source) - sum(CASE WHEN once THEN size ELSE 0 END) OVER (PARTITION BY source) AS off FROM q
), c AS (
  SELECT source, arg_min(doc_id, (abs(size - abs(off)), k, doc_id)) AS flip FROM r
  WHERE once = (off < 0) AND size > 0 AND whole < 3 AND abs(size - abs(off)) < abs(off) GROUP BY source
), e AS (
  SELECT r.*, r.whole + CASE WHEN r.once <> (c.flip IS NOT NULL) THEN 1 ELSE 0 END AS epochs
  FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.doc_id = c.flip
), x AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope,
    CASE WHEN target > 0 THEN least(CAST(start AS DOUBLE) / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS a,
    CASE WHEN target > 0 THEN least(CAST((epochs - 1) * source_size + start AS DOUBLE) / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS z
  FROM e JOIN (SELECT source AS _s, rank FROM s) ON source IS NOT DISTINCT FROM _s
)
SELECT doc_id, size, source_size, target, CAST(epochs * size AS BIGINT) AS taken,
  CASE WHEN epochs > 0 THEN 2 * a / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * a)) END AS position,
  CASE WHEN epochs > 0 THEN 2 * z / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * z)) END AS last_position
FROM x
"""
