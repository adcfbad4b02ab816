"""Phase 3: mixtures, schedules and packing over documents as lanes of records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import ordered_digest
from ..operators import schedule as op
from .base import LANES, lanes, read, with_

WEIGHTS = {"en": 5, "de": 3, "fr": 2, "es": 2}
SHARDS, UPDATE_TOKENS = 7, 4096
W = "w AS (SELECT unnest(['en','de','fr','es']) AS lane, unnest([0, 1, 2, 3]) AS ord, unnest([5, 3, 2, 2]) AS weight)"


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, w) for i, (k, w) in enumerate(WEIGHTS.items())], "lane string, ord long, weight long")


def hamilton_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: line items' quantity dealt by the priorities' numbers of orders."""
    weights = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lane")).agg(F.count("*").alias("weight"))
    weights = weights.withColumn("ord", F.row_number().over(Window.orderBy("lane")).cast("long"))
    return op.hamilton(weights, 9973)


def deficit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, W3."""
    return op.deficit_schedule(lanes(spark, sf_dir), _weights(spark)).select("sequence", "record_id", "lane", "token_length", "token_start", "token_end")


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("en", 60_000), ("de", 40_000), ("fr", 30_000), ("es", 20_000)], "lane string, budget long")


def relative_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: English is the open-ended lane."""
    return op.relative_schedule(lanes(spark, sf_dir), _budgets(spark, sf_dir), "en").select("sequence", "record_id", "lane")


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of all records by ordinal."""
    return op.offsets(lanes(spark, sf_dir), ["ordinal"], "token_length").select("record_id", "token_start")


def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    tokens = lanes(spark, sf_dir).agg(F.sum("token_length")).first()[0]
    return op.assign_shards(spark, math.ceil(tokens / UPDATE_TOKENS), SHARDS, UPDATE_TOKENS)


def strided_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: records and tokens of each task."""
    return op.strided(lanes(spark, sf_dir), 7).groupBy("task").agg(F.count("*").alias("records"), F.sum("token_length").alias("tokens"), F.min("ordinal").alias("first_ordinal"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, token, weight): all words of the benchmark as a stream; a token is a word's length, every seventh word of an item is masked."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).withColumn("n", F.size("w").cast("long"))
    placed = op.offsets(items, ["item_id"], "n", "start")
    words = placed.select("start", F.posexplode("w").alias("i", "w"))
    return words.select((F.col("start") + F.col("i")).alias("pos"), F.length("w").cast("long").alias("token"), (F.col("i") % 7 != 0).cast("long").alias("weight"))


STREAM = r"""items AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
placed AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM items),
stream AS (SELECT CAST(start + i AS BIGINT) AS pos, CAST(length(x) AS BIGINT) AS token, CAST(i % 7 <> 0 AS BIGINT) AS weight FROM (SELECT start, unnest(range(len(w))) AS i, unnest(w) AS x FROM placed))"""


def pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards of 4096 tokens, the rest filled up; sums of each."""
    packed = op.pack(_stream(spark, sf_dir), 4096, 4)
    return packed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("token").alias("tokens"), F.sum("weight").alias("weights"), F.sum((F.col("offset") + 1) * F.col("token")).alias("mark"))


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the items of the benchmark by position."""
    leaves = op.numbered(read(spark, sf_dir, "benchmark"), "item_id", out="position").select("position", F.sha2("text", 256).alias("hash"))
    return op.merkle(leaves)


def stream_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SHA-256 over all items' hashes in order."""
    ordered = read(spark, sf_dir, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", F.sha2("text", 256).alias("h")))).alias("r"))
    return ordered.select(ordered_digest(F.transform("r", lambda x: x["h"])).alias("digest"), F.size("r").cast("long").alias("items"))


def generate_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7."""
    return op.until_budget(lanes(spark, sf_dir), 50_000).select("record_id", "before")


def quota_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: sequential; held against a plain loop in the tests."""
    rows = lanes(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("lane").orderBy("ordinal")) - 1)
    return op.quota_choice(rows.select(F.col("lane").alias("task"), F.col("k").cast("long").alias("k"), "token_length"), WEIGHTS, 60_000)


def exact_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: records of each language that fill 5000 tokens exactly."""
    return op.exact_fill(lanes(spark, sf_dir).select(F.col("lane").alias("task"), F.col("ordinal").alias("k"), "token_length"), 5000)


def curriculum_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, W16."""
    rows = lanes(spark, sf_dir).withColumn("lane", F.when(F.col("lane") == "en", "graph").otherwise(F.col("lane")))
    return op.curriculum_schedule(rows, {"graph": 80_000, "de": 30_000, "fr": 20_000, "es": 10_000})


def exposure_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by phase."""
    placed = op.offsets(lanes(spark, sf_dir), ["ordinal"], "token_length").crossJoin(F.broadcast(lanes(spark, sf_dir).agg(F.sum("token_length").alias("all_tokens"))))
    return placed.groupBy(op.phase(F.col("token_start"), F.col("all_tokens")).alias("phase")).agg(F.count("*").alias("records"), F.sum("token_length").alias("tokens"))


def mixture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    targets = spark.createDataFrame([("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1), ("it", 0.0)], "lane string, target double")
    rows = op.mixture_report(lanes(spark, sf_dir), targets)
    return rows.select("lane", "tokens", "docs", "target", *[F.round(c, 9).alias(c) for c in ("share", "deviation", "max_deviation")])


def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17, M18."""
    rows = op.batch_windows(_stream(spark, sf_dir), 4, 128)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return rows.select("window", text("x").alias("x"), text("y").alias("y"))


def assembled_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19."""
    return op.assembled(lanes(spark, sf_dir), "arm-a").select("record_id", "sequence", "token_start")


QUERIES = {f.__name__: f for f in (hamilton_quota, deficit_schedule, relative_schedule, token_offsets, shard_assignment, strided_tasks, pack_shards, merkle_root, stream_commitment, generate_until, quota_choice, exact_fill, curriculum_schedule, exposure_phase, mixture_report, batch_windows, assembled_arm)}

_BEFORE = "coalesce(sum(token_length) OVER (PARTITION BY lane ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_START = "CAST(coalesce(sum(token_length) OVER (ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
ORACLES = {
    "hamilton_quota": """WITH c AS (SELECT o_orderpriority AS lane, count(*) AS weight FROM orders GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY lane) AS ord, 9973 * weight // (SELECT sum(weight) FROM c) AS base, 9973 * weight % (SELECT sum(weight) FROM c) AS rest FROM c)
      SELECT lane, ord, weight, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, ord) <= 9973 - (SELECT sum(base) FROM p) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM p""",
    "deficit_schedule": with_(LANES, W) + f"""SELECT row_number() OVER (ORDER BY key DESC, ord, ordinal) - 1 AS sequence, record_id, lane, token_length, {_START.format('key DESC, ord, ordinal')} AS token_start, token_start + token_length AS token_end
      FROM (SELECT l.*, ord, (SELECT sum(token_length) FROM lanes)::HUGEINT * weight - {_BEFORE} * 12 AS key FROM lanes l JOIN w USING (lane))""",
    "relative_schedule": with_(LANES, "b AS (SELECT unnest(['en','de','fr','es']) AS lane, unnest([60000, 40000, 30000, 20000]) AS budget)") + f"""SELECT row_number() OVER (ORDER BY (budget - b4)::DOUBLE / budget DESC, lane, ordinal) - 1 AS sequence, record_id, lane
      FROM (SELECT l.*, budget, {_BEFORE} AS b4 FROM lanes l JOIN b USING (lane)) WHERE lane <> 'en' OR b4 < budget""",
    "token_offsets": with_(LANES) + f"SELECT record_id, {_START.format('ordinal')} AS token_start FROM lanes",
    "shard_assignment": with_(LANES, f"u AS (SELECT CAST(ceil(sum(token_length) / {UPDATE_TOKENS}.0) AS BIGINT) AS n FROM lanes)") + f"""SELECT i AS shard_index, {SHARDS}::BIGINT AS shard_count, i * (n // {SHARDS}) + least(i, n % {SHARDS}) AS update_start, update_start + n // {SHARDS} + CASE WHEN i < n % {SHARDS} THEN 1 ELSE 0 END AS update_end,
      update_start * {UPDATE_TOKENS} AS token_start, update_end * {UPDATE_TOKENS} AS token_end FROM u, range({SHARDS}) t(i)""",
    "strided_tasks": with_(LANES) + "SELECT ordinal % 7 AS task, count(*) AS records, CAST(sum(token_length) AS BIGINT) AS tokens, min(ordinal) AS first_ordinal FROM lanes GROUP BY 1",
    "pack_shards": with_(STREAM) + """SELECT i // 4096 AS shard, count(*) AS n, CAST(sum(coalesce(token, 0)) AS BIGINT) AS tokens, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS weights, CAST(sum((i % 4096 + 1) * coalesce(token, 0)) AS BIGINT) AS mark
      FROM range(16384) t(i) LEFT JOIN stream ON pos = i GROUP BY 1""",
    "merkle_root": """WITH RECURSIVE leaves AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS p, sha256(text) AS h FROM benchmark), up AS (
      SELECT 0 AS level, (SELECT list(h ORDER BY p) FROM leaves) AS hs
      UNION ALL SELECT level + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(unhex(hs[2 * i + 1] || hs[least(2 * i + 2, len(hs))]))) FROM up WHERE len(hs) > 1)
      SELECT level::BIGINT AS levels, hs[1] AS root FROM up WHERE len(hs) = 1""",
    "stream_commitment": "SELECT sha256(string_agg(sha256(text), '' ORDER BY item_id)) AS digest, count(*) AS items FROM benchmark",
    "generate_until": with_(LANES) + f"SELECT * FROM (SELECT record_id, {_START.format('ordinal')} AS before FROM lanes) WHERE before < 50000",
    "exposure_phase": with_(LANES) + f"SELECT CASE WHEN s * 5 < a THEN 0 WHEN s * 2 < a THEN 1 ELSE 2 END::BIGINT AS phase, count(*) AS records, CAST(sum(token_length) AS BIGINT) AS tokens FROM (SELECT *, {_START.format('ordinal')} AS s, (SELECT sum(token_length) FROM lanes) AS a FROM lanes) GROUP BY 1",
    "mixture_report": with_(LANES, "g AS (SELECT unnest(['en','de','fr','es','it']) AS lane, unnest([0.5, 0.2, 0.2, 0.1, 0.0])::DOUBLE AS target)") + """SELECT lane, tokens, docs, target, round(share, 9) AS share, round(abs(share - target), 9) AS deviation, round(max(abs(share - target)) OVER (), 9) AS max_deviation
      FROM (SELECT g.lane, target, CAST(coalesce(sum(token_length), 0) AS BIGINT) AS tokens, count(record_id) AS docs, tokens::DOUBLE / sum(tokens) OVER () AS share FROM g LEFT JOIN lanes USING (lane) GROUP BY ALL)""",
    "batch_windows": with_(STREAM, "n AS (SELECT count(*) AS n FROM stream)") + """SELECT s.pos // 512 AS "window", string_agg(s.token, ' ' ORDER BY s.pos) AS x, string_agg(CASE WHEN t.weight > 0 THEN t.token ELSE -100 END, ' ' ORDER BY s.pos) AS y
      FROM stream s, n JOIN stream t ON t.pos = (s.pos + 1) % n WHERE s.pos < n // 512 * 512 GROUP BY 1""",
    "assembled_arm": with_(LANES) + f"SELECT record_id, row_number() OVER (ORDER BY k, record_id) - 1 AS sequence, {_START.format('k, record_id')} AS token_start FROM (SELECT *, sha256('arm-a' || chr(0) || record_id) AS k FROM lanes)",
}
