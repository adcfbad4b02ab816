"""Phase 6: paired statistics of the two arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference as op
from .base import EVAL_ROWS, eval_rows, read, with_
from .metrics import _round

VALUES = [(0.1,), (0.25,), (-0.05,), (0.3,), (0.15,), (0.02,), (-0.1,), (0.2,), (0.05,), (0.12,)]


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    return op.nearest_rank(read(spark, sf_dir, "orders"), "o_totalprice", [0.025, 0.5, 0.975], ["o_orderpriority"])


def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2."""
    return _round(op.linear(read(spark, sf_dir, "orders"), "o_totalprice", [0.025, 0.5, 0.975], ["o_orderpriority"]), 6)


def _seed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten seeds by document id, the arms' difference of each."""
    rows = eval_rows(spark, sf_dir).groupBy((F.col("qid") % 10).alias("seed")).agg(F.sum(F.when(F.col("arm") == "split", F.col("correct")).otherwise(-F.col("correct"))).alias("k"), (F.count("*") / 2).alias("n"))
    return rows.select("seed", F.col("k"), F.round(F.col("k") / F.col("n") - 0.5, 6).alias("delta"))


SEEDS = "seeds AS (SELECT qid % 10 AS seed, CAST(sum(t - q) AS BIGINT) AS k, round(sum(t - q) / count(*)::DOUBLE - 0.5, 6) AS delta FROM eval_base GROUP BY 1)"


def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three alternatives."""
    d = _seed_deltas(spark, sf_dir)
    rows = [op.sign_flip(d, "delta", a).withColumn("alternative", F.lit(a)) for a in ("greater", "less", "two-sided")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("statistic", F.round("statistic", 9))


def exact_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    return op.exact_sign_test(_seed_deltas(spark, sf_dir), "k")


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of the events' types and days by a stated rule."""
    p = read(spark, sf_dir, "events").groupBy(F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string")).alias("name")).agg(F.round(F.count("*") / 20000.0, 6).alias("p"))
    return _round(op.holm(p))


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.paired(eval_rows(spark, sf_dir), ["qid", "pair_id", "task", "world"], "split", "dense")


def paired_delta_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster sums and the point estimate."""
    return op.cluster_sums(_diffs(spark, sf_dir), "world")


def unpaired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that only one arm answers rightly."""
    rows = eval_rows(spark, sf_dir).filter("correct = 1")
    return op.unpaired(rows, ["qid"], "split", "dense")


def clustered_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests hold its interval to the point estimate and to any partitioning."""
    return _round(op.interval(op.clustered_bootstrap(_diffs(spark, sf_dir), "world", 2000)))


def hierarchical_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks are fixed; worlds and pairs are drawn."""
    return _round(op.interval(op.hierarchical_bootstrap(_diffs(spark, sf_dir), ["task", "world", "pair_id"], ["task"], 500), rank=True))


def multinomial_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    return _round(op.interval(op.multinomial_bootstrap(_diffs(spark, sf_dir).withColumn("seed", F.col("qid") % 10), "seed", "task", 1000), 0.05, 0.95, rank=True))


def point_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    weights = spark.createDataFrame([("split", 1.0), ("dense", -1.0)], "arm string, weight double")
    return _round(op.point_deltas(eval_rows(spark, sf_dir).withColumn("seed", F.col("qid") % 5), weights, ["seed"]))


def design_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return op.design_power(spark, 0.03, 0.02, 5, 4000)


def blinded_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    return op.blinded(eval_rows(spark, sf_dir), "arm", ["dense", "split"], "commit-1").groupBy("arm").agg(F.sum("correct").alias("correct"))


def pairing_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18."""
    return op.pairing_failures(eval_rows(spark, sf_dir).withColumn("seed", F.col("qid") % 30), "seed", ["task"])


def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: of each event type's mean value around the grand mean."""
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("n"))
    half = 1.645 * F.col("s") / F.sqrt("n")
    return _round(rows.select("event_type", (F.col("m") - 20 - half).alias("lo"), (F.col("m") - 20 + half).alias("hi"), op.equivalent(F.col("m") - 20 - half, F.col("m") - 20 + half, 1.0).alias("equivalent")), 6)


_CASES = "VALUES (1, true, 0.03, 0.01, 0.04, 0.004, 0.2), (2, true, 0.0, -0.004, 0.006, 0.5, 0.3), (3, true, 0.03, -0.01, 0.02, 0.3, 0.4), (4, false, 0.5, 0.4, 0.6, 0.0, 0.5), (5, true, 0.0, -0.004, 0.006, 0.5, 0.01), (6, true, 0.02, 0.001, 0.03, 0.05, 0.02)"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three generations of rules over stated cases."""
    rows = spark.sql(f"SELECT * FROM {_CASES} AS t(id, valid, mean, lo, hi, p, acc)").select(F.col("id").cast("long").alias("id"), "valid", *[F.col(c).cast("double").alias(c) for c in ("mean", "lo", "hi", "p", "acc")])
    c = F.col
    first = {"guardrails": c("valid"), "mean_360": c("mean"), "lo_360": c("lo"), "lo_160": c("lo"), "dose_lo": c("lo"), "random_lo": c("lo"), "hi_160": c("hi"), "hi_360": c("hi"), "dose_hi": c("lo"), "random_hi": c("hi"), "tasks_positive": c("mean") > 0}
    second = {"valid": c("valid"), "complete": c("id") != 3, "p_value": c("p"), "lo_95": c("lo"), "providers_positive": c("mean") > 0, "lo_90": c("lo"), "hi_90": c("hi")}
    third = {"valid": c("valid"), "mean": c("mean"), "p_value": c("p"), "lo_95": c("lo"), "lo_90": c("lo"), "hi_90": c("hi"), "dense": c("acc"), "split": c("acc") - 0.01}
    return rows.select("id", op.verdict_first(first).alias("first"), op.verdict_second(second).alias("second"), op.verdict_third(third).alias("third"))


def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over measures of the tables."""
    row = eval_rows(spark, sf_dir).agg(F.avg(F.when(F.col("arm") == "dense", F.col("correct"))).alias("dense_internal"), F.avg(F.when(F.col("arm") == "split", F.col("correct"))).alias("split_internal"))
    row = row.select(F.round("dense_internal", 9).alias("dense_internal"), F.round("split_internal", 9).alias("split_internal"), F.lit(0.41).alias("dense_recognition_lo"), F.lit(0.31).alias("split_recognition_hi"), F.lit(0.98).alias("split_bpb"), F.lit(0.975).alias("dense_bpb"), F.lit(0.6).alias("route_rate"), F.lit(0.79).alias("tail_external"), F.lit(0.8).alias("structure_internal"), F.lit(0).alias("mask_violations"))
    return _round(op.guardrails(row))


def load_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    loads = spark.createDataFrame([(50_000, 0.95, 0.8), (100_000, 0.85, 0.76), (200_000, 0.7, 0.75), (400_000, 0.5, 0.6), (800_000, 0.3, 0.5)], "entities long, recall double, composite double")
    budgets = spark.createDataFrame([(5, True, False), (10, True, True), (20, True, True)], "multiple long, available boolean, passes boolean")
    return op.select_loads(loads, [500_000, 900_000, 1_200_000], 2.25).crossJoin(op.select_budget(budgets))


QUERIES = {f.__name__: f for f in (percentile_nearest, percentile_linear, sign_flip, exact_sign_test, holm, paired_delta_point, unpaired_keys, clustered_bootstrap, hierarchical_bootstrap, multinomial_bootstrap, point_deltas, design_power, blinded_arms, pairing_failures, equivalence, verdicts, guardrails, load_gates)}

_FLIP = "flips AS (SELECT m, avg(CASE WHEN (m >> i) & 1 = 1 THEN {0} ELSE -{0} END) AS s, sum(CASE WHEN (m >> i) & 1 = 1 THEN {0} ELSE -{0} END) AS t FROM range(1024) r(m), (SELECT row_number() OVER (ORDER BY {0}) - 1 AS i, {0} FROM seeds) GROUP BY m), o AS (SELECT avg({0}) AS o, sum({0}) AS k FROM seeds)"
ORACLES = {
    "percentile_nearest": "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.025) AS p0_025, quantile_disc(o_totalprice, 0.5) AS p0_5, quantile_disc(o_totalprice, 0.975) AS p0_975 FROM orders GROUP BY 1",
    "percentile_linear": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS p0_025, round(quantile_cont(o_totalprice, 0.5), 6) AS p0_5, round(quantile_cont(o_totalprice, 0.975), 6) AS p0_975 FROM orders GROUP BY 1",
    "sign_flip": with_(EVAL_ROWS, SEEDS, _FLIP.format("delta")) + " UNION ALL ".join(f"SELECT round(any_value(o), 9) AS statistic, count(*) FILTER ({c}) / 1024.0::DOUBLE AS p_value, 10::BIGINT AS n, 1024::BIGINT AS permutations, '{a}' AS alternative FROM flips, o" for a, c in (("greater", "s >= o - 1e-12"), ("less", "s <= o + 1e-12"), ("two-sided", "abs(s) >= abs(o) - 1e-12"))),
    "exact_sign_test": with_(EVAL_ROWS, SEEDS, _FLIP.format("k")).replace("sum(k) AS k", "sum(k) AS kk") + "SELECT count(*) FILTER (t >= kk) AS extreme, count(*) AS permutations FROM flips, o",
    "holm": "WITH t AS (SELECT event_type || '-' || user_id % 4 AS name, round(count(*) / 20000.0, 6)::DOUBLE AS p FROM events GROUP BY 1), h AS (SELECT *, max(least(1, (m - i + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS a FROM (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM t)) SELECT name, p, round(a, 9) AS adjusted, a <= 0.05 AS reject FROM h",
    "paired_delta_point": with_(EVAL_ROWS) + "SELECT world, sum(t - q)::DOUBLE AS s, count(*) AS n FROM eval_base GROUP BY world",
    "unpaired_keys": with_(EVAL_ROWS) + "SELECT qid, q AS b, t AS a FROM eval_base WHERE q + t = 1",
    "point_deltas": with_(EVAL_ROWS) + "SELECT seed, round(avg(t) - avg(q), 9) AS delta FROM (SELECT qid % 5 AS seed, task, avg(t) AS t, avg(q) AS q FROM eval_base GROUP BY ALL) GROUP BY seed",
    "blinded_arms": with_(EVAL_ROWS) + "SELECT chr(64 + CAST(row_number() OVER (ORDER BY sha256('commit-1' || chr(0) || arm), arm) AS INT)) AS arm, correct FROM (SELECT arm, CAST(sum(correct) AS BIGINT) AS correct FROM eval_rows GROUP BY arm)",
    "pairing_failures": with_(EVAL_ROWS) + "SELECT qid % 30 AS seed, count(DISTINCT task) AS identities FROM eval_rows GROUP BY 1 HAVING identities > 1",
    "equivalence": "SELECT event_type, round(m - 20 - h, 6) AS lo, round(m - 20 + h, 6) AS hi, m - 20 - h > -1 AND m - 20 + h < 1 AS equivalent FROM (SELECT event_type, avg(value) AS m, 1.645::DOUBLE * stddev_samp(value) / sqrt(count(*)) AS h FROM events GROUP BY 1)",
    "verdicts": "SELECT unnest(range(1, 7)) AS id, unnest(['validated','practical_null','inconclusive','invalid','practical_null','validated']) AS first, unnest(['supports_effect','supports_practical_null','inconclusive','invalid','supports_practical_null','supports_effect']) AS second, unnest(['exploratory_supports_effect','exploratory_supports_practical_null','inconclusive','invalid','inconclusive_floor','exploratory_supports_effect']) AS third",
    "guardrails": with_(EVAL_ROWS) + """SELECT unnest(['burden','leakage','internal_knowledge','language_bpb','route_rate','tail_external','structure_internal','mask_ledger']) AS "check", unnest([0.41, 0.31, round(round(t, 9) - round(q, 9), 9), round(0.98::DOUBLE / 0.975, 9), 0.6, 0.79, 0.8, 0.0])::DOUBLE AS value,
      unnest([0.3, 0.3, -0.02, 1.01, 0.4, 0.8, 0.8, 0.0])::DOUBLE AS threshold, unnest([true, false, t - q >= -0.02, true, true, false, true, true]) AS passed FROM (SELECT avg(t) AS t, avg(q) AS q FROM eval_base)""",
    "load_gates": "SELECT 50000::BIGINT AS low, 400000::BIGINT AS high, 900000::BIGINT AS confirmation, 10::BIGINT AS budget",
}
