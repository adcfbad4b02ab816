"""Paired statistics: exact tests, corrections, bootstraps and verdicts. Conventions that differ keep functions of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most pairs whose signs are enumerated.
MAX_PAIRS = 20


def nearest_rank(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank, the value of index ceil(p * n) - 1."""
    return rows.groupBy(*(by or [])).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{p:g}".replace(".", "_")) for p in shares])


def linear(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Percentiles interpolated linearly between ranks."""
    return rows.groupBy(*(by or [])).agg(*[F.percentile(value, F.lit(p)).alias(f"p{p:g}".replace(".", "_")) for p in shares])


def sign_flip(deltas: DataFrame, value: str = "delta", alternative: str = "two-sided", tolerance: float = 1e-15) -> DataFrame:
    """One row (statistic, p_value, n, permutations): all sign patterns of at most MAX_PAIRS paired differences, a row each."""
    values = [r[value] for r in deltas.orderBy(value).limit(MAX_PAIRS + 1).select(value).collect()]
    n = len(values)
    if not 1 <= n <= MAX_PAIRS:
        raise ValueError(f"between 1 and {MAX_PAIRS} pairs are enumerated")
    bits = deltas.sparkSession.range(1 << n)
    terms = [F.when(F.shiftright("id", i).bitwiseAND(1) == 1, F.lit(float(v))).otherwise(F.lit(-float(v))) for i, v in enumerate(values)]
    statistic = sum(terms[1:], terms[0]) / n
    observed = float(np.mean(values))
    s = F.col("s")
    extreme = {"greater": s >= observed - tolerance, "less": s <= observed + tolerance, "two-sided": F.abs(s) >= abs(observed) - tolerance}[alternative]
    return bits.select(statistic.alias("s")).agg(F.lit(observed).alias("statistic"), (F.count_if(extreme) / F.lit(float(1 << n))).alias("p_value"), F.lit(n).cast("long").alias("n"), F.count("*").alias("permutations"))


def exact_sign_test(deltas: DataFrame, numerator: str, seeds: int = 10) -> DataFrame:
    """The one-sided test over exactly ``seeds`` integer differences (over one denominator): (extreme, permutations), whose ratio is the p-value."""
    values = [int(r[numerator]) for r in deltas.orderBy(numerator).limit(seeds + 1).select(numerator).collect()]
    if len(values) != seeds:
        raise ValueError(f"exactly {seeds} seeds are tested")
    terms = [F.when(F.shiftright("id", i).bitwiseAND(1) == 1, F.lit(v)).otherwise(F.lit(-v)) for i, v in enumerate(values)]
    rows = deltas.sparkSession.range(1 << seeds).select(sum(terms[1:], terms[0]).alias("s"))
    return rows.agg(F.count_if(F.col("s") >= sum(values)).alias("extreme"), F.count("*").alias("permutations"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(name, p, adjusted, reject): the running maximum of (tests left) * p, at most 1, in the order of p and name."""
    order = Window.orderBy("p", "name")
    left = F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1
    rows = tests.withColumn("_s", F.least(F.lit(1.0), left * F.col("p")))
    return rows.withColumn("adjusted", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("reject", F.col("adjusted") <= alpha).drop("_s")


def equivalent(lower: Column, upper: Column, margin: float) -> Column:
    """P10: both bounds lie strictly inside the margin."""
    return (lower > -margin) & (upper < margin)


def paired(rows: DataFrame, keys: list[str], a: str, b: str, arm: str = "arm", value: str = "correct") -> DataFrame:
    """(keys, d): a - b of rows of both arms; keys of one arm only are errors, see ``unpaired``."""
    own = lambda x, n: rows.filter(F.col(arm) == x).select(*keys, F.col(value).alias(n))
    return own(a, "_a").join(own(b, "_b"), keys).select(*keys, (F.col("_a") - F.col("_b")).alias("d"))


def unpaired(rows: DataFrame, keys: list[str], a: str, b: str, arm: str = "arm") -> DataFrame:
    """Keys that only one arm has, or that an arm repeats."""
    got = rows.groupBy(*keys).agg(F.count_if(F.col(arm) == a).alias("a"), F.count_if(F.col(arm) == b).alias("b"))
    return got.filter("a <> 1 or b <> 1")


def cluster_sums(diffs: DataFrame, cluster: str) -> DataFrame:
    """(cluster, s, n): all that a clustered bootstrap needs of the items."""
    return diffs.groupBy(cluster).agg(F.sum("d").cast("double").alias("s"), F.count("*").alias("n"))


def _replicates(spark, draws: int, parts: int = 16) -> DataFrame:
    return spark.range(0, draws, 1, min(parts, draws)).withColumnRenamed("id", "replicate")


def clustered_bootstrap(diffs: DataFrame, cluster: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(replicate, delta): clusters drawn with replacement, items weighing as often as their cluster is drawn.

    Every replicate has a generator seeded by its number, so results don't depend
    on partitions. Clusters are few (sums of them are sent to every task); the
    stream of draws is numpy's by replicate, the contract (size, determinism) is kept, not another library's byte stream.
    """
    sums = sorted((str(r[cluster]), r["s"], r["n"]) for r in cluster_sums(diffs, cluster).collect())
    s, n = np.array([x[1] for x in sums]), np.array([x[2] for x in sums], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b))
            for k, rep in enumerate(b["replicate"]):
                draw = np.random.default_rng([seed, int(rep)]).integers(0, len(s), len(s))
                out[k] = s[draw].sum() / n[draw].sum()
            yield pd.DataFrame({"replicate": b["replicate"], "delta": out})

    return _replicates(diffs.sparkSession, draws).mapInPandas(run, "replicate long, delta double")


def hierarchical_bootstrap(diffs: DataFrame, levels: list[str], fixed: list[str], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(replicate, delta): means of means along ``levels`` (outermost first), resampling the units of each level within their parent but those of ``fixed`` levels.

    Arms enter as paired differences, so they share draws. Each replicate is seeded by its number.
    """
    rows = diffs.groupBy(*levels).agg(F.avg("d").alias("d")).collect()
    root: dict = {}
    for r in sorted(rows, key=lambda r: tuple(str(r[x]) for x in levels)):
        at = root
        for x in levels[:-1]:
            at = at.setdefault(str(r[x]), {})
        at[str(r[levels[-1]])] = r["d"]

    def value(node, depth: int, rng) -> float:
        if not isinstance(node, dict):
            return node
        units = list(node.values())
        if levels[depth] not in fixed:
            units = [units[i] for i in rng.integers(0, len(units), len(units))]
        if not isinstance(units[0], dict):
            return float(np.mean(units))
        return float(np.mean([value(u, depth + 1, rng) for u in units]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"replicate": b["replicate"], "delta": [value(root, 0, np.random.default_rng([seed, int(x)])) for x in b["replicate"]]})

    return _replicates(diffs.sparkSession, draws).mapInPandas(run, "replicate long, delta double")


def multinomial_bootstrap(diffs: DataFrame, outer: str, family: str, draws: int = 20_000, seed: int = 0) -> DataFrame:
    """(replicate, delta): seeds drawn with replacement, families fixed, items of a cell drawn by its shares of -1, 0 and 1."""
    cells = diffs.groupBy(outer, family).agg(F.count_if(F.col("d") < 0).alias("minus"), F.count_if(F.col("d") > 0).alias("plus"), F.count("*").alias("n")).collect()
    seeds, families = sorted({str(c[outer]) for c in cells}), sorted({str(c[family]) for c in cells})
    at = {(str(c[outer]), str(c[family])): (c["minus"], c["plus"], c["n"]) for c in cells}
    table = [[at[s, f] for f in families if (s, f) in at] for s in seeds]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b))
            for k, rep in enumerate(b["replicate"]):
                rng = np.random.default_rng([seed, int(rep)])
                picked = rng.integers(0, len(table), len(table))
                means = []
                for i in picked:
                    cell = [rng.multinomial(n, [lo / n, hi / n, 1 - (lo + hi) / n]) for lo, hi, n in table[i]]
                    means.append(np.mean([(c[1] - c[0]) / c.sum() for c in cell]))
                out[k] = np.mean(means)
            yield pd.DataFrame({"replicate": b["replicate"], "delta": out})

    return _replicates(diffs.sparkSession, draws).mapInPandas(run, "replicate long, delta double")


def interval(replicates: DataFrame, low: float = 0.025, high: float = 0.975, rank: bool = False) -> DataFrame:
    """One row (lo, hi, se, draws) of bootstrap replicates, by linear (P2) or nearest-rank (P1) percentiles."""
    p = (lambda x: F.expr(f"percentile_disc({x}) within group (order by delta)")) if rank else (lambda x: F.percentile("delta", F.lit(x)))
    return replicates.agg(p(low).alias("lo"), p(high).alias("hi"), F.stddev_samp("delta").alias("se"), F.count("*").alias("draws"))


def point_deltas(rows: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, delta): arms' task means, tasks weighing equally, put together by contrast weights (arm, weight)."""
    tasks = rows.groupBy(*by, "arm", "task").agg(F.avg("correct").alias("m"))
    arms = tasks.groupBy(*by, "arm").agg(F.avg("m").alias("m"))
    return arms.join(F.broadcast(weights), "arm").groupBy(*by).agg(F.sum(F.col("m") * F.col("weight")).alias("delta"))


def design_power(spark, effect: float, spread: float, seeds: int, simulations: int = 10_000, seed: int = 0, critical: float = 2.776) -> DataFrame:
    """One row (power, simulations): the share of simulated designs whose one-sample t exceeds the critical value; simulations are seeded by number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = []
            for x in b["replicate"]:
                d = np.random.default_rng([seed, int(x)]).normal(effect, spread, seeds)
                hit.append(int(d.mean() / (d.std(ddof=1) / np.sqrt(seeds)) > critical))
            yield pd.DataFrame({"hit": hit})

    return _replicates(spark, simulations).mapInPandas(run, "hit int").agg(F.avg("hit").alias("power"), F.count("*").alias("simulations"))


def blinded(rows: DataFrame, arm: str, labels: list[str], commitment_seed: str) -> DataFrame:
    """Rows with the arms' labels replaced by letters in the order of their hash with a seed; ``blind_key`` has the map."""
    return rows.join(F.broadcast(blind_key(rows.sparkSession, labels, commitment_seed)).withColumnRenamed("label", arm), arm).drop(arm).withColumnRenamed("blind", arm)


def blind_key(spark, labels: list[str], commitment_seed: str) -> DataFrame:
    """(label, blind): a permutation that opens with its seed."""
    keyed = spark.createDataFrame([(x,) for x in labels], "label string").withColumn("_h", F.sha2(F.concat(F.lit(commitment_seed + "\0"), "label"), 256))
    return keyed.select("label", F.char(64 + F.row_number().over(Window.orderBy("_h", "label"))).alias("blind"))


def pairing_failures(rows: DataFrame, seed: str, identity: list[str]) -> DataFrame:
    """Seeds with more than one identity over their arms and steps."""
    return rows.groupBy(seed).agg(F.countDistinct(F.struct(*identity)).alias("identities")).filter("identities > 1")


def verdict_first(c: dict[str, Column]) -> Column:
    """P14, first generation: invalid unless all guardrails pass; then validated, practical_null or inconclusive."""
    validated = (c["mean_360"] >= 0.02) & (c["lo_360"] > 0) & (c["lo_160"] > 0) & (c["dose_lo"] > 0) & (c["random_lo"] > 0) & c["tasks_positive"]
    null = (c["hi_160"] < 0.02) & (c["hi_360"] < 0.02) & (c["dose_hi"] <= 0) & (c["random_hi"] <= 0.01)
    return F.when(~c["guardrails"], "invalid").when(validated, "validated").when(null, "practical_null").otherwise("inconclusive")


def verdict_second(c: dict[str, Column], alpha: float = 0.05, margin: float = 0.01) -> Column:
    """P14, second generation: invalid, inconclusive while the cohort is incomplete, then effect before practical null."""
    effect = (c["p_value"] <= alpha) & (c["lo_95"] > 0) & c["providers_positive"]
    return (
        F.when(~c["valid"], "invalid").when(~c["complete"], "inconclusive").when(effect, "supports_effect")
        .when(equivalent(c["lo_90"], c["hi_90"], margin), "supports_practical_null").otherwise("inconclusive")
    )


def verdict_third(c: dict[str, Column], alpha: float = 0.05, margin: float = 0.01, floor: float = 0.05) -> Column:
    """P14, frozen exploratory rules: an effect counts even at the floor of learnability, a null doesn't."""
    effect = (c["mean"] > 0) & (c["p_value"] <= alpha) & (c["lo_95"] > 0)
    learnable = F.greatest(c["dense"], c["split"]) >= floor
    return (
        F.when(~c["valid"], "invalid").when(effect, "exploratory_supports_effect").when(~learnable, "inconclusive_floor")
        .when(equivalent(c["lo_90"], c["hi_90"], margin), "exploratory_supports_practical_null").otherwise("inconclusive")
    )


def guardrails(row: DataFrame) -> DataFrame:
    """(check, value, threshold, passed) of one row of measures: recognition burden and leakage, noninferiority, language ratio, routes, mask ledger."""
    tol = 1e-12
    c = F.col
    checks = [
        ("burden", c("dense_recognition_lo"), 0.30, c("dense_recognition_lo") > 0.30),
        ("leakage", c("split_recognition_hi"), 0.30, c("split_recognition_hi") < 0.30),
        ("internal_knowledge", c("split_internal") - c("dense_internal"), -0.02, c("split_internal") - c("dense_internal") >= -0.02 - tol),
        ("language_bpb", c("split_bpb") / c("dense_bpb"), 1.01, c("split_bpb") / c("dense_bpb") <= 1.01 + tol),
        ("route_rate", c("route_rate"), 0.40, c("route_rate").between(0.40, 0.60)),
        ("tail_external", c("tail_external"), 0.80, c("tail_external") >= 0.80),
        ("structure_internal", c("structure_internal"), 0.80, c("structure_internal") >= 0.80),
        ("mask_ledger", c("mask_violations").cast("double"), 0.0, c("mask_violations") == 0),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), F.lit(float(t)).alias("threshold"), p.alias("passed")) for n, v, t, p in checks])
    return row.select(F.explode(each).alias("x")).select("x.*")


def select_loads(loads: DataFrame, candidates: list[int], scale: float) -> DataFrame:
    """One row (low, high, confirmation): the smallest load that is learnt well, the largest other that is learnt less, and the candidate nearest to its scaled size.

    ``loads`` has (entities, recall, composite); without a low or a high load the row is null.
    """
    low = loads.filter("recall >= 0.80 and composite >= 0.75").orderBy("entities").limit(1).select(F.col("entities").alias("low"), F.col("recall").alias("_r"), F.col("composite").alias("_c"))
    fits = (F.col("entities") != F.col("low")) & (F.col("recall") >= 0.40) & (F.col("composite") >= 0.40) & ((F.col("recall") <= F.col("_r") - 0.10) | (F.col("composite") <= F.col("_c") - 0.05))
    high = loads.crossJoin(F.broadcast(low)).filter(fits).agg(F.max("entities").alias("high"), F.first("low").alias("_low"))
    each = F.array(*[F.struct(F.abs(F.lit(float(x)) - F.col("high") * scale).alias("gap"), F.lit(x).cast("long").alias("x")) for x in candidates])
    return high.select(F.when(F.col("high").isNotNull(), F.col("_low")).alias("low"), "high", F.when(F.col("high").isNotNull(), F.array_min(each)["x"]).alias("confirmation"))


def select_budget(budgets: DataFrame) -> DataFrame:
    """The smallest budget whose arms all pass, if the largest one is there: (multiple, available, passes)."""
    top = budgets.agg(F.max_by("available", "multiple").alias("a"), F.min(F.when(F.col("passes"), F.col("multiple"))).alias("m"))
    return top.select(F.when(F.col("a"), F.col("m")).alias("budget"))
