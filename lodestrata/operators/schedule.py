"""Mixture schedules, offsets, shards and packing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import frozen

#: Buckets into which prefix sums cut an order.
BUCKETS = 64


def hamilton(weights: DataFrame, total: int, group: str = "lane") -> DataFrame:
    """M5: (group, ord, weight, quota): total dealt by weight, the largest remainders rounded up, ties by ``ord``. Integers only."""
    every, order = Window.partitionBy(), Window.orderBy(F.desc("rest"), "ord")
    rows = weights.withColumn("w", F.sum("weight").over(every))
    rows = rows.withColumn("base", F.expr(f"({total} * weight) div w")).withColumn("rest", F.expr(f"({total} * weight) % w"))
    rows = rows.withColumn("short", F.lit(total) - F.sum("base").over(every)).withColumn("n", F.row_number().over(order))
    return rows.select(group, "ord", "weight", (F.col("base") + (F.col("n") <= F.col("short")).cast("long")).cast("long").alias("quota"))


def offsets(rows: DataFrame, order: list[str], length: str, out: str = "token_start", group: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows with ``out``, the sum of the lengths before each in the order of its first, numeric column (then the others).

    Two levels: ranges of the order are summed up first, then each is a window
    of its own, so that no task holds the whole order. Ranges are cut evenly between
    the smallest and the largest value; ``group`` starts a new order for each group.
    """
    group, lead = group or [], order[0]
    ends = rows.agg(F.min(lead).alias("lo"), F.max(lead).alias("hi")).first()
    lo, width = ends["lo"] or 0, max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // buckets))
    cut = F.floor((F.col(lead) - lo) / width).cast("long")
    sums = rows.groupBy(*group, cut.alias("_c")).agg(F.sum(length).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias("_" + g) for g in group], F.col("_c").alias("_r"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy(*group, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_c", cut).withColumn("_i", F.coalesce(F.sum(length).over(inner), F.lit(0)))
    same = F.col("_c") == F.col("_r")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col("_" + g))
    return placed.join(base, same).withColumn(out, (F.col("_b") + F.col("_i")).cast("long")).drop("_c", "_i", "_r", "_b", *["_" + g for g in group])


def deficit_order(records: DataFrame, lane_weights: DataFrame) -> DataFrame:
    """M1: records with ``deficit_key``: emitting the lane furthest below its share first is one sort by it.

    A lane's deficit before its k-th record is its target minus its own earlier
    tokens; so with the denominators cleared the greedy order is that of
    (total * weight - all weights * earlier tokens) descending, then lane and place. Decimals keep the products exact.
    """
    w = lane_weights.select("lane", F.col("ord").alias("lane_ord"), "weight")
    sums = records.join(F.broadcast(w), "lane").agg(F.sum("token_length").alias("tot")).first()["tot"] or 0
    all_w = lane_weights.agg(F.sum("weight")).first()[0] or 0
    placed = offsets(records, ["ordinal"], "token_length", "lane_before", ["lane"])
    key = (F.lit(int(sums)).cast("decimal(38,0)") * F.col("weight") - F.col("lane_before").cast("decimal(20,0)") * F.lit(int(all_w)).cast("decimal(18,0)")).cast("decimal(38,0)")
    return placed.join(F.broadcast(w), "lane").withColumn("deficit_key", key)


def numbered(rows: DataFrame, *order: Column | str, out: str = "sequence") -> DataFrame:
    """rows with their place in an order: they are range-sorted, the ranges are counted, and each continues where the one before ended."""
    # the sort must not run again between counting and numbering, nor after a lost executor
    placed = frozen(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(out, (F.col("_b") + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_id", "_p", "_b")


def deficit_schedule(records: DataFrame, lane_weights: DataFrame) -> DataFrame:
    """Every record with its sequence and token range; whole records, ties by the lanes' order."""
    ordered = numbered(deficit_order(records, lane_weights), F.desc("deficit_key"), "lane_ord", "ordinal")
    placed = offsets(ordered, ["sequence"], "token_length", "token_start")
    return placed.withColumn("token_end", F.col("token_start") + F.col("token_length"))


def relative_schedule(records: DataFrame, budgets: DataFrame, open_lane: str | None = None) -> DataFrame:
    """M2: records by the largest relative deficit (budget - emitted) / max(1, budget), ties by lane name.

    The open-ended lane stops at its budget: its record that crosses it stays.
    Others emit all. Keys are doubles, as the rule compares them.
    """
    placed = offsets(records, ["ordinal"], "token_length", "lane_before", ["lane"]).join(F.broadcast(budgets.select("lane", "budget")), "lane")
    if open_lane is not None:
        placed = placed.filter((F.col("lane") != open_lane) | (F.col("lane_before") < F.col("budget")))
    key = (F.col("budget") - F.col("lane_before")).cast("double") / F.greatest(F.lit(1), F.col("budget"))
    return numbered(placed.withColumn("relative_key", key), F.desc("relative_key"), "lane", "ordinal")


def until_budget(records: DataFrame, budget: int, length: str = "token_length") -> DataFrame:
    """M7: records in order as long as those before them stay below the budget; the one that crosses it stays."""
    return offsets(records, ["ordinal"], length, "before").filter(F.col("before") < budget)


def assign_shards(spark, updates: int, shards: int, tokens_per_update: int) -> DataFrame:
    """M8: contiguous shards of whole updates; the first of the remainder get one more. Closed form."""
    base, rest = divmod(updates, shards)
    rows = spark.range(shards).select(F.col("id").alias("shard_index"), F.lit(shards).cast("long").alias("shard_count"))
    start = F.col("shard_index") * base + F.least(F.col("shard_index"), F.lit(rest))
    end = start + base + (F.col("shard_index") < rest).cast("long")
    return rows.select("shard_index", "shard_count", start.alias("update_start"), end.alias("update_end"), (start * tokens_per_update).alias("token_start"), (end * tokens_per_update).alias("token_end"))


def strided(rows: DataFrame, tasks: int) -> DataFrame:
    """M9: the task of each ordinal by stride; the tasks part the ordinals."""
    return rows.withColumn("task", F.pmod(F.col("ordinal"), F.lit(tasks)))


def pack(tokens: DataFrame, shard_tokens: int, shards: int, pad: int = 0) -> DataFrame:
    """(shard, offset, token, weight) of a token stream (pos, token, weight) cut into shards, the last one filled with padding of weight 0."""
    total = tokens.agg(F.max("pos")).first()[0]
    n = 0 if total is None else total + 1
    if n > shards * shard_tokens:
        raise ValueError(f"{n} tokens don't fit {shards} shards of {shard_tokens}")
    real = tokens.select("pos", F.col("token").cast("long").alias("token"), F.col("weight").cast("long").alias("weight"))
    filled = real.union(tokens.sparkSession.range(n, shards * shard_tokens).select(F.col("id"), F.lit(pad).cast("long"), F.lit(0).cast("long")))
    return filled.select(F.expr(f"pos div {shard_tokens}").alias("shard"), (F.col("pos") % shard_tokens).alias("offset"), "token", "weight")


def write_shards(packed: DataFrame, folder: str) -> None:
    """The packed stream as Parquet by shard, in the order of offsets."""
    packed.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").write.mode("errorifexists").partitionBy("shard").parquet(folder)


def merkle(leaves: DataFrame) -> DataFrame:
    """(level, nodes, root): the binary tree of SHA-256 over (position, hash) leaves, an odd last node paired with itself.

    Each level halves the nodes by one aggregation; the loop runs log2(n) times on the driver and sees counts only.
    """
    level = leaves.select(F.col("position"), F.unhex("hash").alias("h"))
    n, depth = level.count(), 0
    while n > 1:
        up = level.groupBy(F.expr("position div 2").alias("position")).agg(F.min_by("h", "position").alias("l"), F.max_by("h", "position").alias("r"))
        level = up.select("position", F.unhex(F.sha2(F.concat("l", "r"), 256)).alias("h"))
        n, depth = (n + 1) // 2, depth + 1
    return level.select(F.lit(depth).cast("long").alias("levels"), F.lower(F.hex("h")).alias("root"))


def stream_digest(leaves: DataFrame) -> str:
    """The running SHA-256 over all hashes in order; sequential by definition, so they pass the driver one by one."""
    h = hashlib.sha256()
    for r in leaves.orderBy("position").select("hash").toLocalIterator():
        h.update(bytes.fromhex(r["hash"]))
    return h.hexdigest()


def quota_choice(lengths: DataFrame, quotas: dict[str, int], total: int) -> DataFrame:
    """M4: (sequence, task, k): always a record of the task furthest below its quota's share of what is written, ties by task name, until ``total`` tokens or a task runs out.

    The order depends on all that went before: one task walks over (task, k, length), and nothing else of the records.
    """
    names = sorted(quotas)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        rows = pd.concat(parts) if parts else pd.DataFrame({"task": [], "k": [], "token_length": []})
        lanes = {t: rows[rows["task"] == t].sort_values("k")["token_length"].tolist() for t in names}
        written, done, out, all_quota = 0, dict.fromkeys(names, 0), [], sum(quotas.values())
        at = dict.fromkeys(names, 0)
        while written < total:
            best = max(names, key=lambda t: (quotas[t] * written - done[t] * all_quota, [-ord(c) for c in t]))
            if at[best] >= len(lanes[best]):
                break
            n = lanes[best][at[best]]
            out.append((len(out), best, at[best], n))
            at[best] += 1
            done[best] += n
            written += n
        yield pd.DataFrame(out, columns=["sequence", "task", "k", "token_length"])

    return lengths.select("task", "k", "token_length").repartition(1).mapInPandas(run, "sequence long, task string, k long, token_length long")


def exact_fill(candidates: DataFrame, target: int, most: int = 32_768) -> DataFrame:
    """M6: of each task's candidates (task, k, token_length) in the order of k, the first set found whose lengths sum to the target exactly.

    A bit set of reachable sums grows candidate by candidate; ``via`` remembers
    by which candidate a sum was first reached. Nothing is returned for a task that can't fill it.
    The search is a window: only a task's first ``most`` candidates are looked at, which bounds its memory; raise it to look further.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k").head(most)
        reach, mask, via = 1, (1 << (target + 1)) - 1, {}
        for k, n in zip(rows["k"].tolist(), rows["token_length"].tolist(), strict=True):
            new = (reach << n) & mask & ~reach
            reach |= new
            while new:
                low = new & -new
                via[low.bit_length() - 1] = (k, n)
                new ^= low
            if reach >> target & 1:
                break
        out, left = [], target
        if reach >> target & 1:
            while left:
                k, n = via[left]
                out.append((key[0], k, n))
                left -= n
        return pd.DataFrame(out, columns=["task", "k", "token_length"])

    return candidates.select("task", "k", "token_length").filter("token_length > 0").groupBy("task").applyInPandas(run, "task string, k long, token_length long")


def curriculum_schedule(records: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Relative deficits that stop at their targets, the graph lane in units of ten records, and for each record the phase and the least used band.

    Order-dependent: one task walks over (lane, ordinal, length).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        rows = pd.concat(parts) if parts else pd.DataFrame({"lane": [], "ordinal": [], "token_length": []})
        lanes = {t: rows[rows["lane"] == t].sort_values("ordinal")[["ordinal", "token_length"]].values.tolist() for t in sorted(targets)}
        done, at, out, total = dict.fromkeys(lanes, 0), dict.fromkeys(lanes, 0), [], max(1, sum(targets.values()))
        used: dict[tuple[str, int], int] = {}
        while True:
            open_ = [t for t in lanes if done[t] < targets[t] and at[t] < len(lanes[t])]
            if not open_:
                break
            lane = max(open_, key=lambda t: ((targets[t] - done[t]) / max(1, targets[t]), [-ord(c) for c in t]))
            for _ in range(10 if lane == "graph" else 1):
                if at[lane] >= len(lanes[lane]):
                    break
                ordinal, n = lanes[lane][at[lane]]
                share = sum(done.values()) / total
                phase = 0 if share < 0.2 else 1 if share < 0.5 else 2
                band = min(range(phase + 1), key=lambda b: (used.get((lane, b), 0), b))
                used[lane, band] = used.get((lane, band), 0) + 1
                out.append((len(out), lane, int(ordinal), int(n), phase, band))
                at[lane] += 1
                done[lane] += int(n)
        yield pd.DataFrame(out, columns=["sequence", "lane", "ordinal", "token_length", "phase", "band"])

    return records.select("lane", "ordinal", "token_length").repartition(1).mapInPandas(run, "sequence long, lane string, ordinal long, token_length long, phase long, band long")


def phase(position: Column, total: Column) -> Column:
    """0, 1 or 2 by relative position below 1/5, below 1/2, or after."""
    return F.when(position * 5 < total, 0).when(position * 2 < total, 1).otherwise(2).cast("long")


def mixture_report(lanes: DataFrame, targets: DataFrame) -> DataFrame:
    """A10: (lane, tokens, docs, share, target, deviation, max_deviation); lanes are few."""
    sums = lanes.groupBy("lane").agg(F.sum("token_length").alias("tokens"), F.count("*").alias("docs"))
    rows = targets.join(sums, "lane", "left").select("lane", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), "target")
    rows = rows.withColumn("share", F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy())))
    return rows.withColumn("deviation", F.abs(F.col("share") - F.col("target"))).withColumn("max_deviation", F.max("deviation").over(Window.partitionBy()))


def batch_windows(tokens: DataFrame, batch: int, length: int, masked: int = -100) -> DataFrame:
    """(window, x, y) of a token stream (pos, token, weight) in windows of batch * length positions: y is the next token, or ``masked`` where its weight is 0; past the end the stream begins again.

    The shift is a join on position, not a window over the stream.
    """
    n = tokens.agg(F.count("*")).first()[0]
    nxt = tokens.select(F.pmod(F.col("pos") - 1, F.lit(max(1, n))).alias("pos"), F.when(F.col("weight") > 0, F.col("token")).otherwise(masked).alias("next"))
    pairs = tokens.select("pos", "token").join(nxt, "pos").withColumn("window", F.expr(f"pos div {batch * length}")).filter(F.col("pos") < n // (batch * length) * (batch * length))
    gathered = pairs.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "next"))).alias("r"))
    return gathered.select("window", F.transform("r", lambda r: r["token"]).alias("x"), F.transform("r", lambda r: r["next"]).alias("y"))


def assembled(docs: DataFrame, seed: str, length: str = "token_length") -> DataFrame:
    """Documents in an order of their hash with the seed, with their token offsets."""
    keyed = docs.withColumn("order_key", F.sha2(F.concat(F.lit(seed + "\0"), F.col("record_id")), 256))
    return offsets(numbered(keyed, "order_key", "record_id"), ["sequence"], length)


def np_windows(values: np.ndarray, start: int, length: int) -> np.ndarray:
    """``length`` values from ``start`` on, around the end."""
    return values[(start + np.arange(length)) % len(values)]
