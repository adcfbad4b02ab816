"""Assertions as queries: each gives the rows that break a rule; none means that it holds."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The event types that may follow each; the first of a run must be planned.
FOLLOWING = {
    None: ("planned",),
    "planned": ("preflight_passed", "failed", "excluded"),
    "preflight_passed": ("launch_requested", "failed", "excluded"),
    "launch_requested": ("started", "failed", "excluded"),
    "started": ("checkpointed", "failed", "completed"),
    "checkpointed": ("checkpointed", "failed", "resumed", "completed"),
    "failed": ("preflight_passed", "launch_requested", "checkpointed", "resumed", "excluded"),
    "resumed": ("started", "checkpointed", "failed", "completed"),
    "excluded": (),
    "completed": (),
}
#: (before, after) pairs of event types that are allowed.
TRANSITIONS = tuple((a, b) for a, after in FOLLOWING.items() for b in after)


def wrong_fields(rows: DataFrame, wanted: list[tuple[str, str]]) -> list[str]:
    """V1: columns that are missing, unknown or of another type than (name, type) in order."""
    have = dict(rows.dtypes)
    bad = [f"missing {n}" for n, _ in wanted if n not in have]
    bad += [f"{n} is {have[n]}, not {t}" for n, t in wanted if n in have and have[n] != t]
    return bad + [f"unknown {n}" for n in have if n not in dict(wanted)]


def wrong_rows(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """V2: (key, rule) of rows that break a rule; an unknown outcome breaks it as well."""
    each = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return rows.select(key, F.explode(F.array_compact(each)).alias("rule"))


def broken_pairs(rows: DataFrame, by: list[str], equal: list[str]) -> DataFrame:
    """V3: pairs that repeat a variant, lack one, or differ in fields that must be equal."""
    got = rows.groupBy(*by, "pair_id").agg(F.count("*").alias("n"), F.countDistinct("variant").alias("variants"), *[F.countDistinct(c).alias(f"_{c}") for c in equal])
    differ = functools.reduce(lambda a, b: a | b, (F.col(f"_{c}") > 1 for c in equal), F.lit(False))
    problem = F.when(F.col("n") > F.col("variants"), "repeated_variant").when(F.col("variants") < 2, "missing_variant").when(differ, "unequal_fields")
    return got.withColumn("problem", problem).filter("problem is not null").select(*by, "pair_id", "problem")


def trace_errors(rows: DataFrame, key: str, actions: str) -> DataFrame:
    """V4: traces with more than one halt, or with anything but no-ops after it."""
    a = F.col(actions)
    halt = F.array_position(a, "halt")
    after = F.when(halt > 0, F.slice(a, (halt + 1).cast("int"), F.greatest(F.lit(0), F.size(a) - halt).cast("int"))).otherwise(F.array().cast("array<string>"))
    halts = F.size(F.filter(a, lambda x: x == "halt"))
    problem = F.when(halts > 1, "several_halts").when(F.exists(after, lambda x: x != "noop"), "action_after_halt").when((halt == 0) & F.array_contains(a, "noop"), "noop_without_halt")
    return rows.select(key, problem.alias("problem")).filter("problem is not null")


def unordered(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value doesn't exceed the one before it in its group's order."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_p", F.lag(value).over(w)).filter(F.col(value) <= F.col("_p")).drop("_p")


def artifact_digests(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_artifacts(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose size or digest isn't the manifest's, and files that either lacks."""
    name = F.substring_index("path", "/", -1)
    m = manifest.select(F.col("name"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    rows = found.select(name.alias("name"), "bytes", "sha256").join(m, "name", "full_outer")
    problem = F.when(F.col("_b").isNull(), "unlisted").when(F.col("bytes").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_s"), "digest")
    return rows.select("name", problem.alias("problem")).filter("problem is not null")


def repeated_addresses(rows: DataFrame, address: list[str]) -> DataFrame:
    """V9: functional addresses that more than one row claims."""
    return rows.groupBy(*address).agg(F.count("*").alias("n")).filter("n > 1")


def event_hash(previous: Column, *parts: Column) -> Column:
    """The hash of an event over the one before it and its own fields."""
    return F.sha2(F.concat_ws("\n", F.coalesce(previous, F.lit("")), *[p.cast("string") for p in parts]), 256)


def ledger_errors(events: DataFrame, transitions=TRANSITIONS) -> DataFrame:
    """(run, seq, problem) of hash-chained events (run, seq, type, previous, hash): gaps, links that don't hold, changes of state that aren't allowed."""
    w = Window.partitionBy("run").orderBy("seq")
    rows = events.withColumn("_t", F.lag("type").over(w)).withColumn("_h", F.lag("hash").over(w)).withColumn("_s", F.coalesce(F.lag("seq").over(w), F.lit(-1)))
    allowed = events.sparkSession.createDataFrame(list(transitions), "a string, b string").withColumn("ok", F.lit(True))
    rows = rows.join(F.broadcast(allowed), F.col("_t").eqNullSafe(F.col("a")) & (F.col("type") == F.col("b")), "left")
    own = event_hash(F.col("previous"), F.col("run"), F.col("seq"), F.col("type"))
    problem = F.when(F.col("seq") != F.col("_s") + 1, "gap").when(~F.col("previous").eqNullSafe(F.col("_h")), "link").when(F.col("hash") != own, "hash").when(F.col("ok").isNull(), "transition")
    return rows.select("run", "seq", problem.alias("problem")).filter("problem is not null")


def ledger_summary(events: DataFrame, run: str, seq: str, kind: str, kinds: list[str]) -> DataFrame:
    """(run, events, status, a count for each type, digest): the status is the last event's, the digest that of all in order."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(seq, kind))), lambda x: x[kind])
    return events.groupBy(run).agg(F.count("*").alias("events"), F.max_by(kind, F.struct(seq)).alias("status"), *counts, F.sha2(F.array_join(in_order, "\n"), 256).alias("digest"))
