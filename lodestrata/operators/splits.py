"""Splits, samples and set checks: hash buckets, strata, disjointness, overlap and reconciliation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import composition_bucket, composition_hash, leading, sha

#: Buckets of a split plan: [first, last].
BUCKETS = {"train": (0, 79), "development": (80, 89), "held_out": (90, 99)}


def compositions(relations: DataFrame, length: int) -> DataFrame:
    """Every sequence of ``length`` relations, a cartesian power of a short list, with hash and bucket."""
    rows = relations.select(F.array("relation").alias("path"))
    for _ in range(length - 1):
        rows = rows.crossJoin(F.broadcast(relations.select(F.col("relation").alias("_r")))).select(F.array_append("path", F.col("_r")).alias("path"))
    return rows.withColumn("hash", composition_hash(F.col("path"))).withColumn("bucket", composition_bucket(F.col("path")))


def used_once(path: Column) -> Column:
    """some relation occurs exactly once; single steps are always fit."""
    return (F.size(path) == 1) | F.exists(F.array_distinct(path), lambda r: F.size(F.filter(path, lambda x: x == r)) == 1)


def split_of(bucket: Column) -> Column:
    """The split of a bucket."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in BUCKETS.items():
        out = F.when(bucket.between(lo, hi), name).otherwise(out)
    return out


def split_plan(relations: DataFrame, lengths: list[int], per_split: dict[str, int]) -> DataFrame:
    """(split, length, place, path, bucket): of each split and length the fit compositions of lowest hash, up to its count."""
    rows = functools.reduce(DataFrame.unionByName, (compositions(relations, n).filter(used_once(F.col("path"))) for n in lengths))
    rows = rows.withColumn("split", split_of(F.col("bucket"))).withColumn("length", F.size("path").cast("long"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("split", "length").orderBy("hash")).cast("long"))
    most = F.create_map(*[x for k, n in per_split.items() for x in (F.lit(k), F.lit(n))])
    return rows.filter(F.col("place") <= most[F.col("split")]).select("split", "length", "place", "path", "bucket")


def shared_values(axes: DataFrame) -> DataFrame:
    """(axis, value, splits) of values that several splits have, from one long table (axis, split, value); none if disjoint. One shuffle for all axes."""
    return axes.groupBy("axis", "value").agg(F.array_sort(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)


def id_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side only, as often as they are missing, with their side."""
    left = a.exceptAll(b).withColumn("side", F.lit("missing"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both registries have."""
    return a.intersect(b)


def matrix_gaps(observed: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Cells of the cartesian product of the dimensions that aren't observed."""
    return expected_matrix(observed.sparkSession, dims).exceptAll(observed.select(*dims).distinct())


def expected_matrix(spark, dims: dict[str, list]) -> DataFrame:
    """The cells of a run matrix, exploded from one row: the dimensions are short lists."""
    cells = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in dims.items()])
    for name in dims:
        cells = cells.withColumn(name, F.explode(name))
    return cells


def conflicting_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids whose repeats differ in content; equal repeats count once."""
    return rows.dropDuplicates().groupBy(key).agg(F.count("*").alias("contents")).filter("contents > 1")


def seeded_order(key: Column, seed: str) -> Column:
    """The hash by which values are ordered."""
    return sha(seed, "\0", key)


def capped(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of lowest seeded hash, in the order of their key."""
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n).orderBy(key)


def floor_split(rows: DataFrame, group: list[str], key: str, num: int, den: int, seed: str) -> DataFrame:
    """Of each group the first floor(n * num / den) rows by seeded hash are ``train``, the others ``held``.

    Groups may be large: instead of ranking them whole, sizes and rows of each hash
    bucket are counted first, and only rows of a group's bucket are ranked together.
    """
    from .schedule import offsets

    rows = rows.withColumn("_h", leading(seeded_order(F.col(key), seed), 15)).withColumn("_one", F.lit(1))
    sizes = rows.groupBy(*group).agg((F.expr(f"count(*) * {num} div {den}")).alias("_cut"))
    placed = offsets(rows, ["_h", key], "_one", "_before", group).join(sizes, group)
    return placed.withColumn("split", F.when(F.col("_before") < F.col("_cut"), "train").otherwise("held")).drop("_h", "_one", "_before", "_cut")


def partners(rows: DataFrame, group: list[str], key: str, seed: str) -> DataFrame:
    """Each row with the row of its group that has its rank by seeded hash: a permutation within the group."""
    natural, hashed = Window.partitionBy(*group).orderBy(key), Window.partitionBy(*group).orderBy(seeded_order(F.col(key), seed), key)
    a = rows.select(*group, key, F.row_number().over(natural).alias("_n"))
    b = rows.select(*group, F.col(key).alias("partner"), F.row_number().over(hashed).alias("_n"))
    return a.join(b, [*group, "_n"]).drop("_n")


def reservoir(rows: DataFrame, strata: list[str], key: str, seed: str, n: int) -> DataFrame:
    """(place, strata, key): strata take turns, each giving its rows by seeded hash; the first n turns."""
    w = Window.partitionBy(*strata).orderBy(seeded_order(F.col(key), seed), key)
    ranked = rows.select(*strata, key).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    place = F.row_number().over(Window.orderBy("_r", *strata))
    return ranked.orderBy("_r", *strata).limit(n).withColumn("place", place.cast("long")).drop("_r")


def first_accepted(rows: DataFrame, family: str, order: str, n: int) -> DataFrame:
    """Of each family the first n accepted rows in their order; rows are already the accepted ones."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(family).orderBy(order)).cast("long")).filter(F.col("place") <= n)


def exact_split(rows: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """(key, split): exactly ``size`` rows of lowest seeded hash are ``test``."""
    test = rows.orderBy(seeded_order(F.col(key), seed), key).limit(size).select(key, F.lit("test").alias("split"))
    return rows.join(test, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def reserved(rows: DataFrame, ordinal: str, text: str, count: int) -> DataFrame:
    """rows with ``split``: the first ``count`` are held out, later ones are training unless their text is held out; those exact repeats are dropped."""
    held = rows.filter(F.col(ordinal) < count)
    rest = rows.filter(F.col(ordinal) >= count).join(held.select(text).distinct(), text, "left_anti")
    return held.withColumn("split", F.lit("held")).unionByName(rest.withColumn("split", F.lit("train")))


def excluded(rows: DataFrame, protected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't protected."""
    return rows.join(protected.select(*keys).distinct(), keys, "left_anti")


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, width: int) -> DataFrame:
    """Rows whose value lies in a range [lo, hi), with the range's columns: an equi-join by bucket of ``width``, every range being listed in the buckets it meets."""
    listed = ranges.withColumn("_b", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    return rows.withColumn("_b", F.expr(f"{value} div {width}")).join(listed, "_b").filter((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))).drop("_b")


def clean_rows(rows: DataFrame, fields: list[str], key: Column, order: str) -> DataFrame:
    """F8: stripped fields, rows with an empty one dropped, the first of each normalized key kept."""
    trimmed = rows.select(order, *[F.trim(F.regexp_replace(f, r"(?U)^\s+|\s+$", "")).alias(f) for f in fields])
    whole = trimmed.filter(functools.reduce(lambda a, b: a & b, (F.coalesce(F.col(f) != "", F.lit(False)) for f in fields)))
    return whole.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(order))).filter("_n = 1").drop("_n", "_k")


def reconcile_catalog(catalog: DataFrame, candidates: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, problem): candidates that are unexpected, repeated or disagree, and catalogued records that are missing."""
    own = candidates.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*content)).alias("_c"))
    rows = catalog.select(key, F.struct(*content).alias("_want"), F.lit(True).alias("_in")).join(own, key, "full_outer")
    problem = F.when(F.col("_in").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").when(~F.col("_want").eqNullSafe(F.col("_c")), "disagreement")
    return rows.select(key, problem.alias("problem")).filter("problem is not null")


def broken_links(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no parent has."""
    return rows.join(parents.select(*keys).distinct(), keys, "left_anti")


def reference_modes(records: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, control, mask, records) of rows' references to records (qid, control, record), whose modes (1, 2) must make up 3; records that no row names have mask 0."""
    named = rows.groupBy("qid", "control").agg(F.bit_or("mode").alias("mask"))
    own = records.groupBy("qid", "control").agg(F.count("*").alias("records"))
    return own.join(named, ["qid", "control"], "full_outer").select("qid", "control", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"), F.coalesce("records", F.lit(0)).alias("records")).filter("mask <> 3 or records = 0")


def locality(controls: DataFrame, baseline: DataFrame) -> DataFrame:
    """Controls joined to their baseline by (mode, qid), each with whether it holds: a relevant edit must move the prediction to its oracle, an irrelevant one must leave it."""
    b = baseline.select("mode", "qid", F.col("prediction").alias("_base"))
    rows = controls.join(b, ["mode", "qid"], "full_outer")
    held = F.when(F.col("relevant"), (F.col("prediction") == F.col("oracle")) & (F.col("oracle") != F.col("_base"))).otherwise(F.col("prediction") == F.col("_base"))
    return rows.withColumn("covered", F.col("_base").isNotNull() & F.col("prediction").isNotNull()).withColumn("holds", F.coalesce(held, F.lit(False))).drop("_base")


def same_value_pairs(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, other): for each row the smallest other row whose ``b`` is its ``a``. Only the two smallest of each value are kept to join, so that a common value isn't squared."""
    w = Window.partitionBy(b).orderBy(key)
    least = rows.select(F.col(b).alias("_v"), F.col(key).alias("other"), F.row_number().over(w).alias("_n")).filter("_n <= 2")
    joined = rows.join(least, F.col(a) == F.col("_v")).filter(F.col("other") != F.col(key))
    return joined.groupBy(key).agg(F.min("other").alias("other"))


def distractors(facts: DataFrame, kind: str, value: str, key: str, n: int) -> DataFrame:
    """(key, value, choices): n other values of a fact's kind: the kind's distinct values in order, without its own, from the key's place on, around the end. Values of a kind are gathered once."""
    pool = facts.select(kind, value).distinct().groupBy(kind).agg(F.array_sort(F.collect_list(value)).alias("_pool"))
    rows = facts.join(pool, kind).withColumn("_o", F.array_remove("_pool", F.col(value))).filter(F.size("_o") >= n)
    at = F.pmod(F.col(key), F.size("_o"))
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(F.col("_o"), (F.pmod(at + i, F.size("_o")) + 1).cast("int")))
    return rows.select(key, value, picked.alias("choices"))
