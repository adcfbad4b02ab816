"""Metrics over evaluation rows: rates with their populations, slices, pairs, paths, likelihoods and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VARIANTS = ("original", "counterfactual")
#: The z of the rounded and of the exact 95 % interval.
Z_ROUNDED, Z_EXACT = 1.96, 1.959963984540054


def rate(hits: Column, total: Column) -> Column:
    """A rate, null where there is nothing to rate."""
    return F.try_divide(hits.cast("double"), total.cast("double"))


def wilson_parts(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Centre and radius of the Wilson score interval; null for n = 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = k / n, z * z
    denom = 1 + z2 / n
    return (p + z2 / (2 * n)) / denom, z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denom


def wilson_clamped(k: Column, n: Column) -> tuple[Column, Column]:
    """P3 (a): z = 1.96, clamped to [0, 1], (0, 0) for n = 0."""
    c, r = wilson_parts(k, n, Z_ROUNDED)
    # least and greatest skip nulls, so the empty case is told first
    return F.when(n > 0, F.greatest(F.lit(0.0), c - r)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), c + r)).otherwise(0.0)


def wilson_exact(k: Column, n: Column) -> tuple[Column, Column]:
    """P3 (b): the exact z, not clamped; null for n = 0, which the rule calls an error."""
    c, r = wilson_parts(k, n, Z_EXACT)
    return c - r, c + r


def wilson_upper(k: Column, n: Column) -> Column:
    """P3 (c): the upper bound alone, by the exact z."""
    c, r = wilson_parts(k, n, Z_EXACT)
    return c + r


def pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, pair_id, variants, rows, both): a pair is complete with both variants once each; ``both``: all correct."""
    got = rows.groupBy(*by, "pair_id").agg(F.countDistinct("variant").alias("variants"), F.count("*").alias("n"), F.bool_and(F.col("correct") == 1).alias("both"))
    return got.withColumn("complete", (F.col("variants") == 2) & (F.col("n") == 2))


def pair_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, pairs, both_right, accuracy, incomplete): the strict rate over complete pairs, and how many are not."""
    got = pairs(rows, by).groupBy(*by).agg(F.count_if("complete").alias("pairs"), F.count_if(F.col("complete") & F.col("both")).alias("both_right"), F.count_if(~F.col("complete")).alias("incomplete"))
    return got.withColumn("accuracy", rate(F.col("both_right"), F.col("pairs")))


def checkpoint_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows, correct, abstained, malformed, lookups and hits, with accuracy, selective accuracy over the rows not abstained, and hit rate, in one pass."""
    got = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("correct").alias("correct"), F.count_if("abstained").alias("abstained"), F.sum("malformed").alias("malformed"),
        F.sum("lookups").alias("lookups"), F.sum("hits").alias("hits"), F.sum(F.when(~F.col("abstained"), F.col("correct"))).alias("_kept"),
    )
    return got.select(
        *by, "n", "correct", "abstained", "malformed", "lookups", "hits", rate(F.col("correct"), F.col("n")).alias("accuracy"), (F.col("n") - F.col("abstained")).alias("answered"),
        rate(F.col("_kept"), F.col("n") - F.col("abstained")).alias("selective_accuracy"), rate(F.col("hits"), F.col("lookups")).alias("hit_rate"), rate(F.col("abstained"), F.col("n")).alias("abstention_rate"),
    )


def slices(rows: DataFrame, families: list[str], by: list[str]) -> DataFrame:
    """(by, family, key, n, correct, accuracy): every row counts once in each family; one pass and one shuffle."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).cast("string").alias("key")) for f in families])
    long = rows.select(*by, "correct", F.explode(each).alias("s")).select(*by, "correct", "s.family", "s.key")
    got = long.groupBy(*by, "family", "key").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    return got.withColumn("accuracy", rate(F.col("correct"), F.col("n")))


def per_hop(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, hop, gold, right, accuracy): predicted actions against gold by place; a missing one is wrong, null-safe."""
    long = rows.select(*by, "pred", F.posexplode("gold").alias("i", "g"))
    right = F.try_element_at("pred", (F.col("i") + 1).cast("int")).eqNullSafe(F.col("g"))
    got = long.groupBy(*by, (F.col("i") + 1).cast("long").alias("hop")).agg(F.count("*").alias("gold"), F.count_if(right).alias("right"))
    return got.withColumn("accuracy", rate(F.col("right"), F.col("gold")))


def path_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Exact paths, hop accuracy over gold hops, misses over gold hops (A16's divide by attempts), and halting, a path that doesn't halt counting as step 7."""
    shared = F.size(F.filter(F.zip_with("gold", F.slice("pred", F.lit(1), F.size("gold")), lambda g, p: g.eqNullSafe(p)), lambda x: x))
    got = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gold")).alias("exact"), F.sum(F.size("gold")).alias("gold_hops"), F.sum(shared).alias("right_hops"), F.sum("misses").alias("misses"),
        F.sum("attempts").alias("attempts"), F.sum(F.coalesce("halt_step", F.lit(7))).alias("_halts"), F.count("halt_step").alias("halted"),
    )
    r = lambda a, b: rate(F.col(a), F.col(b))
    return got.select(
        *by, "n", "gold_hops", r("exact", "n").alias("full_path_exact"), r("right_hops", "gold_hops").alias("per_hop_accuracy"), r("misses", "gold_hops").alias("miss_rate"),
        r("misses", "attempts").alias("attempt_miss_rate"), r("_halts", "n").alias("mean_halt_step"), r("halted", "n").alias("halt_rate"),
    )


def split_rates(rows: DataFrame, flags: list[str], split: str = "split") -> DataFrame:
    """(split, n, and for each flag its rate and clamped Wilson bounds); the group ``all`` is the rollup's grand total. Empty groups rate 0."""
    got = rows.rollup(split).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), *[F.count_if(f).alias(f"_{f}") for f in flags])
    out = [F.when(F.col("_g") == 1, "all").otherwise(F.col(split)).alias(split), F.col("n")]
    for f in flags:
        lo, hi = wilson_clamped(F.col(f"_{f}"), F.col("n"))
        out += [F.coalesce(rate(F.col(f"_{f}"), F.col("n")), F.lit(0.0)).alias(f"{f}_rate"), lo.alias(f"{f}_lo"), hi.alias(f"{f}_hi")]
    return got.select(*out)


def recall(rows: DataFrame, attribute: str) -> DataFrame:
    """(attribute, n, correct, accuracy), ``overall`` included."""
    got = rows.rollup(attribute).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("correct").alias("correct"))
    return got.select(F.when(F.col("_g") == 1, "overall").otherwise(F.col(attribute)).alias(attribute), "n", "correct", rate(F.col("correct"), F.col("n")).alias("accuracy"))


def bits_in_weights(accuracies: DataFrame, pools: DataFrame, key: str, entities: int) -> DataFrame:
    """One row (bits): the sum over attributes of the share known beyond guessing, times entities, times log2 of the pool."""
    g = 1 / F.col("pool").cast("double")
    share = F.greatest(F.lit(0.0), (F.col("accuracy") - g) / (1 - g))
    return accuracies.join(pools, key).agg(F.sum(share * entities * F.log2(F.col("pool").cast("double"))).alias("bits"))


def composite(rows: DataFrame, by: list[str], task: str = "task") -> DataFrame:
    """The plain mean of the tasks' accuracies."""
    per = rows.groupBy(*by, task).agg(F.avg("correct").alias("a"))
    return per.groupBy(*by).agg(F.avg("a").alias("composite"), F.count("*").alias("tasks"))


def seed_summary(deltas: DataFrame, value: str = "delta") -> DataFrame:
    """Mean, sample deviation (0 for one seed), count, and whether all deltas lie strictly on one side of 0."""
    x = F.col(value)
    same = F.bool_and(x > 0) | F.bool_and(x < 0)
    return deltas.agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("seed_sigma"), same.alias("sign_consistent"), F.count("*").alias("n_seeds"))


def bits_per_byte(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sum of nll / (sum of UTF-8 bytes * ln 2): a ratio of sums, not a mean of ratios."""
    return rows.groupBy(*by).agg(F.sum("nll").alias("_nll"), F.sum(F.octet_length("text")).alias("bytes")).select(*by, "bytes", (F.col("_nll") / (F.col("bytes") * F.log(F.lit(2.0)))).alias("bpb"))


def value_nll(rows: DataFrame, attribute: str) -> DataFrame:
    """Nll per token by attribute and overall, as ratios of sums."""
    got = rows.rollup(attribute).agg(F.grouping_id().alias("_g"), F.sum("nll").alias("_nll"), F.sum("tokens").alias("tokens"))
    return got.select(F.when(F.col("_g") == 1, "overall").otherwise(F.col(attribute)).alias(attribute), "tokens", rate(F.col("_nll"), F.col("tokens")).alias("nll_per_token"))


def continuous_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, mean): missing values are left out, and metrics without any value have no row."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = rows.select(*by, F.explode(each).alias("x")).select(*by, "x.metric", "x.v").filter("v is not null")
    return long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def choice_row(sums: Column, lengths: Column, gold: Column) -> Column:
    """struct(acc, acc_norm, mass): whether the first largest sum, and the first largest mean, is the gold choice; the gold's stable softmax mass."""
    means = F.zip_with(sums, lengths, lambda s, n: s / n)
    first = lambda a: F.array_position(a, F.array_max(a)) - 1
    exps = F.transform(sums, lambda s: F.exp(s - F.array_max(sums)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.struct((first(sums) == gold).cast("long").alias("acc"), (first(means) == gold).cast("long").alias("acc_norm"), (F.element_at(exps, (gold + 1).cast("int")) / total).alias("mass"))


def choice_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """N and the means of acc, acc_norm and mass."""
    scored = rows.withColumn("x", choice_row(F.col("sums"), F.col("lengths"), F.col("gold")))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x.acc").alias("acc"), F.avg("x.acc_norm").alias("acc_norm"), F.avg("x.mass").alias("correct_prob"))


def cohens_d(rows: DataFrame, by: list[str], arm: str, a: str, b: str, value: str, eps: float = 1e-12) -> DataFrame:
    """(mean a - mean b) / (pooled deviation + eps) by group."""
    side = lambda s: F.when(F.col(arm) == s, F.col(value))
    got = rows.groupBy(*by).agg(F.avg(side(a)).alias("ma"), F.avg(side(b)).alias("mb"), F.var_samp(side(a)).alias("va"), F.var_samp(side(b)).alias("vb"))
    return got.select(*by, ((F.col("ma") - F.col("mb")) / (F.sqrt((F.col("va") + F.col("vb")) / 2) + eps)).alias("d"))


def paired_dz(deltas: DataFrame, by: list[str], value: str = "delta") -> DataFrame:
    """Mean / sample deviation of paired differences, null without spread."""
    return deltas.groupBy(*by).agg(rate(F.avg(value), F.nullif(F.stddev_samp(value), F.lit(0.0))).alias("dz"), F.count("*").alias("n"))


def nested_means(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Means of means, from the finest of ``levels`` (outermost first) to one for each value of the first."""
    got, v = rows, value
    for k in range(len(levels), 0, -1):
        got = got.groupBy(*levels[:k]).agg(F.avg(v).alias("mean"))
        v = "mean"
    return got


def macro_exact(rows: DataFrame, dims: list[str], family: str, expected: int) -> DataFrame:
    """Macro accuracy over families by cell, with the cells' families and whether the matrix is complete; sums stay integers until the last division."""
    cells = rows.groupBy(*dims, family).agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    got = cells.groupBy(*dims).agg(F.count("*").alias("families"), F.avg(rate(F.col("k"), F.col("n"))).alias("macro"), F.sum("k").alias("correct"), F.sum("n").alias("n"))
    return got.withColumn("complete", F.col("families") == expected)


def numeric_leaves(rows: DataFrame, key: list[str], json: str, depth: int = 4) -> DataFrame:
    """(key, path, value) of all numbers in nested JSON objects, level by level to ``depth``; booleans are not numbers."""
    todo = rows.select(*key, F.lit("").alias("path"), F.col(json).alias("j"))
    found = None
    for _ in range(depth):
        kids = todo.filter("j like '{%'").select(*key, "path", F.explode(F.from_json("j", "map<string,string>")).alias("k", "v"))
        kids = kids.select(*key, F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "k").alias("path"), F.col("v").alias("j"))
        numbers = kids.filter(F.col("j").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")).select(*key, "path", F.col("j").cast("double").alias("value"))
        found = numbers if found is None else found.unionByName(numbers)
        todo = kids
    return found


def localization(rows: DataFrame, top: int, arms: tuple[str, str]) -> DataFrame:
    """The ``top`` units of the first arm by absolute effect, and the other arm's effect and ratio at the same units."""
    a, b = (rows.filter(F.col("arm") == x).select("unit", F.col("effect").alias(f"effect_{n}")) for x, n in zip(arms, ("a", "b"), strict=True))
    best = a.orderBy(F.desc(F.abs("effect_a")), "unit").limit(top)
    return best.join(b, "unit", "left").withColumn("ratio", F.try_divide(F.abs("effect_b"), F.abs("effect_a")))


def calibrated(facts: DataFrame, grid: list[float], low: float = 0.4, high: float = 0.6, goal: float = 0.5) -> DataFrame:
    """Of a few costs the one whose rate of facts with ``gain`` above it lies within the bounds, nearest to the goal, then the smallest."""
    sums = facts.agg(F.count("*").alias("n"), *[F.count_if(F.col("gain") > c).alias(f"k{i}") for i, c in enumerate(grid)])
    each = F.array(*[F.struct(F.lit(float(c)).alias("cost"), rate(F.col(f"k{i}"), F.col("n")).alias("rate")) for i, c in enumerate(grid)])
    return sums.select(F.explode(each).alias("x")).select("x.*").filter(F.col("rate").between(low, high)).orderBy(F.abs(F.col("rate") - goal), "cost").limit(1)


def fact_costs(items: DataFrame) -> DataFrame:
    """(fact, reads, hop_share) of items' arrays of facts: how often a fact is read, and the places from it to the end."""
    long = items.select(F.size("facts").alias("n"), F.posexplode("facts").alias("i", "fact"))
    return long.groupBy("fact").agg(F.count("*").alias("reads"), F.sum(F.col("n") - F.col("i")).alias("hop_share"))


def route_rates(facts: DataFrame) -> DataFrame:
    """The rate of external facts, of external ones in the tail, and of internal ones in the structure, with their populations."""
    e, t, s = F.col("external"), F.col("tail"), F.col("structure")
    got = facts.agg(F.count("*").alias("facts"), F.count_if(e).alias("_e"), F.count_if(t).alias("tail_facts"), F.count_if(t & e).alias("_t"), F.count_if(s).alias("structure_facts"), F.count_if(s & ~e).alias("_s"))
    return got.select("facts", rate(F.col("_e"), F.col("facts")).alias("route_rate"), "tail_facts", rate(F.col("_t"), F.col("tail_facts")).alias("tail_external"), "structure_facts", rate(F.col("_s"), F.col("structure_facts")).alias("structure_internal"))


def first_crossing(points: DataFrame, threshold: Column, by: list[str], higher: bool = True) -> DataFrame:
    """(by, reached, x_cross, final_value, n_points) of curves (x, y): the first point that meets the threshold, interpolated from the one before; a flat step gives its end, a first point itself."""
    meets = (lambda y: y >= threshold) if higher else (lambda y: y <= threshold)
    w = Window.partitionBy(*by).orderBy("x")
    rows = points.withColumn("_x0", F.lag("x").over(w)).withColumn("_y0", F.lag("y").over(w))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (threshold - F.col("_y0")) / F.nullif(F.col("y") - F.col("_y0"), F.lit(0.0))))
    at = F.when(F.col("_x0").isNull() | (F.col("y") == F.col("_y0")), F.col("x").cast("double")).otherwise(F.col("_x0") + share * (F.col("x") - F.col("_x0")))
    hit = F.min(F.when(meets(F.col("y")), F.struct("x", at.alias("c"))))
    got = rows.groupBy(*by).agg(hit.alias("_h"), F.max_by("y", "x").alias("final_value"), F.count("*").alias("n_points"))
    return got.select(*by, F.col("_h").isNotNull().alias("reached"), F.col("_h.c").alias("x_cross"), "final_value", "n_points")


def aulc_trapezoid(points: DataFrame, by: list[str]) -> DataFrame:
    """The area under a curve by trapezoids, over its width; null for fewer than two points."""
    w = Window.partitionBy(*by).orderBy("x")
    rows = points.withColumn("_a", (F.col("y") + F.lead("y").over(w)) * (F.lead("x").over(w) - F.col("x")) / 2)
    return rows.groupBy(*by).agg(F.try_divide(F.sum("_a"), (F.max("x") - F.min("x")).cast("double")).alias("aulc"))


def aulc_right(points: DataFrame, by: list[str]) -> DataFrame:
    """The area by right steps, over the width: each value counts for the step that ends with it."""
    w = Window.partitionBy(*by).orderBy("x")
    rows = points.withColumn("_a", F.col("y") * (F.col("x") - F.lag("x").over(w)))
    return rows.groupBy(*by).agg(F.try_divide(F.sum("_a"), (F.max("x") - F.min("x")).cast("double")).alias("aulc"))


def milestones(points: DataFrame, by: list[str], at: list[int], threshold: float) -> DataFrame:
    """(by, points, first_x) over exactly the frozen checkpoints ``at``; null where none reaches the threshold."""
    own = points.filter(F.col("x").isin(at))
    return own.groupBy(*by).agg(F.count("*").alias("points"), F.min(F.when(F.col("y") >= threshold, F.col("x"))).alias("first_x"))


def report_sections(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Frames of different columns as one long table (section, keys, metric, value); missing keys are null."""
    out = None
    for name, df in parts.items():
        metrics = [c for c, t in df.dtypes if c not in keys and t in ("bigint", "int", "double", "boolean")]
        each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        have = [F.col(k).cast("string").alias(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys]
        rows = df.select(F.lit(name).alias("section"), *have, F.explode(each).alias("x")).select("section", *keys, "x.metric", "x.value").filter("value is not null")
        out = rows if out is None else out.unionByName(rows)
    return out
