"""Key-value stores as tables: lookups, overlays, derangements, remaps and the control views of an evaluation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha

KEY = ["source", "relation"]
CONTROLS = ("shuffled_returns", "relevant_edge", "irrelevant_edge", "gold_path", "gold_returns", "no_query", "explicit_miss", "entity_remap", "store_off", "deleted_rows", "identity")


def lookup(queries: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    """Queries with ``hit`` and the store's columns, null where it has none; keys of a store are unique. A join by key takes the place of a packed hash index."""
    return queries.join(store.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def lookup_counts(found: DataFrame) -> DataFrame:
    """(lookups, hits, misses)."""
    return found.agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def overlay(base: DataFrame, patch: DataFrame, key: list[str], value: str, deleted: DataFrame | None = None) -> DataFrame:
    """Base with the patch's values in place of its own and the patch's new keys added, without the deleted keys."""
    p = patch.select(*key, F.col(value).alias("_p"), F.lit(True).alias("_in"))
    rows = base.select(*key, value).join(p, key, "full_outer").select(*key, F.when(F.col("_in"), F.col("_p")).otherwise(F.col(value)).alias(value))
    return rows if deleted is None else rows.join(deleted.select(*key).distinct(), key, "left_anti")


def derangement(rows: DataFrame, kind: str, key: str, payload: str, seed: str) -> DataFrame:
    """(kind, key, payload, donor, donated): each row gets another's payload of its kind, never an equal one.

    Rows stand by equal payload, larger groups first, then by hash; the donor is the
    largest group's size further on, around the end. A kind whose largest group is over half of it has no
    derangement: such rows are left out, see ``underivable``.
    """
    w, g = Window.partitionBy(kind), Window.partitionBy(kind, payload)
    sized = rows.select(kind, key, payload).withColumn("_g", F.count("*").over(g)).withColumn("_n", F.count("*").over(w)).withColumn("_max", F.max("_g").over(w))
    order = Window.partitionBy(kind).orderBy(F.desc("_g"), sha(seed, "\0", F.col(payload)), payload, sha(seed, "\0", F.col(key)), key)
    placed = sized.filter("2 * _max <= _n").withColumn("_i", F.row_number().over(order) - 1)
    donors = placed.select(F.col(kind), F.col("_i").alias("_d"), F.col(key).alias("donor"), F.col(payload).alias("donated"))
    return placed.withColumn("_d", F.pmod(F.col("_i") + F.col("_max"), F.col("_n"))).join(donors, [kind, "_d"]).select(kind, key, payload, "donor", "donated")


def underivable(rows: DataFrame, kind: str, payload: str) -> DataFrame:
    """Kinds whose commonest payload is that of over half the rows."""
    sizes = rows.groupBy(kind, payload).agg(F.count("*").alias("g")).groupBy(kind).agg(F.max("g").alias("largest"), F.sum("g").alias("n"))
    return sizes.filter("2 * largest > n")


def bijection(ids: DataFrame, column: str, seed: str) -> DataFrame:
    """(column, mapped): ids permuted by the order of their hash: the k-th smallest becomes the k-th by hash."""
    from .schedule import numbered

    a = numbered(ids.select(column).distinct(), column, out="_k")
    b = numbered(ids.select(F.col(column).alias("mapped")).distinct(), sha(seed, "\0", F.col("mapped")), "mapped", out="_k")
    return a.join(b, "_k").select(column, "mapped")


def remapped(store: DataFrame, mapping: DataFrame, is_entity: Column) -> DataFrame:
    """A store (source, relation, target) whose sources and entity targets are mapped; other targets stay."""
    m = mapping.select(F.col(mapping.columns[0]).alias("_from"), F.col("mapped").alias("_to"))
    rows = store.withColumn("_e", is_entity).join(m, F.col("source") == F.col("_from")).withColumn("source", F.col("_to")).drop("_from", "_to")
    rows = rows.join(m, F.col("_e") & (F.col("target") == F.col("_from")), "left")
    return rows.select("source", "relation", F.coalesce("_to", "target").alias("target"))


def control_views(store: DataFrame, gold: DataFrame, seed: str) -> DataFrame:
    """(control, source, relation, target) of each control's store view, from one store and the items' gold rows (source, relation).

    Returns shuffled, one relevant or irrelevant row edited, gold rows only,
    rows deleted, entities renamed, or nothing at all; controls that force
    actions or drop queries read the store as it is.
    """
    own = store.select("source", "relation", "target")
    used = gold.select(*KEY).distinct()
    on, off = own.join(used, KEY, "left_semi"), own.join(used, KEY, "left_anti")
    pick = lambda df: df.orderBy(sha(seed, "\0", F.col("source"), "\0", F.col("relation")), "source", "relation").limit(1)
    edited = lambda df: overlay(own, pick(df).withColumn("target", F.col("target") + 1), KEY, "target")
    shuffled = derangement(own.withColumn("_k", F.concat_ws("|", F.col("source").cast("string"), "relation")), "relation", "_k", "target", seed)
    shuffled = shuffled.select(F.split("_k", r"\|")[0].cast("long").alias("source"), "relation", F.col("donated").alias("target"))
    missing = pick(on)
    names = bijection(own.select(F.col("source").alias("id")), "id", seed)
    views = {
        "shuffled_returns": shuffled, "relevant_edge": edited(on), "irrelevant_edge": edited(off), "gold_path": on, "gold_returns": on, "no_query": own,
        "explicit_miss": own.join(missing, KEY, "left_anti"), "entity_remap": remapped(own, names, F.lit(False)), "store_off": own.filter("false"), "deleted_rows": off, "identity": own,
    }
    return functools.reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("control"), *KEY, "target") for c, df in views.items()))


def run_plans(plans: DataFrame, store: DataFrame, hops: int = 6) -> DataFrame:
    """(item, slot, misses, reads, halt_step) of action plans (item, start, actions) over a store: reads replace the slot by the row's target, a missing row leaves it and counts; nothing after a halt is read.

    One left join for each step.
    """
    rows = plans.select("item", "start", "actions", F.col("start").alias("slot"), F.lit(0).alias("misses"), F.lit(0).alias("reads"))
    halt = F.nullif(F.array_position("actions", F.lit("halt")), F.lit(0))
    for k in range(1, hops + 1):
        act = F.try_element_at("actions", F.lit(k))
        reads = F.startswith(act, F.lit("read:")) & (halt.isNull() | (halt > k))
        rows = rows.withColumn("_r", F.when(F.coalesce(reads, F.lit(False)), F.substring(act, F.lit(6), F.length(act))))
        s = store.select(F.col("source").alias("_s"), F.col("relation").alias("_rel"), F.col("target").alias("_t"))
        rows = rows.join(s, (F.col("slot") == F.col("_s")) & (F.col("_r") == F.col("_rel")), "left")
        miss = F.col("_r").isNotNull() & F.col("_t").isNull()
        rows = rows.select("item", "start", "actions", F.coalesce("_t", "slot").alias("slot"), (F.col("misses") + miss.cast("int")).alias("misses"), (F.col("reads") + F.col("_r").isNotNull().cast("int")).alias("reads"))
    return rows.select("item", "slot", F.col("misses").cast("long").alias("misses"), F.col("reads").cast("long").alias("reads"), halt.cast("long").alias("halt_step"))


def edit_rates(probes: DataFrame, store: DataFrame, patch: DataFrame) -> DataFrame:
    """(edited, n, success): with a patch laid over a store, whether edited keys give their new value and all others their old one."""
    new = overlay(store, patch, KEY, "target").withColumnRenamed("target", "_new")
    old = store.withColumnRenamed("target", "_old")
    p = patch.select(*KEY, F.col("target").alias("_p"))
    rows = probes.join(new, KEY, "left").join(old, KEY, "left").join(p, KEY, "left")
    good = F.when(F.col("_p").isNotNull(), F.col("_new") == F.col("_p")).otherwise(F.col("_new").eqNullSafe(F.col("_old")))
    return rows.groupBy(F.col("_p").isNotNull().alias("edited")).agg(F.count("*").alias("n"), F.count_if(good).alias("success"))
