"""Functional addresses and multi-hop paths over them, with every candidate accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import chosen, root_key, sha

MAX_HOPS, MAX_ROOTS = 6, 10_000
REASONS = ("missing_hop", "ambiguous_address", "repeated_address", "no_counterfactual_alternative")


def address_stats(triples: DataFrame) -> DataFrame:
    """A3: (subject, relation, n, sole): distinct objects of each address, and the object where there is one."""
    edges = triples.select("subject", "relation", "object").distinct()
    return edges.groupBy("subject", "relation").agg(F.count("*").alias("n"), F.min("object").alias("o")).select("subject", "relation", "n", F.when(F.col("n") == 1, F.col("o")).alias("sole"))


def roots(stats: DataFrame, split: str, limit: int = MAX_ROOTS) -> DataFrame:
    """The unique addresses of lowest hash; Spark plans a top-k without a full sort."""
    keyed = stats.filter("n = 1").select("subject", "relation", root_key(split, F.col("subject"), F.col("relation")).alias("root_key"))
    return keyed.orderBy("root_key", "subject", "relation").limit(limit)


def successors(triples: DataFrame) -> DataFrame:
    """(relation, object, successor): the next object of the relation's domain, around the end; null if it is the only one.

    The distinct objects of one relation are one window's work; relations whose
    domain outgrows a task go through ``successors_ranged``.
    """
    domain = triples.select("relation", "object").distinct()
    w, every = Window.partitionBy("relation").orderBy("object"), Window.partitionBy("relation")
    return domain.withColumn("successor", F.coalesce(F.lead("object").over(w), F.nullif(F.min("object").over(every), F.col("object"))))


def successors_ranged(triples: DataFrame, width: int = 1 << 16) -> DataFrame:
    """W4 for domains of any size: windows over ranges of ``width`` ids, the ends joined to the next range that has objects."""
    domain = triples.select("relation", "object").distinct().withColumn("range", F.floor(F.col("object") / width).cast("long"))
    ends = domain.groupBy("relation", "range").agg(F.min("object").alias("first"))
    by_range, every = Window.partitionBy("relation").orderBy("range"), Window.partitionBy("relation")
    ends = ends.select("relation", "range", F.coalesce(F.lead("first").over(by_range), F.min("first").over(every)).alias("following"))
    inner = Window.partitionBy("relation", "range").orderBy("object")
    return domain.withColumn("n", F.lead("object").over(inner)).join(ends, ["relation", "range"]).select("relation", "object", F.nullif(F.coalesce("n", "following"), F.col("object")).alias("successor"))


def expand(found: DataFrame, stats: DataFrame, order: list[str], hops: int = MAX_HOPS) -> DataFrame:
    """(root_key, root, hop, status, relation, subject, object, path) for each root and hop.

    From a root, the next relation is the cyclic successor of the last in
    ``order``. A hop's status is ``ok`` or why it failed: the address isn't
    there, has several objects, or was visited before; a failed path fails at all
    later hops for the same reason. Each hop is one left join by address.
    """
    ring = F.array(*[F.lit(r) for r in order])
    rows = found.select("root_key", F.col("subject").alias("root"), (F.array_position(ring, F.col("relation")) - 1).alias("at"), F.col("subject").alias("s1"), F.col("relation").alias("r1"))
    addresses = stats.filter(F.col("relation").isin(order))
    seen, status = [], F.lit("ok")
    for h in range(1, hops + 1):
        if h > 1:
            rows = rows.withColumn(f"s{h}", F.col(f"o{h - 1}")).withColumn(f"r{h}", F.element_at(ring, ((F.col("at") + h - 1) % len(order) + 1).cast("int")))
        a = addresses.select(F.col("subject").alias(f"s{h}"), F.col("relation").alias(f"r{h}"), F.col("n").alias(f"n{h}"), F.col("sole").alias(f"o{h}"))
        rows = rows.join(a, [f"s{h}", f"r{h}"], "left")
        again = F.lit(False)
        for s, r in seen:
            again |= (F.col(s) == F.col(f"s{h}")) & (F.col(r) == F.col(f"r{h}"))
        own = F.when(F.col(f"n{h}").isNull(), "missing_hop").when(F.col(f"n{h}") > 1, "ambiguous_address").when(F.coalesce(again, F.lit(False)), "repeated_address").otherwise("ok")
        before = F.col(f"x{h - 1}") if h > 1 else status
        rows = rows.withColumn(f"x{h}", F.when(before != "ok", before).otherwise(own)).withColumn(f"o{h}", F.when(F.col(f"x{h}") == "ok", F.col(f"o{h}")))
        seen.append((f"s{h}", f"r{h}"))
    each = []
    for h in range(1, hops + 1):
        path = F.array(*[F.struct(F.col(f"s{k}").alias("subject"), F.col(f"r{k}").alias("relation"), F.col(f"o{k}").alias("object")) for k in range(1, h + 1)])
        ok = F.col(f"x{h}") == "ok"
        each.append(F.struct(F.lit(h).cast("long").alias("hop"), F.col(f"x{h}").alias("status"), F.when(ok, F.col(f"r{h}")).alias("relation"), F.when(ok, F.col(f"o{h}")).alias("object"), F.when(ok, path).alias("path")))
    return rows.select("root_key", "root", F.col("r1").alias("root_relation"), F.explode(F.array(*each)).alias("p")).select("root_key", "root", "root_relation", "p.*")


def with_alternatives(hops: DataFrame, successor: DataFrame) -> DataFrame:
    """Each surviving hop with the alternative endpoint; without one the hop is excluded, but not the hops after it."""
    s = successor.select(F.col("relation"), F.col("object"), F.col("successor").alias("alternative"))
    rows = hops.join(s, ["relation", "object"], "left")
    return rows.withColumn("status", F.when((F.col("status") == "ok") & F.col("alternative").isNull(), "no_counterfactual_alternative").otherwise(F.col("status")))


def accounting(hops: DataFrame, unique: int, limit: int = MAX_ROOTS, max_hops: int = MAX_HOPS) -> DataFrame:
    """A5: (hop, candidates, surviving, and a count for each reason): candidates = surviving + all exclusions, at every hop.

    ``selection_bound`` counts the unique addresses beyond the limit of roots.
    """
    beyond = max(0, unique - limit)
    rows = hops.groupBy("hop").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("surviving"), *[F.count_if(F.col("status") == r).alias(r) for r in REASONS])
    return rows.select("hop", (F.col("n") + beyond).alias("candidates"), "surviving", *REASONS, F.lit(beyond).cast("long").alias("selection_bound"))


def exclusion_ledger(stats: DataFrame, hops: DataFrame, selected: list[str]) -> DataFrame:
    """(stage, reason, relation, hop, n): grouped counts of addresses that several objects or the selection exclude, and of hops by reason."""
    null_r, null_h = F.lit(None).cast("string"), F.lit(None).cast("long")
    several = stats.filter("n > 1").groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("address").alias("stage"), F.lit("ambiguous_address").alias("reason"), "relation", null_h.alias("hop"), "n")
    unselected = stats.filter(~F.col("relation").isin(selected)).groupBy("relation").agg(F.count("*").alias("n")).select(F.lit("relation").alias("stage"), F.lit("relation_not_selected").alias("reason"), "relation", null_h.alias("hop"), "n")
    failed = hops.filter("status <> 'ok'").groupBy("hop", "status").agg(F.count("*").alias("n")).select(F.lit("path").alias("stage"), F.col("status").alias("reason"), null_r.alias("relation"), "hop", "n")
    return several.unionByName(unselected).unionByName(failed)


def unselected_addresses(stats: DataFrame, found: DataFrame) -> DataFrame:
    """Unique addresses that aren't roots."""
    return stats.filter("n = 1").join(found.select("subject", "relation"), ["subject", "relation"], "left_anti")


def candidate_key(split: str, path) -> object:
    """the hash of a split and a path's addresses."""
    return sha(split, "\0", F.array_join(F.transform(path, lambda p: F.concat_ws(":", p["subject"].cast("string"), p["relation"])), "\0"))


def twin_items(surviving: DataFrame, split: str, alias_counts: dict[str, int]) -> DataFrame:
    """Four items for each surviving path: its endpoint to be found, and to be compared, on the original and on the changed last row.

    Which endpoint the comparison names goes by the last hex digit of the path's
    key; which alias names a hop goes by its hash (F31).
    """
    n = F.create_map(*[x for r, c in alias_counts.items() for x in (F.lit(r), F.lit(c))])
    key = F.col("candidate_key")
    rows = surviving.withColumn("candidate_key", candidate_key(split, F.col("path")))
    choices = F.transform(F.col("path"), lambda p, i: chosen(key, "alias", i.cast("string"), n[p["relation"]]))
    rows = rows.withColumn("alias_choices", choices).withColumn("alias_slice", F.when(F.exists("alias_choices", lambda c: c > 0), "includes_alternate").otherwise("primary_only"))
    equal = F.conv(F.substring(key, 64, 1), 16, 10).cast("int") % 2 == 0
    yes, no = F.when(equal, "yes").otherwise("no"), F.when(equal, "no").otherwise("yes")
    q = lambda c: F.concat(F.lit("Q"), c.cast("string"))
    compared = F.when(equal, F.col("object")).otherwise(F.col("alternative"))

    def item(task: str, variant: str, answer, endpoint, named):
        pair = F.concat(F.lit(f"{split}-"), key, F.lit(f"-{task}"))
        return F.struct(F.concat(pair, F.lit("-" + variant[0])).alias("qid"), pair.alias("pair_id"), F.lit(task).alias("task"), F.lit(variant).alias("variant"), answer.alias("answer"), endpoint.alias("endpoint"), named.alias("compared"))

    none = F.lit(None).cast("long")
    items = F.array(
        item("traversal", "original", q(F.col("object")), F.col("object"), none),
        item("traversal", "counterfactual", q(F.col("alternative")), F.col("alternative"), none),
        item("equality", "original", yes, F.col("object"), compared),
        item("equality", "counterfactual", no, F.col("alternative"), compared),
    )
    return rows.select("root", "hop", "path", "alias_choices", "alias_slice", F.explode(items).alias("i")).select("root", "hop", "path", "alias_choices", "alias_slice", "i.*")


def replay(items: DataFrame, stats: DataFrame) -> DataFrame:
    """The original items whose rows don't follow from the addresses again; none in a sound artifact. Joined afresh, row by row."""
    rows = items.filter("variant = 'original'").select("qid", "endpoint", F.size("path").alias("hops"), F.posexplode("path").alias("k", "p")).select("qid", "endpoint", "hops", "k", "p.subject", "p.relation", "p.object")
    joined = rows.join(stats.select("subject", "relation", "n", "sole"), ["subject", "relation"], "left")
    bad = (F.col("n").isNull()) | (F.col("n") != 1) | (F.col("sole") != F.col("object")) | ((F.col("k") == F.col("hops") - 1) & (F.col("object") != F.col("endpoint")))
    return joined.filter(bad).select("qid").distinct()


def published_rows(surviving: DataFrame) -> DataFrame:
    """The rows that paths use, once for each address."""
    return surviving.select(F.explode("path").alias("p")).select("p.*").dropDuplicates(["subject", "relation"])
