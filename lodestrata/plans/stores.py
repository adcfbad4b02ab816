"""Phase 9: stores and controls over the suppliers' nations and the nations' regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stores as op
from .base import TRIPLES, read, triples, with_

SEED = "c1"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).filter("relation in ('P1', 'P2', 'P6')").select(F.col("subject").alias("source"), "relation", F.col("object").alias("target"))


STORE = "store AS (SELECT subject AS source, relation, object AS target FROM triples WHERE relation IN ('P1','P2','P6'))"


def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-supplier rows ask for their supplier's nation; a few ask for more suppliers than there are."""
    q = read(spark, sf_dir, "lineitem").select(((F.col("l_suppkey") + F.col("l_linenumber")) * 8 + 5).alias("source"), F.lit("P6").alias("relation"))
    return op.lookup_counts(op.lookup(q, _store(spark, sf_dir), ["source", "relation"]))


def _patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(99_999_995, "P6", 1)], "source long, relation string, target long")
    return _store(spark, sf_dir).filter("relation = 'P6'").withColumn("target", F.col("target") + 8).unionByName(new)


def store_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    s = _store(spark, sf_dir)
    return op.overlay(s, _patch(spark, sf_dir), ["source", "relation"], "target", s.filter("relation = 'P2'"))


def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation swap segments."""
    return op.derangement(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_mktsegment", SEED)


def underivable_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of nations that one market segment rules; by the orders' status."""
    return op.underivable(read(spark, sf_dir, "orders").withColumn("s", F.when(F.col("o_custkey") % 5 == 0, "x").otherwise(F.col("o_orderstatus"))), "o_orderpriority", "s")


def entity_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the store's sources and targets permuted."""
    s = _store(spark, sf_dir)
    ids = s.select(F.col("source").alias("id")).union(s.select("target")).distinct()
    return op.remapped(s, op.bijection(ids, "id", SEED), F.col("relation") == "P6")


def control_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and mark of each view."""
    s = _store(spark, sf_dir)
    gold = s.filter("relation = 'P6'").select("source", "relation")
    views = op.control_views(s, gold, SEED)
    return views.groupBy("control").agg(F.count("*").alias("n"), F.sum("target").alias("targets"), F.sum(F.pmod(F.col("source"), F.lit(10007))).alias("sources"))


def run_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From suppliers to regions, some asking once too often, some halting early."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_suppkey") * 8 + 5).alias("start"))
    plan = F.when(F.col("item") % 4 == 0, F.array(*[F.lit(x) for x in ("read:P6", "read:P2", "read:P2", "halt", "noop", "noop")])).when(F.col("item") % 4 == 1, F.array(*[F.lit(x) for x in ("read:P6", "halt", "read:P2", "noop", "noop", "noop")])).otherwise(F.array(*[F.lit(x) for x in ("read:P6", "read:P2", "noop", "noop", "noop", "noop")]))
    return op.run_plans(s.withColumn("actions", plan), _store(spark, sf_dir))


def edit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24."""
    s = _store(spark, sf_dir)
    return op.edit_rates(s.select("source", "relation"), s, _patch(spark, sf_dir).filter("source < 99999995"))


def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one nation's world."""
    return read(spark, sf_dir, "customer").filter("c_nationkey = 7").select("c_custkey", "c_mktsegment")


QUERIES = {f.__name__: f for f in (store_lookup, store_overlay, derangement, underivable_kinds, entity_remap, control_views, run_plans, edit_rates, provenance_rows)}

_SH = f"sha256('{SEED}' || chr(0) || {{}})"
_VIEW = "SELECT '{0}' AS control, count(*) AS n, CAST(sum(target) AS BIGINT) AS targets, CAST(sum(source % 10007) AS BIGINT) AS sources FROM {1}"
_PICK = f"SELECT source, relation FROM {{}} ORDER BY sha256('{SEED}' || chr(0) || source || chr(0) || relation), source, relation LIMIT 1"
ORACLES = {
    "store_lookup": with_(TRIPLES, STORE) + "SELECT count(*) AS lookups, count(s.source) AS hits, count(*) - count(s.source) AS misses FROM lineitem LEFT JOIN store s ON s.source = (l_suppkey + l_linenumber) * 8 + 5 AND s.relation = 'P6'",
    "store_overlay": with_(TRIPLES, STORE) + "SELECT source, relation, CASE WHEN relation = 'P6' THEN target + 8 ELSE target END AS target FROM store WHERE relation <> 'P2' UNION ALL SELECT 99999995, 'P6', 1",
    "derangement": f"""WITH s AS (SELECT c_nationkey, c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS g, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), m AS (SELECT *, max(g) OVER (PARTITION BY c_nationkey) AS mx FROM s),
      p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY g DESC, {_SH.format('c_mktsegment')}, c_mktsegment, {_SH.format('c_custkey')}, c_custkey) - 1 AS i FROM m WHERE 2 * mx <= n)
      SELECT a.c_nationkey, a.c_custkey, a.c_mktsegment, b.c_custkey AS donor, b.c_mktsegment AS donated FROM p a JOIN p b ON a.c_nationkey = b.c_nationkey AND b.i = (a.i + a.mx) % a.n""",
    "underivable_kinds": "WITH o AS (SELECT o_orderpriority, CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS s, count(*) AS g FROM orders GROUP BY ALL) SELECT o_orderpriority, max(g) AS largest, CAST(sum(g) AS BIGINT) AS n FROM o GROUP BY 1 HAVING 2 * max(g) > sum(g)",
    "entity_remap": with_(TRIPLES, STORE, "ids AS (SELECT source AS id FROM store UNION SELECT target FROM store)", f"m AS (SELECT a.id, b.id AS mapped FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM ids) a JOIN (SELECT id, row_number() OVER (ORDER BY {_SH.format('id')}, id) AS k FROM ids) b USING (k))") + "SELECT a.mapped AS source, relation, CASE WHEN relation = 'P6' THEN b.mapped ELSE target END AS target FROM store JOIN m a ON a.id = source JOIN m b ON b.id = target",
    "control_views": with_(TRIPLES, STORE, "gold AS (SELECT * FROM store WHERE relation = 'P6')", "rest AS (SELECT * FROM store WHERE relation <> 'P6')", f"g1 AS ({_PICK.format('gold')})", f"r1 AS ({_PICK.format('rest')})",
        "ids AS (SELECT DISTINCT source AS id FROM store)", "sz AS (SELECT relation, max(g) AS mx, sum(g) AS n FROM (SELECT relation, target, count(*) AS g FROM store GROUP BY ALL) GROUP BY relation)")
        + " UNION ALL ".join([*(_VIEW.format(c, "store") for c in ("no_query", "identity", "entity_remap")), *(_VIEW.format(c, "gold") for c in ("gold_path", "gold_returns")), _VIEW.format("deleted_rows", "rest"),
        _VIEW.format("relevant_edge", "(SELECT source, target + CASE WHEN (source, relation) IN (SELECT (source, relation) FROM g1) THEN 1 ELSE 0 END AS target FROM store)"), _VIEW.format("irrelevant_edge", "(SELECT source, target + CASE WHEN (source, relation) IN (SELECT (source, relation) FROM r1) THEN 1 ELSE 0 END AS target FROM store)"),
        _VIEW.format("explicit_miss", "store WHERE (source, relation) NOT IN (SELECT (source, relation) FROM g1)"), _VIEW.format("shuffled_returns", "store WHERE relation IN (SELECT relation FROM sz WHERE 2 * mx <= n)")]),
    "run_plans": with_(TRIPLES, STORE) + """SELECT s_suppkey AS item, CASE WHEN s_suppkey % 4 = 1 THEN a.target ELSE b.target END AS slot, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS misses, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS reads,
      CASE s_suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 END::BIGINT AS halt_step FROM supplier JOIN store a ON a.source = s_suppkey * 8 + 5 AND a.relation = 'P6' JOIN store b ON b.source = a.target AND b.relation = 'P2'""",
    "edit_rates": with_(TRIPLES, STORE) + "SELECT relation = 'P6' AS edited, count(*) AS n, count(*) AS success FROM store GROUP BY 1",
    "provenance_rows": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 7",
}
