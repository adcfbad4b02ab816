"""Phase 8: worlds, records and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths
from ..operators import worlds as op
from .base import TRIPLES, read, triples, with_

SEED = 11


def world_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers shared among worlds of 64 and of 97."""
    n = read(spark, sf_dir, "customer").count()
    return op.worlds(spark, n, 64).withColumn("size", F.lit(64).cast("long")).union(op.worlds(spark, n, 97).withColumn("size", F.lit(97).cast("long")))


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relations import relation_stats

    stats = relation_stats(triples(spark, sf_dir)).filter("relation in ('P1', 'P2', 'P6')").withColumn("kind", F.lit("entity"))
    literal = spark.createDataFrame([("L1", "date", 0, 700, 0), ("L2", "quantity", 0, 300, 0), ("L3", "category", 0, 1000, 0)], "relation string, kind string, support long, distinct_subjects long, distinct_objects long")
    return op.schema_world(op.worlds(spark, 400, 64), stats.select(*literal.columns[:1], "support", "distinct_subjects", "distinct_objects", "kind").unionByName(literal), SEED)


def schema_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, G11, F35, F38."""
    return _world(spark, sf_dir)


def followed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From orders to regions."""
    facts = triples(spark, sf_dir).select(F.col("subject").alias("source"), "relation", F.col("object").alias("target"))
    starts = read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 8 + 3).alias("start"))
    return op.follow(starts, facts, ["P3", "P1", "P2"]).groupBy("end").agg(F.count("*").alias("starts"))


def oracle_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compositions of orders' line numbers, and the order of two dates."""
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("long")).alias("v"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("b"))
    return o.groupBy(op.composition_answer(F.col("v")).alias("answer"), op.date_order(F.col("b"), F.col("a")).alias("earlier")).agg(F.count("*").alias("n"))


def value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation next to each other with different, and with the same, segment."""
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    a = op.unequal_pairs(c, "c_nationkey", "c_custkey", "c_mktsegment").withColumn("kind", F.lit("unequal"))
    b = op.equal_pairs(c, "c_nationkey", "c_custkey", "c_mktsegment").select("c_nationkey", "a", "b", F.lit("equal").alias("kind"))
    return a.unionByName(b)


def value_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    return op.value_groups(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_mktsegment").select("c_nationkey", "c_mktsegment", "members", "first", "second")


def interleaved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of documents, seven, two and one in turn."""
    rows = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 < 7, "peripheral").when(F.col("doc_id") % 10 < 9, "central").otherwise("rule").alias("kind"), "doc_id")
    return op.interleaved(rows, "kind", "doc_id", {"peripheral": 7, "central": 2, "rule": 1})


def prefix_free_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of four neighbouring parts' brands and numbers."""
    p = read(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 4").alias("item")).agg(F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 3 == 0, F.substring("p_brand", 1, 7)).otherwise(F.col("p_brand")))).alias("choices"))
    return p.select("item", op.prefix_free(F.col("choices")).alias("prefix_free"))


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers' nations and nations' regions, as they are and changed."""
    t = triples(spark, sf_dir).filter("relation in ('P1', 'P2', 'P3', 'P6')")
    return op.eval_pairs(t.select(F.col("subject").alias("source"), "relation", F.col("object").alias("target")), paths.successors(t))


def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G22."""
    return op.entity_records(spark, 1000, SEED)


def recall_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of all records, and back: what was a row for each attribute is one for each entity again."""
    probes = op.recall_probes(op.entity_records(spark, 1000, SEED))
    return probes.groupBy("id").pivot("attribute", list(op.ATTRIBUTES)).agg(F.first("answer"))


def rendered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their masked characters."""
    rows = op.rendered(op.entity_records(spark, 500, SEED), ["{name} was born in city {birth_city}.", "City {birth_city} is where {name} was born; now {current_city}."])
    masked = F.aggregate(F.filter("segments", lambda s: s["masked"]), F.lit(0), lambda a, s: a + F.length(s["text"]))
    return rows.select("id", "text", masked.cast("long").alias("masked"))


QUERIES = {f.__name__: f for f in (world_sizes, schema_world, followed_paths, oracle_compositions, value_pairs, value_groups, interleaved_records, prefix_free_choices, eval_pairs, entity_records, recall_probes, rendered_records)}


def _pick(attribute: str, size: int) -> str:
    return f"CAST('0x' || substr(sha256('{SEED}' || chr(0) || id || chr(0) || '{attribute}'), 1, 12) AS BIGINT) % {size} AS {attribute}"


_RECORDS = "recs AS (SELECT id, 'Person ' || id || ' ' || substr(sha256('11' || chr(0) || id || chr(0) || 'name'), 1, 6) AS name, " + ", ".join(_pick(a, s) for a, s in op.ATTRIBUTES.items()) + " FROM range({}) r(id))"
_W = "SELECT i AS world, i * {s} AS first, CASE WHEN i < n // {s} - 1 OR n % {s} = 0 THEN {s} WHEN n % {s} >= 16 THEN CASE WHEN i = n // {s} - 1 THEN ({s} + n % {s}) // 2 ELSE {s} + n % {s} - ({s} + n % {s}) // 2 END WHEN i = n // {s} - 1 THEN {s} - 16 + n % {s} ELSE 16 END AS entities, {s}::BIGINT AS size FROM c, range(n // {s} + CASE WHEN n % {s} > 0 THEN 1 ELSE 0 END) r(i)"
ORACLES = {
    "world_sizes": "WITH c AS (SELECT count(*) AS n FROM customer), w AS (" + " UNION ALL ".join(_W.format(s=s) for s in (64, 97)) + ") SELECT world, CAST(coalesce(sum(entities) OVER (PARTITION BY size ORDER BY world ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, entities, size FROM w",
    "followed_paths": with_(TRIPLES) + "SELECT c.object AS \"end\", count(*) AS starts FROM triples a JOIN triples b ON a.object = b.subject AND b.relation = 'P1' JOIN triples c ON b.object = c.subject AND c.relation = 'P2' WHERE a.relation = 'P3' GROUP BY 1",
    "oracle_compositions": "SELECT 'r' || s % 4 AS answer, CASE WHEN b < a THEN 'first' WHEN b > a THEN 'second' ELSE 'same' END AS earlier, count(*) AS n FROM (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem GROUP BY 1) GROUP BY ALL",
    "value_pairs": """SELECT c_nationkey, c_custkey AS a, b, 'unequal' AS kind FROM (SELECT *, lead(c_custkey) OVER w AS b, lead(c_mktsegment) OVER w AS v FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)) WHERE v <> c_mktsegment
      UNION ALL SELECT c_nationkey, c_custkey, b, 'equal' FROM (SELECT *, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS b FROM customer) WHERE b IS NOT NULL""",
    "value_groups": "SELECT c_nationkey, c_mktsegment, count(*) AS members, min(c_custkey) AS first, (list(c_custkey ORDER BY c_custkey))[2] AS second FROM customer GROUP BY ALL HAVING members > 1",
    "interleaved_records": """WITH k AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'peripheral' WHEN doc_id % 10 < 9 THEN 'central' ELSE 'rule' END AS kind FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) - 1 AS n FROM k),
      b AS (SELECT *, n // CASE kind WHEN 'peripheral' THEN 7 WHEN 'central' THEN 2 ELSE 1 END AS b, CASE kind WHEN 'peripheral' THEN 0 WHEN 'central' THEN 1 ELSE 2 END AS o FROM r) SELECT row_number() OVER (ORDER BY b, o, n) - 1 AS sequence, kind, doc_id FROM b""",
    "prefix_free_choices": """WITH g AS (SELECT p_partkey // 4 AS item, list(CASE WHEN p_partkey % 3 = 0 THEN substr(p_brand, 1, 7) ELSE p_brand END) AS c FROM part GROUP BY 1)
      SELECT item, len(list_distinct(c)) = len(c) AND len(list_filter(c, lambda a: len(list_filter(c, lambda b: a <> b AND starts_with(b, a))) > 0)) = 0 AS prefix_free FROM g""",
    "eval_pairs": with_(TRIPLES, "s AS (SELECT relation, object, coalesce(lead(object) OVER (PARTITION BY relation ORDER BY object), nullif(min(object) OVER (PARTITION BY relation), object)) AS n FROM (SELECT DISTINCT relation, object FROM triples WHERE relation IN ('P1','P2','P3','P6')))") + "SELECT subject || '-' || t.relation AS pair_id, variant, subject AS source, t.relation, CASE WHEN variant = 'original' THEN t.object ELSE n END AS answer FROM triples t JOIN s ON s.relation = t.relation AND s.object = t.object, (VALUES ('original'), ('counterfactual')) v(variant) WHERE n IS NOT NULL",
    "entity_records": "WITH " + _RECORDS.format(1000) + " FROM recs",
    "recall_probes": "WITH " + _RECORDS.format(1000) + " SELECT * EXCLUDE name FROM recs",
    "rendered_records": "WITH " + _RECORDS.format(500) + """, t AS (SELECT *, CAST('0x' || substr(sha256('template' || chr(0) || id), 1, 8) AS BIGINT) % 2 = 0 AS one FROM recs)
      SELECT id, CASE WHEN one THEN name || ' was born in city ' || birth_city || '.' ELSE 'City ' || birth_city || ' is where ' || name || ' was born; now ' || current_city || '.' END AS text, CAST(CASE WHEN one THEN length(birth_city::VARCHAR) ELSE length(birth_city::VARCHAR) + length(current_city::VARCHAR) END AS BIGINT) AS masked FROM t""",
}
