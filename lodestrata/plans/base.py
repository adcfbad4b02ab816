"""The graph, aliases, lanes and evaluation rows that the queries derive from the test tables, in Spark and as SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


#: (table, key, code): ids are key * 8 + code.
CODES = {"region": 0, "nation": 1, "customer": 2, "orders": 3, "part": 4, "supplier": 5}
_EDGES = (
    ("customer", "c_custkey", 2, "P1", "c_nationkey", 1),
    ("nation", "n_nationkey", 1, "P2", "n_regionkey", 0),
    ("orders", "o_orderkey", 3, "P3", "o_custkey", 2),
    ("lineitem", "l_orderkey", 3, "P4", "l_partkey", 4),
    ("lineitem", "l_partkey", 4, "P5", "l_suppkey", 5),
    ("supplier", "s_suppkey", 5, "P6", "s_nationkey", 1),
)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, relation, object): the foreign keys as a graph; rows may repeat."""
    parts = [
        read(spark, sf_dir, t).select((F.col(a).cast("long") * 8 + ca).alias("subject"), F.lit(r).alias("relation"), (F.col(b).cast("long") * 8 + cb).alias("object"))
        for t, a, ca, r, b, cb in _EDGES
    ]
    return functools.reduce(DataFrame.union, parts)


TRIPLES = "triples AS (" + " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) * 8 + {ca} AS subject, '{r}' AS relation, CAST({b} AS BIGINT) * 8 + {cb} AS object FROM {t}" for t, a, ca, r, b, cb in _EDGES) + ")"

#: (table, key, name, code, which have labels): debtors, the largest parts and pending orders have none.
_NAMES = (("region", "r_regionkey", "r_name", 0, "true"), ("nation", "n_nationkey", "n_name", 1, "true"), ("customer", "c_custkey", "c_name", 2, "c_acctbal >= 0"), ("part", "p_partkey", "p_name", 4, "p_size < 50"), ("supplier", "s_suppkey", "s_name", 5, "s_acctbal >= 0"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, raw): a name, its lower and its upper form for each entity that has a label; orders are named by number."""
    parts = [read(spark, sf_dir, t).filter(has).select((F.col(k).cast("long") * 8 + c).alias("id"), F.col(n).alias("name")) for t, k, n, c, has in _NAMES]
    orders = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select((F.col("o_orderkey") * 8 + 3).alias("id"), F.concat(F.lit("Order  "), F.col("o_orderkey").cast("string")).alias("name"))
    every = functools.reduce(DataFrame.union, [*parts, orders])
    return every.select("id", F.posexplode(F.array("name", F.lower("name"), F.upper("name"))).alias("ord", "raw")).withColumn("ord", F.col("ord").cast("long"))


ALIASES = (
    "names AS ("
    + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) * 8 + {c} AS id, {n} AS name FROM {t} WHERE {has}" for t, k, n, c, has in _NAMES)
    + " UNION ALL SELECT o_orderkey * 8 + 3, 'Order  ' || o_orderkey FROM orders WHERE o_orderstatus <> 'P'),\n"
    "aliases AS (SELECT id, 0::BIGINT AS ord, name AS raw FROM names UNION ALL SELECT id, 1, lower(name) FROM names UNION ALL SELECT id, 2, upper(name) FROM names)"
)
NORM = r"lower(trim(regexp_replace(raw, '\s+', ' ', 'g')))"


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, record_id, lane, token_length): documents as records, their language as lane, their words as tokens."""
    docs = read(spark, sf_dir, "documents")
    # trimmed first, so that no part is empty: without a lambda the count stays in generated code
    bare = F.btrim("text", F.lit(" \t\n\r"))
    words = F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \t\n\r]+"))).cast("long")
    return docs.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.col("lang").alias("lane"), words.alias("token_length"))


LANES = r"lanes AS (SELECT doc_id AS ordinal, 'r' || doc_id AS record_id, lang AS lane, CAST(len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')) AS BIGINT) AS token_length FROM documents)"


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, pair_id, variant, task, world, hop, arm, correct): labelled documents as rows of two arms; even and odd ids are a pair's variants."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    variant = F.when(F.col("doc_id") % 2 == 0, "original").otherwise("counterfactual")
    base = rows.select(F.col("doc_id").alias("qid"), F.floor(F.col("doc_id") / 2).cast("long").alias("pair_id"), variant.alias("variant"), F.col("lang").alias("task"), F.col("source").alias("world"), (F.col("doc_id") % 6 + 1).alias("hop"), F.col("quality").cast("long").alias("q"), (1 - F.col("toxic")).cast("long").alias("t"))
    return base.select("qid", "pair_id", "variant", "task", "world", "hop", F.explode(F.array(F.struct(F.lit("dense").alias("arm"), F.col("q").alias("correct")), F.struct(F.lit("split").alias("arm"), F.col("t").alias("correct")))).alias("x")).select("qid", "pair_id", "variant", "task", "world", "hop", "x.arm", "x.correct")


EVAL_ROWS = """eval_base AS (
  SELECT l.doc_id AS qid, l.doc_id // 2 AS pair_id, CASE WHEN l.doc_id % 2 = 0 THEN 'original' ELSE 'counterfactual' END AS variant,
    d.lang AS task, d.source AS world, l.doc_id % 6 + 1 AS hop, CAST(quality AS BIGINT) AS q, CAST(1 - toxic AS BIGINT) AS t
  FROM labels l JOIN documents d USING (doc_id)
), eval_rows AS (
  SELECT qid, pair_id, variant, task, world, hop, 'dense' AS arm, q AS correct FROM eval_base
  UNION ALL SELECT qid, pair_id, variant, task, world, hop, 'split', t FROM eval_base
)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, x, y): for each event type the day's index and the mean value of all events up to that day."""
    from pyspark.sql import Window

    daily = read(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    first = Window.partitionBy("event_type")
    run = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(F.col("event_type").alias("series"), (F.col("day") - F.min("day").over(first)).alias("x"), F.round(F.sum("s").over(run) / F.sum("n").over(run), 6).alias("y"))


CURVE = """daily AS (
  SELECT event_type, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL
), curve AS (
  SELECT event_type AS series, CAST(day - min(day) OVER (PARTITION BY event_type) AS BIGINT) AS x, round(sum(s) OVER w / sum(n) OVER w, 6) AS y
  FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)
)"""
