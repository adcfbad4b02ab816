"""Phase 0 and 1: relation statistics, selection and the keyed sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alias_key
from ..operators import relations as rel
from ..operators import sample as smp
from ..operators import schedule
from ..storage import frozen
from .base import ALIASES, NORM, TRIPLES, aliases, read, triples, with_

#: Thresholds of the queries; the operators' defaults suit a graph of millions of entities.
SUPPORT, COUNT, HIGH, LOW, UNTIL = 20, 4, 9, 8, 2


def _catalog(spark: SparkSession) -> DataFrame:
    """Relations with aliases: P6 has none, P8 has no triples."""
    return spark.createDataFrame([(f"P{i}",) for i in (1, 2, 3, 4, 5, 8)], "relation string")


CATALOG = "catalog AS (SELECT unnest(['P1','P2','P3','P4','P5','P8']) AS relation)"
STATS = f"{TRIPLES}, stats AS (SELECT relation, count(*) AS support, count(DISTINCT subject) AS distinct_subjects, count(DISTINCT object) AS distinct_objects FROM triples GROUP BY relation)"
SELECTED = f"""{CATALOG}, selected AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY support DESC, distinct_subjects DESC, CAST(substr(relation, 2) AS BIGINT)) AS rank FROM stats
    WHERE relation IN (FROM catalog) AND support >= {SUPPORT} AND distinct_subjects * 100 >= support * 95) WHERE rank <= {COUNT})"""


def relation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return rel.relation_stats(triples(spark, sf_dir))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.rank_relations(relation_stats(spark, sf_dir), _catalog(spark), SUPPORT, COUNT)


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked relations with their quotas as rows of the plan: COUNT at most, fetched once, not computed in every branch."""
    rows = _selected(spark, sf_dir).withColumn("quota", rel.quota(F.col("rank"), HIGH, LOW, UNTIL))
    return spark.createDataFrame(rows.collect(), rows.schema)


def _names(chosen: DataFrame) -> list[str]:
    return [r["relation"] for r in chosen.collect()]


def select_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, W1, W2."""
    return _selected(spark, sf_dir).withColumn("quota", rel.quota(F.col("rank"), HIGH, LOW, UNTIL))


def relation_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return rel.filter_reasons(relation_stats(spark, sf_dir), _catalog(spark), _selected(spark, sf_dir), SUPPORT)


def relation_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept and dropped triples."""
    names = _names(_chosen(spark, sf_dir))
    return triples(spark, sf_dir).groupBy(F.when(F.col("relation").isin(names), "kept").otherwise("dropped").alias("side")).agg(F.count("*").alias("n"))


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J28."""
    return rel.schema_rows(_catalog(spark), relation_stats(spark, sf_dir))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, U2b, A31."""
    return rel.entity_count(triples(spark, sf_dir))


def canonical_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all relations and subjects by letter (P before Q), then by number; places in two levels, so that no task holds the order."""
    t = triples(spark, sf_dir)
    ids = t.select(F.col("relation").alias("id")).union(t.select(F.concat(F.lit("Q"), F.col("subject").cast("string")))).distinct()
    ids = ids.select("id", F.substring("id", 1, 1).alias("letter"), rel.numeric_id(F.col("id")).alias("number"), F.lit(1).alias("one"))
    of_letter = ids.groupBy("letter").agg(F.count("*").alias("n"))
    low, high = of_letter.select("letter"), of_letter.select(F.col("letter").alias("l"), "n")
    before = low.join(F.broadcast(high), F.col("l") < F.col("letter"), "left").groupBy("letter").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    placed = schedule.offsets(ids, ["number"], "one", "within", ["letter"])
    return placed.join(F.broadcast(before), "letter").select("id", (F.col("before") + F.col("within") + 1).cast("long").alias("place"))


def edge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges of the selected relations, counted."""
    edges = _edges(spark, sf_dir, _chosen(spark, sf_dir))
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.sum(F.pmod(F.col("subject") * 31 + F.col("object"), F.lit(1000003))).alias("mark"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smp.display_labels(aliases(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    return smp.distinct_edges(rel.whitelist(triples(spark, sf_dir), _names(chosen)))


def _keys(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    # distinct edges are read three times: for the labels they need and on both of their ends
    edges = frozen(_edges(spark, sf_dir, chosen))
    return smp.key_eligibility(edges, frozen(smp.needed_labels(_labels(spark, sf_dir), edges)))


EDGES = "edges AS (SELECT DISTINCT relation, subject, object FROM triples WHERE relation IN (SELECT relation FROM selected))"
LABELS = "labels_ AS (SELECT id, raw AS label FROM aliases WHERE ord = 0)"
KEYS = """keys AS (
  SELECT relation, subject, n_values, s.id IS NOT NULL AS subject_labelled, values_labelled, s.id IS NOT NULL AND values_labelled AS eligible
  FROM (SELECT relation, subject, count(*) AS n_values, bool_and(o.id IS NOT NULL) AS values_labelled FROM edges LEFT JOIN labels_ o ON o.id = object GROUP BY relation, subject)
  LEFT JOIN labels_ s ON s.id = subject)"""
TOPK = f"""topk AS (
  SELECT * FROM (SELECT k.relation, subject, sha256('Q' || subject || chr(9) || k.relation) AS key_hash,
    row_number() OVER (PARTITION BY k.relation ORDER BY sha256('Q' || subject || chr(9) || k.relation), subject) AS key_rank,
    CASE WHEN rank <= {UNTIL} THEN {HIGH} ELSE {LOW} END AS quota, rank
  FROM keys k JOIN selected s ON k.relation = s.relation WHERE eligible) WHERE key_rank <= quota)"""
SAMPLE = (STATS, SELECTED, EDGES, ALIASES, LABELS, KEYS, TOPK)


def key_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of the selected relations."""
    return _keys(spark, sf_dir, _chosen(spark, sf_dir))


def _topk(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    return smp.lowest_hashed(_keys(spark, sf_dir, chosen).filter("eligible").select("relation", "subject"), chosen)


def hash_topk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T0."""
    return _topk(spark, sf_dir, _chosen(spark, sf_dir)).select("relation", "subject", "key_hash", "key_rank")


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled keys with their labels; values as text, in order."""
    chosen = _chosen(spark, sf_dir)
    records = smp.sample_records(_topk(spark, sf_dir, chosen), _edges(spark, sf_dir, chosen), _labels(spark, sf_dir))
    return records.select("relation", "subject", "subject_label", "key_rank", F.array_join(F.transform("values", lambda v: F.concat_ws("=", v["id"].cast("string"), v["label"])), "|").alias("values"))


def sample_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the counters of the build in one row, and how many of its rules are broken."""
    t, selected = triples(spark, sf_dir), _chosen(spark, sf_dir)
    edges, keys, topk = _edges(spark, sf_dir, selected), _keys(spark, sf_dir, selected), _topk(spark, sf_dir, selected)
    raw = t.agg(F.count("*").alias("raw"), F.count_if(F.col("relation").isin(_names(selected))).alias("kept"))
    distinct = edges.agg(F.count("*").alias("distinct_edges"))
    of_keys = keys.agg(F.count("*").alias("keys"), F.count_if("eligible").alias("eligible"))
    sampled = topk.agg(F.count("*").alias("sampled"))
    quota = selected.agg(F.sum("quota").alias("quota"))
    row = raw.crossJoin(distinct).crossJoin(of_keys).crossJoin(sampled).crossJoin(quota)
    broken = sum((~c).cast("long") for c in (F.col("kept") <= F.col("raw"), F.col("distinct_edges") <= F.col("kept"), F.col("keys") <= F.col("distinct_edges"), F.col("eligible") <= F.col("keys"), F.col("sampled") <= F.col("eligible"), F.col("sampled") <= F.col("quota")))
    return row.withColumn("broken", broken)


def needed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the edges need, by kind of entity."""
    return smp.needed_labels(_labels(spark, sf_dir), _edges(spark, sf_dir, _chosen(spark, sf_dir))).groupBy((F.col("id") % 8).alias("code")).agg(F.count("*").alias("labels"), F.min("label").alias("first_label"))


def _normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smp.unique_aliases(aliases(spark, sf_dir), alias_key(F.col("raw")))


NORMED = f"normed AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY ord) AS n FROM (SELECT *, {NORM} AS norm FROM aliases)) WHERE n = 1)"


def unique_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases by id and normalized key, counted by kind and order. The names are ASCII, where F1 has an SQL form."""
    return _normed(spark, sf_dir).groupBy((F.col("id") % 8).alias("code"), "ord").agg(F.count("*").alias("n"), F.max("norm").alias("last_norm"))


def ambiguous_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that several ids claim."""
    return smp.ambiguous(_normed(spark, sf_dir))


def canonical_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without them, by kind."""
    return smp.canonical_aliases(_normed(spark, sf_dir)).groupBy((F.col("id") % 8).alias("code")).agg(F.count("*").alias("n"))


def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, F1b."""
    return _labels(spark, sf_dir)


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses (order, part) that line items repeat."""
    return smp.repeated_ids(read(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("id")))


QUERIES = {f.__name__: f for f in (relation_stats, select_relations, relation_filter_counts, relation_whitelist, schema_rows, entity_counts, canonical_id_order, edge_distinct, key_eligibility, hash_topk_sample, sample_records, sample_reconcile, needed_labels, unique_aliases, ambiguous_aliases, canonical_aliases, display_labels, repeated_ids)}

ORACLES = {
    "relation_stats": with_(STATS) + "FROM stats",
    "select_relations": with_(STATS, SELECTED) + f"SELECT *, CAST(CASE WHEN rank <= {UNTIL} THEN {HIGH} ELSE {LOW} END AS BIGINT) AS quota FROM selected",
    "relation_filter_counts": with_(STATS, SELECTED) + f"""SELECT reason, count(relation) AS relations FROM (SELECT unnest(['no_alias','support','functionality','not_selected','selected']) AS reason)
      LEFT JOIN (SELECT relation, CASE WHEN relation NOT IN (FROM catalog) THEN 'no_alias' WHEN support < {SUPPORT} THEN 'support' WHEN distinct_subjects * 100 < support * 95 THEN 'functionality'
        WHEN relation NOT IN (SELECT relation FROM selected) THEN 'not_selected' ELSE 'selected' END AS reason FROM stats) USING (reason) GROUP BY reason""",
    "relation_whitelist": with_(STATS, SELECTED) + "SELECT CASE WHEN relation IN (SELECT relation FROM selected) THEN 'kept' ELSE 'dropped' END AS side, count(*) AS n FROM triples GROUP BY 1",
    "schema_rows": with_(STATS, CATALOG) + """SELECT c.relation, 'entity' AS target_kind, coalesce(support, 0) AS support, coalesce(distinct_subjects, 0) AS distinct_subjects, coalesce(distinct_objects, 0) AS distinct_objects
      FROM catalog c LEFT JOIN stats USING (relation) UNION ALL SELECT 'L' || i, ['date','date','quantity','quantity','category','category','string','string'][i + 1], 0, 0, 0 FROM range(8) t(i)""",
    "entity_counts": with_(TRIPLES) + "SELECT count(*) AS entities, min(id) AS min_id, max(id) AS max_id, (SELECT count(DISTINCT relation) FROM triples) AS relations FROM (SELECT subject AS id FROM triples UNION SELECT object FROM triples)",
    "canonical_id_order": with_(TRIPLES) + "SELECT id, row_number() OVER (ORDER BY substr(id, 1, 1), CAST(substr(id, 2) AS BIGINT)) AS place FROM (SELECT relation AS id FROM triples UNION SELECT 'Q' || subject FROM triples)",
    "edge_distinct": with_(STATS, SELECTED, EDGES) + "SELECT relation, count(*) AS edges, CAST(sum((subject * 31 + object) % 1000003) AS BIGINT) AS mark FROM edges GROUP BY relation",
    "key_eligibility": with_(STATS, SELECTED, EDGES, ALIASES, LABELS, KEYS) + "FROM keys",
    "hash_topk_sample": with_(*SAMPLE) + "SELECT relation, subject, key_hash, key_rank FROM topk",
    "sample_records": with_(*SAMPLE) + """SELECT t.relation, t.subject, s.label AS subject_label, key_rank, string_agg(e.object || '=' || o.label, '|' ORDER BY e.object) AS values
      FROM topk t JOIN edges e USING (relation, subject) JOIN labels_ o ON o.id = e.object JOIN labels_ s ON s.id = t.subject GROUP BY ALL""",
    "sample_reconcile": with_(*SAMPLE) + f"""SELECT (SELECT count(*) FROM triples) AS raw, (SELECT count(*) FROM triples WHERE relation IN (SELECT relation FROM selected)) AS kept, (SELECT count(*) FROM edges) AS distinct_edges,
      (SELECT count(*) FROM keys) AS keys, (SELECT count(*) FROM keys WHERE eligible) AS eligible, (SELECT count(*) FROM topk) AS sampled,
      (SELECT CAST(sum(CASE WHEN rank <= {UNTIL} THEN {HIGH} ELSE {LOW} END) AS BIGINT) FROM selected) AS quota, 0::BIGINT AS broken""",
    "needed_labels": with_(STATS, SELECTED, EDGES, ALIASES, LABELS) + "SELECT id % 8 AS code, count(*) AS labels, min(label) AS first_label FROM labels_ WHERE id IN (SELECT subject FROM edges UNION SELECT object FROM edges) GROUP BY 1",
    "unique_aliases": with_(ALIASES, NORMED) + "SELECT id % 8 AS code, ord, count(*) AS n, max(norm) AS last_norm FROM normed GROUP BY ALL",
    "ambiguous_aliases": with_(ALIASES, NORMED) + "SELECT norm, count(DISTINCT id) AS owners FROM normed GROUP BY norm HAVING owners > 1",
    "canonical_aliases": with_(ALIASES, NORMED) + "SELECT id % 8 AS code, count(*) AS n FROM normed WHERE norm NOT IN (SELECT norm FROM normed GROUP BY norm HAVING count(DISTINCT id) > 1) GROUP BY 1",
    "display_labels": with_(ALIASES) + "SELECT id, raw AS label FROM aliases WHERE ord = 0",
    "repeated_ids": "SELECT l_orderkey || '-' || l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING n > 1",
}
