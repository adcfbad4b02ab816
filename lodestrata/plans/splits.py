"""Phase 7: splits, samples, set checks and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit
from ..operators import splits as op
from . import schedule
from .base import EVAL_ROWS, LANES, TRIPLES, eval_rows, lanes, read, triples, with_
from .metrics import FULL, _full

RELATIONS = ["P1", "P2", "P3", "P4"]
PER_SPLIT = {"train": 12, "development": 3, "held_out": 3}
SEED = "s1"


def _relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in RELATIONS], "relation string")


def _powers() -> str:
    r = "r AS (SELECT unnest(['P1','P2','P3','P4']) AS a)"
    one, two, three = "SELECT [a] AS path FROM r", "SELECT [x.a, y.a] FROM r x, r y", "SELECT [x.a, y.a, z.a] FROM r x, r y, r z"
    j = """'["' || array_to_string(path, '","') || '"]'"""
    return f"""{r}, paths AS ({one} UNION ALL {two} UNION ALL {three}), hashed AS (SELECT path, sha256({j}) AS hash, CAST('0x' || substr(sha256({j}), 1, 8) AS BIGINT) % 100 AS bucket FROM paths)"""


def composition_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29, G17."""
    rows = [op.compositions(_relations(spark), n) for n in (1, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(F.array_join("path", ">").alias("path"), "hash", "bucket")


def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17, F13."""
    return op.split_plan(_relations(spark), [1, 2, 3], PER_SPLIT).withColumn("path", F.array_join("path", ">"))


def disjointness_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that several splits of documents share, on three axes."""
    split = F.when(F.col("doc_id") % 10 == 0, "held").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    axes = F.array(F.struct(F.lit("text").alias("axis"), F.sha2("text", 256).alias("value")), F.struct(F.lit("id").alias("axis"), F.col("doc_id").cast("string").alias("value")), F.struct(F.lit("source").alias("axis"), F.col("source").alias("value")))
    rows = read(spark, sf_dir, "documents").select(split.alias("split"), F.explode(axes).alias("x")).select("split", "x.axis", "x.value")
    return op.shared_values(rows).withColumn("splits", F.array_join("splits", ","))


def exact_id_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that are good against those that are clean."""
    a = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    b = read(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id")
    return op.id_differences(a, b)


def registry_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and texts that good and other documents share, by axis."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    axes = F.array(F.struct(F.lit("source").alias("axis"), F.col("source").alias("value")), F.struct(F.lit("text").alias("axis"), F.sha2("text", 256).alias("value")))
    side = lambda q: d.filter(F.col("quality") == q).select(F.explode(axes).alias("x")).select("x.axis", "x.value")
    return op.overlap(side(1), side(0))


def matrix_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, task, hop) without rows."""
    return op.matrix_gaps(eval_rows(spark, sf_dir), {"arm": ["dense", "split"], "task": ["en", "de", "fr", "es", "it"], "hop": list(range(1, 7))})


def conflicting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with several suppliers."""
    return op.conflicting_ids(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey")


def composite_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, then conversations, as one ordered stream."""
    base = read(spark, sf_dir, "benchmark").select(F.lit(0).cast("long").alias("segment"), F.col("item_id").alias("pos"), F.sha2("text", 256).alias("hash"))
    more = read(spark, sf_dir, "conversations").select(F.lit(1).cast("long"), F.col("conv_id") * 1000 + F.col("turn"), F.sha2("text", 256))
    from ..operators.schedule import numbered

    return numbered(base.union(more), "segment", "pos").select("sequence", "segment", "hash")


def relation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 % of each nation's customers, by hash."""
    return op.floor_split(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 80, 100, SEED)


def substitution_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    return op.partners(read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey", SEED)


def stratified_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return op.reservoir(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", SEED, 200)


def first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty documents of each language without a bar."""
    rows = read(spark, sf_dir, "documents").filter(~F.contains("text", F.lit("|"))).select("lang", "doc_id")
    return op.first_accepted(rows, "lang", "doc_id", 20)


def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12."""
    return op.exact_split(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 300, SEED)


def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, T7."""
    return op.capped(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", 100, SEED)


def reserved_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    return op.reserved(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 200).select("doc_id", "split")


def overlap_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of line items without those that were sent back in bulk."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    protected = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 49").select("l_partkey")
    return op.excluded(items, protected, ["l_partkey"]).groupBy("l_partkey").agg(F.count("*").alias("n"))


def reserved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as handles inside protected ranges of ids, by text; texts name customers by their keys."""
    text = F.concat(F.lit("see Q"), F.col("c_custkey").cast("string"), F.lit(" and Q"), (F.col("c_custkey") * 7).cast("string"), F.lit("x Q12"))
    ids = read(spark, sf_dir, "customer").select("c_custkey", F.explode(tx.reserved_handles(text)).alias("id"))
    ranges = spark.createDataFrame([(10, 40, "a"), (900, 1100, "b"), (1090, 1300, "c")], "lo long, hi long, range string")
    return op.in_ranges(ids, "id", ranges, 64).select("c_custkey", "id", "range")


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: parts by brand and type, blank or repeated ones dropped."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("subj"), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_type")).alias("obj"))
    return op.clean_rows(rows, ["subj", "obj"], tx.store_key(F.concat_ws("|", "subj", "obj")), "p_partkey")


def accepted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns that are trimmed, hold no mark, and are short enough; NFC holds for all texts of the tables."""
    t = read(spark, sf_dir, "conversations")
    ok = (tx.nfc(F.col("text")) == F.col("text")) & ~F.contains("text", F.lit("<|")) & (F.trim("text") == F.col("text")) & (F.length("text") <= 400)
    return t.groupBy("role").agg(F.count("*").alias("examined"), F.count_if(ok).alias("accepted"))


def emittable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers whose key some span of their prompt makes, and the coverage."""
    s = read(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 8 == 0, F.lit("somebody")).otherwise(F.col("s_name"))
    prompt = F.concat(F.lit("Where is ("), name, F.lit(")'s nation?"))
    rows = s.select("s_suppkey", "s_name", tx.allowed_spans(prompt).alias("spans"))
    gold = tx.store_key(F.concat_ws(", ", "s_name", F.lit("nation")))
    hit = F.exists("spans", lambda x: tx.store_key(F.concat_ws(", ", x, F.lit("nation"))) == gold)
    return rows.agg(F.count("*").alias("items"), F.count_if(hit).alias("reachable"))


def catalog_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against candidates that lack Spanish ones, repeat short French ones, miscount long ones and have German ones under new names besides."""
    cat = lanes(spark, sf_dir).select("record_id", "lane", "token_length", "ordinal")
    cand = cat.filter("lane <> 'es'").withColumn("token_length", F.when(F.col("token_length") > 1000, -1).otherwise(F.col("token_length")))
    extra = cat.filter("lane = 'fr' and token_length <= 1000").union(cat.filter("lane = 'de'").withColumn("record_id", F.concat(F.lit("new"), "record_id")))
    return op.reconcile_catalog(cat, cand.union(extra), "record_id", ["lane", "token_length"])


def schedule_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled records without metadata, and metadata that isn't scheduled."""
    plan = schedule.relative_schedule(spark, sf_dir).select("record_id")
    meta = lanes(spark, sf_dir).filter("lane <> 'es'").select("record_id")
    a = op.broken_links(plan, meta, ["record_id"]).agg(F.count("*").alias("without_metadata"))
    return a.crossJoin(op.broken_links(meta, plan, ["record_id"]).agg(F.count("*").alias("not_scheduled")))


def reference_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    rows = eval_rows(spark, sf_dir).filter("correct = 1").select("qid", F.col("task").alias("control"), F.when(F.col("arm") == "dense", 1).otherwise(2).alias("mode"))
    records = eval_rows(spark, sf_dir).filter("arm = 'split' and variant = 'original'").select("qid", F.col("task").alias("control"))
    return op.reference_modes(records, rows)


def locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of suppliers' nations, every third one relevant."""
    s = read(spark, sf_dir, "supplier")
    base = s.select(F.lit("on").alias("mode"), F.col("s_suppkey").alias("qid"), F.col("s_nationkey").cast("string").alias("prediction"))
    relevant = F.col("s_suppkey") % 3 == 0
    new = (F.col("s_nationkey") + 1).cast("string")
    said = F.when(relevant & (F.col("s_suppkey") % 5 != 0), new).when(~relevant & (F.col("s_suppkey") % 7 == 0), new).otherwise(F.col("s_nationkey").cast("string"))
    controls = s.filter("s_acctbal >= 0").select(F.lit("on").alias("mode"), F.col("s_suppkey").alias("qid"), said.alias("prediction"), new.alias("oracle"), relevant.alias("relevant"))
    return op.locality(controls, base).groupBy(F.coalesce("relevant", F.lit(False)).alias("relevant")).agg(F.count("*").alias("n"), F.count_if("covered").alias("covered"), F.count_if("holds").alias("holds"))


def fact_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that line items name and the catalogue of small parts lacks."""
    facts = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return op.broken_links(facts, read(spark, sf_dir, "part").filter("p_size <= 40"), ["p_partkey"]).groupBy("p_partkey").agg(F.count("*").alias("uses"))


def policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted keys looked up in a store, whose values are compared with the answers, by outcome."""
    s = read(spark, sf_dir, "supplier")
    store = s.filter("s_acctbal >= 0").select(tx.store_key(F.col("s_name")).alias("key"), F.col("s_nationkey").alias("value"))
    said = s.select(F.when(F.col("s_suppkey") % 4 == 0, F.lit("Nobody")).otherwise(F.upper("s_name")).alias("k"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("answer"))
    rows = said.join(store, tx.store_key(F.col("k")) == F.col("key"), "left")
    outcome = F.when(F.col("key").isNull(), "miss").when(F.col("value") == F.col("answer"), "hit_right").otherwise("hit_wrong")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def same_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer whose balance's digit is another's nation's."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("now"), F.col("c_nationkey").cast("long").alias("born"))
    return op.same_value_pairs(rows, "c_custkey", "now", "born")


def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J29."""
    rows = op.distractors(read(spark, sf_dir, "nation").select("n_regionkey", "n_name", F.col("n_nationkey").cast("long").alias("n_nationkey")), "n_regionkey", "n_name", "n_nationkey", 3)
    return rows.select("n_nationkey", "n_name", F.array_join("choices", "|").alias("choices"))


def wrong_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: rows of the evaluation that break the rules of their fields; lookups below hits were planted."""
    rows = _full(spark, sf_dir).withColumn("hits", F.when(F.col("qid") % 29 == 0, F.col("lookups") + 1).otherwise(F.col("hits")))
    rules = {"correct is 0 or 1": F.col("correct").isin(0, 1), "hits within lookups": F.col("hits").between(0, F.col("lookups")), "halt step": F.col("halt_step").isNull() | F.col("halt_step").between(1, 6)}
    return audit.wrong_rows(rows.filter("arm = 'dense'"), "qid", rules)


def broken_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    return audit.broken_pairs(eval_rows(spark, sf_dir), ["arm"], ["task", "world"])


def trace_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action plans of paths of one to six relations, with planted faults."""
    from ..functions.codecs import action_plan

    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), (F.col("id") % 6 + 1)), lambda i: F.concat(F.lit("P"), i.cast("string"))).alias("r"))
    plan = action_plan(F.col("r"))
    bad = F.when(F.col("id") % 10 == 3, F.concat(F.array(F.lit("halt")), F.slice(plan, 1, 5))).when(F.col("id") % 10 == 5, F.transform(plan, lambda a: F.when(a == "halt", "noop").otherwise(a))).otherwise(plan)
    return audit.trace_errors(rows.withColumn("a", bad), "id", "a")


def unordered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that don't come after the one before them, by type, once every 97th is moved back."""
    rows = read(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 97 == 0, F.col("event_id") - 40).otherwise(F.col("event_id")).alias("source_index"))
    return audit.unordered(rows, ["event_type"], "event_id", "source_index").select("event_type", "event_id")


def repeated_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9."""
    return audit.repeated_addresses(triples(spark, sf_dir), ["subject", "relation"])


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each supplier, whose types go by its key, and links that break in some."""
    kinds = ["planned", "preflight_passed", "launch_requested", "started", "completed"]
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.posexplode(F.array(*[F.lit(k) for k in kinds])).alias("seq", "type"))
    rows = rows.withColumn("seq", F.col("seq").cast("long")).withColumn("type", F.when((F.col("run") % 9 == 0) & (F.col("seq") == 2), "resumed").otherwise(F.col("type")))
    own = lambda k: F.max(F.when(F.col("seq") == k, F.col("type"))).over(Window.partitionBy("run"))
    h = F.lit(None).cast("string")
    hashes = []
    for k in range(5):
        h = audit.event_hash(h, F.col("run"), F.lit(k), F.col(f"t{k}"))
        hashes.append(h)
    for k in range(5):
        rows = rows.withColumn(f"t{k}", own(k))
    chain = F.array(*hashes)
    rows = rows.withColumn("hash", F.element_at(chain, (F.col("seq") + 1).cast("int"))).withColumn("previous", F.when(F.col("seq") > 0, F.element_at(chain, F.greatest(F.lit(1), F.col("seq").cast("int")))))
    return rows.withColumn("hash", F.when((F.col("run") % 13 == 0) & (F.col("seq") == 3), F.reverse("hash")).otherwise(F.col("hash"))).select("run", "seq", "type", "previous", "hash")


def ledger_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    return audit.ledger_errors(_ledger(spark, sf_dir))


def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' events by time."""
    return audit.ledger_summary(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", ["click", "error", "purchase"])


QUERIES = {f.__name__: f for f in (composition_buckets, split_plan, disjointness_axes, exact_id_differences, registry_overlap, matrix_gaps, conflicting_ids, composite_stream, relation_split, substitution_partners, stratified_reservoir, first_accepted, exact_split, capped_rows, reserved_text, overlap_exclusion, reserved_values, clean_rows, accepted_items, emittable_keys, catalog_reconcile, schedule_links, reference_modes, locality, fact_membership, policy_replay, same_value_pairs, distractors, wrong_rows, broken_pairs, trace_errors, unordered_entries, repeated_addresses, ledger_errors, ledger_summary)}

_ONCE = "len(path) = 1 OR len(list_filter(list_distinct(path), lambda r: len(list_filter(path, lambda x: x = r)) = 1)) > 0"
_H = f"sha256('{SEED}' || chr(0) || {{}})"
ORACLES = {
    "composition_buckets": "WITH " + _powers() + " SELECT array_to_string(path, '>') AS path, hash, bucket FROM hashed",
    "split_plan": "WITH " + _powers() + f", s AS (SELECT *, len(path)::BIGINT AS length, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'development' ELSE 'held_out' END AS split FROM hashed WHERE {_ONCE}) SELECT split, length, place, array_to_string(path, '>') AS path, bucket FROM (SELECT *, row_number() OVER (PARTITION BY split, length ORDER BY hash) AS place FROM s) WHERE place <= CASE split WHEN 'train' THEN 12 ELSE 3 END",
    "disjointness_axes": """WITH a AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'held' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split, unnest(['text','id','source']) AS axis, unnest([sha256(text), doc_id::VARCHAR, source]) AS value FROM documents)
      SELECT axis, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM a GROUP BY ALL HAVING count(DISTINCT split) > 1""",
    "exact_id_differences": "SELECT doc_id, 'missing' AS side FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id, 'extra' FROM labels WHERE quality <> 1 AND toxic = 0",
    "registry_overlap": "WITH r AS (SELECT quality, unnest(['source', 'text']) AS axis, unnest([source, sha256(text)]) AS value FROM documents JOIN labels USING (doc_id)) SELECT DISTINCT axis, value FROM r a WHERE quality = 1 AND EXISTS (FROM r b WHERE b.quality = 0 AND b.axis = a.axis AND b.value = a.value)",
    "matrix_gaps": with_(EVAL_ROWS) + "SELECT arm, task, hop::BIGINT AS hop FROM (SELECT unnest(['dense','split']) AS arm), (SELECT unnest(['en','de','fr','es','it']) AS task), range(1, 7) t(hop) EXCEPT SELECT arm, task, hop FROM eval_rows",
    "conflicting_ids": "SELECT l_partkey, count(DISTINCT l_suppkey) AS contents FROM lineitem GROUP BY 1 HAVING contents > 1",
    "composite_stream": "SELECT row_number() OVER (ORDER BY segment, pos) - 1 AS sequence, segment, hash FROM (SELECT 0::BIGINT AS segment, item_id AS pos, sha256(text) AS hash FROM benchmark UNION ALL SELECT 1, conv_id * 1000 + turn, sha256(text) FROM conversations)",
    "relation_split": f"SELECT c_nationkey, c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY substr({_H.format('c_custkey')}, 1, 15), c_custkey) <= count(*) OVER (PARTITION BY c_nationkey) * 80 // 100 THEN 'train' ELSE 'held' END AS split FROM customer",
    "substitution_partners": f"SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS partner FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) a JOIN (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_H.format('s_suppkey')}, s_suppkey) AS n FROM supplier) b ON a.s_nationkey = b.s_nationkey AND a.n = b.n",
    "stratified_reservoir": f"SELECT c_mktsegment, c_custkey, row_number() OVER (ORDER BY r, c_mktsegment) AS place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_H.format('c_custkey')}, c_custkey) AS r FROM customer) ORDER BY place LIMIT 200",
    "first_accepted": "SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents WHERE NOT contains(text, '|')) WHERE place <= 20",
    "exact_split": f"SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY {_H.format('p_partkey')}, p_partkey) <= 300 THEN 'test' ELSE 'train' END AS split FROM part",
    "capped_rows": f"SELECT p_partkey, p_brand FROM part ORDER BY {_H.format('p_partkey')}, p_partkey LIMIT 100",
    "reserved_text": "SELECT doc_id, CASE WHEN doc_id < 200 THEN 'held' ELSE 'train' END AS split FROM documents WHERE doc_id < 200 OR text NOT IN (SELECT text FROM documents WHERE doc_id < 200)",
    "overlap_exclusion": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49) GROUP BY 1",
    "reserved_values": "SELECT c_custkey, id, range FROM (SELECT c_custkey, unnest([c_custkey, 12]) AS id FROM customer) JOIN (VALUES (10, 40, 'a'), (900, 1100, 'b'), (1090, 1300, 'c')) r(lo, hi, range) ON id >= lo AND id < hi",
    "clean_rows": "SELECT p_partkey, subj, obj FROM (SELECT p_partkey, p_brand AS subj, p_type AS obj, row_number() OVER (PARTITION BY lower(p_brand), lower(p_type) ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 9 <> 0) WHERE n = 1",
    "accepted_items": "SELECT role, count(*) AS examined, count(*) FILTER (NOT contains(text, '<|') AND trim(text) = text AND length(text) <= 400 AND nfc_normalize(text) = text) AS accepted FROM conversations GROUP BY role",
    "emittable_keys": "SELECT count(*) AS items, count(*) FILTER (s_suppkey % 8 <> 0) AS reachable FROM supplier",
    "catalog_reconcile": with_(LANES) + "SELECT record_id, CASE WHEN lane = 'es' THEN 'missing' WHEN token_length > 1000 THEN 'disagreement' ELSE 'duplicate' END AS problem FROM lanes WHERE lane = 'es' OR token_length > 1000 OR lane = 'fr' UNION ALL SELECT 'new' || record_id, 'unexpected' FROM lanes WHERE lane = 'de'",
    "schedule_links": "WITH s AS (" + schedule.ORACLES["relative_schedule"] + ") SELECT (SELECT count(*) FROM s WHERE lane = 'es') AS without_metadata, (SELECT count(*) FROM documents WHERE lang <> 'es' AND 'r' || doc_id NOT IN (SELECT record_id FROM s)) AS not_scheduled",
    "reference_modes": with_(EVAL_ROWS) + "SELECT qid, task AS control, (q + 2 * t)::BIGINT AS mask, CASE WHEN variant = 'original' THEN 1 ELSE 0 END::BIGINT AS records FROM eval_base WHERE (q + t > 0 OR variant = 'original') AND (q + t < 2 OR variant <> 'original')",
    "locality": "WITH c AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AND s_acctbal >= 0 AS relevant, s_acctbal >= 0 AS covered, CASE WHEN s_acctbal < 0 THEN false WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 <> 0 ELSE s_suppkey % 7 <> 0 END AS holds FROM supplier) SELECT relevant, count(*) AS n, count(*) FILTER (covered) AS covered, count(*) FILTER (holds) AS holds FROM c GROUP BY 1",
    "fact_membership": "SELECT l_partkey AS p_partkey, count(*) AS uses FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY 1",
    "policy_replay": "SELECT CASE WHEN s_suppkey % 4 = 0 OR s_acctbal < 0 THEN 'miss' WHEN s_suppkey % 5 = 0 THEN 'hit_wrong' ELSE 'hit_right' END AS outcome, count(*) AS n FROM supplier GROUP BY 1",
    "same_value_pairs": "SELECT a.c_custkey, min(b.c_custkey) AS other FROM customer a JOIN customer b ON a.c_custkey % 40 = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY 1",
    "distractors": """WITH p AS (SELECT n.n_nationkey::BIGINT AS k, n.n_name, list(o.n_name ORDER BY o.n_name) AS o FROM nation n JOIN nation o ON o.n_regionkey = n.n_regionkey AND o.n_name <> n.n_name GROUP BY ALL)
      SELECT k AS n_nationkey, n_name, array_to_string(list_transform(range(0, 3), lambda i: o[(k + i) % len(o) + 1]), '|') AS choices FROM p WHERE len(o) >= 3""",
    "wrong_rows": with_(*FULL) + "SELECT qid, 'hits within lookups' AS rule FROM full_rows WHERE arm = 'dense' AND qid % 29 = 0",
    "broken_pairs": with_(EVAL_ROWS) + """SELECT arm, pair_id, CASE WHEN variants < 2 THEN 'missing_variant' ELSE 'unequal_fields' END AS problem FROM (SELECT arm, pair_id, count(DISTINCT variant) AS variants, count(DISTINCT task) AS t, count(DISTINCT world) AS w FROM eval_rows GROUP BY ALL) WHERE variants < 2 OR t > 1 OR w > 1""",
    "trace_errors": "SELECT id, CASE WHEN id % 10 = 3 THEN CASE WHEN id % 6 + 1 <= 4 THEN 'several_halts' ELSE 'action_after_halt' END ELSE 'noop_without_halt' END AS problem FROM range(60) t(id) WHERE id % 10 = 3 OR (id % 10 = 5 AND id % 6 <> 5)",
    "unordered_entries": "SELECT event_type, event_id FROM (SELECT event_type, event_id, v, lag(v) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN event_id - 40 ELSE event_id END AS v FROM events)) WHERE v <= p",
    "repeated_addresses": with_(TRIPLES) + "SELECT subject, relation, count(*) AS n FROM triples GROUP BY ALL HAVING n > 1",
    "ledger_errors": """SELECT s_suppkey AS run, 2::BIGINT AS seq, 'transition' AS problem FROM supplier WHERE s_suppkey % 9 = 0
      UNION ALL SELECT s_suppkey, 3, 'hash' FROM supplier WHERE s_suppkey % 13 = 0 UNION ALL SELECT s_suppkey, 4, 'link' FROM supplier WHERE s_suppkey % 13 = 0""",
    "ledger_summary": "SELECT user_id, count(*) AS events, arg_max(event_type, event_id) AS status, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, sha256(string_agg(event_type, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY 1",
}
