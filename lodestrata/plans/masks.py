"""Phase 4: masks over documents. Every group of seven words has a payload of one or two words, a control three words on and an action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks as op
from ..storage import frozen, remove, scratch
from . import schedule
from .base import LANES, lanes, read, with_

SEED = "controls-v1"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(span_id, record, n, role, external, start, end, length, position_bin)."""
    # two numbers a document are kept and dealt evenly; the texts are read once, however often spans are asked for.
    # Their number of partitions is given, else they would be put together by their bytes: each is to become hundreds of spans
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = frozen(lanes(spark, sf_dir).filter("token_length >= 7").select("ordinal", "token_length").repartition(tasks, "ordinal"))
    rows = counted.select(F.col("ordinal").alias("record"), F.col("token_length").alias("n"), F.explode(F.sequence(F.lit(0), F.expr("token_length div 7 - 1"))).alias("k"))
    s, two = F.col("k") * 7, F.col("k") % 2
    parts = F.array(
        F.struct(F.lit("payload").alias("role"), s.alias("start"), (s + 1 + two).alias("end")),
        F.struct(F.lit("random_control").alias("role"), (s + 3).alias("start"), (s + 4 + two).alias("end")),
        F.struct(F.lit("action").alias("role"), (s + 6).alias("start"), (s + 7).alias("end")),
    )
    rows = rows.select("record", "n", "k", F.explode(parts).alias("p")).select("record", "n", "k", "p.*")
    rows = rows.withColumn("span_id", F.concat_ws("-", F.col("record").cast("string"), F.col("start").cast("string"))).withColumn("external", F.col("k") % 3 == 0)
    return op.with_bins(rows).drop("k")


SPANS = (
    LANES,
    """spans AS (SELECT *, e - s AS length, least(9, ((s + e) * 10) // (2 * n)) AS position_bin, record || '-' || s AS span_id FROM (
  SELECT record, n, k % 3 = 0 AS external, role, k * 7 + a AS s, k * 7 + a + 1 + CASE WHEN role = 'action' THEN 0 ELSE k % 2 END AS e
  FROM (SELECT ordinal AS record, token_length AS n, unnest(range(0, token_length // 7)) AS k FROM lanes WHERE token_length >= 7), (VALUES ('payload', 0), ('random_control', 3), ('action', 6)) t(role, a)))""",
)
CONTROLS = f"""controls AS (SELECT * FROM (SELECT s.*, demand, row_number() OVER (PARTITION BY s.length, s.position_bin ORDER BY substr(sha256('{SEED}' || chr(0) || span_id), 1, 15), span_id) AS rn
  FROM spans s JOIN (SELECT length, position_bin, count(*) AS demand FROM spans WHERE role = 'payload' GROUP BY ALL) d ON s.length = d.length AND s.position_bin = d.position_bin WHERE role = 'random_control') WHERE rn <= demand)"""
RANGES = """ranges AS (SELECT 'split' AS condition, record, s, e FROM spans WHERE role = 'payload' UNION ALL SELECT 'selective', record, s, e FROM spans WHERE role = 'payload' AND external UNION ALL SELECT 'random', record, s, e FROM controls)"""


def _controls(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    return op.matched_controls(spans(spark, sf_dir) if own is None else own, SEED)


def by_record(rows: DataFrame, target: str) -> DataFrame:
    """rows (record, start, ...) as a table written in their records' order and read again: what is grouped by record is then grouped in place."""
    rows.repartition("record").sortWithinPartitions("record", "start").write.parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spans(spark, sf_dir)
    return op.masked_ranges(own, _controls(spark, sf_dir, own))


def mask_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked positions of each record and condition."""
    return op.positions(_ranges(spark, sf_dir)).groupBy("condition", "record").agg(F.count("*").alias("masked"), F.sum("pos").alias("mark"))


def weight_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split weights of all documents."""
    records = lanes(spark, sf_dir).select(F.col("ordinal").alias("record"), F.col("token_length").alias("n"))
    rows = op.weights(records, _ranges(spark, sf_dir), "split")
    return rows.select("record", F.array_join(F.transform("weights", lambda w: w.cast("string")), "").alias("weights"))


def mask_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, W15."""
    return op.histogram(spans(spark, sf_dir), F.col("role") == "payload")


def mask_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return op.deficits(spans(spark, sf_dir))


def record_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys a record itself can't supply."""
    return op.deficits(spans(spark, sf_dir), ["record"])


def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4."""
    return _controls(spark, sf_dir).select("span_id", "record", "length", "position_bin")


def record_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the in-record sample, as a contract of size and strata."""
    return op.matched_controls(spans(spark, sf_dir), SEED, ["record"]).select("span_id", "record", "length", "position_bin")


def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return op.zero_runs(op.positions(_ranges(spark, sf_dir)), ["condition", "record"])


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with orders of each customer, joined where they touch."""
    days = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("start")).distinct()
    ranges = days.withColumn("end", F.col("start") + 1)
    return op.merged(ranges, ["record"])


def run_length_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of each user."""
    return op.run_lengths(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


def range_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound schedule has none; this one's longest records begin one token late."""
    whole = schedule.deficit_schedule(spark, sf_dir)
    late = whole.withColumn("token_start", F.col("token_start") + (F.col("token_length") > 2000).cast("long"))
    return op.gaps(late, "sequence").select("sequence", "token_start")


def _words(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    bare = F.btrim("text", F.lit(" \t\n\r"))
    return read(spark, sf_dir, name).select(F.col(key).alias("record"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\r]+")).alias("tokens"))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of five and of nine words of each benchmark item."""
    rows = _words(spark, sf_dir, "benchmark", "item_id")
    rows = rows.select(F.explode(F.array(F.lit(5), F.lit(9))).alias("k"), "record", "tokens").filter(F.size("tokens") >= F.col("k"))
    runs = F.transform(F.sequence(F.lit(0), F.size("tokens") - F.col("k")), lambda i: F.slice("tokens", i + 1, F.col("k")))
    return rows.select("record", "k", F.posexplode(runs).alias("at", "tokens")).select(((F.col("record") * 1_000_000 + F.col("at")) * 10 + F.col("k")).alias("pattern"), "tokens")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pattern_matches(_words(spark, sf_dir, "documents", "doc_id"), _patterns(spark, sf_dir))


_SPLIT = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '')"
MATCHES = f"""dw AS (SELECT doc_id AS record, {_SPLIT} AS w FROM documents), iw AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
pats AS (SELECT (item_id * 1000000 + i) * 10 + k AS pattern, k, array_to_string(w[i + 1:i + k], ' ') AS p FROM (SELECT item_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM iw, (VALUES (5), (9)) t(k) WHERE len(w) >= k)),
matches AS (SELECT record, i AS s, i + k AS e, pattern FROM (SELECT record, k, i, array_to_string(w[i + 1:i + k], ' ') AS p FROM (SELECT record, w, k, unnest(range(len(w) - k + 1)) AS i FROM dw, (VALUES (5), (9)) t(k) WHERE len(w) >= k)) JOIN pats USING (k, p))"""


def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages within documents."""
    return _matches(spark, sf_dir)


def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches inside, and not inside, spans of 64 words from every 80th word on."""
    tagged = lanes(spark, sf_dir).filter("token_length > 0").select(F.col("ordinal").alias("record"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(token_length - 1) div 80"))).alias("k")).select("record", (F.col("k") * 80).alias("start"), (F.col("k") * 80 + 64).alias("end"))
    m = _matches(spark, sf_dir)
    return op.contained(m, tagged).withColumn("inside", F.lit(True)).unionByName(op.uncontained(m, tagged).withColumn("inside", F.lit(False)))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("lang", F.explode(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("text"))
    return rows.select(F.col("lang").alias("fact"), F.lit("object").alias("field"), "text")


PAYLOADS = f"payloads AS (SELECT lang AS fact, 'object' AS field, unnest({_SPLIT}) AS text FROM documents)"


def payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a payload of its language."""
    return op.payload_counts(_payloads(spark, sf_dir))


def payload_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct payloads of each language."""
    return op.inventory(_payloads(spark, sf_dir)).groupBy("fact", "field").agg(F.count("*").alias("payloads"), F.max("text").alias("last_text"))


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External payloads that the split condition doesn't mask, and masked ones that aren't external, by side."""
    s = spans(spark, sf_dir)
    expected = s.filter("role = 'payload' and external").select("record", "start", "end")
    masked = _ranges(spark, sf_dir).filter("condition = 'split'").select("record", "start", "end")
    return op.coverage_gaps(expected, masked, ["record"]).groupBy("side").agg(F.count("*").alias("n"))


def sidecar_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of the weight sidecars, with the violations that these controls and matches have."""
    s = spans(spark, sf_dir)
    kept = scratch(spark, "controls")
    try:
        c = by_record(_controls(spark, sf_dir, s).select("record", "start", "end", "length", "position_bin"), kept)
        return frozen(op.audit(s, c, op.positions(op.masked_ranges(s, c)), _matches(spark, sf_dir)))
    finally:
        remove(spark, kept)


def balanced_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search, held against plain code in the tests."""
    return op.balanced_padding(spans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (mask_positions, weight_arrays, mask_histogram, mask_deficits, record_deficits, matched_controls, record_controls, zero_runs, merged_ranges, run_length_spans, range_gaps, pattern_matches, span_containment, payload_counts, payload_inventory, split_coverage, sidecar_audit, balanced_padding)}

_DEF = "SELECT {0}length, position_bin, demand, supply, demand - supply AS deficit FROM (SELECT {0}length, position_bin, count(*) FILTER (role = 'payload') AS demand, count(*) FILTER (role = 'random_control') AS supply FROM spans GROUP BY ALL) WHERE demand > supply"
_RUNS = "SELECT condition, record, min(pos) AS start, max(pos) + 1 AS \"end\" FROM (SELECT condition, record, pos, pos - row_number() OVER (PARTITION BY condition, record ORDER BY pos) AS i FROM (SELECT DISTINCT condition, record, unnest(range(s, e)) AS pos FROM ranges)) GROUP BY condition, record, i"
_TAGGED = "tagged AS (SELECT ordinal AS record, unnest(range(0, (token_length - 1) // 80 + 1)) * 80 AS ts FROM lanes WHERE token_length > 0)"
ORACLES = {
    "mask_positions": with_(*SPANS, CONTROLS, RANGES) + "SELECT condition, record, count(*) AS masked, CAST(sum(pos) AS BIGINT) AS mark FROM (SELECT condition, record, unnest(range(s, e)) AS pos FROM ranges) GROUP BY ALL",
    "weight_arrays": with_(*SPANS) + """SELECT ordinal AS record, array_to_string(list_transform(range(0, token_length), lambda i: CASE WHEN i // 7 < token_length // 7 AND (i % 7 = 0 OR (i % 7 = 1 AND i // 7 % 2 = 1)) THEN 0 ELSE 1 END), '') AS weights FROM lanes""",
    "mask_histogram": with_(*SPANS) + "SELECT length, position_bin, count(*) AS n FROM spans WHERE role = 'payload' GROUP BY ALL",
    "mask_deficits": with_(*SPANS) + _DEF.format(""),
    "record_deficits": with_(*SPANS) + _DEF.format("record, "),
    "matched_controls": with_(*SPANS, CONTROLS) + "SELECT span_id, record, length, position_bin FROM controls",
    "record_controls": with_(*SPANS) + f"""SELECT span_id, record, length, position_bin FROM (SELECT s.*, demand, row_number() OVER (PARTITION BY s.record, s.length, s.position_bin ORDER BY substr(sha256('{SEED}' || chr(0) || span_id), 1, 15), span_id) AS rn
      FROM spans s JOIN (SELECT record, length, position_bin, count(*) AS demand FROM spans WHERE role = 'payload' GROUP BY ALL) d ON s.record = d.record AND s.length = d.length AND s.position_bin = d.position_bin WHERE role = 'random_control') WHERE rn <= demand""",
    "zero_runs": with_(*SPANS, CONTROLS, RANGES) + _RUNS,
    "merged_ranges": """WITH d AS (SELECT DISTINCT o_custkey AS record, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders) SELECT record, min(s) AS start, max(s) + 1 AS "end" FROM (SELECT record, s, s - row_number() OVER (PARTITION BY record ORDER BY s) AS i FROM d) GROUP BY record, i""",
    "run_length_spans": """SELECT user_id, run, event_type, CAST(min(p) AS BIGINT) AS start, count(*) AS length FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY p) AS BIGINT) AS run FROM (
      SELECT user_id, event_type, row_number() OVER w - 1 AS p, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, run, event_type""",
    "range_gaps": "WITH s AS (" + schedule.ORACLES["deficit_schedule"] + ") SELECT sequence, token_start + 1 AS token_start FROM s WHERE token_length > 2000",
    "pattern_matches": with_(MATCHES) + 'SELECT record, s AS start, e AS "end", pattern FROM matches',
    "span_containment": with_(LANES, MATCHES, _TAGGED) + 'SELECT record, s AS start, e AS "end", pattern, EXISTS (FROM tagged t WHERE t.record = m.record AND ts <= s AND e <= ts + 64) AS inside FROM matches m',
    "payload_counts": with_(PAYLOADS) + "SELECT fact, field, text, count(*) AS n FROM payloads GROUP BY ALL",
    "payload_inventory": with_(PAYLOADS) + "SELECT fact, field, count(DISTINCT text) AS payloads, max(text) AS last_text FROM payloads GROUP BY ALL",
    "split_coverage": with_(*SPANS) + "SELECT 'unexpected' AS side, count(*) AS n FROM spans WHERE role = 'payload' AND NOT external HAVING n > 0",
    "sidecar_audit": with_(*SPANS, CONTROLS, MATCHES) + """SELECT unnest(['zero_runs','random_histogram','protected_roles','untagged_payloads','overlapping_spans']) AS "check", unnest([0,
      (SELECT count(*) FROM ((SELECT length, position_bin, count(*) AS n FROM spans WHERE role = 'payload' GROUP BY ALL) EXCEPT ALL (SELECT length, position_bin, count(*) FROM controls GROUP BY ALL))) +
      (SELECT count(*) FROM ((SELECT length, position_bin, count(*) AS n FROM controls GROUP BY ALL) EXCEPT ALL (SELECT length, position_bin, count(*) FROM spans WHERE role = 'payload' GROUP BY ALL))),
      0, (SELECT count(*) FROM matches m WHERE NOT EXISTS (FROM spans x WHERE role = 'payload' AND x.record = m.record AND x.s <= m.s AND m.e <= x.e)), 0]) AS violations""",
}
