"""Phase 10: streams run to their end, sources and sinks as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import alias_key
from ..operators import splits
from ..sources import jsonl, packed, sinks, tsv
from ..streaming import events as ev
from . import schedule
from .base import ALIASES, EVAL_ROWS, LANES, TRIPLES, aliases, eval_rows, lanes, read, triples, with_


def _staged(df: DataFrame, name: str, parts: int = 3) -> str:
    """df as a few files in the shared folder, to be streamed."""
    path = storage.scratch(df.sparkSession, name)
    df.repartition(parts).write.parquet(path)
    return path


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 in complete mode, over events in several files."""
    path = _staged(read(spark, sf_dir, "events").select("event_type", "value", "ts"), "events")
    got = ev.run_to_table(ev.running_metrics(ev.file_stream(spark, path), ["event_type"], "value"), storage.scratch(spark, "metrics"), "complete")
    return got.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs completed over several files, rows repeated."""
    rows = eval_rows(spark, sf_dir).filter("arm = 'split'")
    path = _staged(rows.union(rows.filter("correct = 1")), "rows")
    return ev.run_to_table(ev.completed_pairs(ev.file_stream(spark, path)), storage.scratch(spark, "pairs"))


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty events of suppliers' ledgers, as they come in one file after another by sequence."""
    from .splits import _ledger

    rows = _ledger(spark, sf_dir).select("run", "seq", "type")
    path = _staged(rows, "ledger", 1)
    return ev.run_to_table(ev.checked_ledger(ev.file_stream(spark, path)), storage.scratch(spark, "errors"))


def decoded_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decode-time state machine over users' events: views open a lookup, clicks close it."""
    t = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "close").otherwise("word")
    return ev.decoded_lookups(read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), t.alias("token")), 5)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: daily windows with a watermark; the last ones stay open."""
    path = _staged(read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "events", 1)
    got = ev.run_to_table(ev.windowed_counts(ev.file_stream(spark, path)), storage.scratch(spark, "windows"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions by a gap of six hours."""
    return ev.sessions(read(spark, sf_dir, "events"), "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def tsv_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as tab-separated lines and scanned again."""
    path = storage.scratch(spark, "triples")
    t = triples(spark, sf_dir)
    q = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string"))
    t.select(F.concat_ws("\t", q("subject"), "relation", q("object"))).write.text(path)
    return tsv.read_triples(spark, path)


def tsv_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias lines written and scanned; kept aliases and the last by kind."""
    path = storage.scratch(spark, "aliases")
    a = aliases(spark, sf_dir).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw"))), lambda x: x["raw"]).alias("r"))
    a.select(F.concat_ws("\t", F.concat(F.lit("Q"), F.col("id").cast("string")), F.array_join("r", "\t"))).write.text(path)
    return tsv.read_aliases(spark, path, "Q", alias_key).groupBy((F.col("id") % 8).alias("code")).agg(F.count("*").alias("n"), F.max("norm").alias("last_norm"))


def locked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as JSON lines, locked by size, digest and rows, and read under the lock."""
    path = storage.scratch(spark, "bed")
    read(spark, sf_dir, "benchmark").select("text").write.json(path)
    return jsonl.read_locked_text(spark, path, jsonl.lock(spark, path)).agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.min("text").alias("first"))


def published_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K9: a schedule sealed and replayed."""
    return sinks.seal_schedule(schedule.relative_schedule(spark, sf_dir), storage.scratch(spark, "schedule"))


def package_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation in three representations, and the rows in which those differ."""
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("key")).agg(F.array_sort(F.collect_list("c_name")).alias("values"))
    paths = sinks.render_package(c, storage.scratch(spark, "package"))
    return sinks.package_differences(spark, paths).agg(F.count("*").alias("differences")).crossJoin(spark.read.parquet(paths["pairs"]).agg(F.count("*").alias("pairs")))


def packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written as raw bytes, read again, and cut into windows around the end."""
    from ..operators import schedule as op

    folder = storage.scratch(spark, "bin")
    packed.write_tokens(op.pack(schedule._stream(spark, sf_dir), 1024, 16), folder)
    starts = spark.range(0, 16).select((F.col("id") * 1100).alias("start"))
    rows = packed.windows(packed.read_tokens(spark, f"{folder}/*.bin"), starts, 64)
    return rows.select("start", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


def zipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files in step, one of them shorter."""
    path = storage.scratch(spark, "lines")
    rows = lanes(spark, sf_dir).orderBy("ordinal")
    rows.coalesce(1).select("record_id").write.text(f"{path}/a")
    rows.coalesce(1).filter("lane <> 'es'").select("lane").write.text(f"{path}/b")
    z = jsonl.zipped(jsonl.numbered_lines(spark, f"{path}/a"), jsonl.numbered_lines(spark, f"{path}/b"))
    return z.agg(F.count("*").alias("lines"), F.max("left").alias("last")).crossJoin(jsonl.uneven(z).agg(F.count("*").alias("uneven")))


def published_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One arm's rows, checked and published in order."""
    path = sinks.publish_results(eval_rows(spark, sf_dir).filter("arm = 'dense'"), storage.scratch(spark, "results"))
    return spark.read.parquet(path)


def occurrence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions under which spans are active, by role."""
    from ..operators import masks as mk
    from . import masks

    s = masks.spans(spark, sf_dir)
    chosen = mk.matched_controls(s, masks.SEED).select("span_id", F.lit(True).alias("selected"))
    rows = sinks.occurrence_ledger(s.select("span_id", "role", "length"), s.filter("role = 'payload'").select("span_id"), chosen)
    return rows.groupBy("condition", "role").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))


def rebuilt_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule built on other numbers of partitions, compared row by row."""
    a = schedule.deficit_schedule(spark, sf_dir)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = storage.frozen(schedule.deficit_schedule(spark, sf_dir))
        return splits.id_differences(a, b).agg(F.count("*").alias("differences"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of suppliers and its hash."""
    j = sinks.canonical_json("s_suppkey", "s_name", "s_nationkey")
    return read(spark, sf_dir, "supplier").select(j.alias("j"), F.sha2(j, 256).alias("hash"))


QUERIES = {f.__name__: f for f in (stream_metrics, stream_pairs, stream_ledger, decoded_lookups, stream_windows, user_sessions, tsv_triples, tsv_aliases, locked_text, published_schedule, package_equality, packed_tokens, zipped_lines, published_results, occurrence_ledger, rebuilt_twice, canonical_hashes)}

from . import masks as _masks  # noqa: E402

ORACLES = {
    "stream_metrics": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "stream_pairs": with_(EVAL_ROWS) + "SELECT pair_id, max(CASE WHEN variant = 'original' THEN correct END) AS original, max(CASE WHEN variant = 'counterfactual' THEN correct END) AS counterfactual FROM eval_rows WHERE arm = 'split' GROUP BY 1 HAVING count(DISTINCT variant) = 2",
    "stream_ledger": "SELECT s_suppkey AS run, 2::BIGINT AS seq, 'resumed' AS type, 'transition' AS problem FROM supplier WHERE s_suppkey % 9 = 0",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1",
    "stream_windows": "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= m.w GROUP BY ALL",
    "tsv_triples": with_(TRIPLES) + "FROM triples",
    "tsv_aliases": with_(ALIASES) + "SELECT id % 8 AS code, count(*) AS n, max(norm) AS last_norm FROM (SELECT DISTINCT id, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS norm FROM aliases) GROUP BY 1",
    "locked_text": "SELECT count(*) AS rows, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(text) AS first FROM benchmark",
    "published_schedule": schedule.ORACLES["relative_schedule"],
    "package_equality": "SELECT 0::BIGINT AS differences, count(*) AS pairs FROM customer",
    "packed_tokens": with_(schedule.STREAM) + "SELECT b AS start, string_agg(coalesce(token, 0), ' ' ORDER BY k) AS tokens FROM (SELECT i * 1100 AS b, k, (i * 1100 + k) % 16384 AS p FROM range(16) t(i), range(64) u(k)) LEFT JOIN stream ON pos = p GROUP BY b",
    "zipped_lines": "SELECT count(*) AS lines, max('r' || doc_id) AS last, count(*) FILTER (lang = 'es') AS uneven FROM documents",
    "published_results": with_(EVAL_ROWS) + "FROM eval_rows WHERE arm = 'dense'",
    "occurrence_ledger": with_(*_masks.SPANS, _masks.CONTROLS) + "SELECT 'split' AS condition, role, count(*) AS n, CAST(sum(length) AS BIGINT) AS tokens FROM spans WHERE role = 'payload' GROUP BY role UNION ALL SELECT 'random', role, count(*), CAST(sum(length) AS BIGINT) FROM controls GROUP BY role",
    "rebuilt_twice": "SELECT 0::BIGINT AS differences",
    "canonical_hashes": """SELECT j, sha256(j) AS hash FROM (SELECT '{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}' AS j FROM supplier)""",
}
