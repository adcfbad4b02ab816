"""Tokens, metadata and the corpus with its weight columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import corpus as op
from ..operators import masks as mk
from . import masks
from .base import read, with_


def encoded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and segments of customers as roles, with their ranges; ids are crc32, which DuckDB lacks, so ranges are compared."""
    seg = F.array(F.struct(F.col("c_name").alias("text"), F.lit("subject").alias("role")), F.struct(F.lit(" -- ").alias("text"), F.lit("text").alias("role")), F.struct(F.col("c_mktsegment").alias("text"), F.lit("payload").alias("role")), F.struct(F.lit(" ").alias("text"), F.lit("text").alias("role")))
    x = read(spark, sf_dir, "customer").select("c_custkey", op.encoded(seg).alias("x"))
    return x.select("c_custkey", F.size("x.tokens").cast("long").alias("tokens"), F.array_join(F.transform("x.spans", lambda s: F.concat_ws(":", s["role"], s["start"].cast("string"), s["end"].cast("string"))), " ").alias("spans"))


def rendered_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as records."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("record_id"), F.lit("bench").alias("lane"), F.col("text").alias("payload"))
    return op.metadata(rows).select("ordinal", "record_id", "token_length", "source_sha256")


def _corpus(spark: SparkSession, sf_dir: str, kept: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents' masked spans over positions 0 to n - 1; a token is its position's remainder. ``kept``: a folder for the controls, if the ranges are used again."""
    own = masks.spans(spark, sf_dir)
    records = storage.frozen(own.select("record", "n").distinct())
    tokens = records.select("record", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos")).withColumn("token", (F.col("pos") % 97).cast("int"))
    controls = mk.matched_controls(own, masks.SEED)
    if kept:
        controls = masks.by_record(controls.select("record", "start", "end"), kept)
    ranges = mk.masked_ranges(own, controls)
    return records, ranges, op.sidecars(tokens, ranges)


def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: a corpus written with its four weight columns, and counted as it is read again."""
    _, _, rows = _corpus(spark, sf_dir)
    return op.counters(spark.read.parquet(op.write(rows, storage.scratch(spark, "corpus"))))


def corpus_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: a corpus of which one position was lost."""
    kept = storage.scratch(spark, "controls")
    try:
        records, ranges, rows = _corpus(spark, sf_dir, kept)
        first = records.agg(F.min("record")).first()[0]
        return storage.frozen(op.verify(rows.filter(~((F.col("record") == first) & (F.col("pos") == 4))), records, ranges))
    finally:
        storage.remove(spark, kept)


QUERIES = {f.__name__: f for f in (encoded_segments, rendered_metadata, corpus_counters, corpus_verified)}

_SPANS = masks.SPANS
ORACLES = {
    "encoded_segments": "WITH t AS (SELECT c_custkey, len(regexp_extract_all(c_name, '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]')) AS a, len(regexp_extract_all(c_mktsegment, '[A-Za-z0-9_]+|[^A-Za-z0-9_ ]')) AS b FROM customer) SELECT c_custkey, a + 2 + b AS tokens, 'subject:0:' || a || ' text:' || a || ':' || a + 2 || ' payload:' || a + 2 || ':' || a + 2 + b AS spans FROM t",
    "rendered_metadata": r"SELECT item_id AS ordinal, 'i' || item_id AS record_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS token_length, sha256(text) AS source_sha256 FROM benchmark",
    "corpus_counters": with_(*_SPANS, masks.CONTROLS, masks.RANGES) + "SELECT c AS condition, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT DISTINCT record, n FROM spans)) AS tokens, (SELECT CAST(coalesce(sum(e - s), 0) AS BIGINT) FROM ranges WHERE condition = c) AS masked FROM (VALUES ('dense'), ('split'), ('selective'), ('random')) t(c)",
}
