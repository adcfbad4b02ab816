"""Incremental forms of the batch operators over streams of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream, a few files at a time; the schema is that of the files there are."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_metrics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A14 as a stream: (by, n, total, mean) of all rows so far; for the complete or update mode."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def completed_pairs(rows: DataFrame) -> DataFrame:
    """K11, J14 as a stream: (pair_id, original, counterfactual), once both variants have come; a repeated row counts once, a third one never."""

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = list(state.get) if state.exists else [None, None, False]
        for b in batches:
            for variant, correct in zip(b["variant"], b["correct"], strict=True):
                i = 0 if variant == "original" else 1
                if have[i] is None:
                    have[i] = int(correct)
        if have[0] is not None and have[1] is not None and not have[2]:
            have[2] = True
            yield pd.DataFrame({"pair_id": [key[0]], "original": [have[0]], "counterfactual": [have[1]]})
        state.update(tuple(have))

    return rows.select("pair_id", "variant", "correct").groupBy("pair_id").applyInPandasWithState(pair, "pair_id long, original long, counterfactual long", "original long, counterfactual long, done boolean", "append", GroupStateTimeout.NoTimeout)


def checked_ledger(events: DataFrame) -> DataFrame:
    """W13 as a stream: (run, seq, type, problem) of events that don't follow the last one of their run; each run's state is its last sequence and type."""
    from ..operators.audit import TRANSITIONS

    allowed = set(TRANSITIONS)

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, last = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for s, kind in zip(rows["seq"], rows["type"], strict=True):
            if s != seq + 1:
                out.append((key[0], s, kind, "gap"))
            elif (last, kind) not in allowed:
                out.append((key[0], s, kind, "transition"))
            seq, last = int(s), kind
        state.update((seq, last))
        yield pd.DataFrame(out, columns=["run", "seq", "type", "problem"])

    return events.select("run", "seq", "type").groupBy("run").applyInPandasWithState(check, "run long, seq long, type string, problem string", "seq long, type string", "append", GroupStateTimeout.NoTimeout)


def decoded_lookups(tokens: DataFrame, most: int = 8) -> DataFrame:
    """The decode-time state machine: (stream, queries, malformed, dropped) of token streams (stream, pos, token): an ``open`` mark begins a query, ``close`` ends it, another ``open`` within one is malformed, and queries beyond the cap are dropped.

    Open and close marks are counted per stream by a fold over its tokens in order.
    """
    ordered = tokens.groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("t"))
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("queries"), F.lit(0).alias("malformed"), F.lit(0).alias("dropped"))

    def step(a, x):
        full = a["queries"] >= most
        closes = a["inside"] & (x == "close")
        return F.struct(
            F.when(x == "open", F.lit(True)).when(x == "close", F.lit(False)).otherwise(a["inside"]).alias("inside"),
            (a["queries"] + (closes & ~full).cast("int")).alias("queries"),
            (a["malformed"] + ((x == "open") & a["inside"]).cast("int") + ((x == "close") & ~a["inside"]).cast("int")).alias("malformed"),
            (a["dropped"] + (closes & full).cast("int")).alias("dropped"),
        )

    return ordered.select("stream", F.aggregate("t", start, step).alias("s")).select("stream", F.col("s.queries").cast("long").alias("queries"), (F.col("s.malformed") + F.col("s.inside").cast("int")).cast("long").alias("malformed"), F.col("s.dropped").cast("long").alias("dropped"))


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension, as the reference has no event time: counts and sums by window and type, late rows within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """An extension: sessions of each user, closed by a gap."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all files that there are, into a folder with its checkpoint; what was written.

    Append goes through the file sink, exactly once. Complete writes every batch
    to a folder of its own, of which the last is the result.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/{epoch:08d}")).start().awaitTermination()
    from ..storage import listed

    return spark.read.parquet(listed(spark, f"{folder}/out")[-1])
