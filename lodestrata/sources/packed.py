"""Packed binary files: record manifests and token streams, read and written in bounded pieces."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schedule import np_windows

#: A manifest begins with this mark and its number of records; a record is (task, flags, index).
MARK, RECORD = b"RMAN", struct.Struct("<HHI")


def manifest_bytes(records: list[tuple[int, int, int]]) -> bytes:
    """A manifest's bytes."""
    return MARK + len(records).to_bytes(8, "little") + b"".join(RECORD.pack(*r) for r in records)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, task, flags, source_index) of manifests; wrong marks and lengths stop the scan. See ``audit.unordered`` for the order of indices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype([("task", "<u2"), ("flags", "<u2"), ("source_index", "<u4")])
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                if data[:4] != MARK or len(data) != 12 + 8 * int.from_bytes(data[4:12], "little"):
                    raise ValueError(f"{name} is no whole manifest")
                a = np.frombuffer(data, kind, offset=12)
                yield pd.DataFrame({"file": name, "entry": np.arange(len(a)), **{k: a[k].astype(np.int64) for k in kind.names}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, entry long, task long, flags long, source_index long")


def read_tokens(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(segment, offset, token) of raw little-endian files; a segment is a file by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                a = np.frombuffer(data, f"<u{width}")
                for s in range(0, len(a), 100_000):
                    part = a[s : s + 100_000]
                    yield pd.DataFrame({"segment": name.rsplit("/", 1)[-1], "offset": np.arange(s, s + len(part)), "token": part.astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "segment string, offset long, token long")


def windows(tokens: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(start, tokens) of windows over the segments put together, around the end, as a join on position."""

    sizes = tokens.groupBy("segment").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    base = sizes.select("segment", F.coalesce(F.sum("n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = sizes.agg(F.sum("n")).first()[0]
    placed = tokens.join(F.broadcast(base), "segment").select((F.col("base") + F.col("offset")).alias("pos"), "token")
    wanted = starts.select("start", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")).withColumn("pos", F.pmod(F.col("start") + F.col("k"), F.lit(total)))
    got = wanted.join(placed, "pos").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("r"))
    return got.select("start", F.transform("r", lambda x: x["token"]).alias("tokens"))


def write_tokens(packed: DataFrame, folder: str) -> list[str]:
    """A raw uint16 file for each shard of (shard, offset, token), in the order of offsets; the names of the files.

    Each shard is written by one task, piece by piece, under a name of its own, and renamed when whole.
    """
    import pyarrow.fs as pafs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, shard, names = None, None, []

        def close():
            if out is not None:
                out.close()
                fs.move(f"{root}/.{shard}.part", f"{root}/{shard:05d}.bin")
                names.append(f"{shard:05d}.bin")

        for b in batches:
            for s, rows in b.groupby("shard", sort=False):
                if s != shard:
                    close()
                    shard = int(s)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/.{shard}.part", compression=None)
                out.write(rows["token"].to_numpy().astype("<u2").tobytes())
        close()
        yield pd.DataFrame({"name": names})

    rows = packed.repartition(F.col("shard")).sortWithinPartitions("shard", "offset").select("shard", "token").mapInPandas(run, "name string").collect()
    return sorted(r["name"] for r in rows)


__all__ = ["manifest_bytes", "np_windows", "read_manifest", "read_tokens", "windows", "write_tokens"]
