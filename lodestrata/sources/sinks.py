"""Writers and publication."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage


def canonical_json(*columns: str) -> Column:
    """K1: compact JSON with its keys in order, nulls kept. Doubles are formatted by Spark: hash only numbers that are whole, and texts."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_bytes(value) -> bytes:
    """K1: canonical JSON of a small document, with a line end; NaN is refused."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=True) + "\n").encode()


def publish(df: DataFrame, target: str, kind: str = "parquet", **options) -> str:
    """K9: written beside the target, then renamed to it; a target that is there is never replaced."""
    spark = df.sparkSession
    if storage.exists(spark, target):
        raise FileExistsError(target)
    staged = f"{target}.staged-{spark.sparkContext.applicationId}"
    df.write.mode("overwrite").format(kind).options(**options).save(staged)
    if not storage.rename(spark, staged, target):
        storage.remove(spark, staged)
        raise FileExistsError(target)
    return target


def write_jsonl(df: DataFrame, target: str, order: list[str] | None = None) -> str:
    """JSON lines, range-sorted if an order is asked for."""
    return publish(df.orderBy(*order) if order else df, target, "json")


def seal_schedule(rows: DataFrame, target: str) -> DataFrame:
    """K4: a schedule written once, and read again in its order."""
    publish(rows.repartitionByRange("sequence").sortWithinPartitions("sequence"), target)
    return rows.sparkSession.read.parquet(target).orderBy("sequence")


def occurrence_ledger(spans: DataFrame, demands: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each condition under which a span is active: demands under split, selected candidates under random."""
    both = demands.select("span_id", F.lit("split").alias("condition")).unionByName(candidates.filter("selected").select("span_id", F.lit("random").alias("condition")))
    return spans.join(both, "span_id")


def render_package(records: DataFrame, folder: str) -> dict[str, str]:
    """K6: records (key, values) as a table, as JSON lines, and as pairs; the three paths."""
    publish(records, f"{folder}/records")
    publish(records, f"{folder}/jsonl", "json")
    publish(records.select("key", F.posexplode("values").alias("place", "value")), f"{folder}/pairs")
    return {n: f"{folder}/{n}" for n in ("records", "jsonl", "pairs")}


def package_differences(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows in which the three representations differ; none if they are equal."""
    a = spark.read.parquet(paths["records"]).select("key", "values")
    b = spark.read.schema("key string, values array<string>").json(paths["jsonl"])
    c = spark.read.parquet(paths["pairs"]).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))
    out = None
    for x, y in ((a, b), (b, a), (a, c), (c, a)):
        d = x.exceptAll(y)
        out = d if out is None else out.unionByName(d)
    return out


def deterministic_zip(files: dict[str, bytes]) -> bytes:
    """K7: an archive whose bytes depend on names and contents only; a driver's tool for small packages."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, files[name])
    return out.getvalue()


def write_store(rows: DataFrame, table: str, key: list[str], buckets: int = 16) -> None:
    """K8: a store as a table bucketed and sorted by its address, so that later joins on it need no shuffle; a repeated address is refused."""
    from ..operators.audit import repeated_addresses

    if not repeated_addresses(rows, key).isEmpty():
        raise ValueError("an address is repeated")
    rows.write.mode("errorifexists").format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(table)


def publish_results(rows: DataFrame, target: str) -> str:
    """Result rows in the order of their key, after a check that qids, and variants of a pair, are unique."""
    twice = rows.groupBy("qid").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = rows.groupBy("pair_id", "variant").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty() or not pairs.isEmpty():
        raise ValueError("a qid or a variant is repeated")
    return publish(rows.repartitionByRange("pair_id", "variant").sortWithinPartitions("pair_id", "variant"), target)


def _cell(v) -> str:
    return "" if v is None else f"{v:.17g}" if isinstance(v, float) else str(v)


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Frames of different columns as one, its columns sorted by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def render(df: DataFrame, kind: str, limit: int = 10_000) -> str:
    """A report's table, of at most ``limit`` rows, as csv, markdown, latex or svg bars."""
    rows, cols = df.limit(limit + 1).collect(), df.columns
    if len(rows) > limit:
        raise ValueError("a report is a small table")
    cells = [[_cell(r[c]) for c in cols] for r in rows]
    if kind == "csv":
        import csv

        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([cols, *cells])
        return out.getvalue()
    if kind == "markdown":
        line = lambda x: "| " + " | ".join(v.replace("|", "\\|") for v in x) + " |"
        return "\n".join([line(cols), line(["---"] * len(cols)), *map(line, cells)]) + "\n"
    if kind == "latex":
        esc = lambda v: "".join("\\" + c if c in "&%$#_{}" else c for c in v)
        body = " \\\\\n".join(" & ".join(map(esc, x)) for x in [cols, *cells])
        return f"\\begin{{tabular}}{{{'l' * len(cols)}}}\n{body} \\\\\n\\end{{tabular}}\n"
    if kind == "svg":
        values = [float(r[cols[-1]] or 0) for r in rows]
        top = max(map(abs, values), default=1) or 1
        bars = "".join(f'<rect x="0" y="{20 * i}" width="{300 * abs(v) / top:.2f}" height="16"/>' for i, v in enumerate(values))
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="300" height="{20 * len(values)}">{bars}</svg>'
    raise ValueError(kind)
