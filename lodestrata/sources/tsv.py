"""Scans of tab-separated triples and aliases. Faulty lines are found as rows, with their text, before anything is typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ScanError(ValueError):
    """Lines that break the format."""


def entity_id(c: Column) -> Column:
    """The number of Q and digits; null otherwise."""
    return F.when(c.rlike("^Q[0-9]+$"), F.substring(c, F.lit(2), F.length(c)).try_cast("long"))


def is_relation(c: Column) -> Column:
    """P and digits."""
    return c.rlike("^P[0-9]+$")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): lines without their ends; blank ones are left out."""
    rows = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r+$", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    return rows.filter(F.trim("value") != "")


def bad_triples(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't an entity, a relation and an entity."""
    f = F.split("value", "\t", -1)
    ok = (F.size(f) == 3) & entity_id(F.get(f, F.lit(0))).isNotNull() & is_relation(F.get(f, F.lit(1))) & entity_id(F.get(f, F.lit(2))).isNotNull()
    return lines(spark, path).filter(~F.coalesce(ok, F.lit(False)))


def read_triples(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(subject, relation, object). With ``check`` a faulty line raises ScanError before anything is returned."""
    if check and (bad := bad_triples(spark, path).limit(3).collect()):
        raise ScanError(f"faulty triples: {[r['value'] for r in bad]}")
    f = F.split("value", "\t", -1)
    return lines(spark, path).select(entity_id(f[0]).alias("subject"), f[1].alias("relation"), entity_id(f[2]).alias("object"))


def read_aliases(spark: SparkSession, path: str, prefix: str, key, strict: bool = True) -> DataFrame:
    """(id, ord, raw, norm): an id and one alias at least on each line; of an id's aliases with the same key the first stays.

    ``strict`` raises ScanError for a faulty line or a repeated id.
    """
    from ..operators.sample import unique_aliases

    rows = lines(spark, path).select("value", F.split("value", "\t", -1).alias("f"))
    if strict:
        ok = (F.size("f") >= 2) & F.col("f")[0].rlike(f"^{prefix}[0-9]+$")
        if bad := rows.filter(~ok).limit(3).collect():
            raise ScanError(f"faulty aliases: {[r['value'] for r in bad]}")
        if twice := rows.groupBy(F.col("f")[0].alias("id")).agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect():
            raise ScanError(f"repeated ids: {[r['id'] for r in twice]}")
    number = F.substring(F.col("f")[0], F.lit(2), F.length(F.col("f")[0])).cast("long")
    each = rows.select(number.alias("id"), F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("ord", "raw")).filter(F.trim("raw") != "")
    return unique_aliases(each, key(F.col("raw")))
