"""Scans of JSON lines with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tsv import ScanError, lines

FACT = "subj string, prop string, obj string, question string, possible_answers array<string>"
GRAPH_ROW = "source_id long, relation_id string, direction string, target_kind string, target string, qualifiers array<array<string>>, provenance_id string"
CATALOG = "ordinal long, record_id string, lane string, source string, source_key string, payload string, flags array<string>, payload_sha256 string"
LOG = "step long, loss double, loss_ema double, lr double, tok_s double, epoch double, loss_masked_values double"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a declared schema; a malformed line stops the scan."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def lock(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256, rows) of a text's files: what a lock records."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = lines(spark, path).groupBy(F.substring_index("file", "/", -1).alias("file")).agg(F.count("*").alias("rows"))
    return files.join(rows, "file", "left").select("file", "bytes", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"))


def read_locked_text(spark: SparkSession, path: str, locked: DataFrame) -> DataFrame:
    """(text) of the lines of files that are as their lock says; every text must be nonempty."""
    if (n := lock(spark, path).exceptAll(locked.select("file", "bytes", "sha256", "rows")).count()) or locked.select("file").exceptAll(lock(spark, path).select("file")).count():
        raise ScanError(f"{n or 'missing'} files aren't as locked")
    rows = read_json(spark, path, "text string")
    if not rows.filter("text is null or text = ''").isEmpty():
        raise ScanError("a text is empty")
    return rows


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, text): nonempty parts between blank lines of whole files, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("ordinal", "text"))
    return whole.select(F.col("ordinal").cast("long"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text")).filter("text <> ''")


def cycled(rows: DataFrame, length: str, budget: int) -> DataFrame:
    """Rows again and again with ``round``, as many rounds as a budget of their total length needs."""
    total = rows.agg(F.sum(length)).first()[0] or 0
    rounds = -(-budget // total) if total else 0
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(rounds).withColumnRenamed("id", "round")))


def log_series(spark: SparkSession, path: str, y: str, x: str = "step") -> DataFrame:
    """(x, y) of a training log whose rows differ in their keys; rows without either are left out."""
    return read_json(spark, path, LOG).select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")


def metric_curve(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(step, value, file) of a dotted key in every summary of a folder; of a step's summaries the last by name counts."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    rows = whole.select(F.get_json_object("value", "$.step").cast("long").alias("step"), F.get_json_object("value", "$." + key).cast("double").alias("value"), "file").filter("value is not null")
    last = Window.partitionBy("step").orderBy(F.desc("file"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): the lines of one file by number: offsets within the scan's partitions, counted out."""
    from ..operators.schedule import offsets

    rows = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).withColumn("_one", F.lit(1))
    return offsets(rows, ["_id"], "_one", "ordinal").select("ordinal", "value")


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ordinal, left, right) of two files read in step; ``uneven`` tells where one has no line."""
    return a.select("ordinal", F.col("value").alias("left")).join(b.select("ordinal", F.col("value").alias("right")), "ordinal", "full_outer")


def uneven(z: DataFrame) -> DataFrame:
    """Ordinals of one side only."""
    return z.filter("left is null or right is null").select("ordinal")


def possible_answers(raw: Column, obj: Column) -> Column:
    """The list that a JSON text holds; without a nonempty one the object alone."""
    got = F.filter(F.from_json(raw, "array<string>"), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return F.coalesce(F.when(F.size(got) > 0, got), F.array(obj))


def complete_records(rows: DataFrame, entity: str, attribute: str, value: str, attributes: list[str]) -> DataFrame:
    """A row for each entity that has all attributes."""
    wide = rows.groupBy(entity).pivot(attribute, attributes).agg(F.first(value))
    return wide.dropna(subset=attributes)


def choice_rows(rows: DataFrame, task: str) -> DataFrame:
    """(context, choices, gold) of four public tasks' rows, and of last words to be guessed."""
    c = F.col
    if task == "endings":
        return rows.select(c("ctx").alias("context"), c("endings").alias("choices"), c("label").cast("long").alias("gold"))
    if task == "labelled":
        return rows.select(F.concat(F.lit("Question: "), c("question"), F.lit("\nAnswer:")).alias("context"), c("choices.text").alias("choices"), (F.array_position(c("choices.label"), c("answerKey")) - 1).alias("gold"))
    if task == "two_solutions":
        return rows.select(c("goal").alias("context"), F.array("sol1", "sol2").alias("choices"), c("label").cast("long").alias("gold"))
    if task == "blank":
        at = F.instr(c("sentence"), "_")
        tail = F.substring(c("sentence"), at + 1, F.length("sentence"))
        return rows.select(F.substring(c("sentence"), F.lit(1), at - 1).alias("context"), F.array(F.concat("option1", tail), F.concat("option2", tail)).alias("choices"), (c("answer").cast("long") - 1).alias("gold"))
    if task == "last_word":
        word = F.substring_index(F.rtrim("text"), " ", -1)
        return rows.select(F.rtrim(F.substring(F.rtrim("text"), F.lit(1), F.length(F.rtrim("text")) - F.length(word))).alias("context"), F.array(word).alias("choices"), F.lit(0).cast("long").alias("gold"))
    raise ValueError(task)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue records; ordinals must be 0, 1, ... and payloads as their digests say."""
    rows = read_json(spark, path, CATALOG)
    bad = rows.agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_if(F.sha2("payload", 256) != F.col("payload_sha256")).alias("x")).first()
    if bad["n"] and (bad["d"] != bad["n"] or bad["lo"] != 0 or bad["hi"] != bad["n"] - 1 or bad["x"]):
        raise ScanError(f"the catalogue is broken: {bad}")
    return rows


def fixture_catalog(spark: SparkSession, n: int) -> DataFrame:
    """N stated records."""
    i = F.col("id")
    payload = F.concat(F.lit("payload "), i.cast("string"))
    return spark.range(n).select(i.alias("ordinal"), F.concat(F.lit("rec-"), i.cast("string")).alias("record_id"), F.when(i % 3 == 0, "a").otherwise("b").alias("lane"), F.lit("fixture").alias("source"), i.cast("string").alias("source_key"), payload.alias("payload"), F.array(F.lit("f")).alias("flags"), F.sha2(payload, 256).alias("payload_sha256"))
