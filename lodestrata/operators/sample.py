"""The keyed sample: labels, eligible keys, and the keys of lowest hash of each relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import address_key


def distinct_edges(triples: DataFrame) -> DataFrame:
    """Each edge once."""
    return triples.select("relation", "subject", "object").distinct()


def unique_aliases(aliases: DataFrame, key: Column) -> DataFrame:
    """(id, ord, raw, norm): of an id's aliases with the same key the first stays."""
    first = Window.partitionBy("id", "norm").orderBy("ord")
    return aliases.withColumn("norm", key).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def ambiguous(aliases: DataFrame) -> DataFrame:
    """(norm, owners) of the keys that several ids claim."""
    return aliases.groupBy("norm").agg(F.countDistinct("id").alias("owners")).filter("owners > 1")


def canonical_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases without the keys that several ids claim; those vanish from all of them."""
    return aliases.join(ambiguous(aliases), "norm", "left_anti")


def display_labels(aliases: DataFrame) -> DataFrame:
    """S3: (id, label): the first alias of each id."""
    return aliases.groupBy("id").agg(F.min_by("raw", "ord").alias("label"))


def repeated_ids(rows: DataFrame, column: str = "id") -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def needed_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of entities that an edge names."""
    ids = edges.select(F.col("subject").alias("id")).union(edges.select(F.col("object").alias("id"))).distinct()
    return labels.join(ids, "id", "left_semi")


def key_eligibility(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(relation, subject, n_values, subject_labelled, values_labelled, eligible) for each key of distinct edges."""
    obj = labels.select(F.col("id").alias("object"), F.lit(True).alias("o"))
    sub = labels.select(F.col("id").alias("subject"), F.lit(True).alias("s"))
    keys = edges.join(obj, "object", "left").groupBy("relation", "subject").agg(F.count("*").alias("n_values"), F.bool_and(F.col("o").isNotNull()).alias("values_labelled"))
    keys = keys.join(sub, "subject", "left").withColumn("subject_labelled", F.col("s").isNotNull())
    return keys.select("relation", "subject", "n_values", "subject_labelled", "values_labelled", (F.col("subject_labelled") & F.col("values_labelled")).alias("eligible"))


def lowest_hashed(keys: DataFrame, quotas: DataFrame) -> DataFrame:
    """Of each relation the ``quota`` keys of lowest hash, with their rank. Spark cuts each partition to the limit before its shuffle."""
    rank = Window.partitionBy("relation").orderBy("key_hash", "subject")
    limits = quotas.select("relation", "quota")
    most = limits.agg(F.max("quota")).first()[0] or 0
    ranked = keys.withColumn("key_hash", address_key(F.col("subject"), F.col("relation"))).join(F.broadcast(limits), "relation", "left_semi")
    ranked = ranked.withColumn("key_rank", F.row_number().over(rank).cast("long")).filter(F.col("key_rank") <= most)
    # quotas have a row for each selected relation, a few dozen
    return ranked.join(F.broadcast(limits), "relation").filter("key_rank <= quota").drop("quota")


def sample_records(sampled: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Sampled keys with the subject's label and all values as an array of (id, label) in the order of ids."""
    values = edges.join(sampled.select("relation", "subject"), ["relation", "subject"], "left_semi").join(labels.select(F.col("id").alias("object"), "label"), "object")
    gathered = values.groupBy("relation", "subject").agg(F.array_sort(F.collect_list(F.struct(F.col("object").alias("id"), "label"))).alias("values"))
    return sampled.join(gathered, ["relation", "subject"]).join(labels.select(F.col("id").alias("subject"), F.col("label").alias("subject_label")), "subject")


def reconcile(counts: dict[str, int]) -> list[str]:
    """A4: the rules that the counters of a build break.

    raw = kept + dropped rows, distinct <= kept, keys <= distinct, eligible <= keys,
    eligible + ineligible = keys, sampled = sum of quotas, sampled <= eligible,
    values >= sampled, labelled <= needed.
    """
    c = counts
    rules = {
        "raw = kept + dropped": c["raw"] == c["kept"] + c["dropped"],
        "distinct <= kept": c["distinct"] <= c["kept"],
        "keys <= distinct": c["keys"] <= c["distinct"],
        "eligible + ineligible = keys": c["eligible"] + c["ineligible"] == c["keys"],
        "sampled <= eligible": c["sampled"] <= c["eligible"],
        "sampled <= quota": c["sampled"] <= c["quota"],
        "sampled <= values": c["sampled"] <= c["values"],
        "values <= distinct": c["values"] <= c["distinct"],
        "labelled <= needed": c["labelled"] <= c["needed"],
    }
    return [k for k, ok in rules.items() if not ok]
