"""Relation statistics, eligibility and ranking over (subject, relation, object) triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SUPPORT, FUNCTIONAL_NUM, FUNCTIONAL_DEN, SELECTED = 5000, 95, 100, 32
#: The literal relations that every schema has besides those of the graph.
LITERAL_KINDS = (("date", 2), ("quantity", 2), ("category", 2), ("string", 2))


def relation_stats(triples: DataFrame) -> DataFrame:
    """A1: (relation, support, distinct_subjects, distinct_objects); support counts repeats, distinct counts are exact.

    Both distinct counts come from one aggregation by (relation, subject or
    object, value), whose partial sums meet before the shuffle: a relation with a third of all triples isn't one task's work.
    """
    ends = triples.select("relation", F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("subject").alias("v")), F.struct(F.lit("o").alias("end"), F.col("object").alias("v")))).alias("x"))
    sums = ends.groupBy("relation", "x.end", "x.v").agg(F.count("*").alias("n"))
    of = lambda e: F.col("end") == e
    return sums.groupBy("relation").agg(F.sum(F.when(of("s"), F.col("n"))).alias("support"), F.count_if(of("s")).alias("distinct_subjects"), F.count_if(of("o")).alias("distinct_objects"))


def entity_count(triples: DataFrame) -> DataFrame:
    """One row (entities, relations, min_id, max_id) over subjects and objects together."""
    ids = triples.select(F.col("subject").alias("id")).union(triples.select(F.col("object").alias("id"))).distinct()
    return ids.agg(F.count("*").alias("entities"), F.min("id").alias("min_id"), F.max("id").alias("max_id")).crossJoin(triples.select("relation").distinct().agg(F.count("*").alias("relations")))


def is_functional(support: Column, subjects: Column, num: int = FUNCTIONAL_NUM, den: int = FUNCTIONAL_DEN) -> Column:
    """distinct subjects / support reaches num / den, in integers."""
    return subjects * den >= support * num


def numeric_id(relation: Column) -> Column:
    """The number of an id of a letter and digits."""
    return F.substring(relation, F.lit(2), F.length(relation)).try_cast("long")


def rank_relations(stats: DataFrame, aliased: DataFrame, min_support: int = MIN_SUPPORT, count: int = SELECTED, num: int = FUNCTIONAL_NUM, den: int = FUNCTIONAL_DEN) -> DataFrame:
    """Eligible relations with rank by support, functionality and number. At equal support functionality goes by distinct subjects.

    ``aliased`` lists relations that have aliases. There is a row for each relation, so the global window is small.
    """
    eligible = stats.join(aliased.select("relation").distinct(), "relation", "left_semi").filter((F.col("support") >= min_support) & is_functional(F.col("support"), F.col("distinct_subjects"), num, den))
    order = Window.orderBy(F.desc("support"), F.desc("distinct_subjects"), numeric_id(F.col("relation")))
    return eligible.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= count)


def quota(rank: Column, high: int = 94, low: int = 93, until: int = 24) -> Column:
    """Keys taken from a relation by its rank."""
    return F.when(rank <= until, high).otherwise(low).cast("long")


def filter_reasons(stats: DataFrame, aliased: DataFrame, selected: DataFrame, min_support: int = MIN_SUPPORT, num: int = FUNCTIONAL_NUM, den: int = FUNCTIONAL_DEN) -> DataFrame:
    """(reason, relations) by the first check that a relation fails; every reason has a row."""
    has, kept = aliased.select("relation").distinct().withColumn("a", F.lit(True)), selected.select("relation").withColumn("k", F.lit(True))
    reason = (
        F.when(F.col("a").isNull(), "no_alias")
        .when(F.col("support") < min_support, "support")
        .when(~is_functional(F.col("support"), F.col("distinct_subjects"), num, den), "functionality")
        .when(F.col("k").isNull(), "not_selected")
        .otherwise("selected")
    )
    counts = stats.join(has, "relation", "left").join(kept, "relation", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    reasons = stats.sparkSession.createDataFrame([(r,) for r in ("no_alias", "support", "functionality", "not_selected", "selected")], "reason string")
    return reasons.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("relations"))


def whitelist(triples: DataFrame, selected: list[str]) -> DataFrame:
    """the triples of the selected relations, a few dozen at most: as a list, so that the filter reaches the scans."""
    return triples.filter(F.col("relation").isin(selected))


def schema_rows(catalog: DataFrame, stats: DataFrame, literals: int = 8) -> DataFrame:
    """Every catalogued relation with its statistics, zeros where there are none, and the literal relations appended."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "distinct_subjects", "distinct_objects")]
    graph = catalog.select("relation").distinct().join(stats, "relation", "left").select("relation", F.lit("entity").alias("target_kind"), *zero)
    kinds = [k for k, n in LITERAL_KINDS for _ in range(n)][:literals]
    rows = catalog.sparkSession.createDataFrame([(f"L{i}", k, 0, 0, 0) for i, k in enumerate(kinds)], "relation string, target_kind string, support long, distinct_subjects long, distinct_objects long")
    return graph.unionByName(rows)
