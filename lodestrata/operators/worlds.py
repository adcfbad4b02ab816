"""Worlds of entities and facts, made and read with expressions of ids so that every task makes its own part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import half_up_ratio, literal_value
from ..functions.hashing import leading, sha

#: The fewest entities a world needs for its reasoning items.
LEAST = 16


def world_sizes(entities: int, size: int, least: int = LEAST) -> list[int]:
    """Sizes of worlds that share the entities: whole ones; a remainder is halved with the last whole one, or filled up from it if it is too small and that can spare it, or joins it."""
    whole, rest = divmod(entities, size)
    if not rest or not whole:
        return [size] * whole + [rest] * bool(rest)
    kept = [size] * (whole - 1)
    if rest >= least:
        half = (size + rest) // 2
        return [*kept, half, size + rest - half]
    spare = size - (least - rest)
    return [*kept, spare, least] if spare >= least else [*kept, size + rest]


def worlds(spark, entities: int, size: int, least: int = LEAST) -> DataFrame:
    """(world, first, entities) of every world. Whole worlds are a closed form; only the repaired tail differs."""
    sizes = world_sizes(entities, size, least)
    whole = next((i for i, s in enumerate(sizes) if s != size), len(sizes))
    rows = spark.range(whole).select(F.col("id").alias("world"), (F.col("id") * size).alias("first"), F.lit(size).cast("long").alias("entities"))
    tail, at = [], whole * size
    for i, s in enumerate(sizes[whole:]):
        tail.append((whole + i, at, s))
        at += s
    return rows.union(spark.createDataFrame(tail, "world long, first long, entities long")) if tail else rows


def schema_world(worlds_: DataFrame, schema: DataFrame, seed: int) -> DataFrame:
    """(world, source, relation, kind, target) of each world.

    ``schema`` has (relation, kind, support, distinct_subjects, distinct_objects).
    A relation has as many sources as its share of the largest relation's subjects
    allows (half up, one at least), and its targets are dealt in turn over as many as its objects allow,
    from a place that its hash with the world gives; literal kinds have values instead.
    """
    most = Window.partitionBy()
    s = schema.withColumn("_s", F.greatest(F.lit(1), F.max("distinct_subjects").over(most))).withColumn("_o", F.greatest(F.lit(1), F.max("distinct_objects").over(most)))
    rows = worlds_.crossJoin(F.broadcast(s))
    sources = F.greatest(F.lit(1), half_up_ratio(F.col("distinct_subjects"), F.col("_s"), 1000) * F.col("entities") / 1000).cast("long")
    objects = F.greatest(F.lit(1), half_up_ratio(F.col("distinct_objects"), F.col("_o"), 1000) * F.col("entities") / 1000).cast("long")
    rows = rows.withColumn("_n", sources).withColumn("_m", objects).withColumn("_at", leading(sha(str(seed), "\0", F.col("world"), "\0", F.col("relation")), 8) % F.col("_m"))
    rows = rows.select("world", "first", "relation", "kind", "_m", "_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k"))
    entity = F.col("first") + F.pmod(F.col("k") + F.col("_at"), F.col("_m"))
    target = F.when(F.col("kind") == "entity", entity.cast("string")).otherwise(literal_value(F.col("kind"), F.col("first") + F.col("k"), seed))
    return rows.select("world", (F.col("first") + F.col("k")).alias("source"), "relation", "kind", target.alias("target"))


def follow(starts: DataFrame, facts: DataFrame, relations: list[str]) -> DataFrame:
    """(start, end) of a path of relations through facts (source, relation, target); starts whose path breaks are dropped."""
    rows = starts.select("start", F.col("start").alias("end"))
    for r in relations:
        step = facts.filter(F.col("relation") == r).select(F.col("source").alias("end"), F.col("target").alias("_t"))
        rows = rows.join(step, "end").select("start", F.col("_t").try_cast("long").alias("end"))
    return rows


def composition_answer(values: Column, n: int = 4) -> Column:
    """R and the sum of the rows' composition values modulo n."""
    return F.concat(F.lit("r"), (F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) % n).cast("string"))


def date_order(a: Column, b: Column) -> Column:
    """Which of two ISO dates is the earlier: first, second or same."""
    return F.when(a < b, "first").when(a > b, "second").otherwise("same")


def unequal_pairs(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, a, b): each row of a group with the next by key, where their values differ."""
    w = Window.partitionBy(group).orderBy(key)
    nxt = rows.withColumn("b", F.lead(key).over(w)).withColumn("_v", F.lead(value).over(w))
    return nxt.filter(F.col(value) != F.col("_v")).select(group, F.col(key).alias("a"), "b")


def equal_pairs(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, value, a, b): each row with the next of its group that has the same value."""
    w = Window.partitionBy(group, value).orderBy(key)
    return rows.withColumn("b", F.lead(key).over(w)).filter("b is not null").select(group, value, F.col(key).alias("a"), "b")


def value_groups(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, value, members, first, second) of values that two or more rows of a group share; members are counted, not gathered."""
    got = rows.groupBy(group, value).agg(F.count("*").alias("members"), F.min(key).alias("first"))
    more = rows.join(got, [group, value]).filter(F.col(key) > F.col("first")).groupBy(group, value).agg(F.min(key).alias("second"))
    return got.filter("members > 1").join(more, [group, value])


def interleaved(rows: DataFrame, kind: str, key: str, turns: dict[str, int]) -> DataFrame:
    """(sequence, kind, key): kinds give so many rows in turn, each in the order of its keys; a batch goes on without a kind that has run out."""
    w = Window.partitionBy(kind).orderBy(key)
    n = F.create_map(*[x for k, v in turns.items() for x in (F.lit(k), F.lit(v))])
    place = F.create_map(*[x for i, k in enumerate(turns) for x in (F.lit(k), F.lit(i))])
    ranked = rows.filter(F.col(kind).isin(list(turns))).withColumn("_r", F.row_number().over(w) - 1)
    ranked = ranked.withColumn("_turn", F.floor(F.col("_r") / n[F.col(kind)])).withColumn("_k", place[F.col(kind)])
    from .schedule import numbered

    return numbered(ranked, "_turn", "_k", "_r").select("sequence", kind, key)


def prefix_free(choices: Column) -> Column:
    """Whether no choice begins another."""
    clash = F.exists(choices, lambda a: F.exists(choices, lambda b: (a != b) & F.startswith(b, a)))
    return ~clash & (F.size(F.array_distinct(choices)) == F.size(choices))


def eval_pairs(facts: DataFrame, successor: DataFrame) -> DataFrame:
    """(pair_id, variant, source, relation, answer): each fact as it is, and with its target changed to the next of its relation; facts without another are left out."""
    s = successor.select("relation", F.col("object").alias("target"), "successor")
    rows = facts.join(s, ["relation", "target"]).filter("successor is not null")
    pair = F.concat_ws("-", F.col("source").cast("string"), F.col("relation"))
    each = F.array(F.struct(F.lit("original").alias("variant"), F.col("target").alias("answer")), F.struct(F.lit("counterfactual").alias("variant"), F.col("successor").alias("answer")))
    return rows.select(pair.alias("pair_id"), "source", "relation", F.explode(each).alias("x")).select("pair_id", "x.variant", "source", "relation", "x.answer")


#: The attributes of an entity record and the sizes of their pools.
ATTRIBUTES = {"birth_city": 200, "birth_date": 27_759, "current_city": 200, "employer": 300, "major": 100, "university": 150}


def entity_records(spark, n: int, seed: int) -> DataFrame:
    """(id, name, and each attribute's index in its pool) of n entities; names are unique by their number."""
    pick = lambda a, size: (leading(sha(str(seed), "\0", F.col("id"), "\0" + a), 12) % size).alias(a)
    name = F.concat(F.lit("Person "), F.col("id").cast("string"), F.lit(" "), F.substring(sha(str(seed), "\0", F.col("id"), "\0name"), 1, 6))
    return spark.range(n).select("id", name.alias("name"), *[pick(a, s) for a, s in ATTRIBUTES.items()])


def recall_probes(records: DataFrame) -> DataFrame:
    """(id, attribute, prompt, answer): a probe for each attribute of each entity."""
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("answer")) for a in ATTRIBUTES])
    rows = records.select("id", "name", F.explode(each).alias("x"))
    return rows.select("id", "x.attribute", F.concat(F.lit("What is the "), F.replace("x.attribute", F.lit("_"), F.lit(" ")), F.lit(" of "), F.col("name"), F.lit("?")).alias("prompt"), "x.answer")


def rendered(records: DataFrame, templates: list[str]) -> DataFrame:
    """(id, text, segments): a sentence by a template that the entity's hash chooses, ``{name}`` and attributes filled in; segments are (text, masked), values being masked."""
    parts = []
    for t in templates:
        pieces = []
        for i, part in enumerate(t.replace("{", "\0{").replace("}", "}\0").split("\0")):
            if part.startswith("{") and part != "{name}":
                pieces.append(F.struct(F.col(part[1:-1]).cast("string").alias("text"), F.lit(True).alias("masked")))
            elif part:
                pieces.append(F.struct((F.col("name") if part == "{name}" else F.lit(part)).alias("text"), F.lit(False).alias("masked")))
        parts.append(F.array(*pieces))
    at = (leading(sha("template", "\0", F.col("id")), 8) % len(parts) + 1).cast("int")
    rows = records.withColumn("segments", F.element_at(F.array(*parts), at))
    return rows.select("id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), "segments")
