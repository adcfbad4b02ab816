"""Phase 8: closures, exact answers and problems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reasoning as op
from .base import read

RULES = [(1, "a", "b"), (2, "b", "c"), (2, "r", "c"), (3, "c", "d"), (4, "d", "e"), (4, "a", "e"), (5, "x", "y")]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("person"), F.explode(F.array(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b"), F.when(F.col("c_custkey") % 3 == 0, "r").otherwise("z"))).alias("atom"))


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.forward_chain(_facts(spark, sf_dir), spark.createDataFrame(RULES, "rule int, antecedent string, head string"))


def forward_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return _closure(spark, sf_dir).select("person", "atom")


def closure_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    return _closure(spark, sf_dir).groupBy("atom", "level").agg(F.count("*").alias("people"))


def prime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O14."""
    return op.prime_counts(spark, 3000)


def base_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O13, native: keys in bases 2 to 36."""
    k = F.col("p_partkey")
    base = (k % 35 + 2).cast("int")
    return read(spark, sf_dir, "part").select(k.alias("p_partkey"), F.lower(F.expr("conv(cast(p_partkey * 7919 as string), 10, cast(p_partkey % 35 + 2 as int))")).alias("text"), base.cast("long").alias("base"))


def letter_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5, native: names whose letters a part's name has, by letter counts."""
    letters = lambda c: F.filter(F.split(F.lower(c), ""), lambda x: x.rlike("[a-z]"))
    p = read(spark, sf_dir, "part").select("p_partkey", letters("p_type").alias("note"), letters(F.concat("p_name", F.lit("aeiorst"))).alias("magazine"))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    fits = F.forall("note", lambda x: count(F.col("magazine"), x) >= count(F.col("note"), x))
    return p.select("p_partkey", fits.alias("fits"))


#: A row and the answer of each task, worked out by hand.
CASES = [
    ("course_schedule", {"courses": [0, 1, 2], "prerequisites": [[1, 0], [2, 1]]}, "True"),
    ("course_schedule", {"courses": [0, 1], "prerequisites": [[1, 0], [0, 1]]}, "False"),
    ("binary_matrix", {"matrix": [[0, 1, 1], [1, 1, 1], [1, 1, 1]]}, "0 1 2\n1 2 3\n2 3 4"),
    ("rotten_oranges", {"matrix": [[2, 1, 1], [1, 1, 0], [0, 1, 1]]}, "4"),
    ("rotten_oranges", {"matrix": [[2, 0, 1]]}, "-1"),
    ("futoshiki", {"puzzle": [[0, 0], [0, 0]], "constraints": [[0, 0, 0, 1, "<"]]}, "1 2\n2 1"),
    ("futoshiki", {"puzzle": [[0, 0], [0, 0]], "constraints": []}, None),
    ("ransom_note", {"note": "aab", "magazine": "baac"}, "True"),
    ("ransom_note", {"note": "aab", "magazine": "abc"}, "False"),
    ("dice", {"dice": [6, 6], "target": 11}, "1/12"),
    ("string_splitting", {"machines": [1, 0, 0], "most": 10}, "0 0 0 1 0 1"),
    ("path_star", {"edges": [[1, 2], [2, 3], [1, 4], [4, 3]], "start": 1, "goal": 3}, "1 2 3"),
    ("largest_island", {"grid": [[1, 1, 0], [0, 1, 0], [1, 0, 1]]}, "3"),
    ("rotate_matrix", {"matrix": [[1, 2], [3, 4]], "turns": 1}, "3 1\n4 2"),
    ("spiral_matrix", {"matrix": [[1, 2, 3], [4, 5, 6], [7, 8, 9]]}, "1 2 3 6 9 8 7 4 5"),
    ("prime_factorization", {"number": 360}, "2 × 2 × 2 × 3 × 3 × 5"),
    ("base_conversion", {"text": "ff", "source": 16, "target": 2}, "11111111"),
    ("count_primes", {"start": 10, "end": 30}, "6"),
]


def oracle_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated rows with their answers."""
    rows = spark.createDataFrame([(i, t, json.dumps(x)) for i, (t, x, _) in enumerate(CASES)], "id long, task string, x string")
    return rows.select("id", "task", op.canonical_answer("task", "x").alias("answer"))


def math_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems whose shapes a held-out set lacks, with the answer that their text alone gives."""
    held = op.problems(spark, 40, 3)
    rows = op.held_out_shapes(op.problems(spark, 400, 4), held)
    return rows.select("seed", "shape", "answer", op.solved("prompt").alias("solved"), (op.solved("prompt") == F.col("answer")).alias("agrees"))


QUERIES = {f.__name__: f for f in (forward_chain, closure_level, prime_counts, base_conversion, letter_containment, oracle_answers, math_problems)}

_CLOSURE = """RECURSIVE facts AS (SELECT c_custkey AS person, unnest([CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END, CASE WHEN c_custkey % 3 = 0 THEN 'r' ELSE 'z' END]) AS atom FROM customer),
have AS (SELECT person, list(atom) AS atoms, 0::BIGINT AS level FROM facts GROUP BY person UNION ALL
  SELECT person, list_distinct(list_concat(atoms, fired)), level + 1 FROM (SELECT *, list_filter(list_concat(
    CASE WHEN list_contains(atoms, 'a') THEN ['b'] ELSE [] END, CASE WHEN list_contains(atoms, 'b') AND list_contains(atoms, 'r') THEN ['c'] ELSE [] END,
    CASE WHEN list_contains(atoms, 'c') THEN ['d'] ELSE [] END, CASE WHEN list_contains(atoms, 'd') AND list_contains(atoms, 'a') THEN ['e'] ELSE [] END), lambda x: NOT list_contains(atoms, x)) AS fired FROM have) WHERE len(fired) > 0),
closure AS (SELECT person, atom, min(level) AS level FROM (SELECT person, unnest(atoms) AS atom, level FROM have) GROUP BY ALL)"""
_QUOTED = ", ".join("NULL" if a is None else "'" + a.replace("\n", "' || chr(10) || '") + "'" for _, _, a in CASES)
ORACLES = {
    "forward_chain": f"WITH {_CLOSURE} SELECT person, atom FROM closure",
    "closure_level": f"WITH {_CLOSURE} SELECT atom, level, count(*) AS people FROM closure GROUP BY ALL",
    "prime_counts": "WITH c AS (SELECT DISTINCT a * b AS n FROM range(2, 55) x(a), range(2, 1500) y(b) WHERE a * b < 3000) SELECT n, CAST(sum(CASE WHEN n IN (SELECT n FROM c) THEN 0 ELSE 1 END) OVER (ORDER BY n) AS BIGINT) AS primes FROM range(2, 3000) r(n)",
    "base_conversion": "SELECT p_partkey, lower(to_base(p_partkey * 7919, CAST(p_partkey % 35 + 2 AS INT))) AS text, p_partkey % 35 + 2 AS base FROM part",
    "letter_containment": """WITH l AS (SELECT p_partkey, list_filter(string_split(lower(p_type), ''), lambda x: regexp_matches(x, '[a-z]')) AS n, list_filter(string_split(lower(p_name || 'aeiorst'), ''), lambda x: regexp_matches(x, '[a-z]')) AS m FROM part)
      SELECT p_partkey, len(list_filter(n, lambda x: len(list_filter(m, lambda y: y = x)) < len(list_filter(n, lambda y: y = x)))) = 0 AS fits FROM l""",
    "oracle_answers": f"SELECT unnest(range({len(CASES)})) AS id, unnest([{', '.join(repr(t) for t, _, _ in CASES)}]) AS task, unnest([{_QUOTED}]) AS answer",
}
