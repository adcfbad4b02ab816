"""Exact answers of reasoning tasks, Horn closures and problems in modular arithmetic."""

from __future__ import annotations

import graphlib
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import frozen

MODULUS = 23


def forward_chain(facts: DataFrame, rules: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(person, atom, level): the closure of facts (person, atom) under rules (rule, antecedent, head) and the round in which an atom first holds.

    A rule fires for a person who has all its antecedents. Each round joins the
    whole closure to the rules, which are few, and adds what is new; it ends when nothing is.
    """
    need = rules.groupBy("rule", "head").agg(F.countDistinct("antecedent").alias("need"))
    terms = rules.select("rule", "head", "antecedent").distinct().join(need, ["rule", "head"])
    known = frozen(facts.select("person", "atom").distinct().withColumn("level", F.lit(0).cast("long")))
    for level in range(1, max_rounds + 1):
        met = known.join(F.broadcast(terms), F.col("atom") == F.col("antecedent")).groupBy("person", "rule", "head", "need").agg(F.count("*").alias("have"))
        fired = met.filter("have = need").select("person", F.col("head").alias("atom")).distinct()
        new = frozen(fired.join(known, ["person", "atom"], "left_anti").withColumn("level", F.lit(level).cast("long")))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def prime_counts(spark, limit: int) -> DataFrame:
    """(n, primes): primes up to each n below the limit, by a sieve as an anti join and a running sum."""
    numbers = spark.range(2, limit).withColumnRenamed("id", "n")
    factors = spark.range(2, math.isqrt(limit) + 1).withColumnRenamed("id", "f")
    multiples = factors.select(F.explode(F.sequence(F.col("f") * F.col("f"), F.lit(max(4, limit)), F.col("f"))).alias("n")).distinct()
    from .schedule import offsets

    prime = numbers.join(multiples.withColumn("c", F.lit(0)), "n", "left").select("n", F.coalesce("c", F.lit(1)).cast("long").alias("p"))
    return offsets(prime, ["n"], "p", "before").select("n", (F.col("before") + F.col("p")).alias("primes"))


def matrix_text(m) -> str:
    return "\n".join(" ".join(map(str, r)) for r in m)


def schedulable(courses: list[int], needs: list[list[int]]) -> str:
    """O1: whether courses with (course, prerequisite) pairs have an order."""
    graph = graphlib.TopologicalSorter({c: set() for c in courses})
    for course, before in needs:
        graph.add(course, before)
    try:
        graph.prepare()
    except graphlib.CycleError:
        return "False"
    return "True"


def zero_distances(m: list[list[int]]) -> str:
    """O2: each cell's steps to the nearest zero, by relaxing all cells at once until nothing changes."""
    a = np.array(m)
    d = np.where(a == 0, 0, a.size + 1)
    while True:
        p = np.pad(d, 1, constant_values=a.size + 1)
        n = np.minimum(d, 1 + np.minimum.reduce([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]))
        if (n == d).all():
            return matrix_text(d.tolist())
        d = n


def infection_minutes(m: list[list[int]]) -> str:
    """O3: minutes until 2s have spread to all 1s, -1 if some stay out of reach."""
    a, minutes = np.array(m), 0
    while True:
        p = np.pad(a == 2, 1)
        new = (a == 1) & (p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:])
        if not new.any():
            return str(-1 if (a == 1).any() else minutes)
        a[new] = 2
        minutes += 1


def unequal_square(puzzle: list[list[int]], constraints: list[list]) -> str | None:
    """The only Latin square that fits given cells (0: open) and (r, c, r', c', sign) constraints; None if none or several do.

    Cells keep bit masks of open values; the cell with the fewest is tried first.
    """
    n = len(puzzle)
    cells = [(r, c) for r in range(n) for c in range(n)]
    peers = {(r, c): {(r, x) for x in range(n)} | {(x, c) for x in range(n)} for r, c in cells}
    less = [((a, b), (c, d)) if s == "<" else ((c, d), (a, b)) for a, b, c, d, s in constraints]
    found: list[dict] = []

    def settle(open_: dict) -> dict | None:
        changed = True
        while changed:
            changed = False
            for cell, mask in list(open_.items()):
                if not mask:
                    return None
                if mask & (mask - 1) == 0:
                    for p in peers[cell] - {cell}:
                        if open_[p] & mask:
                            open_[p] &= ~mask
                            changed = True
            for lo, hi in less:
                if not open_[lo] or not open_[hi]:
                    return None
                top, bottom = open_[hi].bit_length() - 1, (open_[lo] & -open_[lo]).bit_length() - 1
                a, b = open_[lo] & ((1 << top) - 1), open_[hi] & ~((1 << (bottom + 1)) - 1)
                if (a, b) != (open_[lo], open_[hi]):
                    open_[lo], open_[hi], changed = a, b, True
        return open_ if all(open_.values()) else None

    todo = [{(r, c): 1 << v if (v := puzzle[r][c]) else (1 << (n + 1)) - 2 for r, c in cells}]
    while todo and len(found) < 2:
        state = settle(todo.pop())
        if state is None:
            continue
        unsure = [c for c in cells if state[c].bit_count() > 1]
        if not unsure:
            found.append(state)
            continue
        cell = min(unsure, key=lambda c: state[c].bit_count())
        todo += [state | {cell: 1 << v} for v in range(1, n + 1) if state[cell] >> v & 1]
    if len(found) != 1:
        return None
    return matrix_text([[found[0][r, c].bit_length() - 1 for c in range(n)] for r in range(n)])


def note_fits(note: str, magazine: str) -> str:
    """Whether the magazine has all letters of the note."""
    return str(not Counter(note) - Counter(magazine))


def dice_odds(sides: list[int], target: int) -> str:
    """The probability that dice show ``target`` or more, as a reduced fraction."""
    ways = Counter({0: 1})
    for s in sides:
        ways = sum((Counter({k + f: n for k, n in ways.items()}) for f in range(1, s + 1)), Counter())
    p = Fraction(sum(n for k, n in ways.items() if k >= target), math.prod(sides))
    return f"{p.numerator}/{p.denominator}"


#: What a rewriting takes and gives, by machine A, B, C and part X, Y, Z: the first that fits is used.
REWRITES = (
    ((1, 0, 0, 0, 0, 0), (0, 0, 0, 2, 1, 0)),
    ((0, 2, 0, 0, 0, 0), (0, 0, 0, 1, 0, 0)),
    ((0, 0, 2, 0, 0, 0), (0, 0, 0, 0, 1, 0)),
    ((0, 1, 1, 0, 0, 0), (1, 0, 0, 0, 0, 0)),
    ((0, 0, 0, 1, 1, 0), (0, 0, 0, 0, 0, 1)),
)


def rewritten(machines: list[int], most: int) -> str:
    """Counts after rewriting until nothing fits or ``most`` steps are done."""
    state = np.array([*machines, 0, 0, 0])
    for _ in range(most):
        fit = next(((a, b) for a, b in REWRITES if (state >= a).all()), None)
        if fit is None:
            break
        state = state - fit[0] + np.array(fit[1])
    return " ".join(map(str, state.tolist()))


def shortest_path(edges: list[list[int]], start: int, goal: int) -> str | None:
    """The shortest path, at each step to the smallest neighbour that is nearer to the goal; None if there is none."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    steps, ring = {goal: 0}, {goal}
    while ring and start not in steps:
        ring = {m for n in ring for m in near.get(n, ()) if m not in steps}
        steps |= dict.fromkeys(ring, max(steps.values()) + 1)
    if start not in steps:
        return None
    path = [start]
    while path[-1] != goal:
        path.append(min(m for m in near[path[-1]] if steps.get(m, -1) == steps[path[-1]] - 1))
    return " ".join(map(str, path))


def largest_island(grid: list[list[int]]) -> str:
    """Cells of the largest four-connected group of ones."""
    land = {(r, c) for r, row in enumerate(grid) for c, v in enumerate(row) if v == 1}
    best = 0
    while land:
        todo, size = [land.pop()], 0
        while todo:
            r, c = todo.pop()
            size += 1
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in land:
                    land.discard(n)
                    todo.append(n)
        best = max(best, size)
    return str(best)


def rotated(m: list[list[int]], turns: int) -> str:
    """Quarter turns clockwise."""
    return matrix_text(np.rot90(np.array(m), -turns).tolist())


def spiral(m: list[list[int]]) -> str:
    """The first row, then that of what is left turned counter-clockwise, and so on."""
    a, out = np.array(m), []
    while a.size:
        out += a[0].tolist()
        a = np.rot90(a[1:])
    return " ".join(map(str, out))


def factors(n: int) -> str:
    """Prime factors, ascending, joined by the times sign."""
    out, d = [], 2
    while n > 1:
        d = next((k for k in range(d, math.isqrt(n) + 1) if n % k == 0), n)
        out.append(d)
        n //= d
    return " × ".join(map(str, out))


def in_base(text: str, source: int, target: int) -> str:
    """A number in another base up to 36, lower case."""
    return np.base_repr(int(text, source), target).lower()


def primes_between(start: int, end: int) -> str:
    """Primes from start to end, both included."""
    sieve = np.ones(max(2, end + 1), bool)
    sieve[:2] = False
    for k in range(2, math.isqrt(end) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    return str(int(sieve[start : end + 1].sum()))


ORACLES = {
    "course_schedule": lambda x: schedulable(x["courses"], x["prerequisites"]),
    "binary_matrix": lambda x: zero_distances(x["matrix"]),
    "rotten_oranges": lambda x: infection_minutes(x["matrix"]),
    "futoshiki": lambda x: unequal_square(x["puzzle"], x["constraints"]),
    "ransom_note": lambda x: note_fits(x["note"], x["magazine"]),
    "dice": lambda x: dice_odds(x["dice"], x["target"]),
    "string_splitting": lambda x: rewritten(x["machines"], x["most"]),
    "path_star": lambda x: shortest_path(x["edges"], x["start"], x["goal"]),
    "largest_island": lambda x: largest_island(x["grid"]),
    "rotate_matrix": lambda x: rotated(x["matrix"], x["turns"]),
    "spiral_matrix": lambda x: spiral(x["matrix"]),
    "prime_factorization": lambda x: factors(x["number"]),
    "base_conversion": lambda x: in_base(x["text"], x["source"], x["target"]),
    "count_primes": lambda x: primes_between(x["start"], x["end"]),
}


@F.pandas_udf(T.StringType())
def canonical_answer(task: pd.Series, row: pd.Series) -> pd.Series:
    """The answer of a task's JSON row by its oracle; null where there is no single one."""
    return pd.Series([ORACLES[t](json.loads(r)) for t, r in zip(task, row, strict=True)])


_STATED = re.compile(r"The number of (.+?) (?:is (\d+)|equals the number of (.+?) (plus|minus|times) (?:the number of (.+?)|(\d+)), modulo \d+)\.")
_ASKED = re.compile(r"Question: What is the number of (.+?)\?")
_APPLY = {"plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "times": lambda a, b: a * b}


def solve(prompt: str) -> int:
    """The asked number modulo 23, from the sentences alone; definitions may come in any order."""
    head, _, _ = prompt.partition("\nQuestion:")
    stated = {m[1]: m for m in _STATED.finditer(head)}
    asked = _ASKED.search(prompt)
    if asked is None:
        raise ValueError("nothing is asked")
    done: dict[str, int] = {}
    todo = [asked[1]]
    while todo:
        name = todo[-1]
        m = stated[name]
        if m[2]:
            done[name] = int(m[2]) % MODULUS
        else:
            missing = [x for x in (m[3], m[5]) if x and x not in done]
            if missing:
                todo += missing
                continue
            done[name] = _APPLY[m[4]](done[m[3]], done[m[5]] if m[5] else int(m[6])) % MODULUS
        todo.pop()
    return done[asked[1]]


@F.pandas_udf(T.LongType())
def solved(prompt: pd.Series) -> pd.Series:
    """G20 as a column."""
    return prompt.map(solve)


def problem(seed: int, steps: int) -> tuple[str, int, str]:
    """(prompt, answer, shape) of a chain of ``steps`` definitions whose last is asked; the shape leaves out names and order."""
    r = random.Random(f"problem-{seed}")
    names = [f"{r.choice(('red', 'blue', 'old', 'tall'))} {r.choice(('box', 'lamp', 'coin'))}s in room {i}" for i in range(2 * steps + 1)]
    values, lines, shape = {names[0]: r.randrange(MODULUS)}, [], []
    lines.append(f"The number of {names[0]} is {values[names[0]]}.")
    last, free = names[0], names[1:]
    for k in range(steps):
        name, op = free[2 * k], r.choice(sorted(_APPLY))
        if r.random() < 0.5:
            c = r.randrange(1, MODULUS)
            values[name] = _APPLY[op](values[last], c) % MODULUS
            lines.append(f"The number of {name} equals the number of {last} {op} {c}, modulo {MODULUS}.")
            shape.append(f"{op}:c")
        else:
            leaf = free[2 * k + 1]
            values[leaf] = r.randrange(MODULUS)
            values[name] = _APPLY[op](values[last], values[leaf]) % MODULUS
            lines.append(f"The number of {leaf} is {values[leaf]}.")
            lines.append(f"The number of {name} equals the number of {last} {op} the number of {leaf}, modulo {MODULUS}.")
            shape.append(f"{op}:q")
        last = name
    r.shuffle(lines)
    return " ".join(lines) + f"\nQuestion: What is the number of {last}?", values[last], "|".join(shape)


def problems(spark, n: int, steps: int) -> DataFrame:
    """(seed, prompt, answer, shape) of n problems, each made by its own seed, so that partitions don't matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, *problem(s, steps)) for s in b["id"].tolist()]
            yield pd.DataFrame(rows, columns=["seed", "prompt", "answer", "shape"])

    return spark.range(n).mapInPandas(run, "seed long, prompt string, answer long, shape string")


def held_out_shapes(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """Problems without the shapes of a protected set, one of each shape by smallest seed."""
    free = rows.join(protected.select("shape").distinct(), "shape", "left_anti")
    return free.groupBy("shape").agg(F.min_by(F.struct("seed", "prompt", "answer"), "seed").alias("x")).select("shape", "x.*")
