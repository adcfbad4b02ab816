"""Connected components over an edge table: alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen


#: Links (two nodes each) that one task of a round reads; few links need no shuffle, and no small files of one.
TASK_LINKS = 500_000


def _lowest(e: DataFrame) -> DataFrame:
    """The smallest neighbour of each node u; partial minima are taken before the shuffle, so hubs are cheap."""
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _each(rows: DataFrame, *links: tuple[str, str]) -> DataFrame:
    """(u, v) by several pairs of columns of each row; unlike a union it reads the rows once and keeps their partitioning."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in links))))


def _large_star(e: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest of its neighbourhood."""
    both = _each(e, ("u", "v"), ("v", "u"))
    low = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the smallest of them; edges already lead from u to a smaller v."""
    return _each(e.join(_lowest(e), "u"), ("u", "m"), ("v", "m")).filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, root), root being the smallest node reachable; one row for each node of a link.

    Any orderable type serves as a node. Null ends and self-links are dropped (a
    node that has only those isn't listed: it is its own root). Repeated links
    count once; no links give an empty table. The large-star and small-star steps
    alternate until the edge set, which never grows beyond the links, stands
    still; each round is one checkpoint, so a lost executor costs one round. A round's tasks grow
    with its links, of which TASK_LINKS make one task. Joins lie on a node and Spark splits those of a hub (adaptive skew join).
    """
    e = edges.filter("u is not null and v is not null and u <> v")
    e = frozen(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        seen = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
        tasks = -(-seen["n"] // TASK_LINKS)
        e = frozen(_small_star(_large_star(e.coalesce(tasks))).coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
