"""Sharding by a K-d tree: nodes split at distributed weighted medians along their widest dimension. DataFrame operations only.

Every level splits all nodes at once. Medians are found by histograms: a round
sums the bytes in equal steps between a node's bounds, and the next looks into
the step that holds the median, so the driver sees a bounded number of sums and never a row.
The tree is then applied to the rows as an expression, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frozen, table
from .prefix import BUCKET_ROWS, running

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Sums that a round of histograms gives at most, over all nodes; a step that holds at most TOLERANCE of its node isn't looked into.
MAX_SUMS, TOLERANCE = 1 << 16, 0.0005
#: A group of equal texts stays together up to this part of a shard's bytes; larger ones are cut into parts of about that size.
GROUP_PART = 0.125
#: Buckets in which a shard's slots are counted out, at least.
SLOT_BUCKETS = 64
#: Groups of many equal texts that are broadcast; more are joined by their hash.
MAX_BROADCAST = 200_000
#: Bits by which ties of a dimension are parted.
TIE_BITS = 24
NEVER = 2**62


def text_dimensions(text: Column) -> dict[str, Column]:
    """The dimensions of the registered query: metadata that equal texts share, each under 2**38."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    return {"bytes": F.octet_length(plain).cast("long"), "chars": F.length(plain).cast("long")}


class Tree:
    """Levels of splits. A level has for each node the dimension, the cut and the number of its left child; right is the next."""

    def __init__(self, dims: list[str]):
        self.dims, self.levels, self.rows = dims, [], 0

    def value(self, which: list[int], node: Column) -> Column:
        return F.element_at(F.array(*[F.col(d) for d in self.dims]), _at(which, node) + 1)

    def child(self, level: tuple[list[int], list[int], list[int]], node: Column) -> Column:
        which, cut, left = level
        return _at(left, node) + (self.value(which, node) >= _at(cut, node)).cast("int")

    def leaf(self, rows: DataFrame, out: str) -> DataFrame:
        """rows (with the dimensions) and ``out``, the number of the leaf."""
        rows = rows.withColumn(out, F.lit(0))
        for level in self.levels:
            rows = rows.withColumn(out, self.child(level, F.col(out)))
        return rows


def _at(values: list[int], node: Column) -> Column:
    kind = "int" if max(map(abs, values), default=0) < 2**31 else "long"
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), node + 1)


def _medians(units: DataFrame, tree: Tree, which: list[int], bounds: list[tuple[int, int] | None], shares: list[float]) -> list[int]:
    """For each node the cut of its dimension below which its share of the weight lies, to TOLERANCE of the node; NEVER where there is none to find."""
    n = len(which)
    cuts = [NEVER] * n
    window = {k: (b[0], b[1] + 1, 0, None) for k, b in enumerate(bounds) if b is not None}  # from, to, weight before, of all
    while window:
        steps = max(16, MAX_SUMS // len(window))
        width = {k: max(1, -(-(w[1] - w[0]) // steps)) for k, w in window.items()}
        node = F.col("node")
        inside = units.select("node", "weight", tree.value(which, node).alias("v"), _at([window[k][0] if k in window else 0 for k in range(n)], node).alias("lo"),
                              _at([window[k][1] if k in window else 0 for k in range(n)], node).alias("hi"), _at([width.get(k, 1) for k in range(n)], node).alias("step"))
        sums = inside.filter("v >= lo and v < hi").groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("weight").alias("w")).collect()
        own: dict[int, dict[int, int]] = {k: {} for k in window}
        for r in sums:
            own[r["node"]][r["bin"]] = r["w"]
        following = {}
        for k, (lo, hi, before, total) in window.items():
            total = sum(own[k].values()) if total is None else total
            goal, run, last = shares[k] * total, before, max(own[k])
            for b in sorted(own[k]):
                if run + own[k][b] >= goal or b == last:
                    break
                run += own[k][b]
            start, end, w = lo + b * width[k], min(hi, lo + (b + 1) * width[k]), own[k][b]
            if w <= TOLERANCE * total or end - start == 1:
                cuts[k] = start if goal - run < run + w - goal else end
            else:
                following[k] = (start, end, run, total)
        window = following
    return cuts


def grow(units: DataFrame, dims: list[str], shards: int) -> Tree:
    """The tree of as many leaves as shards over units (weight, and each dimension as a long under 2**62)."""
    tree, counts, span = Tree(dims), [shards], None
    units = frozen(units.withColumn("node", F.lit(0)))
    while max(counts) > 1:
        found = units.groupBy("node").agg(*[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        box = {r["node"]: [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(len(dims))] for r in found}
        span = span or [max(1, hi - lo) for lo, hi in box.get(0, [(0, 0)] * len(dims))]
        which = [max(range(len(dims)), key=lambda i: ((box[k][i][1] - box[k][i][0]) / span[i], -i)) if k in box else 0 for k in range(len(counts))]
        bounds = [box[k][which[k]] if k in box and c > 1 else None for k, c in enumerate(counts)]
        cuts = _medians(units, tree, which, bounds, [(c // 2) / c for c in counts])
        left, after = [], []
        for c in counts:
            left.append(len(after))
            after += [c // 2, c - c // 2] if c > 1 else [c]
        level = (which, cuts, left)
        tree.levels.append(level)
        units, counts = frozen(units.withColumn("node", tree.child(level, F.col("node")))), after
    return tree


def planned(docs: DataFrame, dims: dict[str, Column], shards: int = SHARDS, target_bytes: int | None = None) -> tuple[DataFrame, Tree]:
    """docs with ``size`` and the tree's dimensions, and the tree; docs is read once more by whoever uses both.

    With target_bytes, there are as many shards as bring leaves down to it. Rows
    with equal dimensions and text form a unit; a unit of more than GROUP_PART
    of a shard (there are at most shards / GROUP_PART such, joined as a table) is cut in parts by the hash of doc_id, so no group overfills a leaf.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"_d{i}" for i in range(len(dims))]
    rows = docs.withColumn("size", F.octet_length(text).cast("long") + ROW_BYTES).withColumn("_h", F.xxhash64(text))
    for name, c in zip(names, dims.values(), strict=True):
        rows = rows.withColumn(name, F.coalesce(c.cast("long"), F.lit(0)))
    slim = frozen(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "_h", *names))
    total, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    limit = max(1, int(GROUP_PART * total / shards))
    groups = frozen(slim.groupBy("_h", *names).agg(F.sum("size").alias("w")))
    hot = groups.groupBy("_h").agg(F.sum("w").alias("w")).filter(F.col("w") > limit)
    hot = frozen(hot.select(F.col("_h").alias("_hot"), F.ceil(F.col("w") / limit).cast("long").alias("_parts")))
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= MAX_BROADCAST else hot

    def keyed(df: DataFrame) -> DataFrame:
        df = df.join(hot, F.col("_h") == F.col("_hot"), "left") if n_hot else df.withColumn("_parts", F.lit(1))
        part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("part")), F.coalesce("_parts", F.lit(1)))
        df = df.withColumn("_t", F.pmod(F.xxhash64("_h", part.cast("long")), F.lit(1 << TIE_BITS)))
        left = [c for c in df.columns if c not in (*names, "_t", "_hot", "_parts")]
        return df.select(*left, *[(F.col(d) * (1 << TIE_BITS) + F.col("_t")).alias(d) for d in names])

    # copies are summed up before the tree is grown
    tree = grow(keyed(slim).groupBy(*names).agg(F.sum("size").alias("weight")), names, shards)
    tree.rows = n
    return keyed(rows).drop("_h"), tree


def _slot_bucket(tree: Tree) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("size")), F.lit(max(SLOT_BUCKETS, -(-tree.rows // BUCKET_ROWS))))


def sharded(docs: DataFrame, dims: dict[str, Column] | None = None, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """docs with ``size``, ``shard`` and ``slot``; slots count each shard's rows from 0 without gaps.

    Sizes of shards are near equal; equal texts share a shard unless they are too
    many for one. Null texts count as empty, null ids hash like any other value;
    repeated rows have slots of their own; an empty table gives none. Columns of
    docs called size, shard or slot are replaced.
    """
    docs = docs.drop("size", "shard", "slot")
    rows, tree = planned(docs, dims or text_dimensions(F.col("text")), shards, target_bytes)
    placed = tree.leaf(rows, "shard").drop(*tree.dims)
    return running(placed, ["shard"], _slot_bucket(tree), [F.col("doc_id"), F.col("size")], F.lit(1), "slot").withColumn("slot", F.col("slot").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: shard and slot of every document; shards are near equal by bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    # only digests of the texts are dealt to the shards
    slim = docs.select("doc_id", "text", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, tree = planned(slim, text_dimensions(F.col("text")))
    placed = tree.leaf(rows.drop("text"), "shard").drop(*tree.dims)
    placed = running(placed, ["shard"], _slot_bucket(tree), [F.col("doc_id"), F.col("text_crc32")], F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its size, shard and slot."""
    return sharded(docs)
