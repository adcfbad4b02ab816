"""Components of texts whose sets are alike: an exact self-join by Jaccard.

Each text becomes a set of 64-bit hashes. Texts of the same set form a class;
two classes that are alike enough share one of the rarest members of each (prefix
filtering), and what shares one is compared by profiles first and in full then.
Nothing is sampled or capped: the sample of common members only orders the sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen, partitions, short_batches
from .components import components

#: One in so many documents (and no fewer than SAMPLE_ROWS) has its members counted to order all members by; and common
#: members sent to every task, 12 bytes each. Both only steer the cost: any order gives all pairs.
SAMPLE_PART, SAMPLE_ROWS, MAX_COMMON = 4, 8_000, 2_000_000
#: Classes that share a member are all paired up to this number; more are linked to two of them first.
GROUP = 32
#: Members (hashes) of the sets that one task holds of each side when the components of a large group are compared.
BLOCK = 1 << 18
#: Rows of three numbers that are broadcast; more are joined by shuffling the texts.
MAX_BROADCAST = 200_000
#: Entries of one bucket.
BUCKET_ENTRIES = 250_000

#: What turns a text into (its ascending set of hashes, a fingerprint that only ``early`` reads); made once in each task.
Sets = Callable[[], Callable[[str | None], tuple[np.ndarray, int]]]


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard of two sorted sets; 0 as soon as it can't reach ``least``. Two empty sets are alike."""
    n, m = len(a), len(b)
    if not n and not m:
        return 1.0
    if min(n, m) < least * max(n, m):
        return 0.0
    need = math.ceil(least / (1 + least) * (n + m) - 1e-9)
    common, at = 0, 0
    for i in range(0, n, 4096):
        part = a[i : i + 4096]
        end = int(np.searchsorted(b, part[-1], "right"))
        common += len(np.intersect1d(part, b[at:end], assume_unique=True))
        at = end
        if common + min(n - i - len(part), m - at) < need:
            return 0.0
    return common / (n + m - common)


def common_members(texts: DataFrame, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes that several of a sample of texts hold, and how many do."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = texts.count()
    if not total:
        return none
    sample = texts.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(1_000_000)) < int(min(1.0, max(1 / SAMPLE_PART, SAMPLE_ROWS / total)) * 1_000_000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = sets()
        for b in batches:
            yield pd.DataFrame({"s": np.concatenate([of(t)[0] for t in b["text"]] or [none[0]]).view(np.int64)})

    counts = sample.select("text").mapInPandas(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    counts = frozen(counts.select("s", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")))
    by_count = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()
    # as many of the most frequent counts as fit
    least, size = 2**31, 0
    for r in by_count:
        size += r["k"]
        if size > MAX_COMMON:
            break
        least = r["n"]
    rows = counts.filter(F.col("n") >= least).toArrow()
    s, n = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("s", "n"))
    s = s.astype(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], n[order]


def rarest(s: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The members, rarest first, of which a set that is alike enough must share one (prefix filtering holds for any order)."""
    seen = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        seen = np.where(common[at] == s, counts[at], 0)
    return s[np.lexsort((s, seen))][: len(s) - math.ceil(least * len(s) - 1e-9) + 1]


def may_be_alike(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m members that share the one at places p and q of their orders can reach ``least``."""
    most = np.minimum(p, q) + np.minimum(n - p, m - q)
    return (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9) & (most >= least / (1 + least) * (n + m) - 1e-9)


_ENTRY = np.dtype([("s", "<u8"), ("key", "<i8"), ("n", "<i4"), ("p", "<i4")])


def _pairs(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, least: float) -> pd.DataFrame:
    keep = may_be_alike(x["n"][i], x["p"][i], y["n"][j], y["p"][j], least)
    a, b = x["key"][i[keep]], y["key"][j[keep]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def few(rows: DataFrame) -> DataFrame:
    """rows, checkpointed, to be broadcast as long as there are at most MAX_BROADCAST."""
    rows = frozen(rows)
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def profile(s: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of 256 classes: two sets share no more than the sum of the smaller counts."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 2**16 - 1).astype(np.uint16)


def profiles_allow(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two profiles leave ``least`` in reach; a count at its end tells nothing."""
    if max(a.max(), b.max()) == 2**16 - 1:
        return True
    n = int(a.sum(dtype=np.int64) + b.sum(dtype=np.int64))
    return int(np.minimum(a, b).sum(dtype=np.int64)) >= least / (1 + least) * n - 1e-9


def alike(pairs: DataFrame, classes: DataFrame, texts: DataFrame, sets: Sets, least: float) -> DataFrame:
    """(u, v): the pairs (a, b) of classes whose sets reach ``least``: by their profiles first, those left compared in full."""

    def kept(pairs: DataFrame, of, test) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = few(classes.join(ends, "key").select("key", F.col("low").alias("_low"), F.col("h").alias("_h")))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = sets()
            for b in batches:
                yield pd.DataFrame({"key": b["key"], "x": [of(own(t)[0]).tobytes() for t in b["text"]]})

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[["a", "b"]][np.array([test(x, y) for x, y in zip(b["x"], b["y"], strict=True)], bool)]

        own = texts.join(wanted, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_low"))).select("key", "text")
        held = own.mapInPandas(run, "key long, x binary").dropDuplicates(["key"])
        both = pairs.join(held.select(F.col("key").alias("a"), "x"), "a").join(held.select(F.col("key").alias("b"), F.col("x").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")

    likely = frozen(kept(pairs, profile, lambda x, y: profiles_allow(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), least)))
    full = kept(likely, lambda s: s, lambda x, y: jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) >= least)
    return full.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    a, b = parts.select(F.col("node").alias("a"), F.col("root").alias("_ra")), parts.select(F.col("node").alias("b"), F.col("root").alias("_rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def length_partition(n: np.ndarray, least: float) -> np.ndarray:
    """The partition of sets of n > 0 members: sets whose lengths' ratio reaches ``least`` lie in the same or the next one."""
    return np.floor(np.log(n) / -math.log(least) + 1e-9).astype(np.uint64)


def near_sets(docs: DataFrame, sets: Sets, least: float, group: int = GROUP, by_length: bool = False, early: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, h, class_id, component_id) for each row of docs, h being its text's hash.

    Rows joined by a chain of texts whose sets have a Jaccard of ``least`` or
    more share a component; those of the same set share a class. Both are named by
    their smallest doc_id (null only if all are null). Every such pair is in reach. Where more
    than ``group`` classes share a member, each is first compared with two of them; what lies outside the
    largest component by then is held against all of them, block against block. Texts without members are alike.

    ``by_length`` also parts the groups by the sets' lengths: a set meets those of its own partition and the next.
    ``early`` gives candidates (a, b) from classes (key, fp), which are compared first: what they join isn't compared again.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = spark.sparkContext.broadcast(common_members(texts, sets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, (common, counts) = sets(), ordered.value
        for b in batches:
            found = [of(t) for t in b["text"]]
            key = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s, _ in found], np.uint64).view(np.int64)
            fp = np.array([f for _, f in found], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "key": key, "fp": fp, "n": [len(s) for s, _ in found], "prefix": [rarest(s, common, counts, least).tobytes() for s, _ in found]})

    # ids travel as text: pandas would turn a column with nulls into floating point
    own = texts.select(F.col("doc_id").cast("string").alias("id"), "h", "text").mapInPandas(run, "id string, h long, key long, fp long, n int, prefix binary")
    own = frozen(own.withColumn("doc_id", F.col("id").cast("long")).drop("id"))
    # the row of a class whose text is compared: that of the smallest doc_id, nulls last
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "fp", "n")).alias("f")
    classes = frozen(own.groupBy("key").agg(first).select("key", F.col("f.doc_id").alias("low"), F.col("f.h").alias("h"), F.col("f.fp").alias("fp"), F.col("f.n").alias("n")))
    linked = parts = None
    if early is not None:
        linked = frozen(alike(frozen(early(classes.filter("n > 0").select("key", "fp"))), classes, texts, sets, least))
        parts = components(linked)
    entries = own.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(partitions(docs), entries * (2 if by_length else 1) // 8 // BUCKET_ENTRIES)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("key")
            prefix = [np.frombuffer(x, np.uint64) for x in b["prefix"]]
            size = np.array([len(x) for x in prefix], np.int64)
            x = np.empty(size.sum(), _ENTRY)
            x["s"], x["key"], x["n"] = np.concatenate([*prefix, np.zeros(0, np.uint64)]), np.repeat(b["key"], size), np.repeat(b["n"], size)
            x["p"] = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            if by_length and len(x):
                x = np.concatenate((x, x))
                part = length_partition(x["n"], least)
                part[len(part) // 2 :] += np.uint64(1)
                x["s"] ^= (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            to = (x["s"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            used, start = np.unique(to[order], return_index=True)
            yield pd.DataFrame({"bucket": used, "entries": [part.tobytes() for part in np.split(x[order], start[1:])] if len(x) else []})

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["entries"]), _ENTRY)
        x = x[np.lexsort((x["key"], x["n"], x["s"]))]
        x = x[np.concatenate(([True], (x["s"][1:] != x["s"][:-1]) | (x["key"][1:] != x["key"][:-1])))]
        _, start, size = np.unique(x["s"], return_index=True, return_counts=True)
        first, of = np.repeat(start, size), np.repeat(size, size)
        x, first, of = x[of > 1], (first - np.cumsum(of == 1)[first])[of > 1], of[of > 1]
        at, small, out, made = np.arange(len(x)), of <= group, [], 0
        for d in range(1, min(group, int(of.max(initial=1)))):
            i = at[(at - first + d < of) & (small | (d == 1))]
            out.append(_pairs(x, i, x, i + d, least))
            made += len(out[-1])
            if made > 500_000:
                out = [pd.concat(out).drop_duplicates()]
                made = 0
        i = at[~small & (at > first)]
        out.append(_pairs(x, first[i], x, i, least))
        pairs = pd.concat(out).drop_duplicates()
        # the members of large groups go on as arrays, group after group
        members = np.empty(int((~small).sum()), _MEMBER)
        for c in _MEMBER.names:
            members[c] = x[c][~small]
        large = [g.tobytes() for g in np.split(members, np.flatnonzero(members["s"][1:] != members["s"][:-1]) + 1) if len(g)]
        return pd.concat([pd.DataFrame({"a": pairs["a"], "b": pairs["b"], "group": None}), pd.DataFrame({"a": 0, "b": 0, "group": large})])

    dealt = own.filter("n > 0").select("key", "n", "prefix").mapInPandas(deal, "bucket long, entries binary")
    met = frozen(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "a long, b long, group binary"))
    pairs = met.filter("group is null").select("a", "b").distinct()
    pairs = frozen(pairs if parts is None else _apart(pairs, parts))
    more = alike(pairs, classes, texts, sets, least)
    linked = frozen(more if linked is None else linked.union(more))
    parts = components(linked)
    groups = met.filter("group is not null").select("group")
    if not groups.isEmpty():
        more = _across(groups, parts, classes, texts, sets, least)
        if not more.isEmpty():
            parts = components(linked.union(more))
    named = classes.select("key", "low").join(parts.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    of_root = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_key = named.join(of_root, "root").select("key", F.col("low").alias("class_id"), "component_id")
    return own.select("doc_id", "h", "key").join(of_key, "key").select("doc_id", "h", "class_id", "component_id")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes 0..n-1 and links a-b: the smallest node of each one's component, and which links suffice to join them all (a spanning forest)."""
    root, used = np.arange(n), []
    left = np.arange(len(a))
    while True:
        ra, rb = root[a[left]], root[b[left]]
        apart = ra != rb
        left, low, high = left[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        if not len(left):
            return root, np.concatenate(used) if used else np.zeros(0, np.int64)
        # each larger root hooks itself by one link to the smallest root that it meets
        order = np.lexsort((low, high))
        first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        root[high[first]] = low[first]
        used.append(left[first])
        while (root[root] != root).any():
            root = root[root]


_MEMBER = np.dtype([("s", "<u8"), ("key", "<i8"), ("n", "<i4")])


def _open_groups(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(hub, key, n, root): the classes of the large groups that lie in several components, by the group's hub.

    The hub is the member of the smallest hash: groups of the same or nearly the same members, of which a set of
    near copies has many, mostly share it, and so are looked at once. Components come by broadcast
    while they have few nodes, else by a join of the groups' members.
    """
    schema = "hub long, key long, n int, root long"

    def hubs(x: np.ndarray, root: np.ndarray) -> pd.DataFrame:
        mixed = x["key"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return pd.DataFrame({"hub": x["key"][(mixed ^ (mixed >> np.uint64(32))).argmin()], "key": x["key"], "n": x["n"], "root": root})

    none = pd.DataFrame({"hub": [], "key": [], "n": [], "root": []}, dtype=np.int64)
    parts = frozen(parts)
    if parts.count() <= MAX_BROADCAST:
        rows = parts.select("node", "root").toArrow().sort_by("node")
        held = groups.sparkSession.sparkContext.broadcast(tuple(rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "root")))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            node, root = held.value
            for b in batches:
                out = []
                for packed in b["group"]:
                    x = np.frombuffer(packed, _MEMBER)
                    at = np.minimum(np.searchsorted(node, x["key"]), len(node) - 1)
                    own = np.where(node[at] == x["key"], root[at], x["key"]) if len(node) else x["key"]
                    if (own != own[0]).any():
                        out.append(hubs(x, own))
                yield pd.concat(out).drop_duplicates() if out else none

        return groups.mapInPandas(run, schema).distinct()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for packed in b["group"]:
                x = np.frombuffer(packed, _MEMBER)
                yield hubs(x, x["s"].view(np.int64)).rename(columns={"root": "s"})

    rows = groups.mapInPandas(spread, "hub long, key long, n int, s long")
    rows = rows.join(parts.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = rows.groupBy("s").agg(F.min("root").alias("l"), F.max("root").alias("m")).filter("l <> m").select("s")
    return rows.join(open_, "s").select("hub", "key", "n", "root").distinct()


def _across(groups: DataFrame, parts: DataFrame, classes: DataFrame, texts: DataFrame, sets: Sets, least: float) -> DataFrame:
    """(u, v): links between the components that large groups hold, as forests; groups that hang together have none left to find.

    Of a hub's classes those outside its main component are held against all, in blocks of both
    of about BLOCK hashes: a task compares the sets of two blocks and gives fewer links than it has classes.
    """
    rows = frozen(_open_groups(groups, parts))
    if rows.isEmpty():
        return rows.select(F.col("key").alias("u"), F.col("root").alias("v"))
    of_root = rows.groupBy("hub", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    main = of_root.groupBy("hub").agg(F.max(F.struct("k", "root", "n")).alias("m"), F.sum("n").alias("all"))
    main = main.select("hub", F.col("m.root").alias("main"), "all", (F.col("all") - F.col("m.n")).alias("rest"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = rows.join(main.select("hub", "main", blocks("all").alias("all"), blocks("rest").alias("rest")), "hub").withColumn("h", F.xxhash64("key"))
    # a class stands on one side, on the other, or (if one block holds all) on both
    of = lambda i, j, left, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"), right.alias("right"))
    yes, no, outside = F.lit(True), F.lit(False), F.col("root") != F.col("main")
    as_right = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: of(i, F.pmod("h", F.col("all")), no, yes))
    as_left = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: of(F.pmod("h", F.col("rest")), j, yes, no))
    place = F.when(F.col("all") == 1, F.array(of(F.lit(0), F.lit(0), outside, yes))).when(outside, F.concat(as_right, as_left)).otherwise(as_right)
    places = rows.select("hub", "key", "root", F.explode(place).alias("x"))
    wanted = few(classes.join(rows.select("key").distinct(), "key").select("key", F.col("low").alias("_low"), F.col("h").alias("_h")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sets()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "x": [own(t)[0].tobytes() for t in b["text"]]})

    own = texts.join(wanted, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_low"))).select("key", "text")
    held = own.mapInPandas(run, "key long, x binary").dropDuplicates(["key"])

    def cross(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        left, right = b[b["left"]], b[b["right"]]
        u, v, _ = _alike_blocks(*([np.frombuffer(x, np.uint64) for x in side["x"]] for side in (left, right)), left["root"].to_numpy(), right["root"].to_numpy(), least)
        # links join components: a forest over these is enough
        _, node = np.unique(np.concatenate((left["root"].to_numpy()[u], right["root"].to_numpy()[v])), return_inverse=True)
        _, used = forest(int(node.max(initial=-1)) + 1, node[: len(u)], node[len(u) :])
        return pd.DataFrame({"u": left["key"].to_numpy()[u[used]], "v": right["key"].to_numpy()[v[used]]})

    placed = places.select("hub", "key", "root", "x.i", "x.j", "x.left", "x.right").join(held, "key")
    return frozen(placed.groupBy("hub", "i", "j").applyInPandas(cross, "u long, v long"))


def _alike_blocks(left: list[np.ndarray], right: list[np.ndarray], root: np.ndarray, other: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, Jaccard) of the sets of two blocks that lie in different components and reach ``least``."""
    us, vs, js = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if left and right:
        flat = np.concatenate(right)
        names, at = np.unique(flat, return_inverse=True)
        sizes = np.array([len(x) for x in right], np.int64)
        begin = np.cumsum(sizes) - sizes
        for i, x in enumerate(left):
            k = np.minimum(np.searchsorted(names, x), len(names) - 1)
            own = np.zeros(len(names), np.int32)
            own[k[names[k] == x]] = 1
            common = np.add.reduceat(own[at], begin)
            j = common / (len(x) + sizes - common)
            hit = np.flatnonzero((j >= least) & (other != root[i]))
            us.append(np.full(len(hit), i))
            vs.append(hit)
            js.append(j[hit])
    return np.concatenate(us), np.concatenate(vs), np.concatenate(js)
