"""SimHash near-duplicate detection by a binary-trie self-join.

The distinct fingerprints form a binary trie. Pairs of its nodes are walked
together from the top; each level adds a bit in which the two sides differ, and
a pair is dropped as soon as it differs in more bits than allowed. The top of the trie
is cut on the driver over counts of prefixes, until a node holds at most
``leaf_size`` fingerprints; each pair of nodes that the walk reaches is one task's work.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frozen, partitions, pieces, short_batches, table
from .components import components
from .rolling import rolling, stirred, word_codes
from .set_join import GROUP, Sets, few, forest, near_sets

SHINGLE = 3
SEED = 42
BUDGET = 2
#: Distinct fingerprints below one node of the trie's top: what bounds a task's memory.
LEAF_SIZE = 32_768
#: Bits by which prefixes are counted in one round, and prefixes counted in a round: both bound what the driver sees.
STEP_BITS, MAX_COUNTS = 10, 1 << 16
#: Pairs of nodes expanded at once.
FRONT = 300_000
#: What makes two documents near copies in the pipeline: the Jaccard of their sets of shingles of so many words.
COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
#: Differing bits within which the pipeline's stage takes its first candidates from the trie.
COPY_BUDGET = 2
#: ASCII blanks to byte 32, A-Z to a-z.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shingle_parts(text: str | None, width: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``width`` words (fewer words: of the whole run; none: nothing), piece by piece. ASCII case is folded."""
    h, words, begun = xxhash.xxh64_intdigest, [], False
    for piece in pieces(text):
        words += piece.encode("utf-8", "replace").lower().split()
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = len(words) - width + 1
        yield np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, last)
        words, begun = words[last:], True
    if words and not begun:
        yield np.array([h(b" ".join(words), seed)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the hashes of all parts."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for i in range(0, len(hashes), 65_536):
            part = np.ascontiguousarray(hashes[i : i + 65_536], dtype="<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; without words it is zero."""
    return majority(shingle_parts(text, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed 64-bit number. A null text has no words."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([simhash(t, width) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


class _Links:
    """Links reduced to a spanning forest now and then: fewer than one for each fingerprint are kept."""

    def __init__(self, n: int):
        self.n, self.parts, self.size = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.size += len(a)
        if self.size > 1_000_000 + self.n:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([none, *(p[k] for p in self.parts)]) for k in (0, 1))
        _, used = forest(self.n, a, b)
        self.parts, self.size = [(a[used], b[used])], len(used)
        return self.parts[0]


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int, found) -> None:
    """Walk the tries of two sorted arrays of distinct fingerprints together (right None: a self-join).

    ``found(i, j)`` gets arrays of positions that differ in at most ``budget`` bits.
    Fronts of node pairs are cut into runs of FRONT and kept on a stack, so memory
    stays bounded whatever the number of pairs.
    """
    same, other = right is None, left if right is None else right
    if not len(left) or not len(other):
        return
    z = np.zeros(1, np.int64)
    stack = [(0, z, z + len(left), z, z + len(other), np.zeros(1, np.int8))]
    while stack:
        k, al, ah, bl, bh, err = stack.pop()
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            keep = np.bitwise_count(left[i] ^ other[j]) <= budget
            if same:
                keep &= i < j
            if keep.any():
                found(i[keep], j[keep])
            al, ah, bl, bh, err = (x[~single] for x in (al, ah, bl, bh, err))
        if not len(al) or k == 64:
            continue
        if len(al) > FRONT:
            for s in range(0, len(al), FRONT):
                stack.append((k, *(x[s : s + FRONT] for x in (al, ah, bl, bh, err))))
            continue
        bit = np.uint64(1 << (63 - k))
        below = np.uint64((1 << (64 - k)) - 1)
        am = np.searchsorted(left, (left[al] & ~below) | bit)
        bm = np.searchsorted(other, (other[bl] & ~below) | bit)
        twin = (al == bl) if same else np.zeros(len(al), bool)
        nexts = []
        for x0, x1, y0, y1, add, wanted in (
            (al, am, bl, bm, 0, None),
            (am, ah, bm, bh, 0, None),
            (al, am, bm, bh, 1, None),
            (am, ah, bl, bm, 1, ~twin),
        ):
            keep = (x0 < x1) & (y0 < y1) & (err + add <= budget)
            if wanted is not None:
                keep &= wanted
            if keep.any():
                nexts.append([x0[keep], x1[keep], y0[keep], y1[keep], err[keep] + np.int8(add)])
        if nexts:
            stack.append((k + 1, *(np.concatenate(x) for x in zip(*nexts, strict=True))))


def trie_top(distinct: DataFrame, leaf_size: int) -> list[tuple[int, int]]:
    """(depth, prefix) of nodes that part all fingerprints, each over at most leaf_size of them.

    A round counts the prefixes of up to STEP_BITS more bits below nodes that are too large, of so many
    that the driver sees at most MAX_COUNTS counts, or two for each such node; of these there are at most
    total / leaf_size at any depth, however the fingerprints lie.
    """
    total = distinct.count()
    heavy, leaves, depth = [(0, 0)] if total > leaf_size else [], [] if total > leaf_size else [(0, 0)], 0
    while heavy:
        to = min(64, depth + max(1, min(STEP_BITS, (MAX_COUNTS // len(heavy)).bit_length() - 1)))
        rows = distinct
        if depth:
            known = distinct.sparkSession.createDataFrame([(_signed(p),) for _, p in heavy], "p long")
            rows = rows.withColumn("p", F.shiftrightunsigned("fp", 64 - depth)).join(known, "p", "left_semi")
        at = F.shiftrightunsigned("fp", 64 - to) if to < 64 else F.col("fp")
        counts = sorted((int(r["q"]) % 2**64, r["n"]) for r in rows.groupBy(at.alias("q")).agg(F.count("*").alias("n")).collect())
        keys, sums = [q for q, _ in counts], [0, *itertools.accumulate(n for _, n in counts)]
        more = []
        for d, p in heavy:
            inner = [(d, p)]
            while inner:
                d2, p2 = inner.pop()
                lo, hi = (bisect.bisect_left(keys, x << (to - d2)) for x in (p2, p2 + 1))
                n = sums[hi] - sums[lo] if d2 > d else leaf_size + 1
                if n and n <= leaf_size:
                    leaves.append((d2, p2))
                elif n and d2 == to:
                    more.append((d2, p2))
                elif n:
                    inner += [(d2 + 1, 2 * p2), (d2 + 1, 2 * p2 + 1)]
        heavy, depth = more, to
    return sorted(leaves, key=lambda x: x[1] << (64 - x[0]))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def near_leaves(a: int, lows: np.ndarray, depths: np.ndarray, budget: int) -> list[int]:
    """The leaves, a itself included, whose common prefix bits with leaf a differ in at most ``budget`` places: a walk of the trie beside a's prefix."""
    own, depth = int(lows[a]), int(depths[a])
    found: list[int] = []
    stack = [(0, 0, len(lows), 0)]
    while stack:
        k, lo, hi, err = stack.pop()
        if k >= depth or (hi - lo == 1 and depths[lo] <= k):
            found += range(lo, hi)
            continue
        # the first leaf of the range whose bit k is set; all share the bits before
        start = int(lows[lo]) >> (64 - k) << (64 - k) if k else 0
        m = bisect.bisect_left(lows, start | 1 << (63 - k), lo, hi)
        bit = own >> (63 - k) & 1
        for x0, x1, side in ((lo, m, 0), (m, hi, 1)):
            if x0 < x1 and err + (side != bit) <= budget:
                stack.append((k + 1, x0, x1, err + (side != bit)))
    return found


def links(distinct: DataFrame, budget: int = BUDGET, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(u, v) over distinct fingerprints ``fp``: pairs within ``budget`` bits whose components are those of all such pairs.

    Each task walks one pair of trie nodes and returns a spanning forest of its links, so
    that dense groups give a row for each fingerprint, not for each pair; no link between components is lost.
    """
    leaves = trie_top(distinct, leaf_size)
    lows, depths = np.array([p << (64 - d) for d, p in leaves], np.uint64), np.array([d for d, _ in leaves], np.uint8)
    n_leaves = len(leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            yield pd.DataFrame({"leaf": np.searchsorted(lows, fp.view(np.uint64), "right") - 1, "fp": fp})

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"leaf": [key[0]], "fps": [np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64)).tobytes()]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for leaf, fps in zip(b["leaf"].tolist(), b["fps"], strict=True):
                tasks = [min(leaf, x) * n_leaves + max(leaf, x) for x in near_leaves(leaf, lows, depths, budget)]
                yield pd.DataFrame({"task": tasks, "leaf": leaf, "fps": [fps] * len(tasks)})

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = divmod(int(key[0]), n_leaves)
        fps = {leaf: np.frombuffer(x, np.uint64) for leaf, x in zip(rows["leaf"], rows["fps"], strict=True)}
        if a == b:
            fp = fps[a]
            found = _Links(len(fp))
            trie_join(fp, None, budget, found.add)
        else:
            fp, n = np.concatenate((fps[a], fps[b])), len(fps[a])
            found = _Links(len(fp))
            trie_join(fps[a], fps[b], budget, lambda x, y: found.add(x, n + y))
        u, v = found.settle()
        signed = fp.view(np.int64)
        return pd.DataFrame({"u": signed[u], "v": signed[v]})

    # each fingerprint is shuffled once, to its node; from there whole nodes go to their tasks as packed arrays.
    # Tasks are sent the nodes' bounds, nine bytes for each leaf_size fingerprints; whom a node meets is found where it lies
    nodes = distinct.select("fp").mapInPandas(place, "leaf int, fp long").groupBy("leaf").applyInPandas(pack, "leaf int, fps binary")
    dealt = nodes.mapInPandas(deal, "task long, leaf int, fps binary")
    return dealt.repartition(max(partitions(distinct), min(4 * n_leaves, 20_000)), "task").groupBy("task").applyInPandas(walk, "u long, v long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    Rows whose fingerprints are joined by a chain of links of at most ``budget``
    differing bits share a component, named by its smallest doc_id. A null or
    wordless text has fingerprint zero and links like any other; a null doc_id
    never names a component unless all its doc_ids are null; repeated rows stay
    repeated; an empty table gives an empty one; further columns are ignored.
    Copies share a fingerprint and are taken together before any join.
    """
    own = frozen(fingerprints(docs))
    distinct = frozen(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    parts = components(links(distinct, budget, leaf_size))
    low = distinct.join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = low.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = low.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: fingerprint and component of every document."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rolled_shingles(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Rolling hashes of the runs of ``width`` words (fewer words: of the whole run; none: nothing), piece by piece. ASCII case is folded."""
    plain, begun = b"", False
    for piece in pieces(text):
        kept = plain.rsplit(None, width - 1)[1 - width :] if width > 1 else []
        plain = b" ".join([*kept, piece.encode("utf-8", "replace").translate(_PLAIN)])
        _, _, code = word_codes(plain)
        if len(code) >= width:
            yield stirred(rolling(code, width))
            begun = True
    _, _, code = word_codes(b"" if begun else plain)
    if len(code):
        yield stirred(rolling(code, len(code)))


def shingle_sets(width: int = COPY_SHINGLE) -> Sets:
    """For each text the ascending set of its shingles' rolling hashes, and their fingerprint."""

    def of(text: str | None) -> tuple[np.ndarray, int]:
        parts = [*rolled_shingles(text, width)]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), majority(parts)

    return lambda: of


def near_copies(docs: DataFrame, width: int = COPY_SHINGLE, least: float = COPY_SIMILARITY, budget: int = COPY_BUDGET, group: int | None = None) -> DataFrame:
    """(doc_id, h, component_id) for each row of docs, h being its text's hash.

    Rows joined by a chain of texts whose sets of ``width``-word shingles have a
    Jaccard of ``least`` or more share a component, named by its smallest doc_id
    (null only if all its doc_ids are). The trie's links between the fingerprints of these shingles
    come first, each verified by the Jaccard; pairs farther apart than ``budget`` bits, which most at 0.8 are,
    come from the exact join of ``set_join``. Texts without words are alike.
    """

    def early(classes: DataFrame) -> DataFrame:
        low = frozen(classes.groupBy("fp").agg(F.min("key").alias("rep")))
        same = classes.join(low, "fp").filter("key <> rep").select(F.least("key", "rep").alias("a"), F.greatest("key", "rep").alias("b"))
        near = links(low.select("fp"), budget).join(low.select(F.col("fp").alias("u"), F.col("rep").alias("x")), "u").join(low.select(F.col("fp").alias("v"), F.col("rep").alias("y")), "v")
        return same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()

    return near_sets(docs, shingle_sets(width), least, group or GROUP, early=early).select("doc_id", "h", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (five-word shingles, Jaccard 0.8 or more) the document of the smallest doc_id stays.

    doc_id is the key: of rows that share it and the text one stays; where a doc_id
    repeats with different texts, each text goes or stays by its own component. Rows with a null doc_id all stay, since
    nothing tells which document they belong to.
    """
    rows = frozen(near_copies(docs))
    drop = rows.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h")).distinct()
    drop = few(drop)
    # the hash of a null text is a number as well
    kept = docs.join(drop, (docs["doc_id"] == drop["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == drop["_h"]), "left_anti")
    again = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return kept
    twice = kept.join(again, kept["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, kept["doc_id"] == again["_again"], "left_anti").unionByName(twice)
