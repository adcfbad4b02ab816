"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A spot signature is an anchor with the next CHAIN content words at a spot
distance of DISTANCE content words. A text's fingerprint is the set of its signatures'
hashes; likeness is their Jaccard. ``similar`` joins a table with itself: the
sets are partitioned by length so that only neighbouring partitions can be alike
enough, indexed by their rarest signatures, and compared by a Jaccard that stops
as soon as the threshold is out of reach.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frozen, pieces, short_batches, table
from .set_join import jaccard, near_sets

CHAIN, DISTANCE = 2, 1
SIMILARITY = 0.8
#: Common words of four languages: they anchor chains and are never part of one.
ANCHORS = frozenset(
    """
    a an and are as at be but by for from has have he in is it its not of on or she that the their they this to was we were which will with you
    als am auf aus bei das dass dem den der des die ein eine einen er es für hat ich im ist mit nach nicht sich sie sind und von wie zu zum
    au aux avec ce ces dans de du elle en est et il je la le les leur ne nous par pas plus pour que qui sa se ses son sur un une vous
    al como con del el ella era esta fue ha las lo los mas mi muy no nos para pero por si sin sobre su sus te tu una y ya
    """.split()
)
#: Words whose hashes a worker remembers.
CACHE = 150_000
#: Code points of text whose results are held at once, and of a range of documents that one task sorts.
RUN_CHARS, RANGE_CHARS = 4_000_000, 48_000_000
#: Ranges at most: their cuts are part of the plan. Beyond that ranges grow, and their sort spills.
MAX_RANGES = 20_000
_WORD = re.compile(r"[^\W\d_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


class Words:
    """64-bit word hashes, the lowest bit telling whether the word is an anchor; a bounded number is remembered."""

    def __init__(self, anchors: frozenset[str] = ANCHORS):
        self.anchors, self.known = anchors, {}

    def of(self, text: str | None) -> np.ndarray:
        parts = [self._piece(p) for p in pieces(text)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)

    def _piece(self, piece: str) -> np.ndarray:
        words = _WORD.findall(piece.lower())
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) & ~1 | (w in self.anchors)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def signatures(words: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """The sorted set of 32-bit signature hashes of a text's word hashes.

    A text in which no anchor is followed by a whole chain is taken to be
    anchored everywhere; one with too few words for that has the hash of all its
    words as its only signature; without words the set is empty.
    """
    if not len(words):
        return np.zeros(0, np.uint32)
    anchor = (words & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~anchor)
    spots = np.flatnonzero(anchor)
    first = np.searchsorted(content, spots) + distance - 1
    whole = first + (chain - 1) * distance < len(content)
    spots, first, chained = spots[whole], first[whole], words[content]
    if not len(spots):
        spots = np.arange(max(0, len(words) - chain * distance))
        first, chained = spots + distance, words
    if not len(spots):
        h = np.zeros(1, np.uint64)
        for w in words:
            h = _mix(h, np.array([w]))
    else:
        h = _mix(np.full(len(spots), _M3), words[spots])
        for k in range(chain):
            h = _mix(h, chained[first + k * distance])
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def text_of(signature_set: np.ndarray) -> str:
    """The fingerprint as text: eight hex digits for each signature, ascending."""
    return signature_set.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, signatures array<long>): ascending signature hashes of every whole text; null counts as empty."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "signatures": [signatures(words.of(t), chain, distance).astype(np.int64) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, signatures array<long>")


def length_partition(n, least: float = SIMILARITY):
    """The partition of a set of n > 0 signatures: sets whose lengths' ratio reaches ``least`` lie in the same or the next one."""
    return F.floor(F.log(n.cast("double")) / -math.log(least) + 1e-9).cast("long")


def similar(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (doc_id, class_id) of every row, and (a, b, jaccard) between classes.

    Rows with the same signature set form a class, named by its smallest doc_id;
    so copies are never paired. Two classes pair if their Jaccard reaches
    ``least``. Within a length partition and its neighbour, candidates share one
    of the rarest signatures: a set of n has n - ceil(least * n) + 1 of them, of
    which two sets that are alike enough must share one (prefix filtering). Empty sets form one class without pairs.
    """
    own = frozen(fingerprints(docs))
    members = own.withColumn("key", F.sha2(F.concat_ws(",", "signatures"), 256))
    classes = frozen(members.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures")))
    sets = classes.filter(F.size("signatures") > 0).select("key", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    counts = sets.groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.join(counts, "s").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("by"))
    prefix = ranked.select("key", "n", length_partition(F.col("n"), least).alias("part"), F.explode(F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("x"))
    prefix = prefix.select("key", "n", "part", F.col("x.s").alias("s"))
    other = prefix.select(F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("part").alias("part2"), "s")
    near = prefix.withColumn("part2", F.explode(F.array("part", F.col("part") + 1))).join(other, ["s", "part2"])
    fits = (F.least("n", "n2") >= F.greatest("n", "n2") * F.lit(least) - 1e-9) & ((F.col("part") < F.col("part2")) | (F.col("key") < F.col("key2")))
    candidates = near.filter(fits).select("key", "key2").distinct()
    left = classes.select("key", F.col("class_id").alias("a"), F.col("signatures").alias("x"))
    right = classes.select(F.col("key").alias("key2"), F.col("class_id").alias("b"), F.col("signatures").alias("y"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            j = [jaccard(np.asarray(x), np.asarray(y), least) for x, y in zip(p["x"], p["y"], strict=True)]
            out = pd.DataFrame({"a": p["a"], "b": p["b"], "jaccard": np.array(j, float)})
            yield out[out["jaccard"] >= least]

    pairs = candidates.join(left, "key").join(right, "key2").select("a", "b", "x", "y").mapInPandas(compare, "a long, b long, jaccard double")
    return members.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id"), pairs


def signature_sets() -> Callable[[str | None], tuple[np.ndarray, int]]:
    """For each text its signature set, spread over 64 bits."""
    words = Words()
    return lambda text: (np.sort(_mix(signatures(words.of(text)).astype(np.uint64), _M3)), 0)


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, component_id): classes of equal sets, and components of classes joined by chains of pairs that reach ``least``.

    Sets meet within a length partition and its neighbour, by their rarest signatures, and are compared by the
    pruned Jaccard; where many share one, not all pairs are made (see ``set_join``). Null doc_ids name nothing unless they are alone.
    """
    return near_sets(docs, signature_sets, least, by_length=True).select("doc_id", "class_id", "component_id")


def _slim(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, h): what ranges are cut by, read from the texts once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return frozen(docs.select(F.col("doc_id").cast("long"), F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("h")))


def with_following(docs: DataFrame, ranges: int, slim: DataFrame | None = None) -> DataFrame:
    """(bucket, tail, doc_id, text): rows dealt by doc_id ranges; each range ends with a ``tail`` copy of the row that follows it.

    Ranges are cut at approximate quantiles of doc_id (a few numbers on the
    driver), so that one shuffle of the texts is enough: the first row of each
    range is found beforehand among ids and hashes, and is sent to the range
    before it as well. Rows are ordered by doc_id (null first) and, where ids
    repeat, by the hash of their text.
    """
    slim = _slim(docs) if slim is None else slim
    cuts = sorted(set(slim.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    range_of = _range_of(F.col("doc_id"), [int(c) for c in cuts])
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", range_of)
    first = slim.withColumn("bucket", range_of).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h")).alias("f"))
    firsts = {r["bucket"]: r["f"] for r in first.collect()}
    used = sorted(firsts)
    if not used:
        return rows.select("bucket", F.lit(False).alias("tail"), "doc_id", "text", "h").filter("false")
    before = {b: used[i - 1] for i, b in enumerate(used)}
    # arrays by range: what a row looks up is found at once
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    every = range(used[-1] + 1)
    ids, hashes = of([firsts[b]["doc_id"] if b in firsts else None for b in every]), of([firsts[b]["h"] if b in firsts else None for b in every])
    first = ids.eqNullSafe(F.col("doc_id")) & (hashes == F.col("h"))
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("tail"))
    tail = F.struct(of([before.get(b, 0) for b in every]).cast("int").alias("to"), F.lit(True).alias("tail"))
    dealt = rows.withColumn("x", F.explode(F.when(first, F.array(own, tail)).otherwise(F.array(own))))
    return dealt.select(F.col("x.to").alias("bucket"), F.col("x.tail").alias("tail"), "doc_id", "text", "h")


def _range_of(value, cuts: list[int]):
    """The number of cuts at or below a value, 0 for null: first among every m-th cut, then among the m from there."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts)) + 1
    chunks = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    count = lambda a: F.size(F.filter(a, lambda c: c <= value))
    k = count(F.array(*[F.lit(c[0]) for c in chunks]))
    fine = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks]), F.greatest(F.lit(1), k))
    return F.when(value.isNull() | (k == 0), 0).otherwise((k - 1) * m + count(fine)).cast("int")


def edit_likeness(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text takes its new end from the next row's text by doc_id; the
    last row takes it from the first, and a lone row from itself. Null texts
    count as empty, empty ones have an empty fingerprint and two empty ones are alike.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n, slim = ranges, _slim(docs)
    if n is None:
        # as many ranges as keep each to RANGE_CHARS, and no fewer than the session deals to
        chars = slim.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
        n = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS)))
    # a range is a partition: a hash of its number would put several into one task and none into another
    dealt = with_following(docs, n, slim).repartitionById(n, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, out, chars = Words(), None, [], 0
        for b in batches:
            for bucket, tail, doc, text in zip(b["bucket"], b["tail"], b["doc_id"], b["text"], strict=True):
                own = None if held and held[0] == bucket and held[3] else signatures(words.of(text))
                if held and held[0] == bucket and not held[3]:
                    _, d, t, _, s = held
                    new = edited(t, text)
                    e = signatures(words.of(new))
                    out.append((d, len(t), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), text_of(s), text_of(e), jaccard(s, e), jaccard(s, own)))
                    chars += len(t)
                if own is not None:
                    held = (bucket, doc, text, bool(tail), own)
                if chars > RUN_CHARS:
                    yield _frame(out)
                    out, chars = [], 0
        yield _frame(out)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        return out.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": float, "near_next": float})

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("bucket", "tail", "doc_id", "text").mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: fingerprints of every document and of its edited text."""
    return edit_likeness(table(spark, sf_dir, "documents"))


def classes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's join: class and component of every document, by length partitions and pruned Jaccard over all fingerprints."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
