"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays, memory-mapped by workers.

Two passes over the training texts. The first counts words: a word's id is the
position of its 64-bit hash in one sorted array. The second counts bigrams as
pairs of ids. Counts travel between tasks as packed sorted arrays; each shard
of the result is a file of sorted keys with their counts below the shared folder,
which scoring tasks map into memory and search. Nothing is pruned.
"""

from __future__ import annotations

import io
import itertools
import json
import os
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, frozen, new_folder, pieces, put_file, remove_folder, short_batches, table

#: Folds by crc32 of the doc_id; fold 0 is held out.
FOLDS = 10
#: Training tokens for each shard of the counts, which bounds a task's memory; never fewer than MIN_SHARDS.
SHARD_TOKENS, MIN_SHARDS = 4_000_000, 8
#: A word that begins more than this part of a shard's tokens is spread over all shards by the following word.
HOT_PART = 0.25
#: Words that a worker remembers; tokens processed at once.
CACHE, RUN_TOKENS = 400_000, 1_000_000
#: Files that a task has mapped at once (each takes a descriptor), and bytes of those that it had to read instead.
MAX_OPEN, MAX_HELD = 256, 512 << 20
#: What smooths the base score.
BASE_ADD = 0.1
#: The token that ends a text, and so stands before the next one's first word. No word has white space.
END = b" end "


def tokens(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, and the end."""
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def token_parts(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a whole text, piece by piece; only the last part, which the end closes, may hold no word."""
    words: list[bytes] = []
    for piece in pieces(text):
        if words:
            yield words
        words = piece.encode("utf-8", "replace").lower().split()
    words.append(END)
    yield words


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; the first ascends and is kept as differences."""
    head, body = [], []
    for k, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        if k == 0 and len(a):
            a = np.concatenate((a[:1], np.diff(a)))
        head.append([a.dtype.str, len(a)])
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    meta = json.dumps(head).encode()
    return len(meta).to_bytes(4, "little") + meta + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    head, body, at, out = json.loads(data[4 : 4 + n]), zstandard.ZstdDecompressor().decompress(data[4 + n :]), 0, []
    for k, (kind, length) in enumerate(head):
        size = np.dtype(kind).itemsize * length
        planes = np.frombuffer(body, np.uint8, size, at).reshape(np.dtype(kind).itemsize, length)
        a = np.ascontiguousarray(planes.T).view(kind).reshape(length)
        out.append(np.cumsum(a, dtype=a.dtype) if k == 0 else a)
        at += size
    return out


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct ascending keys with the sums of their counts."""
    if not len(keys):
        return [keys, *counts]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(c[order], first) for c in counts)]


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the numbers of items counted 1 to 4 times.

    Where those are too few for the formula the discount is half the count, and it never leaves (0, count).
    """
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] and n[1] else 0.5 * k
        out.append(d if 0 < d < k else 0.5 * k)
    return out


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].tolist()


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all tasks need. ``hot`` has at most shards / HOT_PART ids."""

    folder: str
    shards: int = 0
    n: int = 0
    v: int = 0
    sizes: list[int] = field(default_factory=list)
    hot: list[int] = field(default_factory=list)
    unigram: list[float] = field(default_factory=list)
    bigram: list[float] = field(default_factory=list)
    rest: float = 1.0
    pairs: int = 0


def shard_of(first: np.ndarray, second: np.ndarray, shards: int, v: int, hot: np.ndarray) -> np.ndarray:
    """The shard of a pair: by ranges of the first id; a hot first id's pairs are spread by the second."""
    own = first * shards // max(1, v)
    spread = np.isin(first, hot)
    return np.where(spread, second * 2654435761 % 2**32 % shards, own)


class Arrays:
    """The model's files as arrays: mapped into memory where the shared folder is mounted, else read from it. The least recently used are let go."""

    def __init__(self, folder: str):
        fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs, self.mounted = fs, isinstance(fs, pafs.LocalFileSystem)
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()
        self.held = 0

    def get(self, name: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path = f"{self.path}/{name}.npy"
        if self.mounted:
            # an empty array can't be mapped
            x = np.load(path) if os.path.getsize(path) <= 256 else np.load(path, mmap_mode="r")
        else:
            with self.fs.open_input_stream(path, compression=None) as source:
                x = np.load(io.BytesIO(source.read()))
        self.open[name] = x
        self.held += 0 if self.mounted else x.nbytes
        while len(self.open) > 1 and (len(self.open) > MAX_OPEN or self.held > MAX_HELD):
            _, old = self.open.popitem(last=False)
            self.held -= 0 if self.mounted else old.nbytes
        return x


def save(folder: str, name: str, a: np.ndarray) -> None:
    head = np.lib.format.header_data_from_array_1_0(a)
    top = io.BytesIO()
    np.lib.format.write_array_header_1_0(top, head)
    put_file(f"{folder}/{name}.npy", [top.getvalue(), np.ascontiguousarray(a).tobytes()])


class Ids:
    """The ids of tokens: a word's place in the sorted hashes, whose shards follow each other; -1 for words that training didn't see. A bounded number is remembered."""

    def __init__(self, arrays: Arrays, sizes: list[int]):
        self.arrays, self.sizes, self.known = arrays, sizes, {}
        self.first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids of ascending hashes."""
        out = np.full(len(h), -1, np.int64)
        for a, b in _spans(hash_shard(h, max(1, len(self.sizes)))):
            s = int(hash_shard(h[a : a + 1], len(self.sizes))[0]) if self.sizes else 0
            if not self.sizes or not self.sizes[s]:
                continue
            there, x = self.arrays.get(f"hash-{s}"), h[a:b]
            at = np.searchsorted(there, x)
            hit = at < len(there)
            hit[hit] = there[at[hit]] == x[hit]
            out[a:b][hit] = at[hit] + self.first[s]
        return out

    def of(self, run: list[list[bytes]], n: int) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        flat = list(itertools.chain.from_iterable(run))
        new = list(set(flat).difference(known))
        if new:
            h = np.fromiter(map(word_hash, new), np.uint64, len(new))
            order = np.argsort(h)
            at = np.empty(len(new), np.int64)
            at[order] = self.find(h[order])
            known.update(zip(new, at.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, flat), np.int64, n)

    def end(self) -> int:
        """The id of END."""
        return int(self.of([[END]], 1)[0])

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """The training counts of ascending ids."""
        out = np.zeros(len(ids), np.int64)
        for a, b in _spans(np.searchsorted(self.first, ids, "right") - 1):
            s = int(np.searchsorted(self.first, ids[a], "right") - 1)
            out[a:b] = self.arrays.get(f"count-{s}")[ids[a:b] - self.first[s]]
        return out


def hash_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _runs(texts) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Runs of parts of tokenised texts, in order, with the tokens of each part and the number of its text; bounded by RUN_TOKENS besides one piece."""
    run, owner, size = [], [], 0
    for k, t in enumerate(texts):
        for part in token_parts(t):
            run.append(part)
            owner.append(k)
            size += len(part)
            if size >= RUN_TOKENS:
                yield run, np.fromiter(map(len, run), np.int64, len(run)), np.array(owner)
                run, owner, size = [], [], 0
    if run:
        yield run, np.fromiter(map(len, run), np.int64, len(run)), np.array(owner)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[str | None]:
    for b in batches:
        yield from b["text"]


def _sliced(kind: str, shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """A packed row for each shard; keys ascend within each."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    parts = _spans(shard)
    return pd.DataFrame({"kind": kind, "shard": np.array([shard[a] for a, _ in parts], np.int64), "data": [pack(keys[a:b], counts[a:b]) for a, b in parts]})


ROWS = "kind string, shard long, data binary"


def _merged(blobs) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(x) for x in blobs]
    keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
    return keys, counts


def _narrow(c: np.ndarray) -> np.ndarray:
    top = int(c.max()) if len(c) else 0
    return c.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def count_words(texts: DataFrame, folder: str, shards: int, least_hot: float) -> tuple[int, list[int], list[int]]:
    """Write the shards of the sorted word hashes and their counts; training tokens, the shards' sizes, and the ids of words counted more than least_hot times."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for run, _, _ in _runs(_texts(batches)):
            seen = Counter(itertools.chain.from_iterable(run))
            h = np.fromiter(map(word_hash, seen), np.uint64, len(seen))
            keys, counts = summed(np.concatenate((keys, h)), np.concatenate((counts, np.fromiter(seen.values(), np.int64, len(seen)))))
        yield _sliced("words", hash_shard(keys, shards), keys, _narrow(counts))

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows["data"])
        save(folder, f"hash-{key[0]}", keys)
        save(folder, f"count-{key[0]}", counts)
        return pd.DataFrame({"shard": [key[0]], "n": [int(counts.sum())], "v": [len(keys)], "hot": [np.flatnonzero(counts > least_hot)]})

    got = texts.mapInPandas(count, ROWS).groupBy("shard").applyInPandas(write, "shard long, n long, v long, hot array<long>").collect()
    size = {r["shard"]: r["v"] for r in got}
    sizes = [size.get(s, 0) for s in range(shards)]
    first = np.concatenate(([0], np.cumsum(sizes))).tolist()
    return sum(r["n"] for r in got), sizes, sorted(first[r["shard"]] + x for r in got for x in r["hot"])


def count_pairs(texts: DataFrame, model: Model) -> DataFrame:
    """Write each shard's sorted pairs with their counts; gives a row of numbers for every range of word ids.

    Of each shard the contexts' sums (tokens, and followers counted once, twice and
    more often) and the continuations (distinct words before a word) go to the ranges of
    word ids, where they are added up and written as dense arrays.
    """
    folder, shards, v, hot = model.folder, model.shards, model.v, np.array(model.hot, np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(Arrays(folder), model.sizes)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts: list[np.ndarray] = []
        size, before = 0, ids.end()

        def settle():
            return summed(np.concatenate((keys, *parts)), np.concatenate((counts, np.ones(size, np.int64))))

        for run, lengths, _ in _runs(_texts(batches)):
            second = ids.of(run, int(lengths.sum()))
            parts.append(pair_keys(second, before))
            before = int(second[-1])
            size += len(second)
            if size >= 4 * RUN_TOKENS:
                keys, counts = settle()
                parts, size = [], 0
        keys, counts = settle()
        yield _sliced("pairs", shard_of(keys >> 32, keys & 0xFFFFFFFF, shards, v, hot), keys, _narrow(counts))

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows["data"])
        save(folder, f"pair-{key[0]}", keys)
        save(folder, f"times-{key[0]}", _narrow(counts))
        first, second = keys >> 32, keys & 0xFFFFFFFF
        ctx, total, one, two, more = summed(first, counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64))
        word, before = summed(second, np.ones(len(second), np.int64))
        out = []
        for kind, ids, sums in (("context", ctx, (total, one, two, more)), ("word", word, (before,))):
            to = ids * shards // v
            first_of = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            for a, b in zip(first_of.tolist(), [*first_of[1:].tolist(), len(ids)], strict=True):
                out.append((kind, int(to[a]), pack(ids[a:b], *(_narrow(x[a:b]) for x in sums))))
        out.append(("numbers", int(first[0] * shards // v), pack(np.array(np.cumsum(_counts_of_counts(counts)), np.int64), np.array([len(keys)]))))
        return pd.DataFrame(out, columns=["kind", "shard", "data"])

    def add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = key[0]
        lo, hi = -(-r * v // shards), -(-(r + 1) * v // shards)
        dense = {k: np.zeros(hi - lo, np.int64) for k in ("total", "one", "two", "more", "before")}
        numbers, pairs = np.zeros(4, np.int64), 0
        for kind, data in zip(rows["kind"], rows["data"], strict=True):
            ids, *sums = unpack(data)
            if kind == "numbers":
                numbers += np.diff(np.concatenate(([0], ids)))
                pairs += int(sums[0][0])
                continue
            for name, x in zip(("total", "one", "two", "more") if kind == "context" else ("before",), sums, strict=True):
                dense[name][ids - lo] += x.astype(np.int64)
        for name, x in dense.items():
            save(folder, f"{name}-{r}", _narrow(x))
        b = _counts_of_counts(dense["before"][dense["before"] > 0])
        return pd.DataFrame([[*numbers.tolist(), pairs, *b, int(dense["before"].sum())]], columns=[f"x{k}" for k in range(10)])

    schema = ", ".join(f"x{k} long" for k in range(10))
    pairs = texts.mapInPandas(count, ROWS).groupBy("shard").applyInPandas(write, ROWS)
    return pairs.groupBy("shard").applyInPandas(add_up, schema)


def pair_keys(ids: np.ndarray, before: int) -> np.ndarray:
    """The pairs of each token with the one before it. Texts follow each other, and END, which closes each of them, stands before the next one's first word."""
    return (np.concatenate(([before], ids[:-1])) << 32) | ids


def train(docs: DataFrame, folds: int = FOLDS) -> Model:
    """Learn from all texts whose doc_id is outside fold 0. Without any training text every token has the probability of an unknown word, 1."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.filter(fold(F.col("doc_id"), folds) != 0).select(F.col("text").cast("string"))
    model = Model(new_folder(spark, "bigrams"))
    about = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    if not about["n"]:
        return model
    # a token takes some six code points; only the number of shards and what counts as hot depend on this guess
    guess = about["c"] // 6 + about["n"]
    model.shards = max(MIN_SHARDS, -(-guess // SHARD_TOKENS))
    model.n, model.sizes, model.hot = count_words(texts, model.folder, model.shards, HOT_PART * guess / model.shards)
    model.v = sum(model.sizes)
    if model.v >= 2**31:
        raise ValueError("pairs are kept as two 31-bit ids; part the corpus")
    x = count_pairs(texts, model).agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(10)]).first()
    model.bigram, model.pairs = discounts([x[k] for k in range(4)]), x[4]
    d, total = discounts([x[k] for k in range(5, 9)]), float(x[9])
    model.unigram = [*d, total]
    # every word follows something; the mass that the words' discounts free goes evenly to all words and an unknown one
    model.rest = (d[0] * x[5] + d[1] * x[6] + d[2] * (model.v - x[5] - x[6])) / total / (model.v + 1)
    return model


class Scorer:
    """Log probabilities of tokens, from the mapped arrays."""

    def __init__(self, model: Model):
        self.m, self.a = model, Arrays(model.folder)
        self.ids = Ids(self.a, model.sizes)
        self.hot = np.array(model.hot, np.int64)
        #: the id of the token before the next run
        self.before = self.ids.end()

    def _dense(self, name: str, ids: np.ndarray) -> np.ndarray:
        """The values of distinct ascending ids, taken range by range."""
        v, shards = self.m.v, self.m.shards
        out, to = np.zeros(len(ids), np.int64), ids * shards // v
        for a, b in _spans(to):
            r = int(to[a])
            out[a:b] = self.a.get(f"{name}-{r}")[ids[a:b] - -(-r * v // shards)]
        return out

    def words(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """For distinct ascending known ids: count, unigram probability, and as contexts their sum and free mass."""
        d1, d2, d3, all_ = self.m.unigram
        before = self._dense("before", ids)
        p = (before - np.choose(np.minimum(before, 3), [0.0, d1, d2, d3])) / all_ + self.m.rest
        total = self._dense("total", ids)
        b = self.m.bigram
        free = b[0] * self._dense("one", ids) + b[1] * self._dense("two", ids) + b[2] * self._dense("more", ids)
        return {"count": self.ids.counts(ids), "p": p, "total": total, "free": np.divide(free, total, out=np.ones(len(ids)), where=total > 0)}

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """How often distinct ascending pairs were counted."""
        out = np.zeros(len(keys), np.int64)
        shard = shard_of(keys >> 32, keys & 0xFFFFFFFF, self.m.shards, self.m.v, self.hot)
        order = np.argsort(shard, kind="stable")
        for a, b in _spans(shard[order]):
            at, name = order[a:b], int(shard[order[a]])
            try:
                there = self.a.get(f"pair-{name}")
            except FileNotFoundError:  # no pair was dealt there
                continue
            k = np.searchsorted(there, keys[at])
            hit = k < len(there)
            hit[hit] = there[k[hit]] == keys[at][hit]
            out[at[hit]] = self.a.get(f"times-{name}")[k[hit]]
        return out

    def run(self, run: list[list[bytes]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each part of the run, which follows the last one: known tokens, base score and score."""
        m, ends = self.m, np.cumsum(lengths)
        ids = self.ids.of(run, int(ends[-1]))
        chain = np.concatenate(([self.before], ids))
        self.before = int(ids[-1])
        count, score = np.zeros(len(ids)), np.zeros(len(ids))
        if m.n:
            uniq, slot = np.unique(chain, return_inverse=True)
            # an unknown word is the first of them; its slot is the one beyond the others
            some = uniq >= 0
            slot = slot - (len(some) - some.sum())
            of = self.words(uniq[some])
            n = np.append(of["count"], 0)
            lower, total, free = np.append(of["p"], m.rest), np.append(of["total"], 0), np.append(of["free"], 1.0)
            own, context = slot[1:], slot[:-1]
            count = n[own].astype(float)
            p = np.where(total[context] > 0, free[context], 1.0) * lower[own]
            both = np.flatnonzero((total[context] > 0) & (own >= 0))
            if len(both):
                pair, back = np.unique((chain[:-1][both] << 32) | ids[both], return_inverse=True)
                c = self.pairs(pair)
                gain = c - np.choose(np.minimum(c, 3), [0.0, *m.bigram])
                p[both] += gain[back] / total[context[both]]
            score = np.log10(p)
        base = np.log10((count + BASE_ADD) / (m.n + BASE_ADD * (m.v + 1)))
        add = lambda x: np.add.reduceat(x, ends - lengths)
        return add((count > 0).astype(np.int64)), add(base), add(score)


def _spans(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    if not len(x):
        return []
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist()
    return list(zip(first, [*first[1:], len(x)], strict=True))


def score(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row.

    A null text is empty: its only token is the end. A null doc_id hashes as the
    empty text (fold 0). Repeated rows stay; an empty table gives none. Scores
    are sums of log10 probabilities; perplexity is 10 ** (-score / n_tokens).
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            tokens_, known, base, total = (np.zeros(len(b), kind) for kind in (np.int64, np.int64, float, float))
            for part, lengths, owner in _runs(b["text"]):
                for to, x in zip((tokens_, known, base, total), (lengths, *scorer.run(part, lengths)), strict=True):
                    np.add.at(to, owner, x)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "n_tokens": tokens_, "n_known": known, "base_score": base, "score": total})

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"), F.col("text").cast("string"))
    got = rows.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return got.withColumn("train_tokens", F.lit(model.n).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the model's score of every document beside the base score. The model's folder goes once the scores are written."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    scored = frozen(score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    remove_folder(model.folder)
    return scored
