"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned over every document."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import frozen, pieces, short_batches, table
from .rolling import rolling, word_codes

WINDOW = 13
#: UTF-8 bytes of benchmark text in one index; more are scanned in blocks, one after the other. An index takes 3 to 13 times its text (``Index.nbytes``).
MAX_INDEX_BYTES = 8 << 20
#: Words scanned at once, at some six bytes each.
RUN_WORDS = 200_000
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Word bytes are 0-9, a-z (A-Z folded) and all of 0x80 and above; the others part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<lo:long,hi:long>>"


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, or of a piece of one."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def runs_of(text: str | None, most: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place of the first word, normalised text) of a whole text in pieces that overlap by WINDOW - 1 words, so that each window lies in one of them."""
    at, plain = 0, b""
    for piece in pieces(text, most):
        kept = plain.rsplit(None, WINDOW - 1)
        before, kept = (kept[:1], kept[1:]) if len(kept) == WINDOW else ([], kept)
        at += len(before[0].split()) if before else 0
        plain = b" ".join([*kept, piece.encode("utf-8", "replace").translate(_FOLD)])
        yield at, plain


class _Windows:
    """The windows of one length: ascending distinct hashes; of each the items that have it, and the place of its first word in the index's text."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, item: np.ndarray, words):
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        # other words under the same hash: hardly ever, and then each entry is looked at
        same = np.ones(len(at), bool)
        again = np.flatnonzero(~first)
        same[again] = [words(a) == words(b) for a, b in zip(at[again].tolist(), at[start[again]].tolist(), strict=True)]
        self.odd = frozenset(hashes[~same].tolist())
        keep = first | (item != np.concatenate(([-1], item[:-1]))) | np.isin(hashes, hashes[~same])
        kept = np.flatnonzero(keep)
        self.hashes, self.begin = hashes[first], np.append(np.searchsorted(kept, np.flatnonzero(first)), len(kept)).astype(np.int32)
        self.at, self.item = at[kept].astype(np.int32), item[kept].astype(np.int32)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[hashes >> np.uint64(44)] = True

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.begin, self.at, self.item, self.sieve))


class Index:
    """The windows of some benchmark items in arrays: rolling hashes, one sorted array for each window length, and the words to verify hits."""

    def __init__(self, items: Iterable[tuple[str, str | None]]):
        numbers: dict[str, int] = {}
        words, of = [], []
        for name, text in items:
            if own := words_of(text):
                words.append(b" ".join(own))
                of.append((numbers.setdefault(name, len(numbers)), len(own)))
        self.names = list(numbers)
        self.text = b" ".join(words)
        starts, codes, place = [], [], 0
        for own in words:
            start, _, code = word_codes(own)
            starts.append(start + place)
            codes.append(code)
            place += len(own) + 1
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        #: where each word begins, and where the one after the last would
        self.starts = np.concatenate([*starts, [len(self.text) + 1]]).astype(np.int32)
        by_size, at = {}, 0
        for number, n in of:
            size = min(WINDOW, n)
            hashes = rolling(code[at : at + n], size)
            by_size.setdefault(size, []).append((hashes, at + np.arange(len(hashes)), np.full(len(hashes), number)))
            at += n
        self.sizes = {size: _Windows(*(np.concatenate(x) for x in zip(*parts, strict=True)), functools.partial(self._words, size=size)) for size, parts in by_size.items()}

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays and texts, which are all that grows with the benchmark besides the items' names."""
        return len(self.text) + self.starts.nbytes + sum(w.nbytes for w in self.sizes.values())

    def _hits(self, docs: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
        """Of normalised texts: their word counts, and (text, place, length, items) of each occurrence of a window, verified word by word."""
        plain = b" ".join(docs)
        starts, ends, code = word_codes(plain)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        last = np.searchsorted(starts, np.cumsum(sizes + 1) - 1)  # the words up to each text's end
        begin, found = np.concatenate(([0], last[:-1])), []
        for size, w in self.sizes.items():
            h = rolling(code, size)
            at = np.flatnonzero(w.sieve[h >> np.uint64(44)])
            k = np.searchsorted(w.hashes, h[at])
            doc = np.searchsorted(last, at, "right")
            inside = (k < len(w.hashes)) & (at + size <= last[doc])
            inside[inside] = w.hashes[k[inside]] == h[at[inside]]
            for i, u, d in zip(at[inside].tolist(), k[inside].tolist(), doc[inside].tolist(), strict=True):
                own, a, b = b" ".join(plain[starts[i] : ends[i + size - 1]].split()), int(w.begin[u]), int(w.begin[u + 1])
                odd = int(w.hashes[u]) in w.odd
                same = [x for x in range(a, b if odd else a + 1) if self._words(int(w.at[x]), size) == own]
                if same:
                    found.append((d, i - int(begin[d]), size, w.item[same] if odd else w.item[a:b]))
        return last - begin, found

    def _words(self, at: int, size: int) -> bytes:
        return self.text[self.starts[at] : self.starts[at + size] - 1]

    def _found(self, hits: list[tuple[int, int, np.ndarray]]) -> tuple[int, list[str], list[tuple[int, int]]]:
        """Words hit, names of the items with occurring windows, and the word ranges hit."""
        if not hits:
            return 0, [], []
        items = np.unique(np.concatenate([x for _, _, x in hits]))
        spans: list[list[int]] = []
        for lo, hi in sorted({(at, at + size) for at, size, _ in hits}):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        return sum(b - a for a, b in spans), sorted(self.names[i] for i in items.tolist()), [(a, b) for a, b in spans]

    def _scan(self, docs: list[bytes]) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
        words, hits = self._hits(docs)
        own: dict[int, list] = {}
        for d, at, size, items in hits:
            own.setdefault(d, []).append((at, size, items))
        for d, n in enumerate(words.tolist()):
            yield n, *self._found(own.get(d, []))

    def _scan_long(self, text: str) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        hits, n = [], 0
        for first, plain in runs_of(text):
            words, found = self._hits([plain])
            hits += [(first + at, size, items) for _, at, size, items in found]
            n = first + int(words[0])
        return n, *self._found(hits)

    def scan_texts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """For each whole text: its words, words hit, names of the items with occurring windows, and the word ranges hit.

        Runs of texts are bounded by their bytes, long texts are scanned in overlapping pieces.
        """
        run: list[bytes] = []
        size = 0
        for t in texts:
            long = len(t or "") > common.PIECE_CHARS
            if not long:
                run.append((t or "").encode("utf-8", "replace").translate(_FOLD))
                size += len(run[-1])
            if run and (long or size >= 6 * RUN_WORDS):
                yield from self._scan(run)
                run, size = [], 0
            if long:
                yield self._scan_long(t)
        if run:
            yield from self._scan(run)


def _items(benchmark: DataFrame) -> DataFrame:
    """(name, text): a null item_id is named by the empty text."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string"))


def _parts(name: str, text: str | None, most: int) -> Iterator[tuple[str, str, int]]:
    """An item whole, or a longer one in overlapping parts, which have the same windows; with their bytes."""
    if len(text or "") <= most:
        yield name, text, len((text or "").encode("utf-8", "replace"))
        return
    # a run of fewer words than a window lies in the next one, or is all that the item has
    plain, given = b"", False
    for _, plain in runs_of(text, most):
        if len(plain.split(None, WINDOW)) >= WINDOW:
            yield name, plain.decode("utf-8", "replace"), len(plain)
            given = True
    if not given:
        yield name, plain.decode("utf-8", "replace"), len(plain)


def indexes(benchmark: DataFrame, max_bytes: int = MAX_INDEX_BYTES) -> Iterator[Index]:
    """One index, or as many as hold the benchmark in blocks of about max_bytes; their size is asked first, and one is built at a time."""
    items = _items(benchmark).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    total = items.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = -(-total // max_bytes) or 1
    given = False
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
        held, size = [], 0
        for r in part.select("name", "text").toLocalIterator():
            for name, text, n in _parts(r["name"], r["text"], min(max_bytes, common.PIECE_CHARS)):
                if held and size + n > 2 * max_bytes:
                    yield Index(held)
                    held, size, given = [], 0, True
                held.append((name, text))
                size += n
        if held:
            yield Index(held)
            given = True
    if not given:
        yield Index([])


def _scan(docs: DataFrame, held) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(held.value.scan_texts(b["text"]))
            out = pd.DataFrame({"doc_id": b["doc_id"], "_text": b["_text"]})
            for k, name in enumerate(("n_words", "n_hit", "items")):
                out[name] = [x[k] for x in found]
            out["spans"] = [[{"lo": a, "hi": z} for a, z in x[3]] for x in found]
            yield out

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("_text"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, _text long, " + HITS)


def _merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in parts:
        spans, hits = [], []
        for rows in b["spans"]:
            merged: list[list[int]] = []
            for s in sorted((x["lo"], x["hi"]) for x in rows):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            spans.append([{"lo": a, "hi": z} for a, z in merged])
            hits.append(sum(z - a for a, z in merged))
        yield b.assign(spans=spans, n_hit=hits, items=[sorted(x) for x in b["items"]])[["doc_id", "_text", "n_words", "n_hit", "items", "spans"]]


def hits(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) for each row of docs.

    A document word is hit inside any occurrence of a window: WINDOW consecutive
    words of an item, or all words of a shorter item. Null texts have no words;
    items without words match nothing; repeated items of one item_id count once;
    repeated rows stay; empty tables give no rows, or no hits. A benchmark beyond
    max_bytes is scanned in blocks whose findings are merged by document.
    """
    first, following = _blocks(benchmark, max_bytes)
    found = _scan(docs, docs.sparkSession.sparkContext.broadcast(first)) if following is None else _merged(docs, following)
    return found.select("doc_id", "n_words", "n_hit", "items", "spans", _contaminated().alias("contaminated"))


def _blocks(benchmark: DataFrame, max_bytes: int) -> tuple[Index | None, Iterator[Index] | None]:
    """(the only index, None), or (None, all of several, built one by one)."""
    every = indexes(benchmark, max_bytes)
    first, second = next(every), next(every, None)
    return (first, None) if second is None else (None, itertools.chain((x for x in (first, second)), every))


def _merged(docs: DataFrame, blocks: Iterator[Index]) -> DataFrame:
    """The findings of all blocks, merged by doc_id and hash of the text.

    A block is broadcast, its hits are written to the shared folder, and it is given up before the next one is sent.
    """
    spark = docs.sparkSession
    short_batches(spark)
    key, parts = ["doc_id", "_text"], []
    for index in blocks:
        held = spark.sparkContext.broadcast(index)
        parts.append(frozen(_scan(docs, held).filter("n_hit > 0").dropDuplicates(key)))
        held.destroy()
    every = functools.reduce(DataFrame.unionByName, parts)
    some = every.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    merged = some.mapInPandas(_merge, "doc_id long, _text long, " + HITS)
    bare = _scan(docs, spark.sparkContext.broadcast(Index([]))).select(*key, F.col("n_words").alias("_n"))
    same = bare["doc_id"].eqNullSafe(merged["doc_id"]) & (bare["_text"] == merged["_text"])
    return bare.join(merged, same, "left").select(
        bare["doc_id"], bare["_text"], F.col("_n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<lo:long,hi:long>>")).alias("spans"),
    )


def _contaminated():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: words, hits and items of every document."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "documents", max_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """docs without its contaminated documents; ``how="spans"`` keeps those and cuts the words hit out of every text instead.

    All columns and other rows stay as they are; a text with spans cut is rebuilt from its remaining words and what stands between them.
    """
    if how not in ("documents", "spans"):
        raise ValueError(how)
    short_batches(docs.sparkSession)
    at = docs.columns.index("text")
    first, following = _blocks(benchmark, max_bytes)
    if following is not None:
        # several blocks: what is hit is known only once their findings are merged
        found = _merged(docs, following).filter(_contaminated() if how == "documents" else F.col("n_hit") > 0)
        found = found.select(F.col("doc_id").alias("_bad"), F.col("_text").alias("_hash"), F.col("spans").alias("_spans")).dropDuplicates(["_bad", "_hash"])
        same = docs["doc_id"].eqNullSafe(found["_bad"]) & (F.xxhash64(docs["text"].cast("string")) == found["_hash"])
        if how == "documents":
            return docs.join(found, same, "left_anti")
        whole = docs.join(found, same, "left").drop("_bad", "_hash")
        return whole.mapInArrow(_cutter(at), docs.schema)
    held = docs.sparkSession.sparkContext.broadcast(first)
    if how == "spans":
        return docs.mapInArrow(_cutter(at, held), docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [not (h and SHARE * h >= n) for n, h, _, _ in held.value.scan_texts(b.column(at).to_pylist())]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the given ranges (numbered as in ``words_of``)."""
    raw = text.encode("utf-8", "replace")
    plain = raw.translate(_FOLD)
    bounds, pos = [], 0
    for w in plain.split():
        pos = plain.index(w, pos)
        bounds.append((pos, pos + len(w)))
        pos += len(w)
    out, last = [], 0
    for lo, hi in spans:
        out.append(raw[last : bounds[lo][0]])
        last = bounds[hi - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def _cutter(at: int, held=None):
    """Cuts the spans that an index finds, or those of a last column ``_spans``, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if held is None:
                spans = [[(x["lo"], x["hi"]) for x in row or []] for row in b.column(b.num_columns - 1).to_pylist()]
                b = b.select(range(b.num_columns - 1))
            else:
                spans = [x[3] for x in held.value.scan_texts(texts)]
            new = [cut(t, own) if own else t for t, own in zip(texts, spans, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, the others stay whole."""
    return remove(docs, table(spark, sf_dir, "benchmark"))


def digest(names: Iterable[str]) -> str:
    """The digest that ``query`` gives for a set of item names."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), wins AS (
  SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)
), d AS (
  SELECT doc_id, {_SQL_WORDS} AS w FROM documents
), hits AS (
  SELECT DISTINCT doc_id, s, k, item FROM (
    SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (
      SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM wins)
    )
  ) JOIN wins USING (k, win)
), marks AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)
"""
