"""Rendered records, their tokens, and the corpus of tokens with one weight column for each condition."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import frozen
from .masks import CONDITIONS

#: Ids below are special; words and signs take the rest of 16 bits by their checksum.
SPECIAL = 256
PIECES = r"(?U)\w+|[^\w\s]"


def token_ids(text: Column) -> Column:
    """A deterministic substitute for a trained tokenizer: words and signs as ids by crc32; white space parts them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.transform(pieces, lambda p: (F.crc32(F.encode(p, "UTF-8")) % (65_536 - SPECIAL) + SPECIAL).cast("int"))


def encoded(segments: Column) -> Column:
    """struct(tokens, spans) of an array of (text, role): tokens put together, and for each segment with tokens its role and half-open range."""
    start = F.struct(F.array().cast("array<int>").alias("tokens"), F.array().cast("array<struct<role:string,start:int,end:int>>").alias("spans"))

    def step(a, s):
        t = token_ids(s["text"])
        at = F.size(a["tokens"])
        span = F.struct(s["role"].alias("role"), at.alias("start"), (at + F.size(t)).alias("end"))
        return F.struct(F.concat(a["tokens"], t).alias("tokens"), F.when(F.size(t) > 0, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(segments, start, step)


def metadata(records: DataFrame) -> DataFrame:
    """(ordinal, record_id, lane, token_length, source_sha256, render_sha256, metadata_sha256) of records (ordinal, record_id, lane, payload), in one pass without a shuffle."""
    tokens = token_ids(F.col("payload"))
    rows = records.withColumn("_t", tokens).select("ordinal", "record_id", "lane", F.size("_t").cast("long").alias("token_length"), F.sha2("payload", 256).alias("source_sha256"), F.sha2(F.array_join(F.transform("_t", lambda x: x.cast("string")), ","), 256).alias("render_sha256"))
    whole = F.concat_ws("\n", F.col("ordinal").cast("string"), "record_id", "lane", F.col("token_length").cast("string"), "source_sha256", "render_sha256")
    return rows.withColumn("metadata_sha256", F.sha2(whole, 256))


def sidecars(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """K3: tokens (record, pos, token) with a 0/1 weight for each condition: one left join with the bitmaps of masked positions."""
    from .masks import bitmaps, word_of

    of = lambda c: F.bit_or(F.when(F.col("condition") == c, F.col("bits")))
    zero = bitmaps(ranges, ["condition", "record"]).groupBy(F.col("record").alias("_record"), F.col("word").alias("_word")).agg(*[of(c).alias(f"_{c}") for c in CONDITIONS])
    # by words of 64 positions: the weights of a word are one row
    rows = tokens.join(zero, (F.col("record") == F.col("_record")) & (word_of() == F.col("_word")), "left")
    zero_at = lambda c: F.expr(f"cast(coalesce(shiftrightunsigned(_{c}, cast(pos & 63 as int)) & 1L, 0L) as int)")
    return rows.select("record", "pos", "token", *[(1 - zero_at(c)).alias(f"w_{c}") for c in CONDITIONS])


def counters(corpus: DataFrame) -> DataFrame:
    """K3: (condition, tokens, masked) of a written corpus."""
    row = corpus.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"w_{c}") == 0).alias(c) for c in CONDITIONS])
    each = F.array(*[F.struct(F.lit(c).alias("condition"), F.col("n").alias("tokens"), F.col(c).alias("masked")) for c in CONDITIONS])
    return row.select(F.explode(each).alias("x")).select("x.*")


def write(corpus: DataFrame, target: str) -> str:
    """K3: the corpus range-sorted by record and position, published whole."""
    from ..sources.sinks import publish

    return publish(corpus.repartitionByRange("record", "pos").sortWithinPartitions("record", "pos"), target)


def verify(corpus: DataFrame, records: DataFrame, ranges: DataFrame) -> DataFrame:
    """V8: (check, violations) of a corpus against its records (record, n) and masked ranges: lengths, repeated positions, weights that aren't 0 or 1, dense weights of 0, and masks that differ from the ranges.

    The corpus is read once and kept as a row for each word of 64 positions. Only where words have more rows than positions, or
    bits that aren't those of the ranges, it is read again.
    """
    from .masks import among, bit_of, run_gaps, word_of

    weights = {c: F.col(f"w_{c}") for c in CONDITIONS}
    odd = ~functools.reduce(lambda a, b: a & b, (w.isin(0, 1) for w in weights.values()))
    counts = [F.count("*").alias("n"), F.max("pos").alias("last"), F.bit_or(bit_of()).alias("have"), F.count_if(odd).alias("odd"), F.count_if(weights["dense"] == 0).alias("dense")]
    zeros = [F.bit_or(F.when(w == 0, bit_of())).alias(f"zero_{c}") for c, w in weights.items()]
    words = frozen(corpus.groupBy("record", word_of().alias("word")).agg(*counts, *zeros))
    length = words.groupBy("record").agg(F.sum("n").alias("have"), F.max("last").alias("last"))
    wrong = records.join(length, "record", "full_outer").filter((F.coalesce("n", F.lit(-1)) != F.coalesce("have", F.lit(0))) | (F.col("last") != F.col("n") - 1))
    more = words.filter(F.col("n") > F.coalesce(F.bit_count("have"), F.lit(0))).select("record", "word")
    repeated = more if more.isEmpty() else among(corpus.withColumn("word", word_of()), more, ["record", "word"]).groupBy("record", "pos").agg(F.count("*").alias("n")).filter("n > 1")
    group = ["condition", "record"]
    zero = functools.reduce(DataFrame.unionByName, (corpus.filter(w == 0).select(F.lit(c).alias("condition"), "record", "pos") for c, w in weights.items()))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"zero_{c}").alias("bits")) for c in CONDITIONS]))
    found = words.select("record", "word", each.alias("x")).select("record", "word", "x.*").filter("bits <> 0 or word is null")
    rows = lambda df: df.agg(F.count("*").alias("violations"))
    total = lambda c: words.agg(F.coalesce(F.sum(c), F.lit(0)).alias("violations"))
    checks = {"record_lengths": rows(wrong), "repeated_positions": rows(repeated), "weight_domain": total("odd"), "dense_is_whole": total("dense"), "masked_ranges": rows(run_gaps(ranges, zero, group, found))}
    return functools.reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("check"), "violations") for k, df in checks.items()))
