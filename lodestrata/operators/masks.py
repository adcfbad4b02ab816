"""Spans, weight masks, their matched controls and the audits of both."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import position_bin
from ..functions.hashing import leading, sha
from ..storage import frozen
from .schedule import offsets

CONDITIONS = ("dense", "split", "selective", "random")
PROTECTED = ("relation_alias", "payload", "rule", "action", "provisional_answer", "final_answer")
#: Positions of one bucket when ranges are joined: matches meet the spans of their own bucket and the next only.
RANGE_BUCKET = 1024
#: Tokens of patterns whose hashes are sent to the tasks, at most; and tokens that a task hashes at once, about.
PATTERN_TOKENS, HASHED_TOKENS = 2_000_000, 1_000_000
#: Keys of controls whose demand is broadcast, at most.
DEMAND_KEYS = 100_000


def should_mask(condition: str, role: Column, external: Column) -> Column:
    """whether a span loses its weight: payloads under split, external payloads under selective, nothing under dense and random."""
    if condition not in CONDITIONS:
        raise ValueError(condition)
    if condition == "split":
        return role == "payload"
    return (role == "payload") & F.coalesce(external, F.lit(False)) if condition == "selective" else F.lit(False)


def is_external(entropy: Column, exposures: Column, write: Column, read: Column, reads: Column, hop: Column, hops: Column) -> Column:
    """entropy per exposure strictly exceeds the cost of writing, reads and hops."""
    return entropy / F.greatest(exposures, F.lit(1)) > write + read * reads + hop * hops


def histogram(spans: DataFrame, where: Column) -> DataFrame:
    """(length, position_bin, n) of some spans."""
    return spans.filter(where).groupBy("length", "position_bin").agg(F.count("*").alias("n"))


def deficits(spans: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Exact keys that payloads demand more often than controls supply; by record if grouped so."""
    key = [*(group or []), "length", "position_bin"]
    both = spans.filter(F.col("role").isin("payload", "random_control")).groupBy(*key).agg(F.count_if(F.col("role") == "payload").alias("demand"), F.count_if(F.col("role") == "random_control").alias("supply"))
    return both.filter("demand > supply").withColumn("deficit", F.col("demand") - F.col("supply"))


def matched_controls(spans: DataFrame, seed: str, group: list[str] | None = None) -> DataFrame:
    """T4, T5: of each exact key as many controls as it has payloads, those of lowest hash; grouped by record it is the in-record sample.

    Without a group there are few keys with many spans each, so ranks are
    counted in two levels, over ranges of the hash. The contract is that of a
    seeded sample (size, strata, determinism); the order is SHA-256's.
    """
    key = [*(group or []), "length", "position_bin"]
    demand = spans.filter("role = 'payload'").groupBy(*key).agg(F.count("*").alias("_demand"))
    if not group:
        # few keys: where they are, the controls aren't dealt by them
        demand = frozen(demand)
        demand = F.broadcast(demand) if demand.limit(DEMAND_KEYS + 1).count() <= DEMAND_KEYS else demand
    rank = leading(sha(seed, "\0", F.col("span_id")), 15)
    controls = spans.filter("role = 'random_control'").join(demand, key).withColumn("_rank", rank).withColumn("_one", F.lit(1))
    if group:
        placed = controls.withColumn("_before", F.row_number().over(Window.partitionBy(*key).orderBy("_rank", "span_id")) - 1)
    else:
        placed = offsets(controls, ["_rank", "span_id"], "_one", "_before", key)
    return placed.filter(F.col("_before") < F.col("_demand")).drop("_rank", "_one", "_before", "_demand")


def masked_ranges(spans: DataFrame, controls: DataFrame) -> DataFrame:
    """(condition, record, start, end) of all ranges whose weight is zero."""
    parts = [spans.filter(should_mask(c, F.col("role"), F.col("external"))).select(F.lit(c).alias("condition"), "record", "start", "end") for c in ("split", "selective")]
    return functools.reduce(DataFrame.unionByName, [*parts, controls.select(F.lit("random").alias("condition"), "record", "start", "end")])


def positions(ranges: DataFrame) -> DataFrame:
    """A row for each position of each range."""
    return ranges.select("condition", "record", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))


def weights(records: DataFrame, ranges: DataFrame, condition: str) -> DataFrame:
    """(record, weights): a 0/1 array for each record (record, n), built within the row from its ranges, which don't overlap."""
    own = ranges.filter(F.col("condition") == condition).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    r = F.coalesce(F.col("r"), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    # before each range as many ones as since the end of the one in front of it: linear in the record
    many = lambda v, n: F.array_repeat(F.lit(v), n.cast("int"))
    before = lambda i: F.coalesce(F.get(r, i - 1)["end"], F.lit(0))
    parts = F.transform(r, lambda x, i: F.concat(many(1, x["start"] - before(i)), many(0, x["end"] - x["start"])))
    rest = F.col("n") - F.coalesce(F.get(r, F.size(r) - 1)["end"], F.lit(0))
    return records.join(own, "record", "left").select("record", F.concat(F.flatten(parts), many(1, rest)).alias("weights"))


def zero_runs(points: DataFrame, group: list[str]) -> DataFrame:
    """(group, start, end): maximal runs of consecutive positions; repeated positions count once."""
    w = Window.partitionBy(*group).orderBy("pos")
    islands = points.select(*group, "pos").distinct().withColumn("_i", F.col("pos") - F.row_number().over(w))
    return islands.groupBy(*group, "_i").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("_i")


def merged(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Touching ranges joined. Overlaps are errors: see ``overlaps``."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    starts = ranges.withColumn("_new", (F.col("start") > F.coalesce(F.lag("end").over(w), F.lit(-1))).cast("int"))
    runs = starts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def overlaps(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Ranges that begin before the one in front of them has ended."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    return ranges.withColumn("_e", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("start < _e").drop("_e")


def run_lengths(tokens: DataFrame, group: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Runs of equal consecutive values: (group, run, values, start, length)."""
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.lit(True)
    for v in value:
        same &= F.col(v).eqNullSafe(F.lag(v).over(w))
    rows = tokens.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_new", F.when((F.col("_pos") == 0) | ~same, 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy(*group, "run", *value).agg(F.min("_pos").cast("long").alias("start"), F.count("*").alias("length"))


def gaps(ranges: DataFrame, order: str, start: str = "token_start", end: str = "token_end") -> DataFrame:
    """Ranges that don't begin where the one before ended (the first: at 0). The neighbour is found by a join on the order's number."""
    previous = ranges.select((F.col(order) + 1).alias(order), F.col(end).alias("_end"))
    return ranges.join(previous, order, "left").filter(F.col(start) != F.coalesce("_end", F.lit(0))).drop("_end")


def contained(matches: DataFrame, spans: DataFrame, bucket: int = RANGE_BUCKET) -> DataFrame:
    """Matches (record, start, end) that lie within a span of their record, joined by record and bucket of positions, never by range alone.

    A span is listed in every bucket it touches; a match looks in that of its start.
    """
    listed = spans.select("record", F.col("start").alias("s"), F.col("end").alias("e")).withColumn("b", F.explode(F.sequence(F.expr(f"s div {bucket}"), F.expr(f"(e - 1) div {bucket}"))))
    inside = (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e"))
    return matches.withColumn("b", F.expr(f"start div {bucket}")).join(listed, ["record", "b"]).filter(inside).drop("b", "s", "e")


def uncontained(matches: DataFrame, spans: DataFrame, bucket: int = RANGE_BUCKET) -> DataFrame:
    """Matches that no span contains: the errors of a tagging."""
    key = ["record", "start", "end", "pattern"]
    return matches.join(contained(matches, spans, bucket).select(*key).distinct(), key, "left_anti")


def _window_hashes(v: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive of the token hashes v, modulo 2^64: sums of powers, so that n doesn't matter."""
    base = np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros(len(v) + 1, np.uint64)
    # v[i] * base^-i summed up; times base^i it depends on the window alone
    np.cumsum(v * np.cumprod(np.full(len(v), np.uint64(pow(int(base), -1, 1 << 64)))), out=sums[1:])
    return (sums[n:] - sums[:-n]) * np.cumprod(np.full(len(v) - n + 1, base))


def _likely_windows(known: dict[int, np.ndarray], at_once: int):
    """For mapInArrow over (record, tokens, hashes): (record, start, n, w) of windows whose hash is one of ``known``, sorted hashes by length. None that equals a pattern is left out.

    A batch's tokens are one row of hashes, of which ``at_once`` starts are looked at together, whatever record they are of.
    """
    marks = {n: np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0 for n, h in known.items()}

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record, tokens, hashes = batch.columns
            ends, at = hashes.offsets.to_numpy().astype(np.int64), tokens.offsets.to_numpy().astype(np.int64)
            for low in range(int(ends[0]), int(ends[-1]), at_once):
                for n, want in known.items():
                    v = hashes.values[low : min(int(ends[-1]), low + at_once + n - 1)].to_numpy(zero_copy_only=False).view(np.uint64)
                    if len(v) < n:
                        continue
                    h = _window_hashes(v, n)
                    i = np.flatnonzero(marks[n][(h >> np.uint64(44)).astype(np.int64)])
                    i = i[np.isin(h[i], want)] + low
                    row = np.searchsorted(ends, i, "right") - 1
                    inside = i + n <= ends[row + 1]
                    i, row = i[inside], row[inside]
                    if not len(i):
                        continue
                    start = i - ends[row]
                    took = tokens.values.take(pa.array(((at[row] + start)[:, None] + np.arange(n)).ravel()))
                    took = took.combine_chunks() if isinstance(took, pa.ChunkedArray) else took
                    w = type(tokens).from_arrays(pa.array(np.arange(len(i) + 1) * n, tokens.offsets.type), took)
                    yield pa.RecordBatch.from_arrays([record.take(pa.array(row)), pa.array(start), pa.array(np.full(len(i), n), pa.int32()), w], ["record", "start", "n", "w"])

    return search


def pattern_matches(records: DataFrame, patterns: DataFrame, most: int = 50_000, begins: int = 64) -> DataFrame:
    """(record, start, end, pattern): every occurrence of a token pattern, overlapping ones too, none across records.

    ``records`` are (record, tokens), ``patterns`` (pattern, tokens). Windows of
    each distinct length meet the patterns in a join. Up to ``most`` patterns are
    broadcast, and by their hashes the windows are chosen that leave their row. Where there are more, and they have
    at most ``begins`` first tokens, only windows that begin with one leave it.
    """
    known = patterns.select("pattern", F.col("tokens").alias("p")).filter(F.size("p") > 0)
    lengths = {r["n"]: r["c"] for r in known.groupBy(F.size("p").alias("n")).agg(F.count("*").alias("c")).collect()}
    if not lengths:
        return records.select("record", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).filter("false").crossJoin(known.select("pattern"))
    few = sum(lengths.values()) <= most
    hashes = lambda tokens: F.transform(tokens, lambda t: F.xxhash64(t))
    if few and sum(n * c for n, c in lengths.items()) <= PATTERN_TOKENS:
        found: dict[int, set[int]] = {n: set() for n in sorted(lengths)}
        for r in known.select(hashes("p").alias("h")).distinct().collect():
            found[len(r["h"])].add(int(_window_hashes(np.array(r["h"], np.int64).view(np.uint64), len(r["h"]))[0]))
        to = {n: np.array(sorted(h), np.uint64) for n, h in found.items()}
        fields = [records.schema["record"], T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("w", records.schema["tokens"].dataType)]
        each = records.select("record", "tokens", hashes("tokens").alias("h")).mapInArrow(_likely_windows(to, HASHED_TOKENS), T.StructType(fields))
        return each.join(F.broadcast(known), F.col("w") == F.col("p")).select("record", "start", (F.col("start") + F.col("n")).alias("end"), "pattern")
    lengths = sorted(lengths)
    starts = F.sequence(F.lit(0), F.size("tokens") - 1)
    firsts = [r["f"] for r in known.select(F.element_at("p", 1).alias("f")).distinct().limit(begins + 1).collect()]
    if len(firsts) <= begins:
        wanted = F.array(*[F.lit(f) for f in firsts])
        starts = F.filter(starts, lambda i: F.array_contains(wanted, F.get("tokens", i)))
    # one pass over the tokens: the longest window from each start; shorter ones are its beginnings
    at = F.when(F.size("tokens") > 0, F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice("tokens", i + 1, lengths[-1]).alias("w"))))
    windows = records.select("record", F.explode(at).alias("x")).select("record", F.col("x.i").cast("long").alias("start"), F.col("x.w").alias("w"))
    each = windows.select("record", "start", "w", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).filter("size(w) >= n")
    # patterns are sent to every task only if they are known to be few
    side = F.broadcast(known) if few else known
    return each.join(side, F.slice("w", F.lit(1), F.col("n")) == F.col("p")).select("record", "start", (F.col("start") + F.col("n")).alias("end"), "pattern")


def payload_counts(payloads: DataFrame) -> DataFrame:
    """Occurrences of each (fact, field, text)."""
    return payloads.groupBy("fact", "field", "text").agg(F.count("*").alias("n"))


def inventory(payloads: DataFrame) -> DataFrame:
    """The distinct payloads."""
    return payloads.select("fact", "field", "text").distinct()


def count_mismatches(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Payloads whose occurrences differ from what was expected, on either side."""
    e = expected.withColumnRenamed("n", "expected")
    rows = observed.join(e, ["fact", "field", "text"], "full_outer")
    return rows.filter(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("expected", F.lit(0))))


def bitmaps(ranges: DataFrame, group: list[str]) -> DataFrame:
    """(group, word, bits, listed): the positions of ranges in words of 64, and how many the ranges list there: more than there are bits where they overlap.

    Ranges without a position have no word and no bits. Grouped in place where a group's ranges stand together.
    """
    s, e = F.col("start").cast("long"), F.col("end").cast("long")
    word = F.explode_outer(F.when(s < e, F.sequence(F.shiftright(s, 6), F.shiftright(e - 1, 6))))
    rows = ranges.select(*group, s.alias("_s"), e.alias("_e"), word.alias("word"))
    rows = rows.withColumn("_lo", F.greatest(F.lit(0), F.col("_s") - F.col("word") * 64).cast("int")).withColumn("_n", (F.least(F.lit(64), F.col("_e") - F.col("word") * 64) - F.col("_lo")).cast("int"))
    has = F.col("word").isNotNull()
    bits = F.when(has, F.expr("shiftleft(shiftrightunsigned(-1L, 64 - _n), _lo)"))
    return rows.groupBy(*group, "word").agg(F.bit_or(bits).alias("bits"), F.sum(F.when(has, F.col("_n"))).alias("listed"))


def bit_of(pos: str = "pos") -> Column:
    """The bit of a position in its word, which is the position shifted by 6."""
    return F.expr(f"shiftleft(1L, cast(cast({pos} as bigint) & 63 as int))")


def word_of(pos: str = "pos") -> Column:
    return F.shiftright(F.col(pos).cast("long"), 6)


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose columns ``on`` are those of a row of keys; null equals null."""
    k = keys.select(*[F.col(c).alias(f"_k_{c}") for c in on])
    return rows.join(k, functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on)), "left_semi")


def run_gaps(ranges: DataFrame, points: DataFrame, group: list[str], found: DataFrame | None = None) -> DataFrame:
    """``coverage_gaps`` of merged ranges and the runs of points (group, pos).

    Both are compared as bitmaps first (``found`` has those of the points as (group, word, bits), if they are known). Ranges that
    don't overlap give the runs of their positions, so that groups with equal bits have no gap; ranges and runs are made of the other groups only.
    """
    if found is None:
        found = points.groupBy(*group, word_of().alias("word")).agg(F.bit_or(bit_of()).alias("bits"))
    none = F.lit(None).cast("long")
    both = bitmaps(ranges, group).withColumn("got", none).unionByName(found.select(*group, "word", none.alias("bits"), none.alias("listed"), F.col("bits").alias("got")))
    each = both.groupBy(*group, "word").agg(F.max("bits").alias("bits"), F.max("listed").alias("listed"), F.max("got").alias("got"))
    unlike = F.col("word").isNull() | ~F.col("bits").eqNullSafe(F.col("got")) | (F.col("listed") > F.bit_count("bits"))
    odd = frozen(each.filter(unlike).select(*group).distinct())
    if odd.isEmpty():
        return odd.select(*group, none.alias("start"), none.alias("end"), F.lit("").alias("side"))
    return coverage_gaps(merged(among(ranges, odd, group), group), zero_runs(among(points, odd, group), group), group)


def coverage_gaps(expected: DataFrame, masked: DataFrame, group: list[str]) -> DataFrame:
    """Ranges expected or masked, but not both, with their side."""
    cols = [*group, "start", "end"]
    missing = expected.select(*cols).exceptAll(masked.select(*cols)).withColumn("side", F.lit("missing"))
    return missing.unionByName(masked.select(*cols).exceptAll(expected.select(*cols)).withColumn("side", F.lit("unexpected")))


def audit(spans: DataFrame, controls: DataFrame, points: DataFrame, matches: DataFrame) -> DataFrame:
    """(check, violations) of weight sidecars: runs equal merged ranges, random matches split in keys and mass, protected roles stay, payload patterns are tagged.

    Spans and controls are laid over each other as bitmaps; pairs of ranges are made only in records where bits meet. A match is
    held only against payloads as long as the shortest match.
    """
    group = ["condition", "record"]
    split, random = histogram(spans, F.col("role") == "payload"), controls.groupBy("length", "position_bin").agg(F.count("*").alias("n"))
    split, random = frozen(split), frozen(random)
    kind = F.when(F.coalesce(F.col("role").isin(*PROTECTED), F.lit(False)), "protected").otherwise("open")
    laid = bitmaps(spans.select(kind.alias("kind"), "record", "start", "end").unionByName(controls.select(F.lit("control").alias("kind"), "record", "start", "end")), ["kind", "record"])
    own, of = F.col("kind") != "control", lambda k: F.bit_or(F.when(F.col("kind") == k, F.col("bits")))
    cells = laid.groupBy("record", "word").agg(F.sum(F.when(own, F.col("listed"))).alias("listed"), F.bit_or(F.when(own, F.col("bits"))).alias("bits"), of("protected").alias("p"), of("control").alias("c"))
    # ranges without a position have no word; what they meet is looked up
    over, met = F.col("word").isNull() | (F.col("listed") > F.bit_count("bits")), F.col("word").isNull() | (F.col("p").bitwiseAND(F.col("c")) != 0)
    odd = frozen(cells.select("record", F.coalesce(over, F.lit(False)).alias("over"), F.coalesce(met, F.lit(False)).alias("met")).filter("over or met").groupBy("record").agg(F.max("over").alias("over"), F.max("met").alias("met")))
    none = F.lit(0).cast("long").alias("violations")
    count = lambda df: df.agg(F.count("*").alias("violations"))
    nothing = spans.sparkSession.range(1).select(none)

    def protected() -> DataFrame:
        keys = odd.filter("met")
        if keys.isEmpty():
            return nothing
        hit = among(controls, keys, ["record"]).select("record", "start", "end", F.lit("control").alias("pattern"))
        kept = among(spans.filter(F.col("role").isin(*PROTECTED)), keys, ["record"]).select("record", "start", "end")
        # a control within a protected span, or around it
        inside = contained(hit, kept).select("record", "start", "end")
        around = contained(kept.withColumn("pattern", F.lit("protected")), hit.drop("pattern")).select("record", "start", "end")
        return count(inside.unionByName(around))

    def overlapping() -> DataFrame:
        keys = odd.filter("over")
        return nothing if keys.isEmpty() else count(overlaps(among(spans, keys, ["record"]), ["record"]))

    matches = frozen(matches)
    least = matches.agg(F.min(F.col("end") - F.col("start"))).first()[0]
    payloads = spans.filter("role = 'payload'").filter((F.col("end") - F.col("start") >= least) if least is not None else F.lit(False))
    checks = {
        "zero_runs": count(run_gaps(masked_ranges(spans, controls), points, group)),
        "random_histogram": count(split.exceptAll(random).unionByName(random.exceptAll(split))),
        "protected_roles": protected(),
        "untagged_payloads": count(uncontained(matches, payloads)),
        "overlapping_spans": overlapping(),
    }
    return functools.reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("check"), "violations") for k, df in checks.items()))


def balanced_padding(spans: DataFrame, most: int = 4096) -> DataFrame:
    """(record, padding): the least padding of a record at which its controls cover its payloads' keys; null if none up to ``most`` does.

    Padding moves the position bins. Records are groups of their own, each bounded by its spans.
    """

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        length = int(rows["n"].iloc[0])
        start, end = rows["start"].to_numpy(), rows["end"].to_numpy()
        sides = [(rows["role"] == x).to_numpy() for x in ("payload", "random_control")]
        keys = 10 * (int((end - start).max()) + 1)
        for pad in range(most + 1):
            key = (end - start) * 10 + np.minimum(9, (start + end) * 10 // (2 * (length + pad)))
            need, have = (np.bincount(key[side], minlength=keys) for side in sides)
            if (need <= have).all():
                return pd.DataFrame({"record": [key[0]], "padding": [pad]})
        return pd.DataFrame({"record": [key[0]], "padding": pd.Series([None], dtype="Int64")})

    return spans.select("record", "n", "role", "start", "end").groupBy("record").applyInPandas(search, "record long, padding long")


def with_bins(spans: DataFrame) -> DataFrame:
    """spans with their length and position bin."""
    return spans.withColumn("length", F.col("end") - F.col("start")).withColumn("position_bin", position_bin(F.col("start"), F.col("end"), F.col("n")))
