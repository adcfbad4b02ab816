
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOPS = 6


def position_bin(start: Column, end: Column, length: Column) -> Column:
    """The tenth of a record in which the middle of a range lies."""
    return F.least(F.lit(9), F.floor(((start + end) * 10) / (2 * length)).cast("long"))


def nibbles(code: Column) -> tuple[Column, Column, Column]:
    """F32: a relation code below 4096 as three four-bit digits, the highest first."""
    return F.shiftright(code, 8).bitwiseAND(15), F.shiftright(code, 4).bitwiseAND(15), code.bitwiseAND(15)


def from_nibbles(a: Column, b: Column, c: Column) -> Column:
    """F32: the code of three digits."""
    return F.shiftleft(a, 8) + F.shiftleft(b, 4) + c


def action_frame(slot: Column, relation_code: Column, inward: Column, read: Column, halt: Column) -> Column:
    """an action as eight tokens: open, slot, three relation digits, direction, kind, close."""
    a, b, c = nibbles(relation_code)
    kind = F.when(halt, "halt").when(read, "read").otherwise("noop")
    direction = F.when(inward, "in").otherwise("out")
    parts = [F.lit("<act>"), slot.cast("string"), a.cast("string"), b.cast("string"), c.cast("string"), direction, kind, F.lit("</act>")]
    return F.array(*parts)


def parsed_frame(frame: Column) -> Column:
    """struct(slot, code, inward, kind) of a frame of eight tokens; null if it isn't one."""
    ok = (F.size(frame) == 8) & (F.try_element_at(frame, F.lit(1)) == "<act>") & (F.try_element_at(frame, F.lit(8)) == "</act>")
    digit = [F.try_element_at(frame, F.lit(k)).try_cast("int") for k in (2, 3, 4, 5)]
    fits = (digit[0].between(0, 3)) & digit[1].between(0, 15) & digit[2].between(0, 15) & digit[3].between(0, 15)
    direction, kind = F.try_element_at(frame, F.lit(6)), F.try_element_at(frame, F.lit(7))
    fits &= direction.isin("in", "out") & kind.isin("read", "halt", "noop")
    value = F.struct(digit[0].alias("slot"), from_nibbles(digit[1], digit[2], digit[3]).alias("code"), (direction == "in").alias("inward"), kind.alias("kind"))
    return F.when(F.coalesce(ok & fits, F.lit(False)), value)


def action_plan(relations: Column, hops: int = HOPS) -> Column:
    """reads of the relations, one halt, and no-ops up to the full length; a full plan has no halt."""
    n = F.size(relations)
    reads = F.transform(relations, lambda r: F.concat(F.lit("read:"), r))
    return F.when(n < hops, F.concat(reads, F.array(F.lit("halt")), F.array_repeat(F.lit("noop"), (hops - 1 - n).cast("int")))).otherwise(reads)


def exposure(log_exposure: Column) -> Column:
    """expm1 of a stored log1p exposure."""
    return F.expm1(log_exposure)


def entropy_bits(n: Column) -> Column:
    """bits of a uniform choice of n."""
    return F.log2(n.cast("double"))


def half_up_ratio(a: Column, b: Column, scale: int) -> Column:
    """a * scale / b rounded half up, in integers."""
    return F.floor((2 * a * scale + b) / (2 * b)).cast("long")


def literal_value(kind: Column, number: Column, seed: int) -> Column:
    """a value of a literal kind, marked by the seed it came from."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.pmod(number * 37, F.lit(36500)).cast("int"))
    return (
        F.when(kind == "date", F.date_format(day, "yyyy-MM-dd"))
        .when(kind == "quantity", F.concat(F.pmod(number * 7919, F.lit(100000)).cast("string"), F.lit(f" u{seed}")))
        .when(kind == "category", F.concat(F.lit(f"c{seed}-"), F.pmod(number, F.lit(12)).cast("string")))
        .otherwise(F.concat(F.lit(f"s{seed}-"), number.cast("string")))
    )
