
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUL = "\0"


def sha(*parts: Column | str) -> Column:
    """Lower-case SHA-256 of the parts put together; its order is that of the raw digest."""
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def address_key(subject: Column, relation: Column) -> Column:
    """The rank of a key within its relation."""
    return sha("Q", subject, "\t", relation)


def root_key(split: str, subject: Column, relation: Column) -> Column:
    """The rank of a root of paths."""
    return sha(split, NUL, subject, NUL, relation)


def leading(hex_digest: Column, digits: int = 8) -> Column:
    """The number that the first hex digits of a digest write; up to 15 digits fit a long, 16 come as a decimal."""
    number = F.conv(F.substring(hex_digest, 1, digits), 16, 10)
    return number.cast("long") if digits < 16 else number.cast("decimal(20,0)")


def composition_hash(relations: Column) -> Column:
    """SHA-256 of the JSON array of relation ids."""
    return F.sha2(F.to_json(relations), 256)


def composition_bucket(relations: Column) -> Column:
    """0 to 99 by the first eight hex digits."""
    return leading(composition_hash(relations)) % 100


def chosen(key: Column, label: str, index: Column | int, n: Column | int) -> Column:
    """one of n by the first 16 hex digits of the hash of (key, label, index)."""
    digest = sha(key, NUL + label + NUL, index if isinstance(index, Column) else str(index))
    return (leading(digest, 16) % (n if isinstance(n, Column) else F.lit(n))).cast("long")


def fact_id(*columns: str) -> Column:
    """SHA-256 of the JSON object of the columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def document_hash(text: Column) -> Column:
    """SHA-1 of a text."""
    return F.sha1(text)


def ordered_digest(hashes: Column) -> Column:
    """SHA-256 of hashes put together in the order of an array."""
    return F.sha2(F.array_join(hashes, ""), 256)


@F.pandas_udf(T.BinaryType())
def token_bytes(tokens: pd.Series) -> pd.Series:
    """token ids as little-endian unsigned 16-bit numbers."""
    return tokens.map(lambda x: np.asarray(x, dtype="<u2").tobytes(), na_action="ignore")
