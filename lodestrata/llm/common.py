"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch sent to Python: texts may be long, so batches are short.
BATCH_ROWS = 500
#: Code points of a text that are cut into words at once.
PIECE_CHARS = 1 << 20
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def pieces(text: str | None, most: int | None = None) -> Iterator[str]:
    """A text in pieces of about ``most`` code points, cut before an ASCII blank: no word is cut, and the pieces joined are the text.

    What tokenises piece by piece holds one piece's words, however long the text is. Null has none; a word longer than that stays whole.
    """
    text, most, at = text or "", most or PIECE_CHARS, 0
    while len(text) - at > most and (blank := _BLANK.search(text, at + most)):
        yield text[at : blank.start()]
        at = blank.start()
    if at < len(text):
        yield text[at:] if at else text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other scripts)."""
    return F.translate(c, _UPPER, _LOWER)


def id_text(c: Column) -> Column:
    """The text of an id, as the fold rules hash it; a null id counts as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(c: Column, n: int) -> Column:
    """crc32 of the id's text modulo n."""
    return F.crc32(F.encode(id_text(c), "UTF-8")) % n


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, as each row may hold a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if driver and tasks are one process (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def frozen(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root, as a URI; files in it are kept until its owner removes it."""
    uri = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if ":/" not in uri:
        uri = "file://" + uri
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return uri


def remove_folder(uri: str) -> None:
    """Delete a folder made by ``new_folder`` with all that is in it."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.delete_dir(path)


def put_file(uri: str, chunks: Iterable[bytes]) -> None:
    """Write a file under a name of its own, then rename it: a retried or speculative task leaves one whole file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, path)


def open_file(uri: str):
    """Open a file of the shared folder for sequential reading."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path, compression=None)


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
