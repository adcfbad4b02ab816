"""WARC archives: one gzip member per record, and a sequential reader that verifies what it reads.

The writer deduplicates payloads by digest: of equal payloads one record is a
response, the others are revisits whose block holds the HTTP head only. The
reader inflates member after member in small pieces, frames records by their
Content-Length and checks the digests of every block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frozen, new_folder, open_file, put_file, remove_folder, short_batches, table

#: Bytes read, and at most inflated, at once.
PIECE = 1 << 16
#: Digests of repeated payloads that are broadcast, of some 60 bytes each; beyond that pages are joined by digest.
MAX_BROADCAST = 200_000
#: Compression level of a member.
LEVEL = 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"
_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that is cut short, wrongly framed or that fails its digest."""


def base32_sha1(data: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    """Head fields by lower-case name, the block's HTTP fields, and the payload that the record holds (None: left to a sink)."""

    fields: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    payload_bytes: int = 0


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    clean = [(k, v.replace("\r", " ").replace("\n", " ")) for k, v in head]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """The record of a page: a response, or where another page's id is given a revisit of that."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        ("WARC-Type", "response" if response is None else "revisit"),
        ("WARC-Record-ID", f"<{_URN}{name}>"),
        ("WARC-Date", _DATE),
        *([("WARC-Target-URI", url)] if url else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("WARC-Payload-Digest", "sha1:" + digest),
    ]
    if response is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_URN}{response}>")]
    return member(head, block)


class _Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source, rest: bytes):
        self.source, self.z, self.raw, self.out = source, zlib.decompressobj(31), rest, bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.z.unconsumed_tail or self.source.read(PIECE)
            if not self.raw:
                raise WarcError("the archive ends within a member")
        try:
            self.out += self.z.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise WarcError(f"damaged member: {e}") from e
        self.raw = self.z.unconsumed_tail
        return True

    def head(self) -> bytes:
        """Up to and without the empty line, however long (a head is held whole); what was read of the rest stays."""
        seen = 0
        while (at := self.out.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.out)
            if not self._more():
                raise WarcError("a head without an end")
        text, self.out = bytes(self.out[:at]), self.out[at + 4 :]
        return text

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.out and not self._more():
                raise WarcError("a block shorter than its Content-Length")
            piece, self.out = bytes(self.out[:n]), self.out[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> bytes:
        """Check that only the closing empty lines are left; the compressed bytes of what follows."""
        while self._more():
            if len(self.out) > 4:
                break
        if self.out != b"\r\n\r\n":
            raise WarcError("a block longer than its Content-Length")
        return self.z.unused_data


def _fields(text: bytes, first: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(first.decode()):
        raise WarcError(f"not a {first.decode()} head: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _length(fields: dict[str, str]) -> int:
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        n = -1
    if n < 0:
        raise WarcError("a record without a right Content-Length")
    return n


def read(source, keep_payload: bool = True) -> Iterator[Record]:
    """The records of an archive, one after the other; ``source`` needs read(n) only.

    At most PIECE inflated bytes are held besides the head and, if kept, the
    payload. Raises WarcError for a member cut short, a wrong length or a wrong digest.
    """
    rest = source.read(PIECE)
    while rest:
        m = _Member(source, rest)
        fields = _fields(m.head(), b"WARC/")
        left = _length(fields)
        block, payload, size, kept, lead, http = hashlib.sha1(), hashlib.sha1(), 0, [], bytearray(), None
        is_http = fields.get("content-type", "").startswith("application/http")
        for piece in m.take(left):
            block.update(piece)
            if is_http and http is None:
                seen = len(lead)
                lead += piece
                at = lead.find(b"\r\n\r\n", max(0, seen - 3))
                if at < 0:
                    continue
                http, piece = _fields(bytes(lead[:at]), b"HTTP/"), bytes(lead[at + 4 :])
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        if is_http and http is None:
            raise WarcError("an HTTP head without an end")
        for name, digest in (("warc-block-digest", block), ("warc-payload-digest", payload)):
            said = fields.get(name)
            if said and not (name == "warc-payload-digest" and fields.get("warc-type") == "revisit"):
                if said.removeprefix("sha1:") != base64.b32encode(digest.digest()).decode():
                    raise WarcError(f"{name} of {fields.get('warc-record-id')} is wrong")
        rest = m.end() or source.read(PIECE)
        yield Record(fields, http or {}, b"".join(kept) if keep_payload else None, size)


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with ``response``: null, or the page_id of the response that the row revisits.

    Among rows with equal payloads of ``least`` bytes or more the largest
    page_id is the response (rows that repeat it, all of them); a null page_id is
    the smallest, and if a payload has no other all its rows are responses.
    The maxima are taken by digest, and pages find theirs where they lie as long as the repeated
    digests are few enough to be broadcast; else pages are joined by digest (Spark splits a hot one).
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    last = own.filter(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = frozen(last.filter("n > 1 and last is not null").select("digest", "last"))
    last = F.broadcast(last) if last.count() <= MAX_BROADCAST else last
    return own.withColumn("digest", F.sha1("payload")).join(last, "digest", "left").select(
        "page_id", "url", "payload", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("response")
    )


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> tuple[str, list[str]]:
    """Write an archive for each partition of pages (page_id, url, html) below a shared folder; the folder and the files.

    A file appears under its final name only when it is whole, and each task
    attempt writes names of its own; only those that succeeded are listed.
    """
    spark = pages.sparkSession
    short_batches(spark)
    folder = folder or new_folder(spark, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        count = [0]

        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, payload, response in zip(b["page_id"], b["url"], b["payload"], b["response"], strict=True):
                    count[0] += 1
                    yield page_record(None if pd.isna(page) else int(page), url, bytes(payload), None if pd.isna(response) else int(response))

        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        put_file(name, records())
        yield pd.DataFrame({"file": [name], "records": [count[0]]})

    rows = marked(pages, least).mapInPandas(run, "file string, records long").collect()
    return folder, sorted(r["file"] for r in rows if r["records"])


def remove_archives(folder: str) -> None:
    """Delete a folder of archives."""
    remove_folder(folder)


def _id(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(_URN)
    return int(text) if text else None


def read_archives(spark: SparkSession, files: list[str]) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, file): a row per record, a file per task.

    Size and digest are those of the full payload: a revisit has them in its HTTP head and its record head.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["file"]:
                rows = []
                with open_file(name) as source:
                    for r in read(source, keep_payload=False):
                        kind = r.fields["warc-type"]
                        size = int(r.http.get("content-length", "0")) if kind == "revisit" else r.payload_bytes
                        rows.append((_id(r.fields["warc-record-id"]), r.fields.get("warc-target-uri"), size, r.fields["warc-payload-digest"].removeprefix("sha1:"), kind, _id(r.fields.get("warc-refers-to")), name))
                        if len(rows) >= 1000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"])
        return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, len(files))).mapInPandas(run, schema)


def broken_revisits(records: DataFrame) -> DataFrame:
    """The revisits of ``read_archives`` whose response is missing, or has another size or digest than they say."""
    said = records.filter("record_type = 'revisit'")
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    same = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    return said.join(held, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page written to an archive and read back; the archives go once the rows are written."""
    folder, files = write(table(spark, sf_dir, "pages"))
    rows = frozen(read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove_archives(folder)
    if broken := broken_revisits(rows).limit(1).collect():
        raise WarcError(f"a revisit without its response: {broken[0]}")
    return rows


#: The digest in base32: 20 bits of the hexadecimal one at a time, five for each letter.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), d AS (
  SELECT *, sha1(html) AS h FROM p
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
