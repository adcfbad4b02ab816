"""WARC: exact round trip, framing, digests, damage."""

import gzip
import io
import zlib

import pytest

from lodestrata.llm import warc


class Trickle:
    """A source that gives a few bytes at a time."""

    def __init__(self, data, step):
        self.data, self.step = io.BytesIO(data), step

    def read(self, n):
        return self.data.read(min(n, self.step))


RECORDS = [(1, "http://a/", b"", None), (2, None, b"x" * 200_000, None), (3, "http://b/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n".encode(), None), (4, "u", b"x" * 200_000, 2), (None, "u", b"\r\n\r\n", None)]


@pytest.mark.parametrize("step", [1, 7, 1000, 10**9])
def test_round_trip(step):
    archive = b"".join(warc.page_record(*r) for r in (RECORDS if step > 1 else RECORDS[:1] + RECORDS[2:3]))
    got = list(warc.read(Trickle(archive, step)))
    want = RECORDS if step > 1 else RECORDS[:1] + RECORDS[2:3]
    assert len(got) == len(want)
    for g, (page, _, payload, response) in zip(got, want, strict=True):
        assert warc._id(g.fields["warc-record-id"]) == page
        assert g.payload == (b"" if response else payload)
        assert g.fields["warc-payload-digest"] == "sha1:" + warc.base32_sha1(payload)
        assert int(g.http["content-length"]) == len(payload)
        assert g.fields["warc-type"] == ("revisit" if response else "response")
    assert list(warc.read(io.BytesIO(b""))) == []


def test_one_member_per_record():
    archive = b"".join(warc.page_record(*r) for r in RECORDS)
    members, rest = 0, archive
    while rest:
        z = zlib.decompressobj(31)
        z.decompress(rest)
        rest, members = z.unused_data, members + 1
    assert members == len(RECORDS)
    assert gzip.decompress(archive).count(b"WARC-Type: ") == len(RECORDS)


def test_damage_is_told():
    good = warc.page_record(1, "u", b"payload" * 100, None)
    with pytest.raises(warc.WarcError, match="within a member"):
        list(warc.read(io.BytesIO(good[:-12])))
    plain = gzip.decompress(good)
    for bad, why in ((plain.replace(b"payloadpay", b"payloadpax", 1), "digest"), (plain[:-4] + b"more\r\n\r\n", "longer"), (plain[:-40], "shorter"), (b"HTTP" + plain, "not a WARC")):
        with pytest.raises(warc.WarcError, match=why):
            list(warc.read(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.WarcError, match="damaged"):
        list(warc.read(io.BytesIO(b"no gzip at all")))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_write_and_read_back(spark):
    rows = [(1, "u1", "same", "d"), (7, "u7", "same", None), (3, None, "same", "d"), (4, "u4", None, "d"), (5, "u5", "", "d"), (6, "u", "été", "d"), (None, "u", "same", "d"), (6, "u", "été", "d"), (None, "u", "alone", "d")]
    folder, files = warc.write(pages(spark, rows))
    got = warc.read_archives(spark, files).collect()
    assert len(got) == len(rows)
    by = {(g["page_id"], g["payload_digest"]): g for g in got}
    d = lambda t: warc.base32_sha1((t or "").encode())
    for page, _, html, _ in rows:
        g = by[page, d(html)]
        ids = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        last = max(ids, default=None)
        assert (g["record_type"], g["refers_to"]) == (("response", None) if page == last or last is None else ("revisit", last))
        assert g["payload_bytes"] == len((html or "").encode())
    warc.remove_archives(folder)


def test_empty_table(spark):
    _, files = warc.write(pages(spark, []))
    assert warc.read_archives(spark, files).collect() == []


@pytest.mark.parametrize("step", [1 << 16, 5000])
def test_long_heads(step):
    url = "http://h/" + "u" * 3_000_000
    archive = warc.page_record(1, url, b"p", None) + warc.page_record(2, "v", b"q", None)
    one, two = warc.read(Trickle(archive, step))
    assert one.fields["warc-target-uri"] == url and (one.payload, two.payload) == (b"p", b"q")


@pytest.mark.parametrize("most", [0, warc.MAX_BROADCAST])
def test_revisits_are_held_against_their_response(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST", most)
    folder, files = warc.write(pages(spark, [(i, "u", f"t{i % 4}", None) for i in range(40)]))
    rows = warc.read_archives(spark, files)
    assert rows.filter("record_type = 'revisit'").count() == 36 and warc.broken_revisits(rows).count() == 0
    assert warc.broken_revisits(rows.filter("page_id <> 39")).count() == 9
    warc.remove_archives(folder)
