import base64
import hashlib
import struct

import pytest
import zstandard

from marlstone.llm import warc


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://e.com/{i}", f"<p>page {i % 40} {'x' * (i % 40)}</p>") for i in range(120)]
    rows += [(200, None, None), (201, "http://e.com/a b\nc", ""), (None, "u", "<p>only here</p>"), (None, "u", "<p>page 1 x</p>"), (202, "l", "y" * 300_000), (203, "r", "twin"), (203, "r", "twin")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(pages):
    got = sorted((tuple(r)[:5] for r in warc.archived_pages(pages).collect()), key=repr)
    first = {}
    for r in pages.collect():
        h = r.html or ""
        if r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    want = []
    for r in pages.collect():
        h = (r.html or "").encode()
        f = first.get(r.html or "")
        revisit = f is not None and f != r.page_id
        want.append((r.page_id, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=repr)


def test_payloads_come_back(pages):
    html = {r.page_id: r.html or "" for r in pages.where("page_id is not null").collect()}
    rows = warc.read_archives(warc.write_archives(pages, archive_mb=0.01)).where("record_type = 'response' and page_id is not null").collect()
    assert rows and all(bytes(r.payload).decode() == html[r.page_id] for r in rows)


@pytest.mark.parametrize("change", [lambda r: (r["records"], r["bytes"] + 1), lambda r: (r["records"] - 1, r["bytes"])])
def test_archives_that_lost_something(pages, change):
    spark = pages.sparkSession
    manifest = warc.write_archives(pages)
    rows = [(r.path, *change(r), r.folder) for r in manifest.collect()]
    with pytest.raises(Exception, match="were written"):
        warc.read_archives(spark.createDataFrame(rows, manifest.schema)).count()


def test_a_cut_between_frames_is_seen(pages):
    manifest = warc.write_archives(pages.where("page_id < 40").coalesce(1))
    r = manifest.first()
    with open(r.path, "rb") as f:
        data = f.read()
    with open(r.path, "wb") as f:
        f.write(data[: data.rindex(b"\x28\xb5\x2f\xfd")])
    with pytest.raises(Exception, match="were written"):
        warc.read_archives(manifest).count()


def test_smaller_payloads_are_all_responses(pages):
    rows = warc.read_archives(warc.write_archives(pages, least_bytes=1000), payloads=False).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_empty(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def archive(records, dictionary=None, packed=False):
    out = b""
    if dictionary:
        data = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        out = struct.pack("<II", warc.DICTIONARY_MAGIC, len(data)) + data
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(write_checksum=True)
    return out + b"".join(c.compress(r) for r in records)


GOOD = warc.format_record(7, "http://e.com/", b"hello", warc.digest(b"hello"), None, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("packed", [False, True])
def test_dictionary_frame(packed):
    samples = [warc.format_record(i, f"http://e.com/{i}", b"page %d" % i * 9, warc.digest(b"page %d" % i * 9), None, "2024-01-01T00:00:00Z") for i in range(200)]
    d = zstandard.train_dictionary(2000, samples).as_bytes()
    assert list(warc.frames(archive(samples, d, packed))) == samples


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_streamed_frames_without_sizes(chunk, monkeypatch):
    import io

    monkeypatch.setattr(warc, "CHUNK", chunk)
    records = [GOOD, GOOD * 2000, b""]
    data = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    for r in records:
        c = zstandard.ZstdCompressor(write_content_size=False).compressobj()
        data += c.compress(r) + c.flush()
    assert list(warc.frames(io.BytesIO(data))) == records == list(warc.frames(data))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data[:-2])))


def test_columns_with_clashing_names_and_many_equal_payloads(pages):
    from pyspark.sql import functions as F

    odd = pages.select("*", *[F.lit(i).alias(n) for i, n in enumerate(["sha1", "refers_to", "size", "first", "n", "p", "s", "path", "folder"])])
    assert sorted(map(tuple, warc.archived_pages(odd).collect()), key=repr) == sorted(map(tuple, warc.archived_pages(pages).collect()), key=repr)
    many = pages.limit(0).unionAll(pages.sparkSession.range(3000).selectExpr("id as page_id", "'u' as url", "'same' as html"))
    rows = warc.archived_pages(many).groupBy("record_type", "refers_to").count().collect()
    assert {tuple(r) for r in rows} == {("response", None, 1), ("revisit", 0, 2999)}


def test_skippable_frames_between_records():
    data = archive([GOOD]) + struct.pack("<II", 0x184D2A51, 3) + b"abc" + archive([GOOD])
    assert list(warc.frames(data)) == [GOOD, GOOD]


@pytest.mark.parametrize("spoil", [
    lambda r: r.replace(b"hello", b"hellO"),
    lambda r: r[:-2],
    lambda r: r.replace(b"WARC-Date", b"X-Date"),
    lambda r: r.replace(b"WARC/1.1", b"WARD/1.1"),
    lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"),
    lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: other"),
    lambda r: r.replace(b"WARC-Type: response", b"no colon here"),
])
def test_malformed_records(spoil):
    assert warc.parse_record(GOOD)[0] == 7
    with pytest.raises(warc.WarcError):
        warc.parse_record(spoil(GOOD))


@pytest.mark.parametrize("data", [archive([GOOD])[:-3], b"\x28\xb5\x2f\xfd", b"nonsense", struct.pack("<II", warc.DICTIONARY_MAGIC, 99)])
def test_malformed_archives(data):
    with pytest.raises(warc.WarcError):
        list(warc.frames(data))
