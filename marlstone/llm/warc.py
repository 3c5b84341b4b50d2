"""Zstandard WARC archives: write one frame per record behind a dictionary frame, and read them back.

An archive starts with a skippable frame that holds the compression dictionary (raw, or itself compressed); every
record is one zstd frame of its own. The reader streams the file through a window of about CHUNK bytes and decodes a frame
at a time, whether or not its header states the content's size, so it holds one record at a time; it checks magic numbers, lengths, WARC header lines, block length, the closing blank lines and the
payload digest.

Writing: each task rolls archives of about `archive_mb` into the shared folder under names of its own, and returns a
manifest row per closed archive. Only archives in the manifest are read, so a task that ran twice or died leaves
nothing but an unread file. Files are opened through pyarrow's file systems by URI.

Defined cases: a null html is the empty payload; a null url leaves the target out; null page ids are kept, and come
after all others when the response of equal payloads is chosen; rows that repeat a page id and payload are alike, all
responses or all revisits; empty tables give no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import cut, shared_dir

#: Fixed values of the zstd format (RFC 8878) and of the skippable frame that WARC archives keep their dictionary in.
FRAME_MAGIC, DICTIONARY_MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
#: Pages from which the dictionary is trained, the most characters of each, and the dictionary's bytes.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 32_768
#: Bytes of an archive read at a time, and given to a frame's decoder at a time.
CHUNK, FEED = 1 << 20, 1 << 13
RECORD, PROFILE = "urn:marlstone:page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """A malformed archive or record."""


class Window:
    """The unread bytes of a file, of which about CHUNK are held at a time."""

    def __init__(self, file):
        self.file, self.data, self.begin, self.at = file, b"", 0, 0

    def fill(self, n: int) -> int:
        """How many bytes stand unread, at least n unless the file ends before."""
        while len(self.data) - self.begin < n and (more := self.file.read(max(CHUNK, n))):
            self.data, self.begin = self.data[self.begin :] + more, 0
        return len(self.data) - self.begin

    def ahead(self, n: int) -> bytes:
        """The next n bytes or what there is of them; they stay unread."""
        self.fill(n)
        return self.data[self.begin : self.begin + n]

    def take(self, n: int, what: str) -> bytes:
        out = self.ahead(n)
        if len(out) < n:
            raise WarcError(f"{what} at byte {self.at} is cut short")
        self.begin += n
        self.at += n
        return out

    def frame(self, opener: zstandard.ZstdDecompressor) -> bytes:
        """The content of the zstd frame that starts here, whether or not its header tells the size."""
        start, reader, out = self.at, opener.decompressobj(), []
        try:
            while not reader.eof:
                if not self.fill(1):
                    raise WarcError(f"frame at byte {start} is cut short")
                given = self.data[self.begin : self.begin + FEED]
                out.append(reader.decompress(given))
                used = len(given) - len(reader.unused_data)
                self.begin += used
                self.at += used
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {start}: {e}") from e
        return b"".join(out)

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.take(min(n, CHUNK), "skippable frame"))


def frames(source) -> Iterator[bytes]:
    """The content of every record frame of an archive, given as bytes or as a file open for reading; one record and
    about CHUNK bytes are held at a time. The dictionary is that of the leading skippable frame, if there is one."""
    window = Window(io.BytesIO(source) if isinstance(source, bytes) else source)
    opener = zstandard.ZstdDecompressor()
    while head := window.ahead(8):
        magic, size = int.from_bytes(head[:4], "little"), int.from_bytes(head[4:], "little")
        if magic == DICTIONARY_MAGIC and not window.at:
            window.take(8, "dictionary frame")
            data = window.take(size, "dictionary frame")
            if data[:4] == struct.pack("<I", FRAME_MAGIC):
                data = Window(io.BytesIO(data)).frame(zstandard.ZstdDecompressor())
            opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        elif magic in SKIPPABLE:
            window.take(8, "skippable frame")
            window.skip(size)
        elif magic == FRAME_MAGIC:
            yield window.frame(opener)
        else:
            raise WarcError(f"no frame at byte {window.at}")


def header_lines(block: bytes, first: bytes) -> dict[str, str]:
    lines = block.split(b"\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"expected {first.decode()}, found {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"bad header line {line[:60]!r}")
        out[name.decode("latin-1").lower()] = value.strip().decode("utf-8")
    return out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def number(value: str | None, what: str) -> int:
    if value is None or not value.isdigit():
        raise WarcError(f"{what} is missing or no number")
    return int(value)


def page_of(uri: str | None) -> int | None:
    if not uri or not uri.startswith(f"<{RECORD}") or uri[-1] != ">":
        raise WarcError(f"bad record id {uri!r}")
    value = uri[len(RECORD) + 1 : -1].partition(":")[0]
    return None if value == "none" else int(value)


def parse_record(data: bytes) -> tuple:
    """A row of RECORD_SCHEMA; raises WarcError for anything out of place."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("record without a header's end")
    fields = header_lines(head, b"WARC/1.")
    for need in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if need not in fields:
            raise WarcError(f"header {need} is missing")
    size = number(fields.get("content-length"), "Content-Length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"record of {len(rest) - 4} bytes says {size}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("block without a header's end")
    length = number(header_lines(http, b"HTTP/1.").get("content-length"), "HTTP Content-Length")
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    refers = None
    if kind == "response":
        if len(payload) != length:
            raise WarcError(f"payload of {len(payload)} bytes says {length}")
        if digest(payload) != said:
            raise WarcError("payload digest differs")
    elif kind == "revisit":
        if payload or fields.get("warc-profile") != PROFILE:
            raise WarcError("revisit with a payload or another profile")
        refers = page_of(fields.get("warc-refers-to"))
    else:
        raise WarcError(f"unknown type {kind!r}")
    return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, length, said, payload if kind == "response" else None


def format_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "none:" + uuid.uuid5(uuid.NAMESPACE_URL, f"{url}:{sha1}").hex if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame) -> bytes:
    """From a bounded sample: the SAMPLE_PAGES short pages of lowest hash. Empty if there are too few."""
    html = pages["html"].cast("string")
    short = pages.where(F.length(html).between(1, SAMPLE_CHARS)).select(html.alias("html"), F.xxhash64(html).alias("h"))
    # tasks send hashes, not pages: at most SAMPLE_PAGES of them are chosen, and then their pages fetched, one each
    chosen = short.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES)
    rows = short.join(F.broadcast(chosen), "h", "left_semi").groupBy("h").agg(F.min("html").alias("html")).sort("h").collect()
    if len(rows) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [format_record(0, "http://example.com/", r["html"].encode(), digest(r["html"].encode()), None, "2024-01-01T00:00:00Z") for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages as (page_id, url, html, sha1, refers_to): refers_to is the smallest page id with the same payload, null
    for that page itself and for payloads under least_bytes. Payloads move once, by page id, which no hot payload skews.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html")).withColumn("sha1", F.sha1("html"))
    narrow = cut(rows.select("page_id", "sha1", F.octet_length("html").alias("size")).distinct())
    firsts = narrow.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = narrow.join(firsts, ["sha1", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    again = again.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), F.col("first").alias("refers_to"))
    return rows.join(again, rows["page_id"].eqNullSafe(again["p"]) & (rows["sha1"] == again["s"]), "left").drop("p", "s")


def write_archives(pages: DataFrame, folder: str | None = None, archive_mb: float = 64, level: int = 3, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Write the pages' records under folder (default: in the shared folder) and return the manifest of archives."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    raw = train_dictionary(pages)
    rows = revisits(pages, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=level)
        out, path, count, done = None, "", 0, []

        def close():
            done.append((path, count, out.tell()))
            out.close()

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, sha1, refers = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    path, count = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(path, compression=None)
                    if raw:
                        packed = zstandard.ZstdCompressor(level=9).compress(raw)
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
                out.write(writer.compress(format_record(page_id, url, html, base64.b32encode(bytes.fromhex(sha1)).decode(), refers, date)))
                count += 1
                if out.tell() >= archive_mb * 1e6:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([{"path": p, "records": n, "bytes": b} for p, n, b in done])

    return cut(rows.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, MANIFEST)).withColumn("folder", F.lit(folder))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of RECORD_SCHEMA for every record of the archives in the manifest (columns folder, path, records, bytes). An archive
    that has another length, or gives another number of records, than was written is an error: a cut between two frames
    looks like an end otherwise."""
    spark = manifest.sparkSession
    schema = T._parse_datatype_string(RECORD_SCHEMA) if payloads else T._parse_datatype_string(RECORD_SCHEMA.rpartition(",")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = [(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema]
        for batch in batches:
            for folder, path, records, length in zip(*(c.to_pylist() for c in batch.columns)):
                store, _ = fs.FileSystem.from_uri(folder)
                there = store.get_file_info(path).size
                if there != length:
                    raise WarcError(f"{path} has {there} bytes, {length} were written")
                rows, size, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as f:
                    for record in frames(f):
                        seen += 1
                        rows.append(parse_record(record)[: len(types)])
                        size += len(record) if payloads else 300
                        if size >= 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])
                            rows, size = [], 0
                if seen != records:
                    raise WarcError(f"{path} gave {seen} records, {records} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("folder", "path", "records", "bytes").repartition(parts, "path").mapInArrow(run, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages and return what the archives say of each."""
    return read_archives(write_archives(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
