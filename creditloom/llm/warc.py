"""Operator 9, WARC: archives written by Spark's own text sink, and a salvage reader that recovers records after damaged bytes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import stored
from creditloom.session import fresh_path

VERSION = b"WARC/1.1"
CRLF2 = b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The last byte of a member is the top byte of its size: 0 while the member holds less than this.
MEMBER = (1 << 24) - 1
SALTS = 64
BATCH_BYTES = 8 << 20
#: An archive is read whole by one task.
FILE_BYTES = 512 << 20


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, origin: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that names the response with the same payload."""
    block = HTTP + payload if origin is None else HTTP
    lines = [VERSION, b"WARC-Type: " + (b"response" if origin is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    if origin is not None:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % origin]
    lines += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % len(payload), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode()]
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + CRLF2 + block + CRLF2


def members(data: bytes, level: int = 4) -> bytes:
    """Gzip members of less than 16 MB each, one for a usual record."""
    out = []
    for at in range(0, len(data), MEMBER):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += [packer.compress(data[at : at + MEMBER]), packer.flush()]
    return b"".join(out)


def with_origin(pages: DataFrame, least: int) -> DataFrame:
    """Adds ``payload, digest, origin``: origin is the smallest page_id with the same payload, null for that page itself and for short payloads.

    A payload that many pages share is spread by a salt of the page, minima are taken per salt and then over the few salts.
    """
    rows = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    part = rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest", "salt").agg(F.min("page_id").alias("low"), F.count("*").alias("n"))
    shared = part.groupBy("digest").agg(F.min("low").alias("origin"), F.sum("n").alias("n")).where("n > 1").select("digest", "origin")
    shared = shared.select("digest", "origin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.join(shared, ["digest", "salt"], "left").drop("salt")
    return joined.withColumn("origin", F.when(F.col("origin") < F.col("page_id"), F.col("origin")))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write every page as a record into gzip archives below ``path``, one member for each record.

    The text sink writes a string's bytes as they are and ends each value with its separator, here the zero byte that ends every
    gzip member, so any file system that Spark reaches can hold the archives. Of pages with equal payloads of at least ``least``
    bytes the smallest page_id is the response and the rest revisit it; pages that share that page_id and payload are all responses. A
    null html is an empty payload. A page without id is a response of its own. A file holds so many records that it stays below ``FILE_BYTES`` even if all are as long as the longest
    page (one record at least).
    """
    longest = pages.agg(F.max(F.octet_length(F.col(html)) + F.coalesce(F.octet_length(F.col(url)), F.lit(0)))).first()[0] or 0
    per_file = max(1, min(20_000, FILE_BYTES // (longest + 1024)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                value = members(record(row[0], row[1], row[2], row[3], row[4], date))
                held.append(value[:-1])
                size += len(value)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = with_origin(source, least).select("page_id", "url", "payload", "digest", "origin")
    rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


@dataclass
class Found:
    """A record, or with ``reason`` set a gap of quarantined bytes ``start`` to ``end``."""

    start: int
    end: int
    head: dict[str, str]
    block: bytes
    reason: str | None = None


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | str:
    """The record at ``at``: head, block and end; or what is wrong with it."""
    if data[at : at + 7] != b"WARC/1." or not data[at + 7 : at + 8].isdigit() or data[at + 8 : at + 10] != b"\r\n":
        return "no version line"
    body = data.find(CRLF2, at)
    if body < 0:
        return "no end of head"
    head = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad head line"
        head[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        return "no content length"
    start = body + 4
    end = start + int(head["content-length"])
    if end + 4 > len(data):
        return "cut short"
    if data[end : end + 4] != CRLF2:
        return "no end of record"
    block = data[start:end]
    kind, _, digest = head.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        return "block digest differs"
    return head, block, end + 4


def member(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` unpacks to, its end, and what is wrong with it, if anything: then the bytes up to the damage.

    Input is fed in small steps, so that no tail is copied; the step that fails is fed again byte by byte.
    """
    if data[at : at + 3] != MAGIC:
        return b"", at, "no member"
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        step = data[at : at + 65536]
        if not len(step):
            return b"".join(out), at, "cut short"
        again = unpack.copy()
        try:
            out.append(unpack.decompress(step))
        except zlib.error as e:
            for k in range(len(step)):
                try:
                    out.append(again.decompress(step[k : k + 1]))
                except zlib.error:
                    return b"".join(out), at + k + 1, f"bad member: {str(e)[:60]}"
        at += len(step)
    return b"".join(out), at - len(unpack.unused_data), None


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive in order, and the gaps between them.

    After a failed check the reader looks for the next gzip member that unpacks to a record, or in a plain archive and in the unpacked bytes of a member for
    the next version line whose record passes its checks. The bytes before it are one gap (inside a member: the member's); what follows is read as usual.
    """
    packed = data[:3] == MAGIC or (data[:5] != b"WARC/" and data.find(MAGIC) >= 0 and data.find(b"WARC/1.") < 0)
    view, at = memoryview(data), 0
    while at < len(data):
        start = at
        got = _packed_records(view, at) if packed else parse(data, at)
        if not isinstance(got, str):
            for head, block, end, reason in got if packed else [(*got, None)]:
                yield Found(start, end, head, block, reason)
                at = end
            continue
        at += 1
        while True:
            at = data.find(MAGIC if packed else b"WARC/1.", at)
            if at < 0:
                at = len(data)
                break
            if not isinstance(_packed_records(view, at) if packed else parse(data, at), str):
                break
            at += 1
        yield Found(start, at, {}, b"", got)


def _packed_records(view: memoryview, at: int) -> list[tuple[dict[str, str], bytes, int, str | None]] | str:
    """Records of the member at ``at``; a record that is longer goes on in the members behind it. Where one fails, the next version line in the unpacked bytes
    whose record passes its checks goes on, and an entry with a reason stands between. The reason alone if there is no record at all."""
    data, end, bad = member(view, at)
    if data[:5] != b"WARC/":
        return bad or "member without version line"
    out: list[tuple[dict[str, str], bytes, int, str | None]] = []
    done = 0
    while done < len(data):
        got = parse(data, done)
        if got in ("cut short", "no end of head") and bad is None and end < len(view):
            more, more_end, more_bad = member(view, end)
            fresh = more[:5] == b"WARC/" and got == "cut short" and len(data) - done < MEMBER
            if more and not fresh:
                data, done, end, bad = data[done:] + more, 0, more_end, more_bad
                continue
        if not isinstance(got, str):
            out.append((got[0], got[1], end, None))
            done = got[2]
            continue
        out.append(({}, b"", end, bad or got))
        done = data.find(b"WARC/1.", done + 1)
        while done >= 0 and isinstance(parse(data, done), str):
            done = data.find(b"WARC/1.", done + 1)
        if done < 0:
            break
    if bad and not (out and out[-1][3]):
        out.append(({}, b"", end, bad))
    return out if any(r[3] is None for r in out) else out[0][3]


FOUND = (
    "file string, start long, end long, gap string, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_length long, payload binary"
)


def read_archives(spark, path: str) -> DataFrame:
    """Records and gaps of all archives below ``path``, gzip or plain: ``file, start, end``, then ``gap`` (why the bytes are quarantined; null for a
    record) and the record's fields. ``payload`` is what follows the HTTP head of the block.

    An archive is read whole by one task, so it must be under the 2 GB a row can hold. An empty archive has no rows; one without any
    valid record is a single gap. A response whose payload does not have the digest its head names is a gap, too.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for x in salvage(content.as_py() or b""):
                    row = fields(name, x)
                    held.append(row)
                    size += len(row["payload"] or b"") + 256
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in FOUND.split(", ")])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, FOUND)


def fields(name: str, x: Found) -> dict:
    out = dict.fromkeys((c.split()[0] for c in FOUND.split(", ")), None) | {"file": name, "start": x.start, "end": x.end, "gap": x.reason}
    if x.reason:
        return out
    kind, digest = x.head.get("warc-type"), x.head.get("warc-payload-digest", "").rpartition(":")[2].lower()
    payload = x.block.partition(CRLF2)[2] if x.head.get("content-type", "").startswith("application/http") else x.block
    if kind == "response" and digest and hashlib.sha256(payload).hexdigest() != digest:
        return out | {"gap": "payload digest differs"}
    length = x.head.get("x-payload-length", "")
    return out | {
        "record_type": kind, "record_id": x.head.get("warc-record-id"), "target_uri": x.head.get("warc-target-uri"), "refers_to": x.head.get("warc-refers-to"),
        "payload_digest": digest or None, "payload_length": len(payload) if kind == "response" else int(length) if length.isdigit() else None, "payload": payload,
    }


def archive_and_read(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and return what the reader finds in them."""
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path, least=least)
    return read_archives(spark, path)


def page_rows(found: DataFrame) -> DataFrame:
    """Per record: the page, its payload's size and digest, how it is stored. The reader is run once; a gap among them is an error."""
    number = r"<urn:page:(-?\d+)>"
    rows = found.select(
        F.nullif(F.regexp_extract("record_id", number, 1), F.lit("")).cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        "payload_digest", "record_type", F.nullif(F.regexp_extract("refers_to", number, 1), F.lit("")).cast("long").alias("refers_to"), "gap", "start", "end",
    )
    held = stored(rows, "records")
    if gap := held.where("gap IS NOT NULL").first():
        raise RuntimeError(f"archive damaged: {gap}")
    return held.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
