"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Archives are written by Spark's own text sink, so they reach any store that Spark writes to and survive
lost tasks: a task writes one archive, a row is a gzip member without its last byte, and the line separator
is that byte. The last byte of a member is the high byte of its length, 0 for records under 16 MB; a longer
record is followed by an empty member, which ends in 0.

Every member begins with the ten bytes of HEAD, which no member holds a second time. So archives can be read
by ranges: Spark's text source cuts a file at HEAD wherever its splits fall, and a task reads its range record
by record, with one record in memory. Archives from elsewhere are read whole files at a time."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteloom.llm.common import session

LEAST_BYTES = 100  # smaller payloads are always stored
REPEATED_DIGESTS = 100_000  # up to as many repeated digests are broadcast; beyond it they are joined by hash
SALTS = 32  # parts of a digest's rows in that join
READ_BYTES = 1 << 16
BATCH_BYTES = 4 << 20
HEAD = bytes.fromhex("1f8b08000000000000ff")  # gzip, deflate, no flags, no time, no named system
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head of the response it stands for, without the payload."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    kind, more = "response", ""
    if refers_to is not None:
        kind, more = "revisit", f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: {PROFILE}\r\n"
    else:
        body += payload
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}\r\nWARC-Payload-Digest: sha256:{digest}\r\n{more}"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """``data`` as one gzip member that begins with HEAD and holds it nowhere else."""
    for at in (level, *range(1, 10)):
        out = HEAD + zlib.compress(data, at, wbits=-15) + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
        if out.find(HEAD, 1) < 0:
            return out
    raise ValueError("a record holds the head of a gzip member at every level of compression")


EMPTY_MEMBER = gzip_member(b"")


def line(member: bytes) -> bytes:
    return member[:-1] if member[-1] == 0 else member + EMPTY_MEMBER[:-1]


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, most: int = REPEATED_DIGESTS) -> DataFrame:
    """(id, url, payload, bytes, digest, refers_to): the first record of equal payloads of ``least`` bytes or more is kept
    whole, the payload of others, which refer to it, is null.

    Null payloads are empty. Rows that share the smallest id are all kept whole; a null id is never referred to. Up to
    ``most`` repeated digests are broadcast. Beyond it, digests, ids and urls alone meet the first ids, each digest in
    SALTS parts, and payloads are shuffled once, by id and digest, to leave out those that refer; short ones stay in place."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    long = F.col("bytes") >= least
    first = rows.filter(long).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    columns = ["id", "url", "payload", "bytes", "digest", "refers_to"]
    if first.limit(most + 1).count() <= most:
        found = rows.join(F.broadcast(first), "digest", "left").withColumn("refers_to", F.when(long, refers))
        return found.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).select(columns)
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    narrow = rows.filter(long).drop("payload").withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int"))
    revisits = narrow.join(salted, ["digest", "salt"]).withColumn("refers_to", refers).filter("refers_to is not null").withColumn("payload", F.lit(None).cast("binary"))
    gone = revisits.select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    kept = rows.filter(long).join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti")
    whole = kept.unionByName(rows.filter(~long)).withColumn("refers_to", F.lit(None).cast("long"))
    return whole.select(columns).unionByName(revisits.select(columns))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 6, most: int = REPEATED_DIGESTS) -> None:
    """Write a record per row, one gzip member each; a task writes one archive, so there are as many as the table has splits.

    An empty table leaves a folder without records. Other columns take no part; repeated rows are repeated records. A record
    is held whole in memory, in the writer as in the reader, so a payload has to be under 2 GB."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for r in b.to_pylist():
                held.append(line(gzip_member(record(r["id"], r["url"], r["payload"], r["bytes"], r["digest"], r["refers_to"]), level)))
                size += len(held[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["member"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["member"])

    session(pages)
    lines = plan_records(pages, id_col, url_col, payload_col, most=most).mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").option("maxRecordsPerFile", 0).text(folder)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def fields(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}


def read_members(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of a gzipped archive in order: each member is inflated a chunk at a time, framed by its
    Content-Length. Empty members are passed over; a cut or malformed record raises ValueError."""
    chunks = iter(chunks)
    rest = b""
    while True:
        if not rest:
            rest = next(chunks, b"")
            if not rest:
                return
        stream, held, head, want = zlib.decompressobj(wbits=31), bytearray(), None, 0
        while not stream.eof:
            try:
                held += stream.decompress(rest)
            except zlib.error as e:
                raise ValueError("a member is not in gzip's format") from e
            rest = stream.unused_data
            if head is None and (end := held.find(b"\r\n\r\n")) >= 0:
                head = bytes(held[: end + 2])
                if not head.startswith(b"WARC/1."):
                    raise ValueError("a record does not begin with a WARC version")
                want = end + 4 + int(fields(head)["content-length"])
            if head is not None and len(held) > want + 4:
                raise ValueError("a record is longer than its Content-Length")
            if not stream.eof:
                rest = next(chunks, b"")
                if not rest:
                    raise ValueError("the archive ends within a record")
        if head is None:
            if held:
                raise ValueError("a record has no end of its head")
            continue
        if len(held) != want + 4 or held[want:] != b"\r\n\r\n":
            raise ValueError("a record's Content-Length is not that of its block")
        yield Record(fields(head), bytes(held[len(head) + 2 : want]))


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def parsed(r: Record) -> dict:
    head, _, payload = r.block.partition(b"\r\n\r\n")
    stored = r.headers["warc-type"] == "response"
    digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
    length = int(fields(head + b"\r\n")["content-length"])
    return {
        "page_id": page_of(r.headers["warc-record-id"]), "url": r.headers.get("warc-target-uri"), "record_type": r.headers["warc-type"],
        "refers_to": page_of(r.headers.get("warc-refers-to")), "payload_bytes": length, "payload_digest": digest,
        "verified": not stored or (len(payload) == length and hashlib.sha256(payload).hexdigest() == digest), "payload": payload if stored else None,
    }


def pieces(content: memoryview) -> Iterator[bytes]:
    for i in range(0, len(content), READ_BYTES):
        yield bytes(content[i : i + READ_BYTES])


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, by_ranges: bool = True) -> DataFrame:
    """A row per record. verified: the stored payload has the length and SHA-256 that its head states (revisits store none).

    ``by_ranges`` splits archives whose members all begin with HEAD, as those of ``write_archives`` do, like any text file.
    Without it any archive of one member a record is read, whole files in a task, each in memory: under 2 GB. A member
    that is cut or malformed raises ValueError either way."""
    session(spark)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "verified"] + ["payload"] * with_payload
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def archives(column: pa.Array) -> Iterator[Iterator[bytes]]:
        """The stretches of whole members that a batch holds, as chunks of bytes."""
        contents = (memoryview(c.as_buffer()) for c in column)
        if not by_ranges:
            return (pieces(c) for c in contents)
        return iter([(part for c in contents if len(c) for part in (HEAD, *pieces(c)))])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for chunks in archives(b.column(0)):
                for r in read_members(chunks):
                    row = parsed(r)
                    held.append({n: row[n] for n in names})
                    size += len(r.block) if with_payload else 200
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    ddl = ", ".join(f"{n} {'binary' if n == 'payload' else 'boolean' if n == 'verified' else 'long' if n in types else 'string'}" for n in names)
    if by_ranges:
        lines = spark.read.option("lineSep", HEAD.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
        return lines.select(F.col("value").cast("binary").alias("content")).mapInArrow(records, ddl)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(records, ddl)
