"""WARC archives: a writer that stores repeated payloads once, and a reader that salvages damaged ones.

The writer makes one gzip member per record and rotates archives at ``ROTATE`` bytes. A task's archives have names of
their own; which of them count is in a manifest that Spark commits, so that what a lost task left behind is never read.

The reader checks each member's or record's framing, gzip checksum, length and digest. Where a check fails it
searches for the next place where a record passes: a version line, or a gzip member that begins with one, whichever comes first, be the
archive compressed or not. It goes on from there and logs the bytes between as a quarantined gap. A member may hold several records; a
bad one among them is skipped alike, and its gap has the member's offset and counts bytes of what the member holds. An archive is read
in pieces, so its time is in proportion to its size; it is one row, so its size is bounded by that of a row, 2 GB. Those
written here are much smaller.

Edge cases: null html is an empty payload; payloads under ``LEAST`` bytes are always responses; of rows with a payload's smallest
page_id one is the response and the others revisit it, as do rows with a null page_id; if all have a null page_id, all are
responses; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import slices
from .common import drop_at_exit, fresh_path, require, table

LEAST = 100
ROTATE = 16 << 20
#: Bytes that a decompressor is fed at a time.
PIECE = 16 << 10
#: Most names of archives that are broadcast; more are joined by shuffling.
BROADCAST = 1_000_000
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def urn(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, uncompressed. A revisit has the payload's length and digest but not the payload."""
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:x-page:{page_id}"
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if "application/http" in self.headers.get("content-type", "") else self.block


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damage(ValueError):
    pass


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at ``at``, and where the next one does."""
    if not VERSION_LINE.match(data, at):
        raise Damage("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damage("header without end")
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not headers.get("content-length", "").isdigit():
        raise Damage("no content length")
    end = head + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("block of another length")
    block = data[head + 4 : end]
    kind, _, value = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != value:
        raise Damage("block digest differs")
    return Record(at, headers, block), end + 4


def unpack(data: bytes, at: int) -> tuple[bytes, int]:
    """What the gzip member that begins at ``at`` holds, and where the next one begins. It is fed in pieces, so what follows isn't copied."""
    opener, out = zlib.decompressobj(31), []
    try:
        while not opener.eof:
            piece = data[at : at + PIECE]
            if not piece:
                raise Damage("member without end")
            out.append(opener.decompress(piece))
            at += len(piece)
    except zlib.error as e:
        raise Damage(str(e)) from e
    return b"".join(out), at - len(opener.unused_data)


def starts(data: bytes, at: int) -> bool:
    """Whether a gzip member at ``at`` begins with a version line; reads its first bytes only."""
    try:
        return bool(VERSION_LINE.match(zlib.decompressobj(31).decompress(data[at : at + 512], 64)))
    except zlib.error:
        return False


class Places:
    """Where in ``data`` a record may begin. What was found ahead is kept, so that many gaps don't search the same bytes again."""

    def __init__(self, data: bytes):
        self.data, self.line, self.member = data, -1, -1

    def following(self, at: int) -> int:
        """The next such place from ``at`` on, or the end."""
        if self.line < at:
            found = VERSION_LINE.search(self.data, at)
            self.line = found.start() if found else len(self.data)
        if self.member < at:
            while (at := self.data.find(MEMBER, at)) >= 0 and not starts(self.data, at):
                at += 1
            self.member = at if at >= 0 else len(self.data)
        return min(self.line, self.member)


def records(data: bytes, offset: int | None = None) -> Iterator[Record | Gap]:
    """Records and gaps in order. ``offset`` is that of the member whose content ``data`` is."""
    places, at, begun, reason = Places(data), 0, None, ""
    while at < len(data):
        try:
            if offset is None and data.startswith(MEMBER, at):
                inside, end = unpack(data, at)
                found = list(records(inside, at))
                if inside and not any(isinstance(x, Record) for x in found):
                    raise Damage(found[0].reason)
            else:
                one, end = parse(data, at)
                if offset is not None:
                    one.offset = offset
                found = [one]
        except Damage as e:
            if begun is None:
                begun, reason = at, str(e)
            at = places.following(at + 1)
            continue
        if begun is not None:
            yield Gap(begun if offset is None else offset, at - begun, reason)
            begun = None
        yield from found
        at = end
    if begun is not None:
        yield Gap(begun if offset is None else offset, len(data) - begun, reason)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks and the gaps between, in order. Offsets are those of the archive."""
    return records(data)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload occurs again; only ids and digests are moved."""
    named = pages.filter(F.col("size") >= least).select("page_id", "digest")
    first = named.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return named.distinct().join(first, "digest")


def write(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` to archives in the folder ``path``; returns the manifest (archive, records, bytes)."""
    require(pages, "page_id", "html")
    spark = pages.sparkSession
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    html = F.coalesce("html", F.lit(""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html")).withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    # Null ids are joined by two columns that aren't null, so that the join's partitioning also serves the window.
    key = {"k": F.coalesce("page_id", F.lit(0)), "absent": F.col("page_id").isNull()}
    other = revisits(full, least).withColumns(key).drop("page_id")
    joined = full.withColumns(key).join(other.hint("shuffle_hash"), ["k", "absent", "digest"], "left")
    # Of equal rows with the smallest page_id one is the response.
    turn = F.row_number().over(W.partitionBy("k", "absent", "digest").orderBy("url"))
    refers_to = F.when((F.col("page_id") == F.col("refers_to")) & (turn == 1), None).otherwise(F.col("refers_to"))
    ready = joined.select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))
    store, root = pa.fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(path)
        waiting, size = [], 0

        def rotate() -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}.warc.gz"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
                for x in waiting:
                    f.write(x)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(waiting)], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for part, texts in slices(batches, "html"):
            page_id, url, digest, refers_to = (part.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for row in zip(page_id, url, texts, digest, refers_to, strict=True):
                one = member(record(row[0], row[1], row[2].encode("utf-8"), row[3], row[4]))
                if waiting and size + len(one) > ROTATE:
                    yield rotate()
                    waiting, size = [], 0
                waiting.append(one)
                size += len(one)
        if waiting:
            yield rotate()

    manifest = f"{path}/manifest"
    ready.mapInArrow(run, "archive string, records long, bytes long").write.parquet(manifest)
    return spark.read.schema("archive string, records long, bytes long").parquet(manifest)


ENTRY = "archive string, offset long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, gap_bytes long, reason string"


def read(spark: SparkSession, path: str, manifest: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """All records and quarantined gaps of archives in the folder ``path``, or of those in ``manifest(archive, ...)``.

    A gap's record_type is ``quarantined``. A response's length and digest are taken from the payload as read, a
    revisit's from its headers. With ``payloads`` the payload itself comes along.
    """
    schema = ENTRY + (", payload binary" if payloads else "")
    fields = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for x in salvage(data):
            if isinstance(x, Gap):
                yield (name, x.offset, None, "quarantined", None, None, None, x.length, x.reason, None)
                continue
            kind, payload = x.headers.get("warc-type"), x.payload()
            refers_to = page_of(x.headers.get("warc-refers-to"))
            if kind == "revisit":
                length = x.headers.get("x-payload-length", "")
                size, digest = int(length) if length.isdigit() else 0, x.headers.get("warc-payload-digest", "").removeprefix("sha256:")
            else:
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            yield (name, x.offset, page_of(x.headers.get("warc-record-id")), kind, refers_to, size, digest, None, None, payload if payloads else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = rows(batch.column("path")[i].as_py(), batch.column("content")[i].as_py())
                while part := list(islice(found, 64 if payloads else 1024)):
                    columns = list(zip(*part, strict=True))[: len(fields)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], fields)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    if manifest is not None:
        names = manifest.select(F.col("archive").alias("name"))
        name = F.element_at(F.split("path", "/"), -1)
        files = files.join(F.broadcast(names) if names.count() <= BROADCAST else names, name == F.col("name"), "left_semi")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes the pages to archives in ``path`` and reads those back."""
    return read(pages.sparkSession, path, write(pages, path))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``, written to archives in the shared folder and read back."""
    path = fresh_path(spark, "warc")
    found = round_trip(table(spark, sf_dir, "pages"), path)
    drop_at_exit(spark, path)
    return found.filter("record_type <> 'quarantined'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) first, row_number() over (partition by payload_digest order by page_id nulls last) turn from p),
r as (select *, payload_bytes >= 100 and turn > 1 and first is not null revisit from f)
select page_id, cast(payload_bytes as bigint) payload_bytes, payload_digest,
  case when revisit then 'revisit' else 'response' end record_type, case when revisit then first end refers_to from r
"""
