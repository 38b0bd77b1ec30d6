"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Writer: payload digests are grouped (narrow rows, pre-aggregated), each page learns which page holds its payload, and
tasks write one gzip member a record to files of the shared folder. Reader: archives are cut into byte ranges; a task
scans its range for the gzip magic, takes a candidate for a member only when the first decoded bytes are the head of a
WARC record (version, type and length), and owns the records that start inside its range, reading beyond its end to
finish the last one. A member that cannot be decoded, and bytes behind a member that begin no other one, are errors: a
damaged archive never reads as a shorter one (`strict=False` skips what is between members).

Defined cases: null payload is empty; equal payloads of at least `min_bytes` have one response, that of the largest
page_id; a row with a null page_id is a revisit of the payload's page where one with an id holds it, else a response,
and has a null page_id again when read; rows that repeat a page_id each get a record; an empty table writes no archive
and reads as no records; null url is written as an empty target; only id, url and html are read, so other columns may
have any name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_path

#: Bytes of an archive that one task scans.
SPLIT_BYTES = 32 << 20
#: Bytes of compressed data that a candidate member's header is decoded from, and that are read at once.
PROBE_BYTES, READ_BYTES = 4096, 64 << 10
#: Decoded bytes of a candidate in which the head of a record is looked for.
HEAD_BYTES = 2048
#: Payloads smaller than this are always written whole.
MIN_BYTES = 0
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str):
    """(file system, path in it) of any store that Arrow knows, file: included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _record_id(page_id: int | None, url: str, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}" if page_id is not None else f"payload:{digest}:{url}")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only, which still tells the payload's length."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{_record_id(page_id, url, digest)}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = http + payload
    if refers_to is not None:
        block = http
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{_record_id(refers_to, url, digest)}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Headers of a record (names in lower case) and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    last = ""
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:  # a header that goes on
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        k, _, v = line.partition(b":")
        last = k.decode("latin-1").strip().lower()
        fields[last] = v.strip().decode("utf-8", "replace")
    return {"fields": fields, "block": rest[: int(fields["content-length"])]}


def page_plan(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, refers_to of each row of pages; the payloads move once, by page_id."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    # rows without an id are moved by their payload
    keys = rows.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha2("html", 256).alias("key"))
    holders = (
        keys.groupBy("key")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("holder").isNotNull())
        .drop("n")
    )
    holders = materialize(holders, "holders")
    moved = F.coalesce(F.col("page_id"), F.xxhash64("key")).alias("moved")
    revisits = (
        keys.join(holders, "key")
        .where(F.coalesce(F.col("page_id") != F.col("holder"), F.lit(True)))
        .select(moved, F.col("page_id").alias("revisit_id"), F.col("key").alias("revisit_key"), "holder")
        .distinct()
    )
    # a repeated page_id may hold other payloads: the payload's key decides beside the id
    rows = rows.withColumn("key", F.sha2("html", 256)).select("*", moved)
    joined = rows.join(
        revisits.withColumnRenamed("moved", "to"),
        (F.col("moved") == F.col("to"))
        & F.col("page_id").eqNullSafe(F.col("revisit_id"))
        & (F.col("key") == F.col("revisit_key")),
        "left",
    )
    return joined.select("page_id", "url", "html", F.col("holder").alias("refers_to"))


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """path, bytes of the archives written; each attempt of a task writes files of its own, only finished ones count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        out, name, size, done = None, "", 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in range(4))):
                payload = (html.as_py() or "").encode()
                data = gzip_member(
                    record(page_id.as_py(), url.as_py(), payload, base32_sha1(payload), refers_to.as_py())
                )
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size = fs.open_output_stream(name, compression=None), 0
                out.write(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{n.rpartition('/')[2]}" for n, _ in done], pa.string()),
                pa.array([s for _, s in done], pa.int64()),
            ],
            ["path", "bytes"],
        )

    fs, root = _open(folder)
    fs.create_dir(root)
    return materialize(
        plan.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, bytes long"), "archives"
    )


class Bytes:
    """Reads of an archive, of which the last one is kept."""

    def __init__(self, path: str):
        fs, name = _open(path)
        self.file = fs.open_input_file(name)
        self.size, self.base, self.held = self.file.size(), 0, b""

    def at(self, at: int, n: int) -> bytes:
        """n bytes from at on, fewer at the end."""
        n = min(n, self.size - at)
        if not self.base <= at <= at + n <= self.base + len(self.held):
            self.base, self.held = at, self.file.read_at(min(max(n, READ_BYTES), self.size - at), at)
        return self.held[at - self.base : at - self.base + n]


def begins_record(data: bytes) -> bool:
    """Whether compressed data begins a gzip member whose text is the head of a WARC record."""
    if not data.startswith(MAGIC):
        return False
    try:
        head = zlib.decompressobj(31).decompress(data, HEAD_BYTES)
    except zlib.error:
        return False
    lines = head.partition(b"\r\n\r\n")[0].lower().split(b"\r\n")
    # a head that is longer than what is looked at may tell its length behind that
    whole = b"\r\n\r\n" in head or len(head) < HEAD_BYTES
    told = any(x.startswith(b"content-length:") for x in lines) or not whole
    return lines[0].startswith(b"warc/1.") and any(x.startswith(b"warc-type:") for x in lines) and told


def decode_member(source: Bytes, at: int) -> tuple[bytes, int]:
    """The text of the member that begins at `at`, and its compressed length."""
    z, parts, used, step = zlib.decompressobj(31), [], 0, PROBE_BYTES
    while not z.eof:
        some = source.at(at + used, step)
        if not some:
            raise zlib.error("the archive ends inside a member")
        parts.append(z.decompress(some))
        used += len(some) - len(z.unused_data)
        step = min(2 * step, READ_BYTES)
    return b"".join(parts), used


def members(path: str, start: int, end: int, strict: bool = True) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the WARC gzip members that start at start..end-1 of an archive."""
    source = Bytes(path)
    at, follows = start, start == 0  # follows: a member must begin here
    while at < min(end, source.size):
        if begins_record(source.at(at, PROBE_BYTES)):
            try:
                text, used = decode_member(source, at)
            except zlib.error as e:
                raise ValueError(f"{path}: the member at {at} is damaged ({e})") from e
            yield at, text
            at, follows = at + used, True
            if at >= end and strict and at < source.size and not begins_record(source.at(at, PROBE_BYTES)):
                raise ValueError(f"{path}: no member at {at}")
            continue
        if follows and strict:
            raise ValueError(f"{path}: no member at {at}")
        follows = False
        some = source.at(at + 1, READ_BYTES)
        hit = some.find(MAGIC)
        at = at + 1 + hit if hit >= 0 else at + 1 + max(len(some) - len(MAGIC) + 1, 1)


RECORDS = (
    "path string, offset long, page_id long, record_type string, url string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary, record_id string, date string, content_type string, refers_to_id string, "
    "headers map<string,string>, digest_ok boolean"
)
RECORD_SCHEMA = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
     ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
     ("record_id", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("refers_to_id", pa.string()),
     ("headers", pa.map_(pa.string(), pa.string())), ("digest_ok", pa.bool_())]
)


def whole_number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.removeprefix("-").isdigit() else None


def fields_of(path: str, offset: int, data: bytes, payloads: bool) -> tuple:
    """A row of RECORDS of one record, whoever wrote it."""
    rec = parse(data)
    f, block = rec["fields"], rec["block"]
    kind = f.get("warc-type", "").lower()
    http = f.get("content-type", "").lower().startswith("application/http") or kind in ("response", "revisit")
    head, _, body = block.partition(b"\r\n\r\n") if http and block[:5].upper() == b"HTTP/" or kind == "request" else (b"", b"", block)
    digest = f.get("warc-payload-digest")
    sha1 = digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else None
    payload, length, right = (None, None, None) if kind == "revisit" else (body, len(body), None)
    if kind == "revisit":
        told = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = whole_number(told[0].decode("latin-1")) if told else None
    elif sha1:
        right = base32_sha1(body) == sha1.upper()
        if not right and "x-page-id" in f:
            raise ValueError(f"{path} at {offset}: payload and digest differ")
    return (
        path, offset, whole_number(f.get("x-page-id")), kind, f["warc-target-uri"].removeprefix("<").removesuffix(">") if "warc-target-uri" in f else None,
        whole_number(f.get("x-refers-to-page-id")), sha1 or digest, length, payload if payloads else None, f.get("warc-record-id"), f.get("warc-date"),
        f.get("content-type"), f.get("warc-refers-to"), list(f.items()), right,
    )


def read_archives(
    archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True, strict: bool = True
) -> DataFrame:
    """The records of archives (path, bytes), whichever ranges they are cut into and whoever wrote them.

    record_type: in lower case, of any kind (warcinfo, request, metadata, ...). page_id and refers_to are what this module's
    archives tell in headers of their own, null in others'; refers_to_id is the standard header. payload: the body behind
    the HTTP head of responses and requests, null for revisits, the whole block of others; payload_bytes its length, for
    revisits the one that their HTTP head tells. payload_digest: bare for SHA-1, with its name otherwise, null where it is
    not told; digest_ok whether a SHA-1 one is that of the payload (in this module's own archives a wrong one is an error).
    headers: all of them, names in lower case.
    """
    ranges = archives.select(
        "path",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("bytes", F.lit(1)) - 1, F.lit(split_bytes).cast("long"))).alias("start"),
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), RECORD_SCHEMA)], schema=RECORD_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for offset, data in members(path, start, start + split_bytes, strict):
                    rows.append(fields_of(path, offset, data, payloads))
                    held += len(rows[-1][8] or b"")
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # a range is much work but a short row: one task each, which partitions of a set number are
    spread = ranges.repartition(max(1, ranges.count()))
    return spread.mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages as archives and reads them back: the records without their payloads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "warc"))
    # with its store's scheme, also where the setting has none
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    archives = write_archives(page_plan(pages), folder)
    return read_archives(archives, split_bytes, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
