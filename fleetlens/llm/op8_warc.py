"""WARC archives: one gzip member per record, and a sequential reader that checks framing and digests.

The writer puts a page's HTTP response into a record; of pages with equal payloads one is the response and the others
become revisit records that name it. The reader streams an archive once: it inflates one member after the other in
small steps, takes the block by its Content-Length, and recomputes the digests.
"""

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import batches, staged

ARCHIVE_BYTES = 1 << 30  # an archive that has reached this size is closed
LEAST_PAYLOAD = 0  # payloads of fewer bytes are never revisits
DATE = "1970-01-01T00:00:00Z"  # of every record: pages have no fetch time
_STEP = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """One gzip member. ``original`` is the response's page_id of a revisit, which has HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{_name(page_id)}>"),
              ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{_name(original)}>")]
    fields += [("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _name(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _number(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def members(stream) -> Iterator[BytesIO]:
    """The inflated members of a gzip stream, one at a time; raises ValueError for a broken one."""
    held = b""
    while held or (held := stream.read(_STEP)):
        inflate, out = zlib.decompressobj(31), BytesIO()
        while not inflate.eof:
            if not held and not (held := stream.read(_STEP)):
                raise ValueError("the archive ends inside a record")
            try:
                out.write(inflate.decompress(held, _STEP))
            except zlib.error as broken:
                raise ValueError(f"not a gzip member: {broken}") from None
            held = inflate.unconsumed_tail or inflate.unused_data
        out.seek(0)
        yield out


def parsed(member: BytesIO) -> dict:
    """Fields and block of one record: type, id, refers_to, url, payload and whether its digests hold."""
    if member.readline().strip() not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("a record doesn't start with its version")
    fields = _fields(member)
    size = int(fields["content-length"])
    block = member.read(size)
    if len(block) != size or member.read() != b"\r\n\r\n":
        raise ValueError("the content length doesn't frame the block")
    body = BytesIO(block)
    body.readline()
    http = _fields(body)
    payload = body.read()
    revisit = fields["warc-type"] == "revisit"
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    own = told if revisit else digest(payload)
    return {"page_id": _number(fields["warc-record-id"]), "record_type": fields["warc-type"],
            "url": fields.get("warc-target-uri"), "refers_to": _number(fields["warc-refers-to"]) if revisit else None,
            "payload_bytes": int(http["content-length"]) if revisit else len(payload), "payload_digest": own,
            "verified": own == told and digest(block) == fields["warc-block-digest"].removeprefix("sha1:"),
            "payload": None if revisit else payload}


def _fields(lines: BytesIO) -> dict[str, str]:
    found = {}
    while line := lines.readline().rstrip(b"\r\n"):
        key, _, value = line.decode("utf-8", "replace").partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes the archives and returns their list: ``path``, ``records``, ``bytes``.

    Each task writes its own files, named after its attempt; the list is a written table and names only files of
    attempts that ended well. Of the rows with equal payloads of ``least`` bytes or more, those with the largest
    page_id are responses (several if the row repeats); the others revisit it. Null html is an empty payload. Rows
    without a page_id revisit a row that has one and are responses where there is none. Only digests that repeat
    are joined back.
    """
    folder = folder or shared_dir(pages.sparkSession, "llm-warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha"),
                        F.octet_length(body).alias("size"))
    repeated = rows.where(F.col("size") >= least).groupBy("sha").agg(
        F.count("*").alias("n"), F.max("page_id").alias("original")).where("n > 1 AND original IS NOT NULL")
    joined = rows.join(repeated.select("sha", "original"), "sha", "left").select(
        "page_id", "url", "html", "original",
        F.coalesce(~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull(), F.lit(False)))
    kind = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, _ = fs.FileSystem.from_uri(folder)

        def rows():
            out, count, number = None, 0, 0
            for part in parts:
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        path = f"{name}-{number:04d}.warc.gz"
                        _, inner = fs.FileSystem.from_uri(path)
                        system.create_dir(inner.rpartition("/")[0])
                        out = system.open_output_stream(inner, compression=None)
                    page_id, url, html, original, revisit = values
                    out.write(record(page_id, url, html.encode("utf-8"), original, revisit))
                    count += 1
                    if out.tell() >= ARCHIVE_BYTES:
                        size = out.tell()
                        out.close()
                        yield (path, count, size), 100
                        out, count, number = None, 0, number + 1
            if out is not None:
                size = out.tell()
                out.close()
                yield (path, count, size), 100
        return batches(kind, rows())

    return staged(joined.mapInArrow(written, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``: page_id, record_type, url, refers_to, payload_bytes,
    payload_digest, verified and, if wanted, payload (null for revisits). A broken archive raises ValueError."""
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()),
              ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_())]
    kind = pa.schema(fields + [("payload", pa.binary())] * payload)

    def opened(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for path in part.column(0).to_pylist():
                    system, inner = fs.FileSystem.from_uri(path)
                    with system.open_input_stream(inner, compression=None, buffer_size=_STEP) as stream:
                        for member in members(stream):
                            found = parsed(member)
                            yield tuple(found[c] for c in kind.names), 200 + (payload and len(found["payload"] or b""))
        return batches(kind, rows())

    count = max(1, archives.count())  # one task per archive
    return archives.select("path").repartition(count).mapInArrow(
        opened, "page_id long, record_type string, url string, refers_to long, payload_bytes long, "
                "payload_digest string, verified boolean" + ", payload binary" * payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the records back."""
    return read(write(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                    "refers_to", "verified")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string([['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010',
  '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)] FOR c IN string_split(hex, '')], '') AS b FROM p),
named AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i + 1, 1)::INT
  + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT
  + substr(b, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], '') AS digest, max(page_id) OVER (PARTITION BY hex) AS original FROM bits)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to, true AS verified
FROM named
"""
