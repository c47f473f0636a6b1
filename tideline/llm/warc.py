"""WARC archives: written one gzip member a record, and read back record by record.

Rows with equal payloads are stored once: that with the largest page_id is the response, others are revisit records
that name it. Each partition writes archives of bounded size into a folder that all executors share, through
pyarrow's file systems; a task's files carry its attempt, and the manifest lists those of attempts that succeeded, so that lost
executors and repeated tasks leave no record twice. The reader is sequential: it inflates a member in steps, frames it by its
Content-Length and checks the digests, holding one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import qualified, shared_dir, table, written

#: Bytes after which a new archive begins, and bytes inflated at a time.
ARCHIVE_BYTES = 16 << 20
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"  # the pages carry no date of capture
#: Payloads of at least so many bytes are stored once.
LEAST_BYTES = 0
SALTS = 16


class WarcError(ValueError):
    """An archive that isn't framed as it says, or whose digests don't hold."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None] | None, date: str = DATE) -> bytes:
    """One gzip member: a response with its payload, or, if it refers to a page (id and url), a revisit without.

    name, unique among all records, gives the record's id; WARC-Page-ID and -Refers-To-Page-ID are extension headers, as is the payload's length.
    """
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + (b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    line = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + line(url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to[0]}", f"WARC-Refers-To-Date: {date}"]
        if refers_to[1]:
            head.append("WARC-Refers-To-Target-URI: " + line(refers_to[1]))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(file: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a file its inflated bytes, in steps; each is read to its end before the next."""
    rest = b""
    while rest or (rest := file.read(STEP)):
        unpack = zlib.decompressobj(31)

        def steps() -> Iterator[bytes]:
            nonlocal rest
            while not unpack.eof:
                rest = rest or file.read(STEP)
                if not rest:
                    raise WarcError("an archive ends within a member")
                out = unpack.decompress(rest, STEP)
                rest = unpack.unconsumed_tail if not unpack.eof else unpack.unused_data
                if out:
                    yield out

        yield steps()
        if not unpack.eof:
            raise WarcError("a member wasn't read to its end")


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; framed by Content-Length, digests verified."""
    for steps in members(file):
        got = bytearray()
        while (end := got.find(b"\r\n\r\n")) < 0:
            part = next(steps, None)
            if part is None:
                raise WarcError("a record without a header's end")
            got += part
        first, *lines = bytes(got[:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {first[:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length, begin = int(head["content-length"]), end + 4
        for part in steps:
            got += part
            if len(got) > begin + length + 4:
                raise WarcError("a record longer than its Content-Length")
        if bytes(got[begin + length :]) != b"\r\n\r\n":
            raise WarcError("a record's length isn't its Content-Length")
        block = bytes(got[begin : begin + length])
        if head.get("warc-block-digest", "").removeprefix("sha1:") != digest(block):
            raise WarcError(f"block digest of {head.get('warc-record-id')}")
        yield head, block


def payload(head: dict[str, str], block: bytes) -> bytes | None:
    """A response's payload, its digest verified; None for a revisit."""
    if head["warc-type"] != "response":
        return None
    data = block[block.index(b"\r\n\r\n") + 4 :]
    if head["warc-payload-digest"].removeprefix("sha1:") != digest(data):
        raise WarcError(f"payload digest of {head.get('warc-record-id')}")
    return data


def with_response(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, url, html) with __refers_to and __refers_url, page_id and url of the response that holds an equal payload, or null.

    Only payloads that occur twice or more are joined, by digest; as one may be that of a third of all rows, each is
    sent to several salts and the rows to one of them.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha2(html.cast("binary"), 256).alias("__key"))
    keyed = keyed.withColumn("__key", F.when(F.octet_length(html) >= least_bytes, F.col("__key")))
    copies = keyed.filter("__key IS NOT NULL").groupBy("__key").agg(F.max("page_id").alias("__last"), F.max_by("url", "page_id").alias("__last_url"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(copies, ["__key", "__salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last"))
    return joined.select("page_id", "url", "html", refers.alias("__refers_to"), F.when(refers.isNotNull(), F.col("__last_url")).alias("__refers_url"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as gzip WARC archives under folder (a URI) and returns the manifest: path, records, bytes."""

    folder = qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, done, out, size, rows = f"{task.partitionId():06}-{task.taskAttemptId()}", [], None, 0, 0

        def close() -> None:
            nonlocal out, size, rows
            if out is not None:
                out.close()
                done.append({"path": f"{folder}/{name}-{len(done):04}.warc.gz", "records": rows, "bytes": size})
            out, size, rows = None, 0, 0

        for batch in batches:
            for page_id, url, html, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}-{len(done):04}.warc.gz", compression=None)
                refers = None if refers_to is None else (refers_to, refers_url)
                data = record(f"{folder}/{name}-{len(done):04}/{rows}", page_id, url, (html or "").encode("utf-8", "replace"), refers)
                out.write(data)
                size, rows = size + len(data), rows + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return written(with_response(pages, least_bytes).mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of a manifest's archives.

    With payloads, also payload (binary; null for a revisit). An archive is read as a stream, one record at a time.
    """
    fields = FIELDS.append(pa.field("payload", pa.binary())) if payloads else FIELDS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (x for b in batches for x in b.column("path").to_pylist()):
            fs, at = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_stream(at, compression=None) as file:
                rows, size = [], 0
                for head, block in records(file):
                    data = payload(head, block)
                    length = int(head["warc-payload-length"])
                    if data is not None and len(data) != length:
                        raise WarcError(f"payload length of {head.get('warc-record-id')}")
                    found = (_number(head.get("warc-page-id")), head.get("warc-target-uri"), length, head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], _number(head.get("warc-refers-to-page-id")), data)
                    rows.append(found)
                    size += length
                    if len(rows) == 4096 or payloads and size > 8 << 20:
                        yield _batch(rows, fields)
                        rows, size = [], 0
                yield _batch(rows, fields)

    schema = ", ".join(f"{x} {'long' if x in ('page_id', 'payload_bytes', 'refers_to') else 'binary' if x == 'payload' else 'string'}" for x in fields.names)
    # An archive a row, bounded in size: dealt over as many tasks as there are archives, a number that isn't coalesced.
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def archived(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row of pages(page_id, url, html) as a record under folder and returns what the archives hold.

    A null html is an empty payload, equal to an empty one. Rows that repeat the largest page_id of equal payloads are
    all responses. A null page_id is written without a number, never names a response of others, and is read back as null;
    if all rows of a payload have none, all are responses. No rows give no archives; other columns are not looked at.
    """
    return read_archives(write_archives(pages, folder))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = archived(table(spark, sf_dir, "pages"), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of a SHA-1: 8 groups of 20 bits, 4 letters each.
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::INTEGER >> {s}) & 31), 1)" for g in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
e AS (SELECT page_id, strlen(x) AS n, sha1(x) AS h, max(page_id) OVER (PARTITION BY x) AS last FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
    CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last OR page_id IS NULL THEN last END AS refers_to
FROM e
"""
