"""8. WARC archives as a chunked record table.

Writing: each page's payload is cut into chunk rows (record, chunk number, bytes) by Spark; a task streams the chunk rows
of its partition into an archive, a gzip member for each record. Digests and lengths are computed before, so headers
come first. Of equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is a response; the others
are revisit records that name it and its payload's digest and length, and have no payload.

Reading: a task streams an archive in reads of fixed size and emits a row for each chunk of a payload, carrying the SHA-1
from chunk to chunk; no record is ever held as a whole.

Defined cases: a null html is an empty payload; a null url gives no target header; pages with a null page_id are records
with none, all responses unless a page with an id has the same payload; rows that repeat a page_id and a payload are all of
the same type; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .sharedfs import stream, writing

CHUNK = 1 << 20
LEAST_BYTES = 0
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, n_records long"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, chunk_bytes long, chunk binary, last boolean, payload_bytes long, payload_digest string"


def classified(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, n_bytes, sha1 (hex), record_type and refers_to of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload"), "sha1": F.sha1("payload")})
    # only payloads found twice or more meet their rows again
    first = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, ["sha1", "n_bytes"], "left").select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n_bytes", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row for each chunk; those of a record follow each other in one partition. Records without payload have one empty chunk.

    Chunk numbers are exploded and each cuts its own bytes, so no second copy of a payload is built as an array of chunks.
    """
    payload = F.coalesce("payload", F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length(payload) / size), F.lit(1)).cast("int") - 1
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return numbered.select("page_id", "url", "n_bytes", "sha1", "record_type", "refers_to", "chunk_no", F.substring(payload, F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _header(row: dict) -> bytes:
    response = row["record_type"] == "response"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_record_id(row['page_id'])}", f"WARC-Date: {_DATE}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    lines += [f"WARC-Payload-Digest: sha1:{_digest(row['sha1'])}", f"WARC-Payload-Length: {row['n_bytes']}"]
    if not response:
        lines += [f"WARC-Refers-To: {_record_id(row['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(_HTTP) + (row['n_bytes'] if response else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + _HTTP


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Write archives to ``folder``; a manifest row for each, itself a Parquet table there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, records, packer = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, None
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        with writing(path) as out:
            batch = first
            while batch is not None:
                for row in batch.to_pylist():
                    if row["chunk_no"] == 0:
                        if packer is not None:
                            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        packer, records = zlib.compressobj(6, zlib.DEFLATED, 31), records + 1
                        out.write(packer.compress(_header(row)))
                    out.write(packer.compress(row["chunk"]))
                batch = next(batches, None)
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [records]})

    chunked(classified(pages, least_bytes), chunk).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Inflated:
    """The bytes of a file of gzip members, read piece by piece."""

    def __init__(self, source, size: int):
        self.source, self.size, self.unpacker, self.raw, self.buffer = source, size, None, b"", bytearray()

    def fill(self) -> bool:
        """More bytes in the buffer; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.source.read(self.size)
                if not self.raw:
                    return False
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            out = self.unpacker.decompress(self.raw, self.size)
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, None
            else:
                self.raw = self.unpacker.unconsumed_tail
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.fill():
                return None
        found = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        """Up to n bytes, fewer only at the end."""
        while len(self.buffer) < n and self.fill():
            pass
        found = bytes(self.buffer[:n])
        del self.buffer[:n]
        return found


def records(path: str, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of an archive."""
    with stream(path) as source:
        data = _Inflated(source, min(chunk, 1 << 18))
        while (head := data.until(b"\r\n\r\n")) is not None:
            fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().strip("\r\n").split("\r\n")[1:])}
            page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
            left = int(fields["content-length"])
            left -= len(data.until(b"\r\n\r\n"))  # the HTTP header
            response = fields["warc-type"] == "response"
            base = {"page_id": page("warc-record-id"), "record_type": fields["warc-type"], "refers_to": page("warc-refers-to")}
            sha1, number, total = hashlib.sha1(), 0, 0
            while True:
                part = data.take(min(left, chunk))
                sha1.update(part)
                left, total = left - len(part), total + len(part)
                if left and not part:
                    raise EOFError(f"{path} ends within a record")
                row = base | {"chunk_no": number, "chunk_bytes": len(part), "chunk": part, "last": not left, "payload_bytes": None, "payload_digest": None}
                number += 1
                if left:
                    yield row
                    continue
                digest = base64.b32encode(sha1.digest()).decode() if response else fields["warc-payload-digest"].removeprefix("sha1:")
                if response and fields["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError(f"{path}: the payload of {fields['warc-record-id']} does not match its digest")
                yield row | {"payload_bytes": total if response else int(fields["warc-payload-length"]), "payload_digest": digest}
                break
            data.take(4)


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives that ``manifest`` lists; payloads=False leaves the bytes out."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("chunk", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for row in records(path, chunk):
                    if not payloads:
                        row["chunk"] = None
                    rows.append(row)
                    size += len(row["chunk"] or b"") + 200
                    if size >= 4 * chunk:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks, "path").mapInArrow(read, CHUNKS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark))
    ends = read_archives(manifest, payloads=False).filter("last")
    return ends.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"))


QUERIES = {"op8_warc": op8_warc}
_PAYLOAD = "SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages"
# base32 of a SHA-1 has no DuckDB function: 32 digits of 5 bits of its 160 bits
ORACLES = {
    "op8_warc": f"""
WITH p AS ({_PAYLOAD}),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT hex, payload_bytes, min(page_id) AS first FROM d GROUP BY ALL),
b AS (SELECT d.*, f.first, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || substr(hex, i + 1, 1))::INT), 4, '0')), 'string_agg', '') AS bits
      FROM d JOIN f USING (hex, payload_bytes))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, i * 5 + j + 1, 1)::INT * (16 >> j)))::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       CASE WHEN page_id = first THEN greatest(1, ceil(payload_bytes / {CHUNK}))::BIGINT ELSE 1 END AS n_chunks
FROM b"""
}
