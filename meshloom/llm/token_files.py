"""2. Token-id files with fixed-width bit packing.

A shard holds the ids of a run of documents in ascending doc_id order, each id in the minimum number of bits that
the vocabulary needs. Layout (little-endian):

* ``TOKPACK1``;
* blocks of 64 ids, ``bits`` 64-bit words each, the last one padded with zeros. Block b starts at ``8 + 8 * bits * b``,
  so any id, and with numpy any range of ids, is unpacked without reading the rest;
* the doc_ids, then a byte for each that tells a null doc_id, then the place of each document's first id and the end;
* bits, ids in a block, number of documents, number of ids (four unsigned 64-bit integers).

Blocks are written as they fill, so a task holds one text's ids and 17 bytes for each document of its shard.

Spark range-partitions the documents by doc_id; each task writes one shard to the shared folder and returns its
manifest row. Shards are read back one task each, and starts come from sums over the manifest (a row for each shard).

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; repeated rows and ids are each
encoded, in any order among equal ids; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, text_only
from .sharedfs import random_access, writing
from .tokens import default_vocabulary, encoder

MAGIC = b"TOKPACK1"
BLOCK = 64
END_ID = 2
READ_BLOCKS = 4096
#: Ids that are packed and written at once (a multiple of BLOCK).
WRITE_IDS = 1 << 17
MANIFEST = "shard long, path string, n_docs long, n_ids long"


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Blocks of 64 ids as rows of ``bits`` words."""
    blocks = -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(blocks, BLOCK)
    out = np.zeros((blocks, bits), np.uint64)
    for k in range(BLOCK):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= full[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= full[:, k] >> np.uint64(64 - shift)
    return out


def unpack(blocks: np.ndarray, bits: int) -> np.ndarray:
    """The ids of whole blocks."""
    out, mask = np.empty((len(blocks), BLOCK), np.uint32), np.uint64((1 << bits) - 1)
    for k in range(BLOCK):
        word, shift = divmod(k * bits, 64)
        value = blocks[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (blocks[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = value & mask
    return out.reshape(-1)


class ShardReader:
    """Random access to a shard: ``ids(first, last)`` reads only the blocks that hold them."""

    def __init__(self, path: str):
        self.file = random_access(path)
        size = self.file.size()
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.data = 8
        self.file.seek(size - 32)
        self.bits, self.block, self.n_docs, self.n_ids = (int(x) for x in np.frombuffer(self.file.read(32), "<u8"))
        self.file.seek(self.data + -(-self.n_ids // self.block) * self.bits * 8)
        self.doc_ids = np.frombuffer(self.file.read(8 * self.n_docs), "<i8")
        self.nulls = np.frombuffer(self.file.read(self.n_docs), np.uint8).astype(bool)
        self.offsets = np.frombuffer(self.file.read(8 * (self.n_docs + 1)), "<i8")

    def ids(self, first: int, last: int) -> np.ndarray:
        low, high = first // BLOCK, -(-last // BLOCK)
        self.file.seek(self.data + low * self.bits * 8)
        raw = np.frombuffer(self.file.read((high - low) * self.bits * 8), "<u8").reshape(-1, self.bits)
        return unpack(raw, self.bits)[first - low * BLOCK : last - low * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


def write_shards(rows: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write doc_id, text rows as shards; the manifest, which is itself a Parquet table in ``folder``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.tok"
        coder = encoder(vocabulary)
        bits, doc_ids, nulls, offsets, parts, size = bits_for(max(coder.size, end_id + 1)), array("q"), bytearray(), array("q", [0]), [np.zeros(0, np.uint32)], 0
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        with writing(path) as out:
            out.write(MAGIC)
            while batch is not None:
                column, texts = batch.column("doc_id"), batch.column("text")
                nulls += column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                doc_ids.frombytes(column.fill_null(0).to_numpy().astype(np.int64).tobytes())
                for i in range(0, len(texts), 256):
                    for ids in coder.encode(texts.slice(i, 256).to_pylist()):
                        offsets.append(offsets[-1] + len(ids) + 1)
                        parts += (ids, np.array([end_id], np.uint32))
                        size += len(ids) + 1
                        if size >= WRITE_IDS:
                            rest = np.concatenate(parts)
                            whole = size // BLOCK * BLOCK
                            for at in range(0, whole, WRITE_IDS):
                                out.write(pack(rest[at : min(at + WRITE_IDS, whole)], bits).tobytes())
                            parts, size = [rest[whole:]], size - whole
                batch = next(batches, None)
            out.write(pack(np.concatenate(parts), bits).tobytes())
            out.write(doc_ids.tobytes() + bytes(nulls) + offsets.tobytes())
            out.write(np.array([bits, BLOCK, len(doc_ids), offsets[-1]], "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [offsets[-1]]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            shard = ShardReader(path)
            step, crcs, k = READ_BLOCKS * BLOCK, [], 0
            crc, ends = 0, shard.offsets[1:]
            for first in range(0, shard.n_ids, step):  # a document may span many reads
                last = min(first + step, shard.n_ids)
                raw, at = shard.ids(first, last).astype("<u4"), first
                while k < shard.n_docs and ends[k] <= last:
                    crcs.append(zlib.crc32(raw[at - first : ends[k] - first].tobytes(), crc))
                    crc, at, k = 0, int(ends[k]), k + 1
                crc = zlib.crc32(raw[at - first :].tobytes(), crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids.astype(np.int64), mask=shard.nulls), pa.array(shard.offsets[:-1] + before), pa.array(np.diff(shard.offsets)), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the shards."""
    # one row for each shard, so one task sums them
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("before"))
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(text_only(table(spark, sf_dir, "documents")), shared_dir(spark), default_vocabulary())
    return read_shards(manifest)


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
