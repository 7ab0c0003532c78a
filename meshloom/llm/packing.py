"""3. Packing into fixed-length sequences by shortest pack first over the length histogram.

Every document is cut into pieces of ``capacity`` tokens and a remainder. The histogram of piece lengths has at most
``capacity`` entries whatever the corpus, so packing it is a small computation on the driver: lengths are placed longest
first, each into the pack with the most room, and packs of one pattern are counted, not listed. A pattern's slots then
claim ranges of ranks among the pieces of their length, and Spark ranks the pieces and looks their slots up.

Ranks need no group in one task: pieces of a length are dealt over salts by a hash of their document, ranked there,
and shifted by the counts of the salts before.

Defined cases: a null text is empty and has the end id alone; null doc_ids are documents like others; repeated rows are
packed each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_only
from .tokens import default_vocabulary, encoder

CAPACITY = 1024
END_ID = 0
SALT_ROWS = 100_000
LEAST_SALTS = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def id_bytes(vocabulary_size: int) -> int:
    """Bytes of an id in the column ``ids``."""
    return 2 if vocabulary_size <= 1 << 16 else 4


def cut_into_pieces(rows: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of each doc_id, text row; with_ids: and their ids as little-endian unsigned integers of ``id_bytes``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        width = f"<u{id_bytes(coder.size)}"
        for batch in batches:
            ids_of, texts = batch.column("doc_id"), batch.column("text")
            for i in range(0, len(texts), 512):
                index, start, length, crc, total, kept = [], [], [], [], [], []
                for k, ids in enumerate(coder.encode(texts.slice(i, 512).to_pylist()), i):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(raw), capacity):
                        piece = raw[at : at + capacity]
                        index.append(k)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(raw))
                        if with_ids:
                            kept.append(piece.astype(width).tobytes())
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([ids_of.take(long(index)), long(start), long(length), long(crc), long(total), *([pa.array(kept, pa.binary())] if with_ids else [])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    return rows.mapInArrow(pieces, f"{PIECES}, ids binary" if with_ids else PIECES)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many packs, their pattern as (length, how many) in the order placed) for each pattern."""
    open_packs: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room
    roomiest = 0
    for length in range(capacity, 0, -1):
        todo = counts.get(length, 0)
        while todo:
            while roomiest and not open_packs[roomiest]:
                roomiest -= 1
            if roomiest < length:
                open_packs[capacity - length].append([todo, [(length, 1)]])
                roomiest, todo = max(roomiest, capacity - length), 0
                continue
            many, pattern = open_packs[roomiest].pop()
            used = min(many, todo)
            if used < many:
                open_packs[roomiest].append([many - used, pattern])
            last = pattern[-1]
            grown = [*pattern[:-1], (length, last[1] + 1)] if last[0] == length else [*pattern, (length, 1)]
            open_packs[roomiest - length].append([used, grown])
            todo -= used
    return [(many, pattern) for packs in open_packs for many, pattern in packs]


def slots(packs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Ranges of ranks of each length, sorted, with the first sequence and the offset that they map to."""
    rows, next_rank, base = [], {}, 0
    for many, pattern in packs:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                first = next_rank.get(length, 0)
                rows.append((length, first, base, offset))
                next_rank[length] = first + many
                offset += length
        base += many
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "base", "offset"), columns, strict=True))


def ranked(pieces: DataFrame, n_rows: int) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... among those of the same length."""
    salts = max(LEAST_SALTS, -(-n_rows // SALT_ROWS))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    return rows.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there; with_ids: and its ids, so that a sequence is its pieces' ids by offset."""
    spark = docs.sparkSession
    pieces = materialise(cut_into_pieces(text_only(docs), vocabulary or default_vocabulary(), end_id, capacity, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(slots(pack_histogram(counts, capacity)))  # bounded by the capacity, not by the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = where.value
        keys = (s["length"] << 48) | s["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s["base"][at] + rank - s["first"][at]), pa.array(s["offset"][at])], names=[*names, "sequence_id", "offset"])

    columns = [c.split()[0] for c in PIECES.split(", ")] + (["ids"] if with_ids else [])
    schema = f"{PIECES}, {'ids binary, ' if with_ids else ''}sequence_id long, offset long"
    return ranked(pieces, sum(counts.values())).select(*columns, "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (of the whole sequence, without padding) and n_tokens of what ``pack`` returned with ids; a sequence has at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
