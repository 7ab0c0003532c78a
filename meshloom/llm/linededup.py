"""13. Line dedup with Bloom filters of lines seen once and seen twice.

A line's key is the line without blanks at its ends and with A-Z as a-z. A key of at least CHARS code points that at least
DOCUMENTS documents hold goes everywhere but in the document with the largest doc_id that holds it.

1. One scan puts a hash of each document's distinct keys into two filters (``bloom``): seen once, seen twice or more.
2. A second scan tests all keys; only suspected repeats are shuffled, as (hash, 16-byte digest of the whole key, doc_id), and counted
   exactly: partial counts by (digest, doc_id) first, so that a line of a third of all documents is no hot key.
3. The confirmed keys meet the documents in a third scan: as sorted arrays in every task while there are at most KEYS of
   them (32 MB), beyond that by a join of each document with its own keys to drop. Both give the same rows.

Defined cases: a null or empty text is one empty line; rows that share a doc_id are one document (a line counts once for
them and stays in all of them where theirs is the largest id); rows without a doc_id are one document before all others;
repeated rows repeat their result; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .bloom import SeenTwice
from .common import materialise, met, table, text_hash, text_only

CHARS = 40
DOCUMENTS = 5
#: Confirmed keys that every task gets as arrays of 32 bytes a key.
KEYS = 1 << 20
#: Stands for the doc_id of rows without one.
NO_ID = -(2**63)


class Lines:
    """The lines of a slice of documents, and the keys long enough to count."""

    def __init__(self, data: np.ndarray, at: np.ndarray, chars: int):
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([at[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, at[1:]]))
        #: Lines before each document.
        self.first = np.searchsorted(breaks, at) + np.arange(len(at))
        word_starts, word_ends, _ = tb.word_bounds(data, at)
        after = np.searchsorted(word_starts, self.starts)
        before = np.searchsorted(word_ends, self.ends, "right") - 1
        self.long = np.flatnonzero(before >= after)
        starts, ends = word_starts[after[self.long]], word_ends[before[self.long]]
        enough = ends - starts >= chars
        self.long, starts, ends = self.long[enough], starts[enough], ends[enough]
        if len(starts):
            whole = np.append((data & 0xC0) != 0x80, False)
            enough = np.add.reduceat(whole, np.stack([starts, ends], 1).ravel(), dtype=np.int64)[::2] >= chars
            self.long, starts, ends = self.long[enough], starts[enough], ends[enough]
        self.key_starts, self.key_ends, self._data = starts, ends, data
        self.document = np.searchsorted(self.first, self.long, "right") - 1
        self.hashes = tb.segment_hashes(data, starts, ends, fold=True)

    def distinct(self) -> np.ndarray:
        """One index of ``long`` for each key of each document."""
        order = np.lexsort((self.hashes, self.document))
        h, d = self.hashes[order], self.document[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return order[fresh]

    def digest(self, k: int) -> bytes:
        return hashlib.blake2b(self._data[self.key_starts[k] : self.key_ends[k]].tobytes().lower(), digest_size=16).digest()

    def line(self, k: int) -> bytes:
        return self._data[self.starts[k] : self.ends[k]].tobytes()


def _suspects(rows: DataFrame, twice: SeenTwice, chars: int) -> DataFrame:
    """doc_id, row_hash, hash and digest of each suspected key of each row, once (more often only where two of its keys share a hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tb.strings(batch.column("text"))
            for i, j, d, a in tb.slices(data, at):
                lines = Lines(d, a, chars)
                some = np.flatnonzero(twice(lines.hashes))
                digests = [lines.digest(k) for k in some.tolist()]
                fresh = {(n, x): k for n, x, k in zip(lines.document[some].tolist(), digests, range(len(some)), strict=True)}
                kept = np.array(sorted(fresh.values()), np.int64)
                rows_ = pa.array(i + lines.document[some[kept]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows_), batch.column("row_hash").take(rows_), pa.array(lines.hashes[some[kept]].view(np.int64)), pa.array([digests[k] for k in kept.tolist()], pa.binary())], names=["doc_id", "row_hash", "hash", "digest"])

    return rows.mapInArrow(run, "doc_id long, row_hash long, hash long, digest binary")


class _Known:
    """The confirmed keys as sorted arrays."""

    def __init__(self, rows: pa.Table):
        hashes = rows.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.digests = np.array(rows.column("digest").to_pylist(), "S16")[order]
        self.last = rows.column("last").to_numpy()[order]

    def dropped(self, lines: Lines, ids: np.ndarray) -> list[int]:
        """The indices of ``lines.long`` that go from documents with these ids."""
        at = np.searchsorted(self.hashes, lines.hashes)
        near = np.flatnonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == lines.hashes)) if len(self.hashes) else []
        out = []
        for k in near:
            x, digest = int(at[k]), np.array(lines.digest(k), "S16")
            while x < len(self.hashes) and self.hashes[x] == lines.hashes[k]:
                if self.digests[x] == digest and self.last[x] != ids[lines.document[k]]:
                    out.append(int(k))
                x += 1
        return out


def _cleaned(batch: pa.RecordBatch, known: _Known | None, chars: int) -> pa.RecordBatch:
    """The batch with its new text, n_lines and n_dropped; keys to drop are ``known`` or those in each row's ``drops``."""
    text = batch.column("text")
    data, at = tb.strings(text)
    ids = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
    n_lines, n_dropped = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    changed, new = np.zeros(batch.num_rows, bool), []
    for i, j, d, a in tb.slices(data, at):
        lines = Lines(d, a, chars)
        n_lines[i:j] = np.diff(lines.first)
        if known is not None:
            gone = known.dropped(lines, ids[i:j])
        else:
            drops = [frozenset(x or ()) for x in batch.column("drops").slice(i, j - i).to_pylist()]
            gone = [k for k, doc in enumerate(lines.document.tolist()) if drops[doc] and lines.digest(k) in drops[doc]]
        if not gone:
            continue
        out = np.zeros(lines.first[-1], bool)
        out[lines.long[gone]] = True
        n_dropped[i:j] = np.add.reduceat(out, lines.first[:-1], dtype=np.int64)
        for doc in np.flatnonzero(n_dropped[i:j]).tolist():
            changed[i + doc] = True
            new.append(b"\n".join(lines.line(k) for k in range(lines.first[doc], lines.first[doc + 1]) if not out[k]).decode())
    text = pc.replace_with_mask(text, pa.array(changed), pa.array(new, text.type)) if new else text
    return pa.RecordBatch.from_arrays([batch.column("row"), text, pa.array(n_lines), pa.array(n_dropped)], names=["row", "text", "n_lines", "n_dropped"])


def drop_lines(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, keys: int = KEYS) -> DataFrame:
    """row (all columns of ``docs`` as a struct), text without the lines that go, n_lines and n_dropped of each row of ``docs``."""
    texts = text_only(docs).withColumn("row_hash", text_hash(F.col("text")))

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, at = tb.strings(batch.column("text"))
        for _, _, d, a in tb.slices(data, at):
            lines = Lines(d, a, chars)
            yield lines.hashes[lines.distinct()]

    twice = SeenTwice(texts.select("text"), hashes_of)
    suspects = materialise(_suspects(texts, twice, chars), "suspects")
    held = suspects.select("hash", "digest", F.coalesce("doc_id", F.lit(NO_ID)).alias("holder")).distinct()
    counted = held.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.max("holder").alias("last"))
    repeated = materialise(counted.filter(F.col("n") >= documents).select("hash", "digest", "last"), "repeated")

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    id_, text = F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text")
    if repeated.count() <= keys:
        known = docs.sparkSession.sparkContext.broadcast(_Known(repeated.toArrow()))
        rows = docs.select(whole).select("row", id_, text)
    else:
        known = None
        gone = suspects.join(repeated, ["hash", "digest"]).filter(F.coalesce("doc_id", F.lit(NO_ID)) != F.col("last"))
        # rows that share doc_id and text have the same keys, and a row no more of them than its text has lines
        drops = gone.groupBy("doc_id", "row_hash").agg(F.collect_set("digest").alias("drops"))
        rows = met(docs, drops, text_hash(F.col("text")), "left").select("row", id_, text, "drops")
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("text string, n_lines long, n_dropped long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cleaned(batch, known.value if known is not None else None, chars)

    return rows.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """``docs`` with repeated lines dropped from its texts (a null text stays null); ``n_chars``, where there is one, follows the text."""
    out = drop_lines(docs, chars, documents)
    changed = {"text": F.when(F.col("row.text").isNotNull(), F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}
ORACLES = {
    "op13_line_dedup": """
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM rows_),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT r, keyed.doc_id, place, line, repeated.key IS NOT NULL AND repeated.last <> keyed.doc_id AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id"""
}
