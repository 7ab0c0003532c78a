"""11. Target-distribution importance resampling over hashed n-grams.

A text's features are its runs of one to three words, each in one of BUCKETS buckets. A bucket's gain is the log ratio of
its smoothed share among the features of the target (the benchmark) and of all documents. A document's weight is the sum of
gains over its features, looked up in an array (80 KB, fixed) that every task has; Gumbel noise from its id makes the
highest scores a draw without replacement in proportion to the weights.

The cutoff is found without sorting all scores: a quantile sketch brackets it, exact counts above and inside the bracket
validate the bracket or widen it, and only the rows inside are sorted. The drawn rows are then numbered by ranges.

The CRC of a run of words follows from the CRCs of its words (CRCs are linear), so every word is hashed once.

Defined cases: a null text has no words; a text without features weighs 0; rows that share a doc_id are scored each, and ties
beyond the doc_id are alike in every column; a row without a doc_id draws its noise from an empty id and comes after
others of its score; an empty target or table gives its smoothed shares; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.topology import numbered_along
from . import textblocks as tb
from .common import materialise, table, text_only

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = "42"
#: The share of ranks on either side of the cutoff that the first bracket takes in.
BRACKET = 1 / 256
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Shifts of a CRC by fewer bytes have a table each.
_SHORT = 64


@cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes behind a text do to each byte of its CRC: tables [n, byte, value] for n < _SHORT, and [k, byte, value] for n = 2 ** k."""

    def table(images: np.ndarray) -> np.ndarray:
        """images: of the 32 single bits."""
        values = np.arange(256)
        out = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            out[bit // 8] ^= np.where(values >> bit % 8 & 1, images[bit], np.uint32(0)).astype(np.uint32)
        return out

    def apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return t[0, crc & 255] ^ t[1, crc >> 8 & 255] ^ t[2, crc >> 16 & 255] ^ t[3, crc >> 24]

    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = bits
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0))
    step, images, short = table(one), bits, []
    for _ in range(_SHORT):
        short.append(table(images))
        images = apply(step, images)
    power, images = [], one
    for _ in range(40):
        power.append(table(images))
        images = apply(power[-1], images)
    return np.stack(short), np.stack(power)


def appended(crc: np.ndarray, more: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of texts with CRC ``crc`` followed by texts with CRC ``more`` and ``length`` bytes."""
    short, power = _shifts()
    n = np.where(length < _SHORT, length, 0)
    out = short[n, 0, crc & 255] ^ short[n, 1, crc >> 8 & 255] ^ short[n, 2, crc >> 16 & 255] ^ short[n, 3, crc >> 24]
    for i in np.flatnonzero(length >= _SHORT):
        value = int(out[i])
        for k in range(int(length[i]).bit_length()):
            if int(length[i]) >> k & 1:
                t = power[k]
                value = int(t[0, value & 255] ^ t[1, value >> 8 & 255] ^ t[2, value >> 16 & 255] ^ t[3, value >> 24])
        out[i] = value
    return out ^ more


def _words(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of a slice of documents with the number of their document, about a slice at a time however long a document is."""
    text = data.tobytes().translate(_FOLD)
    words, counts = [], np.zeros(len(at) - 1, np.int64)
    for doc, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while end - start > tb.SLICE_BYTES and (cut := text.find(b" ", start + tb.SLICE_BYTES, end)) >= 0:
            found = text[start:cut].split()
            yield words + found, np.append(np.repeat(np.arange(len(counts)), counts), np.full(len(found), doc))
            words, start = [], cut
            counts[:] = 0
        found = text[start:end].split()
        words += found
        counts[doc] = len(found)
    yield words, np.repeat(np.arange(len(counts)), counts)


def features(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document, bucket) of each feature of a slice of documents, with the length of the runs, a part at a time."""
    space = np.uint32(zlib.crc32(b" "))
    crc, length, doc = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for words, owners in _words(data, at):
        old = len(crc)
        crc = np.append(crc, np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))
        length, doc = np.append(length, np.fromiter(map(len, words), np.int64, len(words))), np.append(doc, owners)
        yield owners, crc[old:] % np.uint32(buckets), 1
        run = crc
        for k in range(2, LONGEST_RUN + 1):
            # runs that end at a word from k - 1 on: those of k - 1 words that end one before, a space and the word
            before, here = run[:-1], slice(k - 1, None)
            if not len(before):
                break
            run = appended(appended(before, np.broadcast_to(space, before.shape), np.ones(len(before), np.int64)), crc[here], length[here])
            fresh = max(0, old - k + 1)
            whole = doc[here][fresh:] == doc[: len(run)][fresh:]
            yield doc[here][fresh:][whole], run[fresh:][whole] % np.uint32(buckets), k
        keep = LONGEST_RUN - 1
        crc, length, doc = crc[-keep:], length[-keep:], doc[-keep:]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of all texts are in each bucket. A task sends at most one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = tb.strings(batch.column("text"))
            for _, _, d, a in tb.slices(data, at):
                for _, bucket, _ in features(d, a, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}  # at most BUCKETS rows


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log(float(target.get(b, 0) + 1) * s / (float(raw.get(b, 0) + 1) * t))) for b in range(buckets)], np.int64)


def noise(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """Gumbel noise of a document, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs``, for the distribution of ``target``'s texts."""
    rows = text_only(docs)
    wanted = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_bucket = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(rows), bucket_counts(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = by_bucket.value
            words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            data, at = tb.strings(batch.column("text"))
            for i, j, d, a in tb.slices(data, at):
                for doc, bucket, k in features(d, a):
                    here = np.bincount(doc, minlength=j - i)
                    n[i:j] += here
                    if k == 1:
                        words[i:j] += here
                    weight[i:j] += np.bincount(doc, gain[bucket], j - i).astype(np.int64)  # whole numbers below 2 ** 53 in a part
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    out = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise("doc_id", seed))


def _order() -> list[Column]:
    return [-F.col("score"), F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0).cast("long"))]


def bracket(rows: DataFrame, n: int, total: int, width: float = BRACKET) -> tuple[int, int, int]:
    """(low, high, how many scores are above high): scores between which the n-th highest of ``total`` lies, by exact counts.

    A bracket that the counts refute is widened; at full width it holds all scores.
    """
    while True:
        shares = [max(0.0, 1 - n / total - width), min(1.0, 1 - n / total + width)]
        low, high = rows.agg(F.percentile_approx("score", shares, round(4 / min(width, 0.25))).alias("q")).first()["q"]
        if width >= 1:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        above, through = rows.agg(F.count(F.when(F.col("score") > high, 1)), F.count(F.when(F.col("score") >= low, 1))).first()
        if above < n <= through:
            return low, high, above
        width *= 4


def drawn(rows: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, width: float = BRACKET) -> DataFrame:
    """``rows`` (as ``scored`` returns them) with rank: 1, 2, ... of the drawn ones, null of the others."""
    able = rows.filter(F.col("n_words") >= least_words)
    total = able.count()
    n = percent * total // 100
    if not n:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    low, high, above = bracket(able, n, total, width)
    inside = numbered_along(able.filter(F.col("score").between(low, high)).select("doc_id", "score"), _order(), "place")
    last = inside.filter(F.col("place") == n - above - 1).first()
    same = F.col("score") == last["score"]
    until = F.lit(True) if last["doc_id"] is None else F.col("doc_id") <= last["doc_id"]
    within = F.coalesce((F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | (same & until)), F.lit(False))
    # rows that share the last doc_id and score may be one too many
    best = numbered_along(rows.filter(within), _order(), "place")
    place = F.when(F.col("place") < n, F.col("place") + 1)
    return best.withColumn("rank", place).drop("place").unionByName(rows.filter(~within).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of ``docs``."""
    return drawn(materialise(scored(docs, target, seed), "scores"), percent)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {
    "op11_importance_resampling": r"""
WITH RECURSIVE crc_steps AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT i, c FROM crc_steps WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, true AS raw FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
words AS (
  SELECT r, doc_id, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT r, raw, w[i] AS a, lead(w[i]) OVER by_text AS b, lead(w[i], 2) OVER by_text AS c FROM (SELECT r, raw, w, unnest(range(1, len(w) + 1)) AS i FROM words) WINDOW by_text AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, raw, a AS f FROM runs UNION ALL SELECT r, raw, a || ' ' || b FROM runs WHERE b IS NOT NULL UNION ALL SELECT r, raw, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
states AS (
  SELECT f, hex(encode(f)) AS rest, 4294967295 AS crc FROM (SELECT DISTINCT f FROM grams)
  UNION ALL SELECT f, substr(rest, 3), xor(t.c, crc >> 8) FROM states JOIN crc_table t ON t.i = xor(crc & 255, ('0x' || substr(rest, 1, 2))::BIGINT) WHERE rest <> ''),
bucket_of AS (SELECT f, xor(crc, 4294967295) % 10000 AS bucket FROM states WHERE rest = ''),
features AS (SELECT r, raw, bucket FROM grams JOIN bucket_of USING (f)),
shares AS (SELECT bucket, count(*) FILTER (WHERE raw) AS s, count(*) FILTER (WHERE NOT raw) AS t FROM features GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM shares),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM shares, totals),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE raw GROUP BY r),
scores AS (
  SELECT w.r, w.doc_id, len(w.w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words w LEFT JOIN weights USING (r) WHERE w.raw),
ranks AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE able) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM ranks"""
}
