"""1. MinHash near-dedup with HyperMinHash registers.

A document is the set of its distinct five-word shingles (64-bit hashes). A sketch has REGISTERS buckets; each keeps the
leading-zero count and ten mantissa bits of its smallest hash in 16 bits, and an empty bucket borrows from the non-empty
one that a fixed random order of the bucket prefers, so short documents have whole sketches too. Bands of ROWS registers
are hashed to keys; documents that share a key are candidates; the Jaccard estimate from equal registers, corrected for
those that collide by chance, drops far pairs of large sets (small sets borrow many registers, which widens the estimate's
error, and are cheap to compare); full shingle sets decide. The estimate drops a pair only where it lies so far below the
threshold that a pair at 0.75 falls there with a chance below 1e-18, so every doubtful pair meets the exact test.

No group is ever expanded into its pairs:

1. documents with equal sets are one class, its smallest doc_id stands for it;
2. every representative is verified against one pivot, the smallest member that shares most of its bands;
3. components of these links are found; only members of different components that share a bucket are still open;
4. open documents are verified against one pivot for each key of two bands together: far pairs hardly ever share one, near
   ones mostly do, so what links there are join components before any pairs are compared (documents made of the same few
   passages end in a few components);
5. of documents that are open still, the shingles that occur in another component bound every overlap: shingles of at most RARE open
   documents lead to their pairs directly, which have their number of common ones and at most as many frequent ones as either
   document; a pair that shares none of these overlaps in frequent shingles only. A pair is compared where the bound allows
   a similarity of 0.75, so documents that drifted away from a large group meet none of its members, and no link is lost.

At a similarity of 0.75 a pair shares no band with a probability of about 4e-8.

Defined cases: null and empty texts, and texts without words, have no shingle, link with nothing and stay; texts with fewer
than five words have one shingle; rows that share a doc_id count as one document with all their links; rows without a
doc_id join a class by their text and lead none, so they stay only where no document with an id has their set; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from . import textblocks as tb
from .common import materialise, table, text_hash, text_only, without

WORDS = 5
REGISTERS = 256
BANDS = 120
ROWS = 7
MANTISSA_BITS = 10
#: Pairs whose estimate is below this are dropped unverified: 0.75 less eleven standard deviations (Chernoff: exp(-0.2 * REGISTERS) at most, a fifth of the registers borrowed: 1e-18).
LEAST_ESTIMATE = 0.45
#: A pair with a set of fewer shingles is verified whatever the estimate.
SMALL_SET = 512
#: Bands in one key where open documents look for more pivots.
DEEP = 2
#: A shingle of at most so many open documents leads to its pairs directly. Any value gives the same links.
RARE = 64
#: Pairs of one pivot that meet its sketch and its set in the same task.
PAIRS = 256

_rng = np.random.default_rng(88)
BAND_REGISTERS = np.stack([_rng.choice(REGISTERS, ROWS, replace=False) for _ in range(BANDS)])
_BAND_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
#: For each bucket the order in which it borrows from the others.
_ORDER = np.stack([_rng.permutation(REGISTERS) for _ in range(REGISTERS)]).astype(np.int16)
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)
_SKETCHES = "doc_id long, text_hash long, n_shingles long, class binary, registers binary"


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    starts, ends, words_at = tb.word_bounds(data, at)
    hashes = tb.segment_hashes(data, starts, ends, fold=True)
    windows = tb.window_hashes(hashes, WORDS)
    for a, b in zip(words_at[:-1].tolist(), words_at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(windows[a : b - WORDS + 1])
        else:
            yield tb.window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty sorted set: the top eight bits of a hash are its bucket."""
    first = np.searchsorted(shingles, _BOUNDS)
    filled = np.flatnonzero(np.diff(first, append=len(shingles)))
    value = (shingles[first[filled]] << np.uint64(8)).astype(np.float64)
    exponent = (value.view(np.uint64) >> np.uint64(52)).astype(np.int64) - 1023
    mantissa = (value.view(np.uint64) >> np.uint64(52 - MANTISSA_BITS)).astype(np.int64) & ((1 << MANTISSA_BITS) - 1)
    zeros = np.clip(63 - exponent, 0, 63)
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = zeros << MANTISSA_BITS | np.where(exponent > 63, (1 << MANTISSA_BITS) - 1, mantissa)
    if len(filled) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
        out[empty] = out[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


@lru_cache(256)
def _cells(log_load: int) -> np.ndarray:
    """The chance of each register value when a bucket holds 2 ** (log_load / 4) hashes on average, and at least one."""
    load = 2.0 ** (log_load / 4)
    zeros, mantissa = np.arange(64)[:, None], np.arange(1 << MANTISSA_BITS)[None, :]
    low = 2.0 ** -(zeros + 1) * (1 + mantissa / (1 << MANTISSA_BITS))
    high = 2.0 ** -(zeros + 1) * (1 + (mantissa + 1) / (1 << MANTISSA_BITS))
    return ((np.exp(-load * low) - np.exp(-load * high)) / -np.expm1(-load)).ravel()


@lru_cache(4096)
def _chance(a: int, b: int) -> float:
    return float(_cells(a) @ _cells(b))


def collision_chance(n_a: int, n_b: int) -> float:
    """How often registers of sets of these sizes agree though their smallest hashes differ."""
    return _chance(*sorted(int(round(4 * np.log2(n / REGISTERS))) for n in (n_a, n_b)))


def estimates(registers_a: np.ndarray, registers_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of rows of sketches, corrected for chance collisions."""
    equal = (registers_a == registers_b).mean(axis=1)
    chance = np.array([collision_chance(a, b) for a, b in zip(n_a.tolist(), n_b.tolist(), strict=True)])
    return (equal - chance) / (1 - chance)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (a digest of the set; null for none) and registers of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tb.strings(batch.column("text"))
            for i, j, d, a in tb.slices(data, at):
                sizes, classes, registers = [], [], []
                for s in shingle_sets(d, a):
                    sizes.append(len(s))
                    classes.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                    registers.append(registers_of(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "class", "registers"])

    return text_only(docs).withColumn("text_hash", text_hash(F.col("text"))).mapInArrow(run, _SKETCHES)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(rows: DataFrame, together: int = 1) -> DataFrame:
    """(key, doc_id) for each band (or so many bands together) of each doc_id, registers row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                chosen = _matrix(part.column("registers")).astype(np.uint64)[:, BAND_REGISTERS]
                total = _BAND_SALT + sum(tb.mix64(chosen[:, :, r] + tb.SHINGLE_CODE[r]) * tb.SHINGLE_CODE[20 + r] for r in range(ROWS))
                keys = tb.mix64(total)
                if together > 1:
                    keys = tb.mix64((keys.reshape(len(keys), -1, together) * tb.SHINGLE_CODE[:together]).sum(axis=2, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part.column("doc_id").to_numpy(), keys.shape[1]))], names=["key", "doc_id"])

    return rows.select("doc_id", "registers").mapInArrow(run, "key long, doc_id long")


def _spread(pairs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(a, b) pairs with ``part``, and a function that repeats rows of ``a`` for all of its parts: a pivot of many pairs is met in as many tasks as they need."""
    many = materialise(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRS).select("a", F.ceil(F.col("n") / PAIRS).alias("parts")), "many")
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts)).drop("parts")
    return dealt, lambda rows: rows.join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")


def _likely(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The (a, b) pairs whose estimate is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            possible = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)  # no overlap is larger than the smaller set
            small = (na < SMALL_SET) | (nb < SMALL_SET)
            near, large = possible & small, np.flatnonzero(possible & ~small)
            if len(large):
                some = batch.take(pa.array(large))
                near[large] = estimates(_matrix(some.column("ra")), _matrix(some.column("rb")), na[large], nb[large]) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda x: sketch.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    dealt, repeated = _spread(pairs)
    return dealt.join(side("b"), "b").join(repeated(side("a")), ["a", "part"]).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, a hash of the set, its size n and shingles (as signed integers) of the documents of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tb.strings(batch.column("text"))
            for i, j, d, a in tb.slices(data, at):
                sets = [s.view(np.int64) for s in shingle_sets(d, a)]
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=offsets[1:])
                of = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(of, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["doc_id", "of", "n", "shingles"])

    return text_only(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, of long, n long, shingles array<long>")


def verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """The (a, b) pairs with 100 * intersection >= 75 * union of their full sets; ``sets`` has these where they are known."""
    likely = materialise(_likely(pairs, sketch), "likely")
    if sets is None:
        ids = materialise(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
        sets = materialise(_sets(docs, ids), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    # a is the pivot of many pairs: it meets them last, so that only the set of b travels with a pair
    dealt, repeated = _spread(likely)
    both = dealt.join(side("b"), "b").join(repeated(side("a")), ["a", "part"]).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return materialise(both.filter(100 * F.col("common") >= 75 * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id that each id of an (a, b) link reaches."""
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("w")).distinct(), "edges")
    ends = edges.select(F.explode(F.array("u", "w")).alias("vid")).distinct()
    return graph.components(edges, ends).select(F.col("vid").alias("doc_id"), F.col("root").alias("label"))


def still_open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """key, doc_id and label of the members of buckets with more than one component."""
    placed = buckets.select("key", "doc_id").join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return materialise(placed.join(mixed, "key"), "mixed")


def deep_pairs(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each open document (doc_id, label) with the first one of another component for each of its keys of DEEP bands."""
    rows = materialise(band_keys(reps.join(members.select("doc_id"), "doc_id", "left_semi"), DEEP).join(members, "doc_id"), "deep")
    pivots = rows.groupBy("key").agg(F.min(F.struct("doc_id", "label")).alias("first"), F.max("label").alias("high"), F.min("label").alias("low")).filter("low < high")
    return rows.join(pivots.select("key", F.col("first.doc_id").alias("a"), F.col("first.label").alias("of")), "key").filter("label <> of").select("a", F.col("doc_id").alias("b")).distinct()


def _meeting(rows: DataFrame, on: str, shared: str) -> DataFrame:
    """Rows of two documents x and y of different labels among ``rows`` that meet in ``on`` and can be similar if they overlap in ``shared`` at most.

    With at most c common shingles, 100 * c >= 75 * (n + m - c) is 7 * c >= 3 * (n + m).
    """
    x, y = (rows.select(on, F.col("doc_id").alias(d), F.col("of").alias(f"of{d}"), F.col("label").alias(f"l{d}"), F.col("n").alias(f"n{d}"), F.col("frequent").alias(f"f{d}"), F.col(shared).alias(f"c{d}")) for d in "xy")
    return x.join(y, [x[on] == y[on], F.col("lx") < F.col("ly"), 7 * F.least("cx", "cy") >= 3 * (F.col("nx") + F.col("ny"))])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def open_pairs(open_: DataFrame, sets: DataFrame, rare: int = RARE) -> DataFrame:
    """The distinct (a, b) pairs still to compare, of (key, doc_id, label) rows of mixed buckets and the sets of their documents.

    Rows of ``sets`` that share a doc_id are told apart by the hash of the set. A shingle occurs once in a set, so its rows
    are no more than the open documents, and AQE splits what is large in the join that brings them its count.
    """
    members = open_.select("doc_id", "label").distinct()
    rows = sets.join(members, "doc_id").select("doc_id", "of", "label", "n", F.explode("shingles").alias("shingle"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle", "df")
    posted = materialise(rows.join(counts, "shingle"), "postings")
    bounds = posted.groupBy("doc_id", "of", "label", "n").agg(F.count("*").alias("any"), F.count(F.when(F.col("df") > rare, 1)).alias("frequent"))
    bounds = materialise(bounds.filter("4 * any >= 3 * n"), "bounds")
    few = posted.filter(F.col("df") <= rare).select("shingle", "doc_id", "of").join(bounds, ["doc_id", "of"])
    placed = materialise(open_.select("key", "doc_id").join(bounds.filter("4 * frequent >= 3 * n"), "doc_id"), "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).filter("low < high").select("key", "least")
    many = placed.join(mixed, "key").filter("7 * frequent >= 3 * (n + least)")
    # what two documents share is their common rare shingles, counted, and no more frequent ones than either has
    counted = _meeting(few, "shingle", "any").groupBy("x", "y", "ofx", "ofy", "nx", "ny", "fx", "fy").agg(F.count("*").alias("common"))
    near = counted.filter(7 * (F.col("common") + F.least("fx", "fy")) >= 3 * (F.col("nx") + F.col("ny")))
    return _ordered(near).unionAll(_ordered(_meeting(many, "key", "frequent"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of each row of ``docs``."""
    sketch = materialise(sketches(docs), "sketches")
    lead = sketch.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    leads = materialise(lead.filter("doc_id is not null"), "classes")
    # a sketch for each class, that of its leader
    reps = materialise(sketch.join(leads.select("class", "doc_id"), ["class", "doc_id"], "left_semi").dropDuplicates(["class", "doc_id"]).select("doc_id", "n_shingles", "registers"), "representatives")
    keys = band_keys(reps)
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialise(keys.join(shared.drop("n"), "key"), "buckets")
    votes = buckets.filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("doc_id").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("minus"))).alias("best"))
    first = materialise(chosen.select((-F.col("best.minus")).alias("a"), F.col("doc_id").alias("b")), "pivots")
    links = verified(first, reps, docs)
    labels = components(links)
    open_ = still_open(buckets, labels)
    if not open_.isEmpty():
        members = materialise(open_.select("doc_id", "label").distinct(), "open")
        sets = materialise(_sets(docs, members.select("doc_id")), "open-sets")
        deep = materialise(deep_pairs(members, reps).join(first, ["a", "b"], "left_anti"), "deep-pairs")
        more = verified(deep, reps, docs, sets)
        if not more.isEmpty():
            links = links.unionAll(more)
            labels = components(links)
            open_ = still_open(buckets, labels)
        pairs = materialise(open_pairs(open_, sets).join(first.unionAll(deep), ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            labels = components(links.unionAll(verified(pairs, reps, docs, sets)))
    # class of each row, then component of the class
    leaders = leads.filter("copies > 1").select("class", F.col("doc_id").alias("leader"))
    rows = sketch.select("doc_id", "text_hash", "n_shingles", "class").join(leaders, "class", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("leader", "doc_id").alias("leader"))
    out = rows.join(labels.select(F.col("doc_id").alias("leader"), "label"), "leader", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("label", "leader").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are not the first of their component.

    Rows that share a doc_id go together; a row without one goes where a document with an id has its text's set.
    """
    gone = near_duplicates(docs).filter(~F.col("kept") & F.col("component_id").isNotNull())
    by = lambda text: F.when(F.col("doc_id").isNull(), text).otherwise(F.lit(0))
    return without(docs, gone.select("doc_id", by(F.col("text_hash")).alias("row_hash")), by(text_hash(F.col("text"))))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
ORACLES: dict[str, str] = {}
