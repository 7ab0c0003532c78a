"""7. Benchmark decontamination by CGK embedding, bit sampling and exact edit distance.

Words are runs of letters and digits of the lower-cased text. The CGK embedding walks over a word sequence: at step j it
emits the word under its pointer and advances by a random bit of (j, word). Sequences at a small edit distance get outputs
at a small Hamming distance, so sampled output positions agree with fair probability. For each of several independent
walks the words at SAMPLES sampled steps make a key.

Every word of an item starts an anchor, and so does every word of a document; equal keys of one walk give a candidate
alignment of the item with an item-sized window of the document. Sampled steps are near the anchor: with a quarter of the
words edited, walks over whole items agree too rarely. The number of walks follows the item's length (``walks_for``), so that
items of every length reach the target recall at the full bound of edits. In a document most walks end early: after each sampled
word the partial key has to be one of some anchor. Items of fewer than SEEDED words are too short for that and have exact seeds instead:
of e + 1 blocks of their words, e edits leave one unchanged, and none of their matches is lost.

Candidates are verified by the exact word edit distance (bit-parallel, free ends in the document); a match has at most
``max_ratio`` edits a word of the item, whatever its length (so items of one to three words match exactly).

The walk over a document needs nothing but its own text, so documents are never shuffled. The item index is broadcast in
blocks of bounded size; a document's words are hashed once for all blocks of a pass, and a benchmark of more than PASS_BLOCKS
blocks takes more passes.

Defined cases: null texts and items without words match nothing; repeated items and documents match each; rows with a
null doc_id or item_id are searched like others; rows are cleaned each by its own text; empty tables give no match; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import table, text_hash, text_only, without

#: Walks of items of at least so many words, for a recall of 0.999 with a quarter of the words edited.
WALKS = ((48, 3), (32, 4), (24, 6), (18, 12), (0, 16))
STEPS = 16
SAMPLES = 5
MAX_RATIO = 0.25
#: Items of fewer words are found by unchanged blocks of words.
SEEDED = 16
#: Different words that a key has to sample.
LEAST_WORDS = 4
#: Characters of item text in one broadcast index (up to about 40 bytes of index each), and indexes of one pass.
BLOCK_CHARS = 2_000_000
PASS_BLOCKS = 4
MATCHES = "doc_id long, row_hash long, item_id long, start_word long, end_word long, edits long"

_SEP = np.ones(256, bool)
_SEP[128:] = False
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_rng = np.random.default_rng(41)
WALK = _rng.integers(1, 2**63, (64, STEPS), dtype=np.uint64) | np.uint64(1)
#: The first step is always sampled; the others are drawn for each walk.
SAMPLED = np.array([[0, *sorted(_rng.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False))] for _ in range(64)])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column and the number of words before each text."""
    data, at = tb.strings(pc.utf8_lower(column))
    starts, ends, words_at = tb.word_bounds(data, at, _SEP)
    return tb.segment_hashes(data, starts, ends), words_at


def _advance(hashes: np.ndarray, places: np.ndarray, walk: int, first: int, last: int) -> np.ndarray:
    """Pointers after steps first..last-1."""
    for j in range(first, last):
        places = places + ((hashes[places] * WALK[walk, j]) >> np.uint64(63)).astype(np.int64)
    return places


def _extend(keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return tb.mix64(keys * tb.SHINGLE_CODE[58] + symbols)


def walks_for(n_words: int) -> int:
    return next(walks for least, walks in WALKS if n_words >= least)


class Filter:
    """Which keys may be among the given ones."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - min(max(int(len(keys)).bit_length() + 5, 12), 24))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[(keys >> self.shift).astype(np.int64)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.table[(keys >> self.shift).astype(np.int64)]


def _equal(keys: np.ndarray, items: np.ndarray, offsets: np.ndarray, start: np.ndarray, key: np.ndarray, words_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, diagonal) of the document places ``start`` whose ``key`` is among the sorted ones of items."""
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    many = high - low
    hit = np.repeat(np.arange(len(key)), many)
    which = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
    return np.searchsorted(words_at, start[hit], "right") - 1, items[which].astype(np.int64), start[hit] - offsets[which]


class Index:
    """Anchor keys and seeds of a block of items."""

    def __init__(self, item_ids: list[int | None], texts: list[str | None], max_ratio: float = MAX_RATIO):
        if not 0 <= max_ratio <= MAX_RATIO:
            raise ValueError(f"the number of walks holds for at most {MAX_RATIO} edits a word")
        self.item_ids = item_ids
        hashes, at = words(pa.array(texts, pa.string()))
        self.words = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.lists = [w.tolist() for w in self.words]
        self.edits = [int(max_ratio * len(w)) for w in self.words]
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            n = len(w)
            if 0 < n < SEEDED:
                cuts = [k * n // (self.edits[i] + 1) for k in range(self.edits[i] + 2)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    seeds.setdefault(b - a, []).append((int(tb.window_hashes(w[a:b], b - a)[0]), i, a))
        self.seeds = {}
        for size, rows in seeds.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            self.seeds[size] = (Filter(keys), keys, np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32))
        long = [i for i, w in enumerate(self.words) if len(w) >= SEEDED]
        sizes = np.array([len(self.words[i]) for i in long], np.int64)
        padded = np.concatenate([*(self.words[i] for i in long), np.zeros(STEPS + 1, np.uint64)])
        ends = np.cumsum(sizes)
        item, begin, limit = np.repeat(np.array(long, np.int32), sizes), np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        walks = np.repeat(np.array([walks_for(n) for n in sizes], np.int64), sizes)
        self.walks, first = [], [np.zeros(0, np.uint64)]
        for t in range(int(walks.max(initial=0))):
            anchors = np.flatnonzero(walks > t)
            place, keys, step, partial, fine = anchors, np.zeros(len(anchors), np.uint64), 0, [], np.ones(len(anchors), bool)
            apart, last = np.zeros(len(anchors), np.int64), np.full(len(anchors), -1)
            for s in SAMPLED[t]:
                place = _advance(padded, np.minimum(place, len(padded) - STEPS - 2), t, step, s)
                step = s
                fine &= place < limit[anchors]  # a walk that leaves its item makes no key
                keys = _extend(keys, padded[np.minimum(place, len(padded) - 1)])
                partial.append(keys)
                apart, last = apart + (place != last), place
            fine &= apart >= LEAST_WORDS  # nor does one whose pointer hardly moved
            order = np.argsort(keys[fine], kind="stable")
            chosen = anchors[fine][order]
            first.append(padded[chosen])
            self.walks.append(([Filter(k[fine]) for k in partial], keys[fine][order], item[chosen], (chosen - begin[chosen]).astype(np.int32)))
        self.vocabulary, self.first = Filter(np.unique(padded)), Filter(np.unique(np.concatenate(first)))

    def candidates(self, hashes: np.ndarray, words_at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, item, diagonal) of equal keys; the diagonal is where the item's first word would be."""
        if self.walks:
            padded = np.concatenate([hashes, np.zeros(STEPS + 1, np.uint64)])
            # every walk samples the word under it first, so places that no anchor begins with are left out once
            known = np.flatnonzero(self.first(hashes))
            known_key = _extend(np.zeros(len(known), np.uint64), hashes[known])
            in_items = np.append(self.vocabulary(hashes), np.zeros(STEPS + 1, bool))
        for t, (filters, keys, items, offsets) in enumerate(self.walks):
            start, step, place, key = known, 0, known, known_key
            for s, may in zip(SAMPLED[t][1:], filters[1:], strict=True):
                place = _advance(padded, place, t, step, s)
                step = s
                some = in_items[place]
                start, place, key = start[some], place[some], _extend(key[some], padded[place[some]])
                some = may(key)
                start, place, key = start[some], place[some], key[some]
            yield _equal(keys, items, offsets, start, key, words_at)
        for size, (may, keys, items, offsets) in self.seeds.items():
            blocks = tb.window_hashes(hashes, size)
            start = np.flatnonzero(may(blocks)) if len(blocks) else np.zeros(0, np.int64)
            yield _equal(keys, items, offsets, start, blocks[start], words_at)


def _semi_global(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the whole pattern and any part of the text, and the end of the first such part."""
    masks: dict[int, int] = {}
    for k, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << k
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j
    return best, end


def best_window(p: list[int], t: list[int]) -> tuple[int, int, int]:
    """Edits, start and end of the part of ``t`` nearest to ``p``."""
    edits, end = _semi_global(p, t)
    # backwards from there, with both ends turned round, the nearest part that starts at the end
    row, best, start = list(range(len(p) + 1)), len(p), end
    for j, w in enumerate(reversed(t[max(0, end - len(p) - edits) : end]), 1):
        last, row = row, [j]
        for k, v in enumerate(reversed(p), 1):
            row.append(min(last[k - 1] + (v != w), last[k] + 1, row[k - 1] + 1))
        if row[-1] < best:
            best, start = row[-1], end - j
    return edits, start, end


def matches_of(index: Index, hashes: np.ndarray, words_at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) for each document and item that match: the window with the fewest edits, the first of equals."""
    found = [np.stack([d, i, g]) for d, i, g in index.candidates(hashes, words_at)]
    if not found:
        return
    pairs = np.unique(np.concatenate(found, axis=1).T, axis=0)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    k = 0
    pairs = pairs.tolist()
    while k < len(pairs):
        doc, item, low = pairs[k]
        edits, pattern, high = index.edits[item], index.words[item], low
        while k + 1 < len(pairs) and pairs[k + 1][0] == doc and pairs[k + 1][1] == item and pairs[k + 1][2] <= high + max(1, edits):
            k += 1
            high = pairs[k][2]
        k += 1
        a, b = int(words_at[doc]), int(words_at[doc + 1])
        first, last = max(a, low - edits), min(b, high + len(pattern) + edits)
        if last - first < len(pattern) - edits:
            continue
        text = hashes[first:last].tolist()
        there = set(text)
        if sum(w not in there for w in index.lists[item]) > edits:  # each word of the item that the window lacks is an edit
            continue
        got, start, end = best_window(index.lists[item], text)
        if got <= edits:
            here = (got, first + start - a, first + end - a)
            best[doc, item] = min(best.get((doc, item), here), here)
    for (doc, item), (edits, start, end) in sorted(best.items()):
        yield doc, item, start, end, edits


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of at most about BLOCK_CHARS characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-int(chars) // BLOCK_CHARS) if chars > BLOCK_CHARS else 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items for b in range(n)]


def _matches(docs: DataFrame, benchmark: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    spark, parts = docs.sparkSession, []
    rows = text_only(docs).withColumn("row_hash", text_hash(F.col("text")))
    blocks = _blocks(benchmark)
    for k in range(0, len(blocks), PASS_BLOCKS):
        shared = []
        for block in blocks[k : k + PASS_BLOCKS]:
            items = block.orderBy("item_id", "text").toPandas()  # bounded by BLOCK_CHARS
            shared.append(spark.sparkContext.broadcast(Index([None if v != v else int(v) for v in items["item_id"]], items["text"].tolist(), max_ratio)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, row_hash, column = (batch.column(c) for c in ("doc_id", "row_hash", "text"))
                _, at = tb.strings(column)
                out: list[tuple] = []
                for i, j, _, _ in tb.slices(np.zeros(0, np.uint8), at):
                    hashes, words_at = words(column.slice(i, j - i))
                    for index in (x.value for x in shared):
                        out += [(ids[i + d].as_py(), row_hash[i + d].as_py(), index.item_ids[item], start, end, edits) for d, item, start, end, edits in matches_of(index, hashes, words_at)]
                names = [c.split()[0] for c in MATCHES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names=names)

        parts.append(rows.mapInArrow(search, MATCHES))
    return reduce(DataFrame.unionAll, parts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, item_id, start_word, end_word (exclusive), edits of every document and item that match."""
    return _matches(docs, benchmark, max_ratio).drop("row_hash")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose texts match an item."""
    return without(docs, _matches(docs, benchmark), text_hash(F.col("text")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict[str, str] = {}
