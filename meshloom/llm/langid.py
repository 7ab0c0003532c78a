"""4. Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased; characters that are no letters are blanks and runs of them one. For each language a model of
ORDER characters is trained: the highest order uses counts, lower orders the numbers of distinct left neighbours, and an
absolute discount moves mass from each order to the next. The probabilities of all grams that training saw, and the
back-off weights of all contexts, are arrays sorted by the 64-bit hash of the gram, with an entry for each language that saw it:
memory follows what training saw, not grams times languages. Each distinct gram of a stretch of text is scored once.

A text gets the language of least cross-entropy by character. ``score`` is its share among all languages after
temperature scaling, with the temperature fitted on training documents that the models did not see; ``rejected`` marks
texts whose cross-entropy lies beyond nearly all of those documents of similar length (they keep their best language).

Counting is a Spark aggregation over whole texts of a sample of labelled rows: about ``max_docs`` documents of each
language, chosen by hash. That bounds the models, whatever the corpus; every row is scored.

Defined cases: null texts and texts without letters are ``und`` with score 0; languages of fewer rows than others have
smaller models; ties take the first language in order; with no labelled row every text is ``und``; repeated rows repeat
their result, whatever stands beside them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import materialise, table

ORDER = 4
MAX_DOCS = 3000
CALIBRATION_SHARE = 5
_BLANK = 0x20
_LOW = [np.uint64((1 << 16 * k) - 1) for k in range(ORDER + 1)]
_LETTERS: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point of the basic plane itself if a letter, else a blank."""
    if "table" not in _LETTERS:
        _LETTERS["table"] = np.array([p if unicodedata.category(chr(p))[0] == "L" else _BLANK for p in range(1 << 16)], np.uint16)
    return _LETTERS["table"]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters of all texts (16 bits each, one blank before and after each text) and where each text begins."""
    joined = [f" {t} " for t in pc.utf8_lower(texts.fill_null("")).to_pylist()]
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(joined) + 1, np.int64)
    np.cumsum([len(t) for t in joined], out=at[1:])
    # letters beyond the basic plane share one symbol
    chars = _letters()[np.minimum(points, 0xFFFF)] if len(points) else np.zeros(0, np.uint16)
    if len(points) and points.max() > 0xFFFF:
        for p in np.unique(points[points > 0xFFFF]):
            if unicodedata.category(chr(p))[0] == "L":
                chars[points == p] = 0xFFFF
    blank = chars == _BLANK
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1]] = True  # each text keeps its first blank
    return chars[keep], np.append(0, np.cumsum(keep))[at]


def grams(chars: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """At each place the ORDER characters that end there, the last one in the lowest bits.

    ``offset`` is how many characters of the same text come before; what would come before a text is blank.
    """
    out = chars.astype(np.uint64)
    for k in range(1, ORDER):
        before = np.full(len(chars), _BLANK, np.uint64)
        before[k:] = chars[:-k]
        before[offset < k] = _BLANK
        out |= before << np.uint64(16 * k)
    return out


def offsets(at: np.ndarray, low: int, high: int) -> np.ndarray:
    """How many characters of the same text come before each of the places low..high-1; texts begin at ``at``."""
    places = np.arange(low, high)
    return places - at[np.searchsorted(at, places, "right") - 1]


def is_held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def training_rows(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """lang, text and calibration (boolean) of the sample: of each language all rows, or as many as make about ``max_docs``."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language, as many as there will be models
    if not counts:
        return labelled.select("lang", "text", F.lit(False).alias("calibration"))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, max_docs / r["count"]))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(place < share[F.col("lang")]).select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION_SHARE)) == 0).alias("calibration"))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "k": range(batch.num_rows)})
        for lang, part in frame.groupby("lang"):
            chars, at = characters(batch.column("text").take(pa.array(part["k"].to_numpy())))
            offset = offsets(at, 0, len(chars))
            keys, n = np.unique(grams(chars, offset)[offset > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Model:
    """Arrays of all languages together, each sorted by hash."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        # letters of any language, and one more for those that no training text has, share what a language keeps for unseen ones
        vocabulary = len(np.unique(counts["gram"].to_numpy().view(np.uint64) & _LOW[1])) + 1
        tables = [self._one(counts[counts["lang"] == lang], vocabulary) for lang in self.languages]
        self.floor = np.array([t["floor"] for t in tables])
        self.letters = np.unique(np.concatenate([t["p"][1][0] for t in tables])) if tables else np.zeros(0, np.uint64)
        self.grams = [self._sorted([t["p"][order] for t in tables], order) for order in range(1, ORDER + 1)]
        self.backoff = [self._sorted([t["b"][order] for t in tables], order) for order in range(1, ORDER)]
        self.temperature, self.limits = 1.0, np.zeros((0, 2))

    @classmethod
    def _sorted(cls, parts: list[tuple[np.ndarray, np.ndarray]], order: int) -> tuple:
        """The (keys, values) of each language as one array of distinct hashes, where the entries of each start, their languages and values."""
        hashes = np.concatenate([np.zeros(0, np.uint64), *(tb.mix64(k + np.uint64(order)) for k, _ in parts)])
        language = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        values = np.concatenate([np.zeros(0), *(v for _, v in parts)])
        by = np.argsort(hashes, kind="stable")
        hashes, first = np.unique(hashes[by], return_index=True)
        return hashes, np.append(first, len(by)), language[by], values[by], cls._prefixes(hashes)

    @staticmethod
    def _prefixes(hashes: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Where the hashes with each leading bits start, and the most that share them."""
        bits = max(1, int(len(hashes)).bit_length() + 1)
        starts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        return starts.astype(np.int32), bits, int(np.diff(starts).max(initial=0))

    @staticmethod
    def _one(counts: pd.DataFrame, vocabulary: int) -> dict:
        """log p of each gram and log back-off weight of each context, by order, of one language."""
        keys, n = counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy(float)
        levels = {ORDER: (keys, n)}
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
            lower, count = np.unique(levels[order + 1][0] & _LOW[order], return_counts=True)
            levels[order] = (lower, count.astype(float))
        out: dict = {"p": {}, "b": {}}
        log_lower = None
        for order in range(1, ORDER + 1):
            keys, n = levels[order]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            contexts, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inverse, n), np.bincount(inverse)
            weight = discount * kinds / total
            if order == 1:
                lower = np.full(len(keys), 1 / vocabulary)
                out["floor"] = float(np.log(weight[0] / vocabulary))
            else:
                below_keys, below = log_lower
                lower = np.exp(below[np.searchsorted(below_keys, keys & _LOW[order - 1])])
                out["b"][order - 1] = (contexts, np.log(weight))
            log_p = np.log((n - discount) / total[inverse] + weight[inverse] * lower)
            out["p"][order] = log_lower = (keys, log_p)
        out["b"][ORDER] = (np.zeros(0, np.uint64), np.zeros(0))
        return out

    @staticmethod
    def _put(out: np.ndarray, table: tuple, hashes: np.ndarray) -> None:
        """Write the entries of ``table`` for these hashes into their rows of ``out``, at their languages."""
        known, first, language, values, (starts, bits, most) = table
        if not len(known):
            return
        at = np.minimum(starts[(hashes >> np.uint64(64 - bits)).astype(np.int64)], len(known) - 1).astype(np.int64)
        behind = np.flatnonzero(known[at] < hashes)
        for _ in range(most):  # hashes are spread evenly, so this is a few steps for a few of them
            if not len(behind):
                break
            at[behind] = np.minimum(at[behind] + 1, len(known) - 1)
            behind = behind[(known[at[behind]] < hashes[behind]) & (at[behind] < len(known) - 1)]
        rows = np.flatnonzero(known[at] == hashes)
        low, many = first[at[rows]], first[at[rows] + 1] - first[at[rows]]
        entry = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        out[np.repeat(rows, many), language[entry]] = values[entry]

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log p of the last character of each gram given the others, in each language."""
        if order == 1:
            out = np.tile(self.floor, (len(keys), 1))
        else:  # what a language lacks it backs off to
            out = np.zeros((len(keys), len(self.languages)))
            self._put(out, self.backoff[order - 2], tb.mix64((keys >> np.uint64(16)) + np.uint64(order - 1)))
            out += self.log_probs(keys & _LOW[order - 1], order - 1)
        self._put(out, self.grams[order - 1], tb.mix64(keys + np.uint64(order)))
        return out

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character of each text in each language, and how many characters were scored."""
        chars, at = characters(texts)
        sums, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        sizes = np.diff(at) - 1  # the first blank is given
        step = max(1 << 12, (1 << 20) // max(4, len(self.languages)))
        for low in range(0, len(chars), step):  # a long text spans several parts
            high = min(low + step, len(chars))
            first = max(0, low - ORDER)
            part = grams(chars[first:high], offsets(at, first, high))[low - first :]
            logs = np.zeros((high - low + 1, len(self.languages)))
            distinct, place = np.unique(part, return_inverse=True)
            np.cumsum(self.log_probs(distinct)[place], axis=0, out=logs[1:])
            real = tb.counts_before(chars[low:high] != _BLANK)
            a, b = np.clip(at[:-1] + 1, low, high) - low, np.clip(at[1:], low, high) - low
            sums += logs[np.maximum(a, b)] - logs[a]
            letters += real[np.maximum(a, b)] - real[a]
        return -sums / np.maximum(sizes, 1)[:, None], np.where(letters > 0, sizes, 0)

    def calibrate(self, entropy: np.ndarray, sizes: np.ndarray, languages: list[str]) -> None:
        """Fit the temperature by the likelihood of the right language, and limits of cross-entropy by length."""
        right = np.array([self.languages.index(x) if x in self.languages else -1 for x in languages], np.int64)
        fine = (right >= 0) & (sizes > 0)
        entropy, sizes, right = entropy[fine], sizes[fine], right[fine]
        if not len(right):
            return
        best = -np.inf
        for t in 2.0 ** np.arange(-8, 7):
            logits = -entropy * t * np.sqrt(np.minimum(sizes, 10_000))[:, None]
            logits -= logits.max(axis=1, keepdims=True)
            likelihood = (logits[np.arange(len(right)), right] - np.log(np.exp(logits).sum(axis=1))).mean()
            if likelihood > best + 1e-12:
                best, self.temperature = likelihood, float(t)
        own = entropy[np.arange(len(right)), right]
        rows = []
        for low in (1, 32, 128, 512, 2048):
            some = own[(sizes >= low)]
            if len(some) >= 20:
                rows.append((low, float(np.quantile(some, 0.999)) + 0.5))
        self.limits = np.array(rows).reshape(-1, 2)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, sizes = self.cross_entropies(texts)
        best = entropy.argmin(axis=1)
        logits = -(entropy - entropy.min(axis=1, keepdims=True)) * self.temperature * np.sqrt(np.minimum(np.maximum(sizes, 1), 10_000))[:, None]
        score = np.where(sizes > 0, 1 / np.exp(logits).sum(axis=1), 0.0)
        limit = np.full(len(sizes), np.inf)
        for low, most in self.limits:
            limit[sizes >= low] = most
        return [self.languages[b] if s else "und" for b, s in zip(best, sizes, strict=True)], score, (entropy.min(axis=1) > limit) | (sizes == 0)


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Models of all languages of the training rows of ``docs`` (doc_id, text, lang)."""
    sample = materialise(training_rows(docs, max_docs), "sample")
    counts = sample.filter("not calibration").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = Model(counts.toPandas())  # bounded by max_docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                entropy, sizes = shared.value.cross_entropies(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(sizes)], names=["lang", "entropy", "size"])

    if model.languages:
        held = sample.filter("calibration").select("lang", "text").mapInArrow(measure, "lang string, entropy array<double>, size long").toPandas()  # numbers of the sample
        if len(held):
            model.calibrate(np.stack(held["entropy"]), held["size"].to_numpy(), held["lang"].tolist())
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = tb.strings(batch.column("text"))
            for i, j, _, _ in tb.slices(np.zeros(0, np.uint8), at):
                language, score, rejected = shared.value.predict(batch.column("text").slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(language, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
