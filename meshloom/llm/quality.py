"""6. Quality rules: counts of each text and robust multivariate outliers.

Every (language, source) group gets a minimum-covariance-determinant estimate of the location and scatter of
transformed text statistics; documents far from it by Mahalanobis distance are rejected. The estimate is found by
concentration steps over all rows, as Spark aggregations:

1. three starts: medians and quartile ranges of the group, alone, and with the correlations of squashed rows or of spatial signs;
2. the distances of all rows fall into logarithmic bins; the bin that completes ``support`` of the group is the cut, and
   its rows weigh as much as completes it exactly;
3. weighted mean and covariance within the cut are the next estimate (with the consistency factor of the normal law),
   until the determinant stops falling; the least determinant of all starts wins;
4. mean and covariance of the rows within the 0.975 quantile of that estimate (with its own factor) are the final one.

A group with fewer than MIN_GROUP passing rows is judged by the estimate of its language, and where that has too few
by the estimate of all rows, so every row is judged.

Defined cases: null texts are empty and fail the base rule; null languages and sources are groups of their own;
repeated rows each get the same verdict;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import materialise, row_hash, salt_of, salted, table, text_only, without

WINDOW = 5
SUPPORT = 0.75
#: A step that lowers the logarithm of the determinant by less is the last one.
LEAST_FALL = 1e-4
#: Passing rows of a group that has an estimate of its own.
MIN_GROUP = 60
#: Squared distance beyond which a document is rejected. Statistics of prose have heavier tails than the normal law,
#: so this lies beyond their 0.99999 quantile (28.5 for four statistics).
CUTOFF = 30.0
#: The least spread of each transformed statistic; keeps the scatter of constant statistics regular.
FLOOR = (0.05, 0.3, 0.3, 0.3)
SALTS = 16
BIN_PER_OCTAVE = 8
FEATURES = ("x0", "x1", "x2", "x3")
D = len(FEATURES)

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def count_slice(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The six counts of each document of a slice."""
    n = len(at) - 1
    starts, ends, words_at = tb.word_bounds(data, at)
    words = np.diff(words_at)
    in_words = ~tb.IS_SEP[data]
    chars = np.diff(tb.counts_before(in_words & ((data & 0xC0) != 0x80))[at])
    symbols = np.diff(tb.counts_before(_SYMBOL[data])[at])
    docs = np.repeat(np.arange(n), words)
    # words that lie in a window found twice or more in the same document
    covered = np.zeros(len(starts), bool)
    windows = tb.window_hashes(tb.segment_hashes(data, starts, ends), WINDOW)
    if len(windows):
        own = docs[: len(windows)] == docs[WINDOW - 1 :]
        places = np.flatnonzero(own)
        again = places[_repeats(tb.mix64(windows[places] + docs[places].astype(np.uint64) * tb.SHINGLE_CODE[62]))]
        for j in range(WINDOW):
            covered[again + j] = True
    repeat_words = np.diff(tb.counts_before(covered)[words_at])
    # lines with a word, and those that equal an earlier one
    lines_start, lines_end, lines_at = tb.word_bounds(data, at, _NEWLINE)
    in_word = tb.counts_before(in_words)
    real = in_word[lines_end] > in_word[lines_start]
    line_doc = np.repeat(np.arange(n), np.diff(lines_at))[real]
    keys = tb.mix64(tb.segment_hashes(data, lines_start, lines_end)[real] + line_doc.astype(np.uint64) * tb.SHINGLE_CODE[61])
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(line_doc, minlength=n)
    return [words, chars, symbols, lines, lines - np.bincount(line_doc[first], minlength=n), repeat_words]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = tb.strings(batch.column("text"))
        parts = [count_slice(d, a) for _, _, d, a in tb.slices(data, at)]
        if not parts:
            continue
        names = [c.split()[0] for c in COUNTS.split(", ")]
        keep = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in keep), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True))],
            names=[*(batch.schema.names[k] for k in keep), *names],
        )


def text_counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns, a hash of the row and the six counts of each whole text."""
    rows = text_only(docs, *more).withColumn("row_hash", row_hash("text", *more))
    schema = ", ".join(["doc_id long", *(f"`{c}` string" for c in more), "row_hash long", COUNTS])
    return rows.mapInArrow(count_batches, schema)


def with_statistics(counts: DataFrame) -> DataFrame:
    """The base rule and the transformed statistics of each row."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            # short texts are drawn to a common rate, since their own says little
            "x0": F.log((F.col("word_chars") + 50 * 5.5) / (F.col("n_words") + 50)),
            "x1": F.log1p(100 * F.col("n_symbols") / (chars + 100)),
            "x2": F.log1p(10 * F.col("n_dup_lines") / (F.col("n_lines") + 5)),
            "x3": F.log1p(10 * F.col("n_repeat_words") / (words + 50)),
        }
    )


def chi2_cdf(x: float, k: int) -> float:
    term = total = 1.0 / math.gamma(k / 2 + 1)
    for i in range(1, 400):
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * math.exp(-x / 2) * (x / 2) ** (k / 2)


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


#: Makes the covariance of the central SUPPORT of a normal sample that of the whole.
CONSISTENCY = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, D), D + 2)
#: Rows beyond this squared distance of the raw estimate have no weight in the final one, and its factor of consistency.
REWEIGHT = 0.975
REWEIGHT_WITHIN = chi2_quantile(REWEIGHT, D)
REWEIGHT_CONSISTENCY = REWEIGHT / chi2_cdf(REWEIGHT_WITHIN, D + 2)
_ENTRIES = [(i, j) for i in range(D) for j in range(i, D)]
#: Whose estimate it is: of a group, of a language (no source), or of all rows (neither).
_OWNER = ["level", "k_lang", "k_source"]
_PARAMS = "level int, k_lang string, k_source string, start int, logdet double, " + ", ".join([f"m{i} double" for i in range(D)] + [f"p{i}{j} double" for i, j in _ENTRIES])


def _param_rows(frame: pd.DataFrame, start, means: np.ndarray, covs: np.ndarray) -> pd.DataFrame:
    covs = covs + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(covs)
    out = {c: frame[c] for c in _OWNER} | {"start": start, "logdet": np.linalg.slogdet(covs)[1]}
    out |= {f"m{i}": means[:, i] for i in range(D)} | {f"p{i}{j}": inverse[:, i, j] for i, j in _ENTRIES}
    return pd.DataFrame(out)


def _symmetric(f: pd.DataFrame, name: str) -> np.ndarray:
    out = np.empty((len(f), D, D))
    for i, j in _ENTRIES:
        out[:, i, j] = out[:, j, i] = f[f"{name}{i}{j}"].to_numpy(float)
    return out


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            means = f[[f"m{i}" for i in range(D)]].to_numpy(float)
            spread = f[[f"d{i}" for i in range(D)]].to_numpy(float)
            for start, name in enumerate((None, "t", "u")):
                shape = np.broadcast_to(np.eye(D), (len(f), D, D))
                if name:
                    shape = _symmetric(f, name)
                    scale = np.sqrt(np.maximum(np.einsum("gii->gi", shape), 1e-12))
                    shape = shape / scale[:, :, None] / scale[:, None, :]
                yield _param_rows(f, start, means, shape * spread[:, :, None] * spread[:, None, :])


def _from_sums(consistency: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                n = f["n"].to_numpy(float)
                means = f[[f"s{i}" for i in range(D)]].to_numpy(float) / n[:, None]
                covs = _symmetric(f, "s") / n[:, None, None] - np.einsum("gi,gj->gij", means, means)
                yield _param_rows(f, f["start"], means, covs * consistency)

    return run


def _sums() -> list:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(D)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _ENTRIES)]


def _distance():
    """The squared Mahalanobis distance as one expression."""
    total = F.lit(0.0)
    for i, j in _ENTRIES:
        total = total + (1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return F.greatest(total, F.lit(0.0))


_KEY = ["g_lang", "g_source"]


def _meet(rows: DataFrame, params: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the parameters of their group; a hot group is dealt over SALTS tasks."""
    return rows.join(salted(params, SALTS), [*keys, "salt"], how)


def owners(rows: DataFrame) -> DataFrame:
    """g_lang, g_source and whose estimate judges it: its own, its language's or that of all rows."""
    passing = F.sum((~F.col("base_failed")).cast("long"))
    groups = materialise(rows.groupBy(*_KEY).agg(passing.alias("n")), "groups")
    langs = groups.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(2).alias("level")
    chosen = groups.join(langs, "g_lang").select(*_KEY, level)
    return chosen.withColumns({"k_lang": F.when(F.col("level") < 2, F.col("g_lang")).otherwise(""), "k_source": F.when(F.col("level") < 1, F.col("g_source")).otherwise("")})


def _first_params(rows: DataFrame) -> DataFrame:
    """Three starts of each owner: the quartiles, with no correlations, those of squashed rows, and those of spatial signs."""
    quartiles = rows.groupBy(*_OWNER).agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(FEATURES)))
    spread = {f"d{i}": (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in range(D)}
    centre = materialise(quartiles.withColumns({f"m{i}": F.col(f"q{i}")[1] for i in range(D)} | spread).drop(*(f"q{i}" for i in range(D))), "quartiles")
    z = _meet(rows, centre, _OWNER).withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"m{i}")) / F.greatest(f"d{i}", F.lit(FLOOR[i])) for i in range(D)})
    z = z.withColumn("zz", F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0)), F.lit(1e-12)))
    sums = z.groupBy(*_OWNER).agg(
        *(F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in _ENTRIES),
        *(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).alias(f"u{i}{j}") for i, j in _ENTRIES),
    )
    return sums.join(centre, _OWNER).mapInPandas(_starts, _PARAMS)


def _concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The next estimate of each owner and start, from the nearest ``SUPPORT`` of its rows."""
    binned = _meet(rows, params, _OWNER).withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * BIN_PER_OCTAVE).cast("int"))
    key, names = [*_OWNER, "start"], [*(f"s{i}" for i in range(D)), *(f"s{i}{j}" for i, j in _ENTRIES)]
    sums = binned.groupBy(*key, "bin").agg(*_sums())
    # few bins in a group, however many rows it has
    all_bins = Window.partitionBy(*key)
    left = SUPPORT * F.sum("n").over(all_bins) - F.coalesce(F.sum("n").over(all_bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = sums.withColumn("share", F.least(left / F.col("n"), F.lit(1.0))).filter("share > 0")
    return shares.groupBy(*key).agg(*(F.sum(F.col("share") * F.col(c)).alias(c) for c in ("n", *names))).mapInPandas(_from_sums(CONSISTENCY), _PARAMS)


def least_determinants(rows: DataFrame) -> DataFrame:
    """One row for each owner of ``rows`` (level, k_lang, k_source, salt, x0..): its location and inverse scatter of least determinant."""
    now = materialise(_concentrated(rows, materialise(_first_params(rows), "starts")), "estimates")
    ended = None
    # each further round lowers every determinant in it, which the floor of the scatter bounds from below
    while not now.isEmpty():
        after = _concentrated(rows, now)
        before = now.select(*_OWNER, "start", F.col("logdet").alias("__was"))
        after = materialise(after.join(before, [*_OWNER, "start"]), "estimates")
        falls = F.col("logdet") < F.col("__was") - LEAST_FALL
        stopped = now.join(after.filter(~falls).select(*_OWNER, "start"), [*_OWNER, "start"], "left_semi")
        ended = stopped if ended is None else ended.unionByName(stopped)
        now = after.filter(falls).drop("__was")
    if ended is None:
        return now.drop("start", "logdet")
    names = [c for c in ended.columns if c not in _OWNER]
    best = ended.groupBy(*_OWNER).agg(F.min(F.struct("logdet", *(c for c in names if c != "logdet"))).alias("p"))
    return materialise(best.select(*_OWNER, "p.*").drop("start", "logdet"), "estimates")


def robust_estimates(rows: DataFrame) -> DataFrame:
    """The estimates of least determinant, reweighted: those of the rows that lie within them."""
    within = _meet(rows, least_determinants(rows), _OWNER).filter(_distance() <= REWEIGHT_WITHIN)
    sums = within.groupBy(*_OWNER).agg(*_sums()).withColumn("start", F.lit(0))
    return materialise(sums.mapInPandas(_from_sums(REWEIGHT_CONSISTENCY), _PARAMS).drop("start", "logdet"), "reweighted")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, row_hash, the counts, ``base_failed``, ``kept`` and ``distance`` (null only where no row of the table passes the base rule) of each row of ``docs``."""
    counts = text_counts(docs, "lang", "source").withColumns({"g_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "g_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "salt": salt_of("doc_id", SALTS)}).drop("lang", "source")
    rows = materialise(with_statistics(counts), "statistics")
    owner = materialise(owners(rows), "owners")
    wanted = owner.select(*_OWNER).distinct()
    # a row counts for its group, its language and the whole, as far as these are asked for
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), (F.col("g_lang") if k < 2 else F.lit("")).alias("k_lang"), (F.col("g_source") if k < 1 else F.lit("")).alias("k_source")) for k in range(3))))
    passing = rows.filter(~F.col("base_failed")).select(*_KEY, "salt", *FEATURES, levels.alias("o")).select("o.*", "salt", *FEATURES)
    params = robust_estimates(materialise(_meet(passing, wanted, _OWNER), "levels"))
    judged = _meet(rows, owner.join(params, _OWNER).drop(*_OWNER), _KEY, "left").withColumn("distance", _distance())
    return judged.select(
        "doc_id", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
        "distance", *FEATURES,
    )


def reject(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows; each row is judged by itself, also where rows share a doc_id or have none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = quality_rules(docs).filter(~F.col("kept"))
    return without(docs, gone, F.xxhash64(F.lit(False), text, *(x for c in ("lang", "source") for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
