"""Operators 11 to 13 against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import audit, bloom, linededup, resample

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash with those made inside."""
    line = "This line of the licence stands in very many documents of the table"
    rows = [(1, None, None), (2, "", "en"), (3, " \t\n\x0b", "en"), (None, f"{line}\n{line}", None), (None, "x\r\n" + line, "en"), (4, line, "en"), (5, f"a\n  {line.upper()}\t\nb", "en"), (6, line + "\n" + line, ""), (6, line + " ", "de"), (6, line + " ", "de"), (7, ("word " * 60_000 + "\n") * 3 + line, "en"), (8, line, "de"), (9, f"{line}\n\n{line}\n", "de"), (10, "é" * 39, "de"), (11, "x" * 400_000, "de"), (12, "é" * 40, "fr")]
    rows += [(20 + i, "é" * 39 + "\n" + "é" * 40 + "\n" + "Ä" * 41 + f"\n{i}", "fr") for i in range(5)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(9) for c in ("row", "hash", "digest", "n_lines", "segment", "score", "rank", "part", "fails", "drops", "weight", "word_counts")})


def plain_line_dedup(rows, chars=40, documents=5):
    """(doc_id, n_lines, n_dropped, sha256 of the kept text) of (doc_id, text) rows."""
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(blank))
    least = -(2**63)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(least if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= chars and len(held[k]) >= documents and max(held[k]) != (least if i is None else i) for x in lines]
        out.append((i, len(lines), sum(gone), hashlib.sha256("\n".join(x for x, g in zip(lines, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def line_dedup_rows(docs, **how):
    return ordered(tuple(r) for r in linededup.drop_lines(docs, **how).select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect())


@pytest.mark.parametrize("keys", [1 << 20, 0])
def test_line_dedup_equals_a_plain_loop(spark, keys):
    for docs in (odd_documents(spark), table(spark, "documents")):
        want = ordered(plain_line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()]))
        assert sum(r[2] for r in want)
        assert line_dedup_rows(docs, keys=keys) == want


def test_line_dedup_of_few_lines_and_no_rows(spark):
    docs = spark.createDataFrame([(i, f"a b\nline {i % 3}\n A B ", None) for i in range(12)], DOCS)
    want = ordered(plain_line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 2))
    assert line_dedup_rows(docs, chars=3, documents=2) == want and want[0][2] == 3
    assert linededup.drop_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_deduplicated_keeps_all_columns(spark):
    docs = odd_documents(spark).withColumn("n_chars", F.length("text"))
    out = linededup.deduplicated(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    assert out.filter("text is null").count() == docs.filter("text is null").count() == 1
    assert out.filter("n_chars <> length(text)").isEmpty()


@pytest.mark.parametrize("most_bits", [16, 29])
def test_filters_never_deny_what_was_seen_twice(spark, most_bits):
    rng = random.Random(4)
    hashes = [rng.getrandbits(64) for _ in range(30_000)]
    repeated = hashes[:500]
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in hashes + repeated], "h long").repartition(7)
    twice = bloom.SeenTwice(rows, lambda batch: iter([batch.column("h").to_numpy().view(np.uint64)]), most_bits)
    assert twice.hashes == len(hashes) + len(repeated)
    assert twice(np.array(repeated, np.uint64)).all()
    suspected = twice(np.array(hashes[500:], np.uint64)).mean()
    assert suspected < 0.05 if most_bits == 29 else suspected > 0.05
    assert not twice(np.zeros(0, np.uint64)).size


def test_filters_of_nothing(spark):
    twice = bloom.SeenTwice(spark.createDataFrame([], "h long"), lambda batch: iter([]))
    assert twice.hashes == 0 and not twice(np.arange(9, dtype=np.uint64)).any()


# 12


def plain_audit(docs, labels):
    """The audit's rows, order by order and document by document; docs are (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[lang or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out, removals = {}, Counter()
    for part, rows in parts.items():
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                before = set(p[:k])
                removed = [r for r in rows if f in r[0] and not r[0] & before]
                removals[part, f] += len(removed)
                out[part, "".join(p), k + 1] = (sum(not r[0] & {*before, f} for r in rows), len(removed), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in removed), sum(r[2] for r in removed))
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_plain_loops(spark):
    odd = odd_documents(spark).withColumn("hash", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (4, 1, None), (4, 1, 1), (None, 1, 1), (20, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, known in ((odd, labels), (table(spark, "documents"), table(spark, "labels"))):
        want = plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in known.collect()])
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in audit.audit(docs, known).collect()}
        assert got == want


def test_filter_audit_of_copies_and_no_rows(spark):
    docs = spark.createDataFrame([(i % 300 if i else None, "same text" if i % 3 else f"text {i % 7}", "en") for i in range(900)], DOCS).repartition(5)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fails = Counter(r["fails"] for r in audit.failed(docs).collect())
    # each text's smallest id, in every row that has both, and the row without an id do not fail E
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    least = {}
    for i, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    assert fails[1] == sum(i is None or least[t] == i for i, t in rows) and fails[17] == 900 - fails[1]
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert audit.audit(docs, labels).count() == 600


# 11


def plain_resampling(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) rows of (doc_id, text) rows."""

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def buckets(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        b = buckets(x)
        weight = sum(gain[k] for k in b)
        rows.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    n = percent * len(able) // 100
    return [(*r[:4], k + 1) for k, r in enumerate(able[:n])] + [(*r[:4], None) for r in [*able[n:], *(r for r in rows if not r[4])]]


def resampled_rows(docs, target, **how):
    return ordered(tuple(r) for r in resample.resampled(docs, target, **how).select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_resampling_equals_a_plain_version(spark):
    for docs, target, percent in ((table(spark, "documents"), table(spark, "benchmark"), 5), (odd_documents(spark), spark.createDataFrame([("the line of the licence",), (None,)], "text string"), 100)):
        want = plain_resampling([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], percent)
        assert resampled_rows(docs, target, percent=percent) == ordered(want)


def test_resampling_of_no_rows_and_no_target(spark):
    docs, none = table(spark, "documents").select("doc_id", "text").limit(60), spark.createDataFrame([], "text string")
    assert resampled_rows(docs, none) == ordered(plain_resampling([tuple(r) for r in docs.collect()], []))
    assert resample.resampled(docs.limit(0), docs).collect() == []
    assert all(r[4] is None for r in resampled_rows(docs.limit(9), none))


def test_resampling_of_long_texts(spark):
    """Texts beyond a slice, cut between words, and a word that is longer than a slice."""
    rng = random.Random(2)
    rows = [(1, " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))), (2, "a B-c " + "x" * 1_500_000 + " d Ünï"), (3, "one")]
    want = ordered(plain_resampling(rows, ["w1 w2 one"]))
    assert resampled_rows(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w2 one",)], "text string")) == want


@pytest.mark.parametrize("width", [1 / 4096, 1 / 16, 4.0])
def test_the_cutoff_of_ties(spark, width):
    """A score that a third of the rows share lies at the cutoff; rows that share a doc_id too."""
    rows = [(None if i % 97 == 0 else i // 2, 30 if i % 5 else 3, 9, 0, 7 if i % 3 else i) for i in range(2000)]
    scores = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(6)
    for percent in (1, 40, 100):
        able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
        n = percent * len(able) // 100
        got = resample.drawn(scores, percent, width=width).collect()
        assert len(got) == len(rows)
        best = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in best] == list(range(1, n + 1))
        assert [(r["score"], r["doc_id"]) for r in best] == [(r[4], r[0]) for r in able[:n]]


def test_crcs_of_runs():
    rng = random.Random(1)
    a, b = ([rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 300, 70_000])) for _ in range(200)] for _ in range(2))
    crcs = lambda x: np.array([zlib.crc32(t) for t in x], np.uint32)
    assert (resample.appended(crcs(a), crcs(b), np.array([len(t) for t in b])) == crcs([x + y for x, y in zip(a, b, strict=True)])).all()
