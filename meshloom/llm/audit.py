"""12. Filter interaction audit: what each of five filters removes, for all 120 orders of them.

Every document has a mask of the filters that it fails; how many documents of a part have each of the 32 masks says all
that the audit needs, and these counts add up over tasks. Orders are applied to the counts, never to documents.

Filters A to D look at one text. E fails documents whose text a document with a smaller id has, anywhere in the table:

1. hashes of whole texts go into a counting Bloom filter (``bloom``: counters that stop at two, merged over all tasks), which
   clears texts that are certainly unique;
2. only possible repeats are shuffled with their full text, and the smallest id of each text is taken there (partial
   minima first, so a text that a third of all documents share is no hot key);
3. a possible repeat that is not the first of its text fails E: first ones are met by doc_id and digest, no two of them alike.

Defined cases: a null text is empty (and equal to other empty ones); a null lang is the part ''; rows that share a doc_id are
documents each, and none is smaller than the other; a row without a doc_id has no label, never fails E and makes no other row
fail it; a label row counts if any row of its doc_id has the value 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import SeenTwice
from .common import materialise, table, text_hash, text_only

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 3
SYMBOLS = "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    counts = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("m"), F.length(text).alias("chars"), (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))).alias("capitals"))
    # a transform over one struct, so that words are split once
    fails = lambda c: [(c["n"] < LEAST_WORDS, "A"), (100 * c["m"].cast("long") < LEAST_DISTINCT_PERCENT * c["n"].cast("long"), "B"), (100 * c["capitals"].cast("long") > MOST_CAPITAL_PERCENT * c["chars"].cast("long"), "C")]
    bits = F.transform(F.array(counts), lambda c: reduce(Column.__add__, (F.when(cond, BIT[f]).otherwise(0) for cond, f in fails(c))))[0]
    return bits + F.when(text.rlike(SYMBOLS), BIT["D"]).otherwise(0)


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column("hash").to_numpy().view(np.uint64)


def failed(docs: DataFrame) -> DataFrame:
    """doc_id, part and fails (the bits of all filters that it fails) of each row of ``docs``."""
    texts = text_only(docs, "lang").withColumn("hash", text_hash(F.col("text")))
    alone = materialise(texts.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), _failures(F.col("text")).alias("fails"), "hash", F.unhex(F.sha2("text", 256)).alias("digest")), "failures")
    twice = SeenTwice(alone.filter("doc_id is not null").select("hash"), _hashes)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(twice(next(_hashes(batch))))).drop_columns(["hash"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("hash"), "possible", pa.array(twice(next(_hashes(batch)))))

    repeats = texts.filter("doc_id is not null").select("doc_id", "text", "hash").mapInArrow(possible, "doc_id long, text string")
    firsts = repeats.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(True).alias("first"))
    rows = alone.mapInArrow(marked, "doc_id long, part string, fails int, possible boolean, digest binary")
    late = F.when(F.col("possible") & F.col("first").isNull(), BIT["E"]).otherwise(0)
    met = rows.filter("doc_id is not null").join(materialise(firsts, "firsts"), ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("fails") + late).alias("fails"))
    return met.unionByName(rows.filter("doc_id is null").select("doc_id", "part", "fails"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good and toxic: how many documents there are, and how many of them are labelled so."""
    has = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has("quality"), has("toxic"))
    met = rows.filter("doc_id is not null").join(known, "doc_id", "left").select("part", "fails", "quality", "toxic")
    none = rows.filter("doc_id is null").select("part", "fails", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias({"quality": "good"}.get(c, c))
    return met.unionByName(none).groupBy("part", "fails").agg(F.count("*").alias("n"), total("quality"), total("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """The audit of mask counts: a row for each part, order and step. A part has at most 32 masks, whatever its documents."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.expr("substring(filter_order, 1, step - 1)")
    here = F.expr("substring(filter_order, step, 1)")
    bits = lambda letters: reduce(Column.__add__, (F.when(F.contains(letters, F.lit(f)), b).otherwise(0) for f, b in BIT.items()))
    steps = steps.withColumns({"this": bits(here), "before": bits(earlier)})
    fails, this, before = (F.col(c) for c in ("fails", "this", "before"))
    failing, gone = fails.bitwiseAND(this) != 0, fails.bitwiseAND(before) != 0
    removed = failing & ~gone
    total = lambda cond, n="n": F.sum(F.when(cond, F.col(n)).otherwise(0)).cast("long")
    # a document that fails m filters is removed by each of them in 120 / m orders
    share = F.col("n") * F.expr("120 div greatest(bit_count(fails), 1)")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(fails.bitwiseAND(this.bitwiseOR(before)) == 0).alias("kept"), total(removed).alias("removed"), total(failing & gone).alias("redundant"), total(fails == this).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), F.sum(F.when(failing, share).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and what its filter does there."""
    return interactions(materialise(mask_counts(failed(docs), labels), "mask-counts"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {
    "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS words FROM documents),
fails AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM texts),
docs AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.f NOT IN (w.f, x.f, y.f, z.f) AND w.f NOT IN (x.f, y.f, z.f) AND x.f NOT IN (y.f, z.f) AND y.f <> z.f),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS here, substr(filter_order, 1, step - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
met AS (
  SELECT docs.*, steps.*, contains(failed, here) AS failing, length(translate(failed, earlier, '')) < length(failed) AS gone FROM docs, steps),
report AS (
  SELECT part, filter_order, step, here, count(*) FILTER (WHERE NOT failing AND NOT gone) AS kept, count(*) FILTER (WHERE failing AND NOT gone) AS removed,
    count(*) FILTER (WHERE failing AND gone) AS redundant, count(*) FILTER (WHERE failed = here) AS unique_fails,
    count(*) FILTER (WHERE failing AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE failing AND NOT gone AND toxic) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, here)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley FROM report"""
}
