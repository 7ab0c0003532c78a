"""The pipeline stage by stage against plain versions of what each stage must do."""

import zlib

import numpy as np
import pytest
from brute import base_spans, components
from pyspark.sql import functions as F

import corpus_pipeline
from meshloom.llm import decontaminate, packing, quality
from meshloom.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, materialise(stage(spark, docs, SF))
        kept[name] = (before, docs)
        assert docs.columns == columns
    before, after = kept["quality rules"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in quality.quality_rules(before).filter("kept").select("doc_id").collect()}
    before, after = kept["near-dedup"]
    want = components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r[0] for r in after.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}
    before, after = kept["decontamination"]
    leaks = {r[0] for r in decontaminate.find_leaks(before, table(spark, SF, "benchmark")).select("doc_id").collect()}
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()} - leaks
    before, after = kept["PII"]
    assert before.count() == after.count()
    assert not any(base_spans(r["text"] or "") for r in after.collect())
    assert after.filter(F.col("n_chars") != F.length("text")).isEmpty()


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert whole.count() > 0 and whole.filter("n <> m").isEmpty()
    assert all(len(r["ids"]) == 2 * r["length"] and zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] for r in out.collect())
    found = packing.sequences(out)
    assert found.filter((F.octet_length("ids") != 2 * F.col("n_tokens")) | (F.col("n_tokens") > 1024)).isEmpty()
    r = out.filter("offset > 0").orderBy("sequence_id", "offset").first()
    ids = found.filter(F.col("sequence_id") == r["sequence_id"]).first()["ids"]
    assert ids[2 * r["offset"] :][: 2 * r["length"]] == r["ids"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, "s", 0), (1, "one " * 60_000, "en", None, 1), (1, "one " * 60_000, "en", None, 1), (None, "mail a@b.com and so on with some ten more words here", "en", "s", 3)]])
def test_stages_of_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [r["text"] for r in docs.collect()] == (["mail [EMAIL] and so on with some ten more words here"] if rows else [])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.isEmpty() != bool(rows)
