"""The stages against a plain version of each, on planted documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.cases import prose
from trawlmill.llm import op1_bpe, op3_near_dedup, op9_decontaminate

SF = "/root/testdata/sf0.001"


def test_planted_documents_go_and_clean_ones_stay(spark):
    clean = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = prose(7, 60)
    rows = [(10_000 + k, prose(200 + k, 150)) for k in range(6)]
    rows += [(20_000, rows[0][1]), (20_001, rows[1][1] + " tail"), (20_002, prose(300, 90) + " " + item + " " + prose(301, 70))]
    rows += [(30_000 + k, prose(400 + k, 90) + " " + passage + " " + prose(500 + k, 80)) for k in range(2)]
    docs = spark.createDataFrame([(i, t, "es", "src0", len(t)) for i, t in rows], clean.schema)
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {20_000, 20_001}
    cut = corpus_pipeline.repeated_passages(spark, left, SF)
    assert cut.columns == docs.columns and cut.count() == left.count()
    assert cut.where(F.col("text").contains(passage)).count() == 0
    assert cut.where("doc_id < 20000").exceptAll(left.where("doc_id < 20000")).count() == 0
    rest = corpus_pipeline.benchmark(spark, cut, SF)
    assert {r.doc_id for r in cut.collect()} - {r.doc_id for r in rest.collect()} == {20_002}
    ids = corpus_pipeline.token_ids(spark, rest, SF)
    own = op1_bpe.tokenizer(*op1_bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in rest.collect()}
    assert {r.doc_id: bytes(r.ids) for r in ids.collect()} == {i: own.encode(t) for i, t in texts.items()}


def test_run_leaves_no_copies_and_no_items(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.join(out.select("doc_id"), "doc_id", "left_semi")
    n = kept.count()
    assert 0 < n == out.count() < docs.count()
    assert op3_near_dedup.near_duplicate_classes(kept).select("class_id").distinct().count() == n
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert op9_decontaminate.contained_items(kept, items).select("doc_id").distinct().count() == 0
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").join(docs, "doc_id")
    lost = good.join(out, "doc_id", "left_anti").count()
    assert lost < good.count() / 2


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.count() == 0, name
