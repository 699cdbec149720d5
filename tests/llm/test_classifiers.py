"""op6 and op10: held-out accuracy, awkward rows, and the shared regression."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import awkward, corpus
from trawlmill.llm import common, linear, op2_suffix_dedup, op3_near_dedup, op6_language, op10_quality

SF = "/root/testdata/sf0.01"


def test_regression_learns_and_calibrates():
    rng = np.random.default_rng(0)
    index = rng.integers(0, 50, (800, 6))
    label = (index < 10).sum(1).argsort().argsort() * 3 // 800
    rows = linear.Rows(np.arange(0, 4801, 6), index.reshape(-1), np.ones(4800))
    weights, bias = linear.fit_ftrl(rows, label, 3, 50, l1=0.01, l2=0.01)
    scores = rows.scores(weights) + bias
    assert (scores.argmax(1) == label).mean() > 0.75
    t = linear.temperature(scores, label)
    assert linear.loss(scores / t, label) <= min(linear.loss(scores / x, label) for x in (0.5, 1, 2)) + 1e-6


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op6_language.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum(F.expr("int(lang = lang_pred)"))).first()
    assert n > 150 and right / n > 0.98


def test_language_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op6_language.train(docs.limit(200), per_language=40)
    got = op6_language.predict(corpus(spark), model).collect()
    assert len(got) == len(awkward())
    assert all((r.lang_pred == "und") == (r.score == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == "und" for r in got) == 4
    nothing = op6_language.train(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in op6_language.predict(corpus(spark), nothing).collect()} == {"und"}
    assert op6_language.predict(corpus(spark, []), model).collect() == []


def test_quality_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = op10_quality.classes_of(labels)
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = op10_quality.train(docs, labels.where(~unseen))
    got = op10_quality.score(docs, model).join(known.where(unseen), "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.expr("int(__keep)")).alias("kept")).collect()
    kept = {r.label: r.kept / r.n for r in got}
    assert kept[0] > 0.95 and kept[1] < 0.25 and kept[2] < 0.6


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, None), (None, 0, 0), (9, None, None), (11, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    docs = corpus(spark)
    model = op10_quality.train(docs, labels)
    got = op10_quality.score(docs, model, carry=docs.columns)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert len(rows) == len(awkward()) and all(0 <= r["__score"] <= 1 for r in rows)
    assert op10_quality.train(docs, labels.limit(0)) is None
    assert all(r["__keep"] for r in op10_quality.score(docs, None).collect())
    assert op10_quality.score(corpus(spark, []), model).collect() == []


def mistakes(spark, rounds):
    """Wrongly kept or rejected among labelled documents that training does not get."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = op10_quality.classes_of(labels)
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = op10_quality.train(docs, labels.where(~unseen), rounds=rounds)
    got = op10_quality.score(docs, model).join(known.where(unseen), "doc_id")
    return got.where("__keep <> (label = 0)").count(), model


def test_pseudo_labels_teach_the_other_view(spark):
    """Rounds over all other documents lower the errors of the labels alone, or leave them."""
    alone, plain = mistakes(spark, 1)
    taught, model = mistakes(spark, 3)
    assert plain["evidence"] == [None, None] and all(w is not None for w in model["evidence"])
    # places of tokens that no labelled document has
    places = set(op10_quality.buckets_of(plain["vocabulary"]).tolist())
    told = set(np.flatnonzero(np.ptp(model["evidence"][0], axis=1) > 1).tolist())
    assert len(told - places) > 100
    assert taught <= alone


def test_names_that_clash(spark):
    names = ["__score", "__label", "__keep", "__text", "__row_id", "__row_hash", "__ranges", "__SCORE_"]
    docs = corpus(spark).withColumns({n: F.lit(f"keep {n}") for n in names[:-1]})
    kept = op10_quality.accepted(docs, None)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.count() == docs.count()
    cut = op2_suffix_dedup.strip_repeats(docs, 100, 25, words=3)
    assert cut.columns == docs.columns and cut.where("__row_id <> 'keep __row_id' OR __ranges <> 'keep __ranges'").count() == 0
    some = common.rows_with_key(docs, docs.selectExpr("coalesce(doc_id, 0) AS row_id", "xxhash64(coalesce(text, '')) AS row_hash"), "left_semi")
    assert some.columns == docs.columns and some.where("__row_id <> 'keep __row_id'").count() == 0
    one = op3_near_dedup.one_of_each(docs)
    assert one.columns == docs.columns and one.exceptAll(docs).count() == 0
    assert common.fresh_names(names, "score", "label") == ["__score__", "__label_"]
