"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Method: characters in lower case, everything that isn't a letter as one blank; 1- to 3-grams of code points go to 2**16
buckets.  A feature is the n-gram's relative frequency in the text times its inverse document frequency, which is counted
over all training documents.  Weights come from follow-the-regularised-leader updates with an elastic net on a
bounded sample (SAMPLE_PER_LANGUAGE labelled documents of each language, by hash); a fifth of the sample is kept from
the fit and sets the temperature.  As the features are linear in the n-gram counts, a prediction adds up weights over the
whole text.

Training uses text and non-null lang of documents with crc32(id) mod 5 <> 0; nothing but the text enters a prediction.

Rows: `und` with score 0 where the text is null, empty or without a letter, or nothing could be learned.  A null id
counts as an empty id text (remainder 0: held out).  Repeated rows are scored each.  Extra columns are not read.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.llm.common import chunks, table, whole_text
from trawlmill.llm.linear import Rows, fit_ftrl, softmax, temperature

BITS = 16
ORDERS = (1, 2, 3)
#: Bound of the training sample.
SAMPLE_PER_LANGUAGE = 3000
SCALE = 30.0


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus == remainder


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
    return out


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets and their rows; nothing for rows without a letter."""
    codes = np.frombuffer("\x00".join(t.replace("\x00", " ") for t in texts).lower().encode("utf-32-le"), np.uint32)
    row = np.cumsum(codes == 0).astype(np.int32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    codes, row, letter = codes[keep], row[keep], letter[keep]
    ends = ~letter & (codes == 0)
    row = row - ends  # the mark after a text belongs to it
    codes = np.where(letter, codes, np.uint32(32))
    for n in ORDERS:
        if len(codes) < n:
            return
        h = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        own = row[: len(row) - n + 1]
        inside = own == row[n - 1 :]
        yield (h[inside] >> np.uint32(32 - BITS)).astype(np.int32), own[inside]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """One row for each partition's share: df (array of 2**BITS counts), n (documents)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in chunks(batches):
            texts = batch.column(0).to_pylist()
            grams = list(ngrams(texts))
            for start in range(0, len(texts), 128):
                there = np.zeros((128, 1 << BITS), bool)
                for bucket, row in grams:
                    a, b = np.searchsorted(row, (start, start + 128))
                    there[row[a:b] - start, bucket[a:b]] = True
                total += there.sum(axis=0)
            n += len(texts)
        if n:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[total[used], n])], names=["bucket", "df"])

    return docs.select(whole_text().alias("text")).mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def _sparse(texts: list[str], idf: np.ndarray) -> Rows:
    """Rows of training texts."""
    grams = list(ngrams(texts))
    bucket = np.concatenate([b for b, _ in grams] or [np.zeros(0, np.int32)])
    row = np.concatenate([r for _, r in grams] or [np.zeros(0, np.int32)])
    key, count = np.unique(row.astype(np.int64) << BITS | bucket, return_counts=True)
    row, bucket = key >> BITS, key & ((1 << BITS) - 1)
    size = np.maximum(np.bincount(row, count, minlength=len(texts)), 1)
    return Rows(np.searchsorted(row, np.arange(len(texts) + 1)), bucket, count * idf[bucket] / size[row] * SCALE)


def fit(sample: DataFrame, idf: np.ndarray, languages: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, intercepts and temperature from rows (label, calibrate, text); the bounded sample meets in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, label, kept = [], [], []
        for batch in chunks(batches):
            parts.append(_sparse(batch.column(2).to_pylist(), idf))
            label.append(batch.column(0).to_numpy(zero_copy_only=False))
            kept.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not parts:
            return
        shift = np.cumsum([0, *(p.start[-1] for p in parts)])
        rows = Rows(np.r_[0, np.concatenate([p.start[1:] + s for p, s in zip(parts, shift, strict=False)])], np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]))
        y, aside = np.concatenate(label), np.concatenate(kept).astype(bool)
        if aside.all():
            aside[:] = False
        learn = np.flatnonzero(~aside)
        weights, bias = fit_ftrl(rows.take(learn), y[learn], len(languages), 1 << BITS, epochs=2, alpha=1.0, l1=0.02, l2=0.1)
        check = np.flatnonzero(aside)
        t = temperature(rows.take(check).scores(weights) + bias, y[check])
        out = io.BytesIO()
        np.savez_compressed(out, weights=weights.astype(np.float32), bias=bias, t=t)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    found = sample.select("label", "calibrate", "text").repartition(1).sortWithinPartitions(F.xxhash64("text"), "label").mapInArrow(run, "model binary").collect()
    if not found:
        return np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0
    model = np.load(io.BytesIO(found[0][0]))
    return model["weights"], model["bias"], float(model["t"])


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """The model: languages (sorted), weights with the IDF in them, intercepts, temperature.  `docs`: the training documents."""
    labelled = docs.where("lang IS NOT NULL")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    frequency = np.zeros(1 << BITS)
    n = 0
    for bucket, df in document_frequencies(labelled).collect():  # at most 2**BITS rows and one
        if bucket < 0:
            n = df
        else:
            frequency[bucket] = df
    idf = np.log((1 + n) / (1 + frequency))
    model = {"languages": languages, "weights": np.zeros((1 << BITS, 0), np.float32), "bias": np.zeros(0), "t": 1.0}
    if languages:
        rates = labelled.sparkSession.createDataFrame([(x, i, min(1.0, per_language / counts[x])) for i, x in enumerate(languages)], "lang string, label int, rate double")
        keyed = labelled.select("doc_id", whole_text().alias("text"), "lang")
        draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
        aside = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id", "text"), F.lit(5)) == 0
        sample = keyed.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("label", aside.alias("calibrate"), "text")
        weights, bias, t = fit(sample, idf, languages)
        model |= {"weights": (weights * idf[:, None] * SCALE).astype(np.float32), "bias": bias, "t": t}
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    weights, bias, t, languages = model["weights"], model["bias"], model["t"], np.array([*model["languages"], "und"], object)
    classes = len(languages) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            total, size = np.zeros((len(texts), classes)), np.zeros(len(texts))
            for bucket, row in ngrams(texts):
                size += np.bincount(row, minlength=len(texts))
                for k in range(classes):
                    total[:, k] += np.bincount(row, weights[:, k][bucket], minlength=len(texts))
            best, score = np.full(len(texts), classes), np.zeros(len(texts))
            if classes:
                p = softmax((total / np.maximum(size, 1)[:, None] + bias) / t)
                some = size > 0
                best[some], score[some] = p.argmax(axis=1)[some], p.max(axis=1)[some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(5, 0)))
    return predict(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
