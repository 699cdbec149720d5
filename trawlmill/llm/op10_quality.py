"""Quality classifier by co-training on two views of a document.

Method: one view is the text's content (which tokens are there: runs of letters and digits, their beginnings, runs of
other signs, and a mark for a word that repeats itself), the other the page's metadata (language, source, length, and how the page is laid out:
shares of capitals, digits, signs, blanks and line breaks, length of words and lines, repetition), each as binned indicators.  Each
view has its own multinomial FTRL classifier for good, low and toxic.  In each round both views, calibrated, label all
documents outside the sample.  Where one view is sure, the document teaches the other: its features are counted under
that label, over the whole corpus, in BUCKETS hashed places for tokens (so every token takes part, also those that no labelled
document has).  The counts give a document evidence for each class, a log-odds sum like that of naive Bayes, and binned it is
a feature of the view in the next round's fit, which learns from labelled rows how far to trust it.  In the end the two
calibrated views are combined by a logistic model on a part of the labels that no fit has seen, with a prior between equal
shares of the classes and their shares in all labels, and score all documents.

Labels: toxic = 1 is toxic, else quality = 0 is low, else quality = 1 is good; rows for one id are put together (least
quality, largest toxic), rows without id or without any label don't count.  The labelled rows of a fit are a bounded sample drawn
by hash, PER_CLASS documents of each class; all other documents are pseudo-labelled in every round, on their whole texts.

Rows: every input row is scored; null and empty texts have no tokens and are scored by their metadata.  With no labels
every document is kept with score 1.  Extra columns are not read; lang and source may be missing or null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlmill.llm.common import chunks, fresh_names, mix, release_memory, table, text_bytes, tokens_of, whole_text
from trawlmill.llm.linear import Rows, fit_ftrl, softmax, temperature
from trawlmill.sources.staging import discard, stage

CLASSES = ("good", "low", "toxic")
#: Bound of the labelled sample.
PER_CLASS = 3000
ROUNDS = 3
#: Places in which tokens of pseudo-labelled documents are counted, and places that go to the shuffle as one row.
BUCKETS = 1 << 18
BLOCK = 1 << 10
#: A class whose pseudo-labelled documents are fewer gives no evidence.
LEAST_TAUGHT = 20
SURE = 0.8
#: A token is a feature if it is in so many sampled documents, and its spread over the classes is no chance (chi-square).
LEAST_DOCUMENTS = 3
LEAST_CHI_SQUARE = 30.0
#: 0 weighs errors in each class alike, 1 each document alike.
PRIOR_WEIGHT = 0.5
#: Beginnings of words, in bytes: they stand for a stem with different endings.
PREFIXES = (4, 5, 6)
BINS = 16
REPEAT = np.uint64(0xA0761D6478BD642F)

#: 0 blank, 1 part of a word, 2 other sign.
_SIGNS = np.ones(256, np.uint8)
_SIGNS[:128] = [1 if chr(c).isalnum() else 2 for c in range(128)]
_SIGNS[[9, 10, 11, 12, 13, 32]] = 0


def content(hashes: np.ndarray, row: np.ndarray, heads: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different tokens and token beginnings of each row: hashes and rows, sorted by row and hash."""
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) if len(hashes) else np.zeros(0, np.int64)
    hashes = np.concatenate([hashes, np.full(len(again), REPEAT), *(h for h, _ in heads)])
    row = np.concatenate([row, row[again], *(r for _, r in heads)])
    order = np.argsort(hashes)
    by_row = row[order]
    # Numbers of 16 bits are sorted by their digits.
    order = order[np.argsort(by_row.astype(np.uint16) if len(row) and row.max() < 1 << 16 else by_row, kind="stable")]
    hashes, row = hashes[order], row[order]
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])] if len(hashes) else np.zeros(0, bool)
    return hashes[keep], row[keep]


def layout(
    data: np.ndarray, at: np.ndarray, lang: list[str | None], source: list[str | None], kinds: np.ndarray, hashes: np.ndarray, row: np.ndarray, words: np.ndarray
) -> np.ndarray:
    """rows x features: indicator numbers, each feature in its own range of BINS (lang and source: 64).

    kinds are the rows of the different tokens; hashes, row and words those of all tokens.
    """
    rows = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(rows), size)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=rows) / np.maximum(size, 1)

    def binned(x: np.ndarray) -> np.ndarray:
        return np.clip(np.log2(x * 4096 + 1), 0, BINS - 1).astype(np.int64)

    once = np.bincount(kinds, minlength=rows) / np.maximum(words, 1)
    signs = (_SIGNS[data] == 2) if len(data) else np.zeros(0, bool)
    repeats = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=rows) / np.maximum(words, 1)
    measures = [
        np.clip(np.log2(size + 1), 0, BINS - 1).astype(np.int64),
        binned(share((data >= 65) & (data <= 90))), binned(share((data >= 48) & (data <= 57))), binned(share(signs)),
        binned(share((data == 32) | (data == 9))), binned(share(data == 10)), binned(share(data >= 128)), binned(share(data == 124)),
        np.clip(size / np.maximum(words, 1), 0, BINS - 1).astype(np.int64),
        np.clip(once * BINS, 0, BINS - 1).astype(np.int64), binned(repeats),
    ]
    out = [m + k * BINS for k, m in enumerate(measures)]
    base = len(measures) * BINS
    for k, names in enumerate((lang, source)):
        known = {x: hash_name(x) for x in set(names)}
        out.append(np.array([known[x] for x in names], np.int64).reshape(rows) + base + 64 * k)
    return np.stack(out, axis=1)


META_FEATURES = 11 * BINS + 128


def hash_name(name: str | None) -> int:
    if name is None:
        return 0
    total = np.uint64(len(name))
    for byte in name.encode():
        total = mix(np.array([total ^ np.uint64(byte + 1)], np.uint64))[0]
    return int(total % np.uint64(63)) + 1


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the columns text, lang, source: token hashes, their rows, metadata features."""
    find = batch.schema.get_field_index
    data, at = text_bytes(batch.column(find("text")))
    tokens, owner, words, heads = tokens_of(data, at, _SIGNS, PREFIXES)
    hashes, row = content(tokens, owner, heads)
    return hashes, row, layout(data, at, batch.column(find("lang")).to_pylist(), batch.column(find("source")).to_pylist(), row, tokens, owner, words)


#: Indicators of the evidence: two margins against the first class.
EVIDENCE = 2 * BINS


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def evidence_weights(counts: np.ndarray, documents: np.ndarray) -> np.ndarray | None:
    """places x classes: log share of a class' documents that have the place, less the mean of the classes; None with fewer than two classes."""
    there = documents >= LEAST_TAUGHT
    if there.sum() < 2:
        return None
    logs = np.log((counts + 0.5) / (documents + 1.0))
    logs[:, ~there] = 0.0
    logs[:, there] -= logs[:, there].mean(axis=1, keepdims=True)
    return logs.astype(np.float32)


def _evidence_bins(places: np.ndarray, row: np.ndarray, rows: int, weights: np.ndarray | None) -> np.ndarray:
    """rows x 2 indicator numbers below EVIDENCE."""
    if weights is None:
        margins = np.zeros((rows, len(CLASSES)))
    else:
        margins = np.stack([np.bincount(row, weights[places, k], minlength=rows) for k in range(len(CLASSES))], axis=1)
        margins /= np.sqrt(np.bincount(row, minlength=rows) + 1.0)[:, None]
    steps = np.clip(np.floor(2 * (margins[:, 1:] - margins[:, :1])) + BINS // 2, 0, BINS - 1).astype(np.int64)
    return steps + np.arange(len(CLASSES) - 1) * BINS


def _text_rows(hashes: np.ndarray, row: np.ndarray, rows: int, vocabulary: np.ndarray, evidence: np.ndarray | None) -> Rows:
    """Known tokens, then the evidence of all tokens."""
    at, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(vocabulary):
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == hashes
        at, owner = at[known], row[known]
    bins = _evidence_bins(buckets_of(hashes), row, rows, evidence) + len(vocabulary)
    at = np.concatenate([at, bins.reshape(-1)])
    owner = np.concatenate([owner, np.repeat(np.arange(rows), bins.shape[1])])
    order = np.argsort(owner, kind="stable")
    at, owner = at[order], owner[order]
    return Rows(np.searchsorted(owner, np.arange(rows + 1)), at, np.ones(len(at)))


def _meta_rows(features: np.ndarray, evidence: np.ndarray | None) -> Rows:
    rows, width = features.shape
    bins = _evidence_bins(features.reshape(-1), np.repeat(np.arange(rows), width), rows, evidence) + META_FEATURES
    whole = np.concatenate([features, bins], axis=1)
    return Rows(np.arange(0, whole.size + 1, whole.shape[1]), whole.reshape(-1), np.ones(whole.size))


def combine(logs: list[np.ndarray], mixing: np.ndarray) -> np.ndarray:
    """Scores of the classes from the calibrated views' log probabilities: a weight for each view and an intercept for each class."""
    return mixing[0] * logs[0] + mixing[1] * logs[1] + mixing[2:]


def fit_combination(logs: list[np.ndarray], label: np.ndarray, classes: int) -> np.ndarray:
    """Multinomial logistic weights of the views by gradient descent on a handful of parameters."""
    mixing = np.r_[0.5, 0.5, np.zeros(classes)]
    if not len(label):
        return mixing
    own = np.eye(classes)[label]
    for _ in range(500):
        error = softmax(combine(logs, mixing)) - own
        slope = np.r_[(error * logs[0]).sum(1).mean(), (error * logs[1]).sum(1).mean(), error.mean(0)]
        mixing = mixing - 0.2 * (slope + 0.002 * np.r_[mixing[:2] - 0.5, mixing[2:]])
        mixing[:2] = np.maximum(mixing[:2], 0)
    return mixing


def telling_tokens(hashes: np.ndarray, label: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Sorted hashes of the tokens whose documents' classes differ from the classes' shares."""
    seen, which = np.unique(hashes, return_inverse=True)
    observed = np.bincount(which * len(CLASSES) + label, minlength=len(seen) * len(CLASSES)).reshape(-1, len(CLASSES))
    total = observed.sum(axis=1)
    expected = np.maximum(total[:, None] * (documents / max(documents.sum(), 1)), 1e-9)
    chi_square = ((observed - expected) ** 2 / expected).sum(axis=1)
    return seen[(total >= LEAST_DOCUMENTS) & (chi_square >= LEAST_CHI_SQUARE)]


def fit_views(label: np.ndarray, hashes: np.ndarray, owner: np.ndarray, meta: np.ndarray, aside: np.ndarray, shares: np.ndarray, evidence: list[np.ndarray | None]) -> dict:
    """The model from sampled labelled rows and the evidence of each view; aside: rows for calibration only."""
    vocabulary = telling_tokens(hashes, label[owner], np.bincount(label, minlength=len(CLASSES)))
    views = [_text_rows(hashes, owner, len(label), vocabulary, evidence[0]), _meta_rows(meta, evidence[1])]
    sizes = [len(vocabulary) + EVIDENCE, META_FEATURES + EVIDENCE]
    known, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    models = []
    for v in (0, 1):
        weights, bias = fit_ftrl(views[v].take(known), label[known], len(CLASSES), sizes[v], epochs=3 if len(known) > 2000 else 10, alpha=1.0 if v == 0 else 0.3, l1=0.2, l2=0.01 if v == 0 else 0.1)
        models.append((weights, bias, temperature(views[v].take(check).scores(weights) + bias, label[check])))
    weights, bias, t = models[0]
    used = np.abs(weights).sum(axis=1) > 0
    used[len(vocabulary) :] = True
    model = {"vocabulary": vocabulary[used[: len(vocabulary)]], "text": (weights[used], bias, t), "meta": models[1], "evidence": evidence}
    sampled = np.bincount(label, minlength=len(CLASSES)) + 1e-9
    logs = [_logs(views[v], models[v]) for v in (0, 1)]
    model["mixing"] = fit_combination([x[check] for x in logs], label[check], len(CLASSES))
    # From the sample's shares of the classes towards those of all labels.
    model["prior"] = PRIOR_WEIGHT * (np.log(np.maximum(shares, 1e-9)) - np.log(sampled / sampled.sum()))
    model["prior"][np.bincount(label, minlength=len(CLASSES)) == 0] = -30.0
    return model


def _logs(rows: Rows, fitted: tuple) -> np.ndarray:
    weights, bias, t = fitted
    return np.log(np.maximum(softmax((rows.scores(weights) + bias) / t), 1e-9))


def _view_logs(model: dict, hashes: np.ndarray, row: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
    """Calibrated log probabilities of the classes by each view."""
    text = _text_rows(hashes, row, len(meta), model["vocabulary"], model["evidence"][0])
    return [_logs(text, model["text"]), _logs(_meta_rows(meta, model["evidence"][1]), model["meta"])]


def classes_of(labels: DataFrame) -> DataFrame:
    """doc_id, label (0 good, 1 low, 2 toxic), one row for each labelled id."""
    by_id = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return by_id.select("doc_id", label.alias("label")).where("label IS NOT NULL")


def _inputs(docs: DataFrame) -> DataFrame:
    names = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", whole_text().alias("text"), *names)


def _fitted(sample: DataFrame, shares: np.ndarray, evidence: list[np.ndarray | None]) -> dict | None:
    """The model of one round, from the staged features of the sample (at most about 3 x per_class rows)."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, held, tokens, counts, meta = [], [], [], [], []
        for batch in batches:
            label.append(batch.column(1).to_numpy(zero_copy_only=False))
            held.append(batch.column(2).to_numpy(zero_copy_only=False))
            tokens.append(batch.column(3).flatten().to_numpy(zero_copy_only=False))
            counts.append(np.diff(batch.column(3).offsets.to_numpy()))
            meta.append(batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        if label:
            sizes = np.concatenate(counts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            model = fit_views(np.concatenate(label), np.concatenate(tokens).view(np.uint64), owner, np.concatenate(meta), np.concatenate(held).astype(bool), shares, evidence)
            # the evidence is on the driver already
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps({**model, "evidence": None})], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fit, "model binary").collect()
    return {**pickle.loads(found[0][0]), "evidence": evidence} if found else None


def taught(others: DataFrame, model: dict, sure: float = SURE) -> list[np.ndarray | None]:
    """Evidence weights of both views from all documents (doc_id, text, lang, source) that the other view is sure of."""
    places = BUCKETS + META_FEATURES
    blocks = -(-places // BLOCK)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        counts = np.zeros((blocks * BLOCK, len(CLASSES)), np.int64)
        documents = np.zeros((2, len(CLASSES)), np.int64)
        for batch in chunks(batches):
            hashes, row, meta = _views(batch)
            logs = _view_logs(model, hashes, row, meta)
            teach = [np.where(x.max(axis=1) >= np.log(sure), x.argmax(axis=1), -1) for x in logs]
            # the metadata teaches the tokens, the text the layout
            own = teach[1][row]
            np.add.at(counts, (buckets_of(hashes[own >= 0]), own[own >= 0]), 1)
            own = np.repeat(teach[0], meta.shape[1])
            np.add.at(counts, (BUCKETS + meta.reshape(-1)[own >= 0], own[own >= 0]), 1)
            for v in (0, 1):
                documents[v] += np.bincount(teach[1 - v][teach[1 - v] >= 0], minlength=len(CLASSES))
        parts = counts.reshape(blocks, -1)
        some = np.flatnonzero(parts.any(axis=1))
        packed = [documents.tobytes(), *[parts[i].tobytes() for i in some]]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(packed, np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    parts = others.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add_up, "block int, counts binary")
    counts = np.zeros((blocks, BLOCK * len(CLASSES)), np.int64)
    documents = np.zeros((2, len(CLASSES)), np.int64)
    for block, packed in parts.collect():  # as many numbers as there are places and classes
        if block < 0:
            documents = np.frombuffer(packed, np.int64).reshape(2, -1)
        else:
            counts[block] = np.frombuffer(packed, np.int64)
    counts = counts.reshape(-1, len(CLASSES))
    return [evidence_weights(counts[:BUCKETS], documents[0]), evidence_weights(counts[BUCKETS:places], documents[1])]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = ROUNDS) -> dict | None:
    """The model; None without labelled documents.  ``rounds`` = 1 is each view on its labelled rows alone."""
    known = classes_of(labels)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").join(known, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}  # at most 3 rows
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])[F.col("label")]
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    aside = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0
    chosen = stage(ids.where(draw < rate).select("doc_id", "label", aside.alias("aside")), "chosen")  # at most about 3 x per_class rows
    sample = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "aside", "text", "lang", "source")
    shares = np.array([counts.get(k, 0) for k in range(len(CLASSES))], float)
    shares /= shares.sum()

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in chunks(batches):
            hashes, row, meta = _views(batch)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))
            wide = pa.ListArray.from_arrays(np.arange(0, meta.size + 1, meta.shape[1], dtype=np.int32), pa.array(meta.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists, wide], names=["doc_id", "label", "aside", "tokens", "meta"])

    rows = stage(sample.mapInArrow(features, "doc_id long, label int, aside boolean, tokens array<long>, meta array<long>"), "sample")
    # all documents that no fit sees
    others = _inputs(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    model = _fitted(rows, shares, [None, None])
    for _ in range(rounds - 1):
        model = _fitted(rows, shares, taught(others, model)) if model else None
    discard(rows)
    return model


def score(docs: DataFrame, model: dict | None, carry: list[str] | None = None, names: tuple[str, str, str] = ("__score", "__label", "__keep")) -> DataFrame:
    """doc_id (or the columns in `carry`, unchanged), then under the given names score (probability of good), label, keep for every row."""
    schema = docs.select(*[F.col(f"`{c}`") for c in carry or ["doc_id"]]).schema
    kept = [f.name for f in schema]
    own = fresh_names(kept, "text", "lang", "source")
    inputs = [whole_text().alias(own[0])]
    inputs += [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(n) for c, n in (("lang", own[1]), ("source", own[2]))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in chunks(batches, column=own[0]):
            out = [batch.column(i) for i in range(len(kept))]
            if model is None:
                good, best = np.ones(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            else:
                view = pa.RecordBatch.from_arrays([batch.column(len(kept) + i) for i in range(3)], names=["text", "lang", "source"])
                p = softmax(combine(_view_logs(model, *_views(view)), model["mixing"]) + model["prior"])
                good, best = p[:, 0], p.argmax(axis=1)
            labels = pa.array(np.array(CLASSES, object)[best], pa.string())
            yield pa.RecordBatch.from_arrays([*out, pa.array(good), labels, pa.array(best == 0)], names=[*kept, *names])

    new = [T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.StringType(), T.BooleanType()), strict=True)]
    return docs.select(*[F.col(f"`{c}`") for c in kept], *inputs).mapInArrow(run, T.StructType([*schema.fields, *new]))


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs, whatever their columns, that the model keeps."""
    names = fresh_names(docs.columns, "score", "label", "keep")
    return score(docs, model, docs.columns, tuple(names)).where(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("__score").alias("score"), F.col("__label").alias("label"), F.col("__keep").alias("keep"))
