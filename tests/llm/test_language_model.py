"""op5 against dictionaries, with sums to 1."""

import collections
import math
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import awkward, corpus, prose, words
from trawlmill.llm import op5_katz as op5


def plain(rows):
    tokens = [[*words(t), "</s>"] for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    uni, bi = collections.Counter(), collections.defaultdict(collections.Counter)
    for t, k in zip(tokens, train, strict=True):
        if k:
            uni.update(t)
            for h, w in zip(["<s>", *t], t, strict=False):
                bi[h][w] += 1
    total, types = sum(uni.values()), len(uni)

    def discounts(counts):
        n = np.zeros(7, int)
        for c in counts:
            if c <= 6:
                n[c] += 1
        return op5.discounts(n)

    du, db = discounts(uni.values()), discounts([c for x in bi.values() for c in x.values()])
    kept = lambda c, d: c * (d[c] if c <= 5 else 1)
    share = sum(kept(c, du) for c in uni.values()) / max(total, 1)
    scale = (total / (total + 1)) / share if total and 1 - share < 1 / (total + 1) else 1.0
    unknown = 1 - scale * share if total else 1.0
    p1 = lambda w: scale * kept(uni[w], du) / total if uni[w] else unknown
    contexts = {}
    for h, x in bi.items():
        c = sum(x.values())
        left, factor = 1 - sum(kept(v, db) for v in x.values()) / c, 1.0
        if left < 1 / (c + 1):
            factor, left = (c / (c + 1)) / (1 - left), 1 / (c + 1)
        contexts[h] = c, factor, left / (1 - sum(p1(w) for w in x))

    def p2(h, w):
        if h not in contexts:
            return p1(w)
        c, factor, a = contexts[h]
        return factor * kept(bi[h][w], db) / c if bi[h][w] else a * p1(w)

    for h in list(contexts)[:40]:
        assert abs(sum(p2(h, w) for w in [*uni, "never seen"]) - 1) < 1e-9
    out = []
    for (i, _), t, k in zip(rows, tokens, train, strict=True):
        score = sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *t], t, strict=False))
        base = sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in t)
        out.append((i, not k, len(t), sum(uni[w] > 0 for w in t), total, base, score))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:], rel=1e-9) for w in want]


def test_scores_equal_dictionaries(spark, monkeypatch):
    rows = [*awkward(), *((100 + k, prose(k % 7, 60 + k)) for k in range(60))]
    want = plain(rows)
    check(op5.score_texts(corpus(spark, rows)).collect(), want)
    # Few cached words, many partitions, split contexts.
    monkeypatch.setattr(op5, "SPLIT_TOKENS", 50)
    monkeypatch.setattr(op5, "PARTITION_TOKENS", 2000)
    check(op5.score_texts(corpus(spark, rows).repartition(3), top_words=40).collect(), want)


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    assert op5.score_texts(corpus(spark, [])).collect() == []
    row = op5.score_texts(corpus(spark, [(1, "a b")]), train=F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


class Here:
    """One text as a table whose map runs in this process."""

    def __init__(self, text):
        self.text = text

    def select(self, *columns):
        self.batch = pa.RecordBatch.from_arrays([pa.array([self.text if c == "text" else 1]) for c in columns], names=list(columns))
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run([self.batch]))


def test_rare_words_do_not_hold_their_text():
    text = " ".join(f"{k:012d}" for k in range(5000))
    none = op5.Cache(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0)
    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    try:
        out = op5.rare_words(Here(text), types.SimpleNamespace(value=none))
    finally:
        pa.set_memory_pool(usual)
    assert sum(b.num_rows for b in out) == 5001
    assert pool.max_memory() < 20 * len(text)


def test_a_long_text_of_rare_words(spark):
    rows = [(1, " ".join(f"{k:012d}" for k in range(20_000))), (2, "a b"), (3, "a 000000000007")]
    check(op5.score_texts(corpus(spark, rows), top_words=2).collect(), plain(rows))


def sent(spark, rows, words, tokens):
    """The rows of one task's pieces."""
    from pyspark.sql import functions as F

    cache = spark.sparkContext.broadcast(op5.Cache(words, np.arange(len(words), 0, -1), len(rows), tokens))
    texts = corpus(spark, rows).coalesce(1).select("doc_id", "text", F.lit(True).alias("train"))
    return op5.bigram_pieces(texts, cache, op5.Unigrams(tokens, len(words), np.zeros(7, np.int64))).collect()


def test_rows_of_pieces_do_not_follow_the_number_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(op5, "PARTITION_TOKENS", 2400)
    rows = [(i, " ".join(f"{k:012d}" for k in range(i, 90_000, 3))) for i in range(3)]
    # 500 partitions in 63 buckets, and the piece's own row; each half megabyte of text had a row for each partition.
    assert len(sent(spark, rows, np.zeros(0, np.uint64), 1_000_000)) == 64
    monkeypatch.setattr(op5, "PIECE_TOKENS", 50_000)
    assert len({r.chunk for r in sent(spark, rows, np.zeros(0, np.uint64), 1_000_000)}) == 3


def test_a_pair_of_every_text_is_sent_once_for_a_piece(spark):
    found = sent(spark, [(i, "a b") for i in range(500)], np.zeros(0, np.uint64), 1000)
    assert sum(len(op5._unpack(r.payload)[3]) for r in found if r.kind == 1) == 3  # a after the start, b after a, the end after b


def test_buckets_of_partitions_and_scores_in_parts(spark, monkeypatch):
    rows = [*awkward(), *((100 + k, prose(k % 7, 60 + k)) for k in range(60))]
    for name, value in (("SPLIT_TOKENS", 50), ("PARTITION_TOKENS", 300), ("LEAST_BUCKETS", 3), ("HELD_SCORES", 500)):
        monkeypatch.setattr(op5, name, value)
    check(op5.score_texts(corpus(spark, rows).repartition(3), top_words=40).collect(), plain(rows))
