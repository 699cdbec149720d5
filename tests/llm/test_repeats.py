"""op2 against counting every string."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import awkward, corpus
from trawlmill.llm import op2_suffix_dedup as op2


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = collections.Counter()
    for (i, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def removed(df, *how):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return collections.Counter(map(tuple, op2.remove_repeats(df, *how).select(*cols).collect()))


def test_block_search_equals_counting():
    rng = random.Random(3)
    for length, letters in ((5, b"ab"), (8, b"ab\x00"), (20, b"abc"), (3, b"a"), (40, b"ab")):
        for _ in range(40):
            segments = [bytes(rng.choices(letters, k=rng.randint(1, 120))) for _ in range(rng.randint(1, 12))]
            base = bytes(rng.choices(letters, k=90))
            segments += [base[rng.randint(0, 30) : rng.randint(50, 90)] for _ in range(rng.randint(0, 5))]
            owner, offset, twice, first = op2.match_block(segments, length)
            seen = collections.Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
            places = {(k, i) for k, s in enumerate(segments) for i in range(len(s) - length + 1)}
            assert set(zip(owner.tolist(), offset.tolist(), strict=True)) == places
            assert {(k, i) for k, i, t in zip(owner.tolist(), offset.tolist(), twice, strict=True) if t} == {(k, i) for k, i in places if seen[segments[k][i : i + length]] > 1}
            assert first.sum() == len(seen)


def mixed(seed=5):
    rng = random.Random(seed)
    shared = "".join(rng.choices("abcdefgh é", k=90))
    rows = []
    for i in range(200):
        own = ["".join(rng.choices("abcdefgh é", k=rng.randint(0, 80))) for _ in range(2)]
        rows.append((i if i % 50 else None, own[0] + (shared[rng.randint(0, 20) : rng.randint(50, 90)] if rng.random() < 0.8 else "") + own[1]))
    return [*rows, (1000, None), (1001, ""), (1002, "ab" * 200), (1003, "x" * 500), (1004, rows[3][1]), (1004, rows[3][1])]


def test_whole_and_split_keys(spark, monkeypatch):
    rows = mixed()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(df, 30, 9, 1 << 20) == plain(rows, 30)
    assert removed(df, 30, 9, 300) == plain(rows, 30)  # the common passage's key is over many blocks
    monkeypatch.setattr(op2, "MEETING_WINDOWS", 2000)
    assert removed(df, 30, 9, 300) == plain(rows, 30)  # and their windows meet in several parts


def test_awkward_rows(spark):
    assert removed(corpus(spark), 100, 25) == plain(awkward(), 100)
    assert removed(corpus(spark, [])) == collections.Counter()


def test_stripped_rows_keep_their_columns(spark):
    df = corpus(spark)
    got = op2.strip_repeats(df, 100, 25)
    assert got.columns == df.columns and got.count() == df.count()
    assert got.where("text IS NULL").count() == 2
    assert got.where("doc_id = 1 AND text = ''").count() == 1
    assert got.where("coalesce(char_length(text), 0) <> n_chars").count() == 0


def test_runs_of_few_words_stay(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    long, short = " ".join(word(1 + i % 3) for i in range(60)), " ".join(word(9) for _ in range(30))
    own = [" ".join(word(12) for _ in range(20)) for _ in range(4)]
    rows = [(1, own[0] + " " + long + " " + own[1]), (2, own[2] + " " + long), (3, own[1] + " " + short), (4, short + " " + own[3])]
    got = {r.doc_id: r.text for r in op2.strip_repeats(corpus(spark, rows), 101, 25, words=50).collect()}
    assert long not in got[1] and long not in got[2]
    assert got[3] == rows[2][1] and got[4] == rows[3][1]  # thirty words, though of more bytes
