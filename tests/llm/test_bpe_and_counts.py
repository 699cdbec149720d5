"""op1 and op7 against the tokenizer library."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm.cases import awkward, corpus
from trawlmill.llm import op1_bpe, op7_token_counts


def reference():
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_exact():
    own, other = op1_bpe.tokenizer(*op1_bpe.default_vocabulary()), reference()
    rng = random.Random(5)
    letters = list("aábe  \t\n\r'stdlm0123.,!#\x1c\x1d\x1e\x1f\x85 ᠎​ 　﻿ñ漢字😀éΩжЖ\x0b\x0c")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdethe", k=rng.randint(0, 500))) for _ in range(300)] + ["a" * 5000, " " * 5000, "ab" * 3000, "<|endoftext|>"]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_query_columns(spark):
    got = op1_bpe.round_trip(corpus(spark), *op1_bpe.default_vocabulary()).collect()
    other = reference()
    want = collections.Counter()
    for i, t in awkward():
        ids = np.array(other.encode_ordinary(t or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_encode_then_decode(spark):
    names = op1_bpe.default_vocabulary()
    back = op1_bpe.decode_ids(op1_bpe.encode_texts(corpus(spark), *names), *names).collect()
    assert collections.Counter((r[0], bytes(r[1])) for r in back) == collections.Counter((i, (t or "").encode()) for i, t in awkward())
    assert op1_bpe.round_trip(corpus(spark, []), *names).collect() == []


def test_length_sums(spark):
    names = op1_bpe.default_vocabulary()
    hist = op7_token_counts.length_histogram(op7_token_counts.encoded_lengths(corpus(spark), *names))
    sums = op7_token_counts.with_suffix_sums(hist)
    n = [len(reference().encode_ordinary(t or "")) for _, t in awkward()]
    got = sums.collect()
    assert {r.n_tokens for r in got} == set(n)
    for r in got:
        longer = [x for x in n if x >= r.n_tokens]
        assert (r.docs, r.docs_at_least, r.tokens_at_least) == (n.count(r.n_tokens), len(longer), sum(longer))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in n)
        assert abs(r.share_shorter - sum(x < r.n_tokens for x in n) / len(n)) < 1e-12
    limits = {r.limit: r.tokens for r in op7_token_counts.truncated_totals(hist, [1, 100, 10**6]).collect()}
    assert limits == {x: sum(min(v, x) for v in n) for x in (1, 100, 10**6)}
    median = op7_token_counts.length_quantiles(sums, [0.5, 1.0]).collect()
    assert {r.probability: r.n_tokens for r in median} == {0.5: sorted(n)[len(n) // 2 - 1 + len(n) % 2], 1.0: max(n)}
    assert op7_token_counts.with_suffix_sums(hist.limit(0)).collect() == []
