"""Language-model scoring with Katz backoff.

Model: words are runs without ASCII white space, A-Z lowered, then one end token for each text; a text's first token has the
start as its context.  c(h, w) and c(w) are counts over the training texts.
  P(w | h) = d(c(h, w)) c(h, w) / c(h)   where c(h, w) > 0,   a(h) P(w) otherwise
  P(w)     = d(c(w)) c(w) / N            where c(w) > 0,      the mass left over otherwise (one unknown word)
d is Katz's Good-Turing discount for counts up to 5, from the counts of counts; a(h) is the exact ratio of the mass left
in h to the mass of the words not seen after h, so every P(. | h) sums to 1 (the unknown word included).  A context that
the discount leaves with less than 1 / (c(h) + 1) is scaled to leave that much, so that no text has probability 0.

How it runs: word counts are a table by word hash.  Its largest rows, TOP_WORDS at most, go to all tasks as a cache;
the other words of each text are joined with the table.  A task gathers its texts into pieces of PIECE_TOKENS.  The different
bigrams of a piece go, as compressed columns, to the partition of their context; a row of a piece holds a bucket of several
partitions, so that rows stay large while partitions grow in number with the texts.  A partition has all pieces' bigrams of
its contexts: it counts the training ones and is one row of a stored table.  From that each piece gets the scores of its
bigrams back, in their order, and adds them up by text; so a bigram is sent once for a piece, in however many texts it is.
A context with very many followers (the start, a common word) is split over several partitions by the word, and only
its sums are put together.  Counts, contexts and texts are complete; nothing is pruned.

Rows: null and empty texts have the end token only.  Repeated rows are trained on and scored each.  A null id counts as an
empty id text (remainder 0: training).  Without training texts the unknown word has probability 1.  Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.llm.common import chunks, mix, release_memory, table, text_bytes, whole_text, words_of
from trawlmill.sources.staging import discard, release_shuffles, stage

END = np.uint64(0x452821E638D01377)
START = np.uint64(0xBE5466CF34E90C6C)
#: Words whose counts every task holds.
TOP_WORDS = 250_000
#: Good-Turing discounts hold up to this count.
DISCOUNTED = 5
#: Bigrams of a partition, about.
PARTITION_TOKENS = 500_000
SPLIT_TOKENS = 500_000
MOST_SPLITS = 4096
#: Tokens of a piece of texts, about; a longer text is a piece by itself.
PIECE_TOKENS = 1 << 20
#: Partitions that share a row of a piece, at most, and the number of buckets from which on they do.
BUCKET_PARTITIONS = 8
LEAST_BUCKETS = 48
#: Scores that a task holds before they go back to their pieces.
HELD_SCORES = 2_000_000


def training(modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus != remainder


def discounts(n: np.ndarray) -> np.ndarray:
    """d for the counts 1 .. DISCOUNTED from n[r], how many types have count r (r up to DISCOUNTED + 1); 1 / (1 + 1/r) where undefined."""
    k = DISCOUNTED
    out = np.ones(k + 1)
    spare = (k + 1) * n[k + 1] / n[1] if n[1] > 0 else 1.0
    for r in range(1, k + 1):
        d = 0.0
        if n[r] > 0 and spare < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare)
        out[r] = d if 0 < d < 1 else r / (r + 1)
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)


class Unigrams:
    """P(w) from c(w)."""

    def __init__(self, tokens: int, types: int, n: np.ndarray):
        self.tokens, self.types, self.d = tokens, types, discounts(n)
        kept = sum(self.d[r] * r * n[r] for r in range(1, DISCOUNTED + 1))
        kept += tokens - sum(r * n[r] for r in range(1, DISCOUNTED + 1))
        self.scale = 1.0
        if tokens and 1 - kept / tokens < 1 / (tokens + 1):
            self.scale = (tokens / (tokens + 1)) / (kept / tokens)
        self.unknown = 1 - self.scale * kept / tokens if tokens else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.scale * discounted(counts, self.d) / max(self.tokens, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def backoff(total: np.ndarray, small: np.ndarray, large: np.ndarray, seen: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts: factor of the discounted frequencies, and a(h).

    total: c(h); small: how many followers have count 1 .. DISCOUNTED; large: sum of the larger counts; seen: P of all followers.
    """
    c = np.maximum(total, 1)
    kept = (small @ (d[1:] * np.arange(1, DISCOUNTED + 1)) + large) / c
    left = 1 - kept
    least = 1 / (c + 1)
    short = left < least
    factor = np.where(short, (1 - least) / np.maximum(kept, 1e-300), 1.0)
    a = np.where(short, least, left) / np.maximum(1 - seen, 1e-300)
    return factor, np.where(total > 0, a, 1.0)


class Cache:
    """The commonest words: hash, count and rank, and in how many parts their contexts are split."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, starts: int, tokens: int):
        """words by falling count; the start comes last."""
        words, counts = np.r_[words, START], np.r_[counts, 0].astype(np.int64)
        self.counts, self.size = counts, len(words)
        self.order = np.argsort(words).astype(np.int32)
        self.sorted = words[self.order]
        limit = max(SPLIT_TOKENS, tokens // MOST_SPLITS)
        self.parts = np.maximum(1, -(-np.r_[counts[:-1], starts] // limit)).astype(np.int32)
        self.partitions = int(max(1, -(-tokens * 6 // 5 // PARTITION_TOKENS)))
        self.together = min(BUCKET_PARTITIONS, max(1, self.partitions // LEAST_BUCKETS))
        self.buckets = -(-self.partitions // self.together)

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 if it isn't here."""
        at = np.searchsorted(self.sorted, words)
        at[at == self.size] = 0
        return np.where(self.sorted[at] == words, self.order[at].astype(np.int64), -1)

    @property
    def words(self) -> np.ndarray:
        """By falling count, the start last."""
        out = np.empty_like(self.sorted)
        out[self.order] = self.sorted
        return out

    def partition(self, context: np.ndarray, context_rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        parts = np.where(context_rank >= 0, self.parts[context_rank], 1).astype(np.uint64)
        return (mix(context + (mix(word) % parts) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(self.partitions)).astype(np.int64)


def sequences(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with the ends, the token before each (the start first), the row of each, tokens per row."""
    data, at = text_bytes(batch.column(column))
    words, row, count = words_of(data, at)
    size = count + 1
    token = np.empty(len(words) + len(count), np.uint64)
    token[np.arange(len(words)) + row] = words
    stop = np.cumsum(size)
    token[stop - 1] = END
    before = np.r_[START, token[:-1]]
    before[stop - size] = START
    return token, before, np.repeat(np.arange(len(count)), size), size


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 32- or 64-bit numbers, byte by byte, compressed."""
    parts = [np.array([len(columns), *(x for c in columns for x in (len(c), c.dtype.itemsize))], "<i8").tobytes()]
    parts += [c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for length, width in sizes.reshape(n, 2).tolist():
        flat = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length).T
        out.append(np.array(flat, order="C").view(np.uint32 if width == 4 else np.uint64).reshape(-1))
        at += length * width
    return out


def _by_number(numbers: np.ndarray, below: int) -> np.ndarray:
    """Places of the numbers (all under `below`) in their order, equal ones as they stand."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different rows of the columns (none negative) in order, and how often each is there."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) <= 64:  # one number holds a row
        key = np.zeros(len(columns[0]), np.uint64)
        for c, b in zip(columns, bits, strict=True):
            key = (key << np.uint64(b)) | c.astype(np.uint64)
        key.sort()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
        times, key, out = np.diff(np.r_[new, len(key)]), key[new], []
        for b in reversed(bits):
            out.append((key & np.uint64((1 << b) - 1)).astype(np.int64))
            key = key >> np.uint64(b)
        return (*reversed(out), times)
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    differs = np.zeros(len(order), bool)
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    differs[:1] = True
    new = np.flatnonzero(differs)
    return (*(c[new] for c in columns), np.diff(np.r_[new, len(order)]))


def word_counts(texts: DataFrame) -> DataFrame:
    """w, c over the training texts (columns text, train)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w, at = np.unique(np.concatenate(words), return_inverse=True)
            return w, np.bincount(at, np.concatenate(counts), minlength=len(w)).astype(np.int64)

        for batch in chunks(batches):
            w, c = np.unique(sequences(batch, 0)[0], return_counts=True)
            words.append(w)
            counts.append(c)
            held += len(w)
            if held > 1_000_000:
                w, c = merged()
                words, counts, held = [w], [c], len(w)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])
                    words, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        w, c = merged()
        if len(w):
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])

    return texts.where("train").select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def rare_words(texts: DataFrame, cache) -> DataFrame:
    """w, p (bucket of the bigrams it ends): words that the cache doesn't hold, each once for a batch of texts and bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        top = cache.value
        for batch in chunks(batches):
            token, before, _, _ = sequences(batch, 0)
            at = np.flatnonzero(top.rank(token) < 0)
            w, h = token[at], before[at]
            p = top.partition(h, top.rank(h), w) // top.together
            order = np.lexsort((p, w))
            w, p = w[order], p[order]
            new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])])[: len(w)]
            yield pa.RecordBatch.from_arrays([pa.array(w[new].view(np.int64)), pa.array(p[new].astype(np.int32))], names=["w", "p"])

    return texts.select("text").mapInArrow(run, "w long, p int")


def common_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts, by falling count, of all words whose count reaches a bound that at most `most` words reach."""
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = sorted(words.groupBy(step.alias("s")).agg(F.count("*"), F.min("c")).collect(), reverse=True)  # at most 16 x 63 rows
    bound, held = None, 0
    for _, n, least in steps:
        held += n
        if held > most:
            break
        bound = least
    if bound is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = words.where(F.col("c") >= bound).toArrow()
    w, c = found["w"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.lexsort((w, -c))
    return w[order], c[order]


INFO = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("train", "<i8"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8")])
PIECES = "p int, kind int, chunk long, payload binary"


class Piece:
    """Texts of one task: their tokens and contexts as ranks in the cache, or numbers from its size on of words it doesn't hold."""

    def __init__(self, top: Cache):
        self.top, self.tokens, self.texts, self.odd_words = top, 0, 0, 0
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.odd: list[np.ndarray] = []
        self.info: list[np.ndarray] = []

    def add(self, token: np.ndarray, row: np.ndarray, size: np.ndarray, info: np.ndarray, unigrams: Unigrams) -> None:
        top = self.top
        w = top.rank(token)
        common = w >= 0
        count = top.counts[w[common]]
        info["known"] = np.bincount(row[common], count > 0, minlength=len(size))
        info["base"] = np.bincount(row[common], unigrams.base(count), minlength=len(size))
        odd, number = np.unique(token[~common], return_inverse=True)
        w[~common] = top.size + self.odd_words + number
        h = np.r_[0, w[:-1]]
        h[np.cumsum(size) - size] = top.size - 1  # the start
        self.columns.append((h.astype(np.uint32), w.astype(np.uint32), (row + self.texts).astype(np.uint32)))
        self.odd.append(odd)
        self.info.append(info)
        self.tokens, self.texts, self.odd_words = self.tokens + len(token), self.texts + len(size), self.odd_words + len(odd)

    def rows(self, chunk: int) -> pa.RecordBatch:
        top = self.top
        h, w, row = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        odd, number = np.unique(np.concatenate(self.odd), return_inverse=True)
        for ids in (h, w):
            out = ids >= top.size
            ids[out] = top.size + number[ids[out] - top.size]
        self.columns, self.odd = [], []
        h, w, row, times = _grouped(h, w, row)
        info = np.concatenate(self.info)
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        trained = np.add.reduceat(times * info["train"][row], new)
        each = np.diff(np.r_[new, len(row)])
        h, w = h[new], w[new]
        hashes = np.r_[top.words, odd]
        q = top.partition(hashes[h], np.where(h < top.size, h, -1), hashes[w])
        order = _by_number(q, top.partitions)
        q, h, w, trained, each, new = (x[order] for x in (q, h, w, trained, each, new))
        at = np.repeat(new - (np.cumsum(each) - each), each) + np.arange(len(row))
        row, times = row[at].astype(np.uint32), times[at].astype(np.uint32)
        p = q // top.together
        begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        payloads = []
        for a, b in zip(begin, np.r_[begin[1:], len(p)], strict=True):
            hp, wp, qp = h[a:b].copy(), w[a:b].copy(), q[a:b]
            own = np.unique(np.r_[hp[hp >= top.size], wp[wp >= top.size]])
            for ids in (hp, wp):
                out = ids >= top.size
                ids[out] = top.size + np.searchsorted(own, ids[out])
            edge = np.flatnonzero(np.r_[True, qp[1:] != qp[:-1]])
            columns = (qp[edge], np.diff(np.r_[edge, len(qp)]), np.diff(hp, prepend=0), wp, trained[a:b])
            payloads.append(_pack(*(c.astype(np.uint32) for c in columns), odd[own - top.size]))
        strange = np.diff(np.flatnonzero(w >= top.size), prepend=0)
        payloads.append(_pack(info.view(np.uint64), each.astype(np.uint32), row, times, strange.astype(np.uint32)))
        kinds = np.r_[np.ones(len(begin), np.int32), 2].astype(np.int32)
        home = mix(np.array([chunk], np.uint64)) % np.uint64(top.buckets)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[p[begin], home.astype(np.int64)].astype(np.int32)), pa.array(kinds), pa.array(np.full(len(kinds), chunk, np.int64)), pa.array(payloads, pa.binary())],
            names=["p", "kind", "chunk", "payload"],
        )


def bigram_pieces(texts: DataFrame, cache, unigrams: Unigrams) -> DataFrame:
    """Rows of two kinds: 1: the bigrams of a piece for one bucket; 2: its texts, with the cached words' part of the base score, and which of them have each bigram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        top = cache.value
        chunk, piece = TaskContext.get().partitionId() << 32, Piece(top)
        for batch in chunks(batches):
            token, _, row, size = sequences(batch, 2)
            info = np.zeros(batch.num_rows, INFO)
            doc = batch.column(0)
            info["null"] = doc.is_null().to_numpy(zero_copy_only=False)
            info["doc_id"] = doc.fill_null(0).to_numpy()
            info["train"], info["tokens"] = batch.column(1).to_numpy(zero_copy_only=False), size
            if piece.tokens and piece.tokens + len(token) > PIECE_TOKENS:
                yield piece.rows(chunk)
                chunk, piece = chunk + 1, Piece(top)
            piece.add(token, row, size, info, unigrams)
        if piece.tokens:
            yield piece.rows(chunk)

    return texts.select("doc_id", "train", "text").mapInArrow(run, PIECES)


class Bigrams:
    """All bigrams of one partition, by context: their counts and their words' (0 in training: held out only), and the pieces that have them."""

    def __init__(self, each: np.ndarray, piece: np.ndarray, count: np.ndarray, word_count: np.ndarray, strange: np.ndarray, followers: np.ndarray):
        self.each, self.piece, self.count, self.word_count, self.strange = each, piece, count, word_count, strange
        self.context_of = np.repeat(np.arange(len(followers)), followers)
        self.contexts, self.followers = len(followers), followers

    def sums(self, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each context: c(h), followers with small counts, sum of the larger ones, P of all followers."""
        n = self.contexts
        total = np.bincount(self.context_of, self.count, minlength=n)
        small = np.stack([np.bincount(self.context_of[self.count == r], minlength=n) for r in range(1, DISCOUNTED + 1)], axis=1)
        large = np.bincount(self.context_of, np.where(self.count > DISCOUNTED, self.count, 0), minlength=n)
        seen = np.bincount(self.context_of, np.where(self.count > 0, unigrams.p(self.word_count), 0), minlength=n)
        return total, small, large, seen

    def packed(self, chunk: np.ndarray, cut: np.ndarray, cut_h: np.ndarray) -> bytes:
        """With the pieces' own numbers, and the places and hashes of the contexts that are split."""
        words = self.word_count.astype(np.uint64) << np.uint64(1) | self.strange.astype(np.uint64)
        each, piece, followers, cut = (x.astype(np.uint32) for x in (self.each, self.piece, self.followers, cut))
        return _pack(each, piece, self.count.astype(np.uint64), words, followers, chunk.view(np.uint64), cut, cut_h)

    @classmethod
    def unpacked(cls, packed: bytes) -> tuple[Bigrams, np.ndarray, np.ndarray, np.ndarray]:
        each, piece, count, words, followers, chunk, cut, cut_h = _unpack(packed)
        strange = (words & np.uint64(1)).astype(bool)
        return cls(each, piece, count.astype(np.int64), (words >> np.uint64(1)).astype(np.int64), strange, followers), chunk.view(np.int64), cut, cut_h


def partitions_of(top: Cache, pieces: list[bytes], rare_w: np.ndarray, rare_c: np.ndarray) -> Iterator[tuple[int, Bigrams, np.ndarray, np.ndarray]]:
    """For each partition of a bucket: its number, its bigrams, and hash and rank (-1 if it isn't cached) of each context."""
    parts: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
    lists, shift = [], 0
    for i, payload in enumerate(pieces):
        number, n, step, w, c, odd = _unpack(payload)
        h = np.cumsum(step, dtype=np.uint32)
        for ids in (h, w):
            ids[ids >= top.size] += np.uint32(shift)
        lists.append(odd)
        shift += len(odd)
        stop = np.cumsum(n).tolist()
        for q, a, b in zip(number.tolist(), [0, *stop], stop, strict=False):
            parts.setdefault(q, []).append((i, h[a:b], w[a:b], c[a:b]))
    # Words that aren't cached get one number each for the whole bucket, in the order that each piece has them in.
    strange, number = np.unique(np.concatenate(lists), return_inverse=True)
    hashes = np.r_[top.words, strange]
    counts = np.zeros(len(strange), np.int64)
    if len(rare_w) and len(strange):
        by = np.argsort(rare_w)
        rare_w, rare_c = rare_w[by], rare_c[by]
        found = np.minimum(np.searchsorted(rare_w, strange), len(rare_w) - 1)
        counts = np.where(rare_w[found] == strange, rare_c[found], 0)
    counts = np.r_[top.counts, counts]
    for q in sorted(parts):
        own = parts.pop(q)
        h, w, c = (np.concatenate([x[k] for x in own]).astype(np.int64) for k in (1, 2, 3))
        piece = np.repeat(np.array([x[0] for x in own], np.uint32), [len(x[1]) for x in own])
        for ids in (h, w):
            out = ids >= top.size
            ids[out] = top.size + number[ids[out] - top.size]
        key = h << 32 | w
        order = np.argsort(key)
        key, piece, c = key[order], piece[order], c[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        h, w = key[new] >> 32, key[new] & 0xFFFFFFFF
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        bigrams = Bigrams(np.diff(np.r_[new, len(key)]), piece, np.add.reduceat(c, new), counts[w], w >= top.size, np.diff(np.r_[first, len(h)]))
        yield q, bigrams, hashes[h[first]], np.where(h[first] < top.size, h[first], -1)


TABLE = "p int, q int, bigrams binary, chunk long, texts binary, n array<long>, split array<struct<h:long,sums:array<double>>>"


def bigram_table(pieces: DataFrame, cache, unigrams: Unigrams) -> DataFrame:
    """From rows (p, kind, chunk, payload, w, c): one for each partition q with its bigrams, counts of counts, and sums of split contexts; and one for each piece with its texts."""
    schema = pa.schema([
        ("p", pa.int32()), ("q", pa.int32()), ("bigrams", pa.binary()), ("chunk", pa.int64()), ("texts", pa.binary()), ("n", pa.list_(pa.int64())),
        ("split", pa.list_(pa.struct([("h", pa.int64()), ("sums", pa.list_(pa.float64()))]))),
    ])

    def rows_of(p: int, rare: list[pa.RecordBatch], held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        top = cache.value
        rare_w = np.concatenate([b.column("w").to_numpy() for b in rare]).view(np.uint64)
        rare_c = np.concatenate([b.column("c").to_numpy() for b in rare])
        chunk = np.array([c for c, _ in held], np.int64)
        for q, bigrams, h, rank in partitions_of(top, [x for _, x in held], rare_w, rare_c):
            n, split = np.bincount(bigrams.count[bigrams.count <= DISCOUNTED + 1], minlength=DISCOUNTED + 2), []
            cut = np.flatnonzero((rank >= 0) & (top.parts[rank] > 1))
            if len(cut):
                total, small, large, seen = bigrams.sums(unigrams)
                split = [{"h": int(h[i].view(np.int64)), "sums": [float(total[i]), *map(float, small[i]), float(large[i]), float(seen[i])]} for i in cut]
            row = {"p": p, "q": q, "bigrams": bigrams.packed(chunk, cut, h[cut]), "chunk": None, "texts": None, "n": n.tolist(), "split": split}
            yield pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        now, rare, held = None, [], []
        for batch in batches:
            p = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)] if len(p) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if p[a] != now:
                    if held:
                        yield from rows_of(now, rare, held)
                    now, rare, held = int(p[a]), [], []
                own = batch.slice(a, b - a)
                kinds = own.column(1).to_numpy()
                rare.append(own.filter(pa.array(kinds == 0)).select(["w", "c"]))
                some = own.filter(pa.array(kinds == 1))
                held.extend(zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True))
                some = own.filter(pa.array(kinds == 2))
                for chunk, texts in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    row = {"p": now, "q": None, "bigrams": None, "chunk": chunk, "texts": texts, "n": None, "split": None}
                    yield pa.RecordBatch.from_pylist([row], schema)
        if held:
            yield from rows_of(now, rare, held)

    return pieces.select("p", "kind", "chunk", "payload", "w", "c").mapInArrow(run, TABLE)


def bigram_scores(model: DataFrame, unigrams: Unigrams, d: np.ndarray, split: dict[int, tuple[float, float, float]]) -> DataFrame:
    """chunk, q, scores (binary): for a piece and partitions from q on, the score of each of its bigrams and the count of each last word that isn't cached, in the piece's order."""
    split_h = np.array(sorted(split), np.uint64)
    split_values = np.array([split[int(h)] for h in split_h]).reshape(-1, 3)

    def logs(bigrams: Bigrams, cut: np.ndarray, cut_h: np.ndarray) -> np.ndarray:
        total, small, large, seen = bigrams.sums(unigrams)
        factor, a = backoff(total, small, large, seen, d)
        for k, x in enumerate((total, factor, a)):
            x[cut] = split_values[np.searchsorted(split_h, cut_h), k]
        h = bigrams.context_of
        seen_p = factor[h] * discounted(bigrams.count, d) / np.maximum(total[h], 1)
        return np.log10(np.where(bigrams.count > 0, seen_p, a[h] * unigrams.p(bigrams.word_count)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held, size, now, first, last = [], 0, None, 0, 0
        numbers: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            number, score, odd_number, count = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            places = np.arange(len(numbers) + 1)
            order = _by_number(number, len(numbers))
            score, edges = score[order], np.searchsorted(number[order], places)
            order = _by_number(odd_number, len(numbers))
            count, at = count[order], np.searchsorted(odd_number[order], places)
            scores = [_pack(score[a:b].view(np.uint64), count[i:j].view(np.uint64)) for a, b, i, j in zip(edges[:-1], edges[1:], at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([*numbers], pa.int64()), pa.array(np.full(len(scores), first, np.int32)), pa.array(scores, pa.binary())], names=["chunk", "q", "scores"])

        for batch in batches:
            for i in range(batch.num_rows):
                p, q = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if held and (p != now or q <= last or size > HELD_SCORES):
                    yield out()
                    size, numbers = 0, {}
                if not held:
                    now, first = p, q
                last = q
                bigrams, chunk, cut, cut_h = Bigrams.unpacked(batch.column(2)[i].as_py())
                number = np.array([numbers.setdefault(c, len(numbers)) for c in chunk.tolist()], np.uint32)[bigrams.piece]
                odd = np.flatnonzero(np.repeat(bigrams.strange, bigrams.each))
                count = np.repeat(bigrams.word_count[bigrams.strange], bigrams.each[bigrams.strange])
                held.append((number, np.repeat(logs(bigrams, cut, cut_h), bigrams.each), number[odd], count))
                size += len(number)
        if held:
            yield out()

    return model.where("bigrams is not null").select("p", "q", "bigrams").mapInArrow(run, "chunk long, q int, scores binary")


def text_scores(scores: DataFrame, model: DataFrame, unigrams: Unigrams) -> DataFrame:
    """A row for each text: its columns of INFO and the whole score."""
    texts = model.where("texts is not null").select("chunk", F.lit(-1).alias("q"), F.col("texts").alias("payload"))
    rows = texts.union(scores.select("chunk", "q", "scores"))

    def scored(texts: bytes, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
        info, each, row, times, strange = _unpack(texts)
        info, row, strange = info.view(INFO), row.astype(np.int64), np.cumsum(strange, dtype=np.int64)
        score, count = (np.concatenate(c) for c in zip(*(_unpack(x) for _, x in sorted(parts)), strict=True))
        count = count.view(np.int64)
        base, known = np.zeros((2, len(each)))
        base[strange], known[strange] = unigrams.base(count), count > 0
        score, base, known = (np.bincount(row, np.repeat(x, each) * times, minlength=len(info)) for x in (score.view(np.float64), base, known))
        doc = pa.array(info["doc_id"], mask=info["null"] != 0)
        columns = (info["train"], info["tokens"], info["known"] + known.astype(np.int64), info["base"] + base, score)
        return pa.RecordBatch.from_arrays([doc, *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["doc_id", "train", "tokens", "known", "base", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        now, texts, parts = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, q, payload = (c[i].as_py() for c in batch.columns)
                if chunk != now:
                    if texts is not None:
                        yield scored(texts, parts)
                    now, texts, parts = chunk, None, []
                if q < 0:
                    texts = payload
                else:
                    parts.append((q, payload))
        if texts is not None:
            yield scored(texts, parts)

    schema = "doc_id long, train long, tokens long, known long, base double, score double"
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, schema)


def score_texts(docs: DataFrame, train: Column | None = None, top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; `train` marks the training rows."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("train", train if train is not None else training())
    words = stage(word_counts(texts), "words")
    end = F.max(F.when(F.col("w") == int(END.view(np.int64)), F.col("c")))
    tokens, types, starts = (int(x or 0) for x in words.agg(F.sum("c"), F.count("*"), end).first())
    n = np.zeros(DISCOUNTED + 2, np.int64)
    for r, k in words.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").count().collect():  # at most 6 rows
        n[r] = k
    unigrams = Unigrams(tokens, types, n)
    cache = spark.sparkContext.broadcast(Cache(*common_words(words, top_words), starts, tokens))
    no_payload = [F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("payload")]
    resolved = rare_words(texts, cache).join(words, "w").select("p", "w", "c").distinct().select("p", *no_payload, "w", "c")
    pieces = bigram_pieces(texts, cache, unigrams).select("p", "kind", "chunk", "payload", F.lit(None).cast("long").alias("w"), F.lit(None).cast("long").alias("c"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = stage(bigram_table(pieces.union(resolved).repartition(tasks, "p").sortWithinPartitions("p", "kind"), cache, unigrams), "bigrams")
    # nothing below needs the cache, the word counts or what was dealt out for the table
    cache.destroy()
    discard(words)
    del words, resolved, pieces
    release_shuffles(spark)
    counts = model.agg(*[F.sum(F.col("n")[r]) for r in range(DISCOUNTED + 2)]).first()
    d = discounts(np.array([int(x or 0) for x in counts]))
    cut = model.select(F.explode("split").alias("s")).groupBy("s.h").agg(*[F.sum(F.col("s.sums")[k]).alias(f"k{k}") for k in range(DISCOUNTED + 3)])
    split = {}
    for h, total, *small, large, seen in cut.collect():  # at most MOST_SPLITS contexts and the start
        factor, a = backoff(np.array([total]), np.array([small]), np.array([large]), np.array([seen]), d)
        split[int(np.int64(h).view(np.uint64))] = (total, float(factor[0]), float(a[0]))
    return text_scores(bigram_scores(model, unigrams, d, split), model, unigrams).select(
        "doc_id", (F.col("train") == 0).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
