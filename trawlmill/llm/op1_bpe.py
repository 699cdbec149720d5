"""Byte-level BPE encoding and decoding.

Method: the vocabulary's byte strings, as Latin-1 text, form an Aho-Corasick automaton that finds the tokens at each
place.  The encoder takes the longest match; when two neighbours could not both come out of the merges, it goes back to
the next shorter token there.  Whether two tokens may stand side by side is decided by undoing their merges along the
border, memoised for each pair.  A bit for each place says that no valid encoding ends there, so each place is left at
most once for each token length and the work is linear in the piece.

Rows: a null or empty text has no ids; texts of any length are cut by the pattern first and each different piece is
encoded once and kept in a bounded memo.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from trawlmill.llm.common import chunks, kept_by_worker, table, whole_text

#: Pieces kept at most; beyond it the memo starts anew.
MEMO_PIECES = 400_000
MEMO_PAIRS = 1_000_000


class Vocabulary:
    """Ranks of byte strings; the token with the lowest rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(t) for t in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.parts = {rank: self._last_merge(token) for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a token that no merge reaches stands for itself."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(self.ranks.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(ranked)
            if best >= self.ranks[token]:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        own = self.ranks[token]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (own, own)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' bytes, side by side, end in just these two tokens."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, bytes_of, ranks, parts = left, right, self.size, self.bytes_of, self.ranks, self.parts
        while True:
            merged = ranks.get(bytes_of[a] + bytes_of[b])
            if merged is not None and merged < limit:
                ok = False
                break
            # Undo the later of the two last merges: what stood at the border before it.
            if a > b:
                limit, inner = a, parts[a][1]
                if inner == a:
                    limit, inner = b + 1, parts[b][0]
                    if inner == b:
                        ok = True
                        break
                    b = inner
                    continue
                a = inner
            else:
                limit, inner = b + 1, parts[b][0]
                if inner == b:
                    limit, inner = a, parts[a][1]
                    if inner == a:
                        ok = True
                        break
                    a = inner
                    continue
                b = inner
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            starts[end + 1 - self.length[rank]].append(rank)
        # Longest last, so that pop() gives the longest that is left to try.
        for at in starts:
            at.sort(key=self.length.__getitem__)
        out: list[int] = []
        dead = bytearray(n + 1)
        place, untried = 0, [*starts[0]]
        stack: list[list[int]] = []
        while place < n:
            token = None
            while untried:
                t = untried.pop()
                if not dead[place + self.length[t]] and (not out or self.compatible(out[-1], t)):
                    token = t
                    break
            if token is not None:
                out.append(token)
                stack.append(untried)
                place += self.length[token]
                untried = [*starts[place]] if place < n else []
            else:
                dead[place] = 1  # a valid prefix encoding is unique, so no other way to this place can go on
                last = out.pop()
                place -= self.length[last]
                untried = stack.pop()
        return out


class Pieces(dict):
    """Piece of text -> its ids as little-endian 32-bit bytes; computed on first use."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        ids = np.array(self.vocabulary.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Tokenizer:
    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as lines:
            self.vocabulary = Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})
        # White space as Unicode defines it; `regex` counts four control characters more.
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.pieces = Pieces(self.vocabulary)

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def tokenizer(ranks_file: str, pattern: str) -> Tokenizer:
    """One for each Python worker and vocabulary."""
    return Tokenizer(ranks_file, pattern)


kept_by_worker(tokenizer.cache_clear)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_file, pattern)
        for batch in chunks(batches):
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, content (binary: the decoded bytes) from a table of doc_id, ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_file, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                content = [own.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids: encoding and decoding in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_file, pattern)
        for batch in chunks(batches):
            counts, ids_digest, decoded_digest, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                decoded_digest.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            more = [pa.array(kept, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(decoded_digest, pa.string()), *more],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids],
            )

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, out)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
