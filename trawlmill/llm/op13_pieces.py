"""SentencePiece encoding and decoding with byte spans of the source.

Method: the text is normalised by the longest prefix that the model's compiled character map knows (a double-array trie with
its replacements; none in an identity model), and every byte of the normalised text keeps the source byte it comes from.
The pieces are then merged by score, best first and leftmost among equals, and each piece is projected through the alignment
to its span of source bytes.  A character outside the vocabulary becomes byte pieces, of which the last one has its span.

Merges never cross a border between two characters that no piece holds side by side, so the normalised text is cut there
first and each different part is encoded once and kept in a bounded memo.  The new parts of a batch are merged side by side as arrays.

Rows: a null or empty text has no pieces; a text of blanks, control characters or one endless word is encoded whole; repeated
rows and ids give repeated results.  Extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from trawlmill.llm.common import chunks, kept_by_worker, table, whole_text

#: Parts of a generation of the memo, and the longest part that is kept.  A full generation becomes the older one, whose
#: parts are taken over as they come again, so common parts stay; two generations are held at most.
MEMO_PARTS = 750_000
MEMO_LENGTH = 64
#: Parts of up to so many characters are merged by plain search, longer ones with a heap.
SHORT_PART = 24

# Fixed values of the model format: the space symbol, and the kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


class CharacterMap:
    """Replacements of prefixes, read off a compiled map: a double-array trie and the replacements it points to."""

    def __init__(self, blob: bytes):
        self.heads: dict[str, list[tuple[str, str]]] = {}
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            units = np.frombuffer(blob, "<u4", size // 4, 4)
            replacements = blob[4 + size :]
            for key, place in self._keys(units):
                new = replacements[place : replacements.index(b"\0", place)]
                text = key.decode("utf-8")
                self.heads.setdefault(text[0], []).append((text, new.decode("utf-8")))
        for known in self.heads.values():
            known.sort(key=lambda pair: -len(pair[0]))

    @staticmethod
    def _keys(units: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """All keys of the trie with their values, by walking it from the root."""
        open_ = [(0, b"")]
        labels = np.arange(1, 256)
        while open_:
            node, key = open_.pop()
            unit = int(units[node])
            base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
            if unit >> 8 & 1:
                yield key, int(units[base]) & 0x7FFFFFFF
            children = base ^ labels
            children, own = children[children < len(units)], labels[children < len(units)]
            # a child holds its own label, and no value bit
            hit = (units[children] & 0x800000FF) == own
            open_ += [(int(c), key + bytes([int(x)])) for c, x in zip(children[hit], own[hit], strict=True)]

    def longest(self, text: str, at: int) -> tuple[str, str] | None:
        """The longest key at this place and its replacement."""
        for key, new in self.heads.get(text[at], ()):
            if text.startswith(key, at):
                return key, new
        return None


class PieceModel:
    """A merge model: pieces with scores, normalisation rules, byte fallback."""

    def __init__(self, content: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        normaliser: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for field, value in _fields(content):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
            elif field == 5 and dict(_fields(value)).get(2):
                raise ValueError("a map for the decoded text is not supported")
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge model")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.trim = bool(normaliser.get(4, 1))
        self.space = SPACE if normaliser.get(5, 1) else " "
        self.suffix = bool(trainer.get(24, 0))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_surface = trainer.get(44, " ⁇ ".encode())
        self.known = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.score_of = {p: self.scores[i] for p, i in self.known.items()}
        self.unused = {p for p, i in self.known.items() if self.kinds[i] == UNUSED}
        self.unknown = self.kinds.index(UNKNOWN)
        self.silent = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = np.zeros(len(self.pieces), np.int64)
        self.byte_of[list(self.byte_ids.values())] = list(self.byte_ids)
        if self.byte_fallback and len(self.byte_ids) != 256:
            raise ValueError("byte fallback needs a piece for each of the 256 bytes")
        own = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.symbols = regex.compile("|".join(map(regex.escape, own))) if own else None
        # Characters where the map or a symbol may apply; all others stay as they are.
        heads = {p[0] for p in own} | set(self.map.heads) | {" "}
        self.special = regex.compile("[" + "".join(map(regex.escape, sorted(heads))) + "]")
        self.neighbours = {p[i : i + 2] for p in self.known for i in range(len(p) - 1)}
        # Parts begin with the symbols of spaces that no other character precedes within a piece.
        crossed = any(b == SPACE and a != SPACE for a, b in self.neighbours)
        self.parts = None if crossed or own else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self._pairs()
        outside = (UNKNOWN, BYTE) if self.byte_fallback else (UNKNOWN,)
        self.size_of = np.array([-1 if k in outside else len(p.encode("utf-8")) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    # --- normalisation ---

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the source byte."""
        if not self.map.heads and not self.trim and self.symbols is None and self.space == SPACE:
            return self._escape(text)
        out: list[str] = []
        sizes: list[int] = []  # bytes of each normalised part
        origin: list[int] = []  # the source byte it comes from
        at = used = 0

        def put(part: str, place: int) -> None:
            out.append(part)
            sizes.append(len(part.encode("utf-8")))
            origin.append(place)

        def prefix(place: int) -> tuple[str, str]:
            found = self.symbols.match(text, place) if self.symbols else None
            if found:
                return found.group(), found.group()
            return self.map.longest(text, place) or (text[place], text[place])

        if self.trim:
            while at < len(text):
                key, new = prefix(at)
                if new != " ":
                    break
                at += len(key)
                used += len(key.encode("utf-8"))
        if at == len(text):
            return "", np.zeros(1, np.int64) + used
        if self.dummy_prefix and not self.suffix:
            put(self.space, used)
        after_space = self.trim
        while at < len(text):
            if not self.special.match(text, at):
                # characters that stay as they are, each with its own place
                stop = self.special.search(text, at)
                stop = stop.start() if stop else len(text)
                for c in text[at:stop]:
                    put(c, used)
                    used += sizes[-1]
                at, after_space = stop, False
                continue
            key, new = prefix(at)
            if after_space:
                new = new.lstrip(" ")
            if new:
                put(new.replace(" ", self.space), used)
                after_space = new.endswith(" ")
            at += len(key)
            used += len(key.encode("utf-8"))
            if not self.trim:
                after_space = False
        normalised = "".join(out)
        align = np.repeat(np.array(origin, np.int64), np.array(sizes, np.int64))
        if self.trim:
            kept = normalised.rstrip(self.space)
            if len(kept) < len(normalised):
                size = len(kept.encode("utf-8"))
                normalised, used, align = kept, int(align[size]), align[:size]
        if self.dummy_prefix and self.suffix:
            normalised += self.space
            align = np.r_[align, np.full(len(self.space.encode("utf-8")), used)]
        return normalised, np.r_[align, used]

    def _escape(self, text: str) -> tuple[str, np.ndarray]:
        """The same for an identity map: spaces become symbols of three bytes, all other bytes are their own source."""
        if not text:
            return "", np.zeros(1, np.int64)
        source = np.frombuffer(text.encode("utf-8"), np.uint8)
        align = np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1))
        normalised = text.replace(" ", SPACE)
        if self.dummy_prefix and not self.suffix:
            return SPACE + normalised, np.concatenate(([0, 0, 0], align, [len(source)]))
        if self.dummy_prefix:
            normalised, align = normalised + SPACE, np.r_[align, [len(source)] * 3]
        return normalised, np.r_[align, len(source)]

    # --- pieces ---

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, and the begin and end of their source bytes."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for each text; what is new in any of them is merged together."""
        normal = [self.normalise(x) for x in texts]
        if not self.parts:
            for normalised, align in normal:
                yield self._put_together(normalised, align, [normalised] if normalised else [])
            return
        parts = [self.parts(normalised) for normalised, _ in normal]
        memo, older = self.memo, self.older
        self._learn([x for x in dict.fromkeys(chain.from_iterable(parts)) if x not in memo and x not in older and len(x) <= MEMO_LENGTH])
        for (normalised, align), own in zip(normal, parts, strict=True):
            yield self._put_together(normalised, align, own)

    def _put_together(self, normalised: str, align: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join([self.memo.get(p) or self._part(p) for p in parts]), np.int32)
        sizes = self.size_of[ids]
        if len(sizes) and sizes.min() < 0:
            sizes = self._sizes_outside(normalised, ids, sizes)
            if not self.byte_fallback:
                # neighbouring unknown characters are one piece
                begins = np.flatnonzero(np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])
                ids, sizes = ids[begins], np.add.reduceat(sizes, begins)
        ends = np.cumsum(sizes)
        return ids, align[ends - sizes], align[ends]

    def _sizes_outside(self, normalised: str, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Normalised bytes of each piece, where some stand for characters outside the vocabulary: the last byte of one has all."""
        outside = np.flatnonzero(sizes < 0)
        sizes = np.maximum(sizes, 0)
        if self.byte_fallback:
            # a piece for each byte of such a character
            starts = np.flatnonzero(self.byte_of[ids[outside]] & 0xC0 != 0x80)
            stops = np.r_[starts[1:], len(outside)]
            sizes[outside[stops - 1]] = stops - starts
        else:
            data = normalised.encode("utf-8")
            at = np.cumsum(sizes)[outside].tolist()
            wider = 0
            for piece, place in zip(outside.tolist(), at, strict=True):
                width = 1 + sum(data[place + wider] >= least for least in (0xC0, 0xE0, 0xF0))
                sizes[piece] = width
                wider += width
        return sizes

    def _part(self, part: str) -> bytes:
        """Ids of the pieces of one part; kept for later texts."""
        return self._keep(part, self.older.get(part) or self._encoded(part))

    def _keep(self, part: str, ids: bytes) -> bytes:
        if len(part) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_PARTS:
                self.older, self.memo = self.memo, {}
            self.memo[part] = ids
        return ids

    def _pairs(self) -> None:
        """Numbers of the symbols that may meet (pieces by their ids, then other characters), and the pairs that make a piece."""
        symbols = dict(self.known)
        for c in sorted({c for piece in self.known for c in piece} - set(symbols)):
            symbols[c] = len(self.pieces) + len(symbols)
        self.number_of = symbols
        self.stranger = max([len(self.pieces) - 1, *symbols.values()]) + 1
        found = [
            (symbols[piece[:i]] * (self.stranger + 1) + symbols[piece[i:]], self.scores[number], number)
            for piece, number in self.known.items()
            for i in range(1, len(piece))
            if piece[:i] in symbols and piece[i:] in symbols
        ]
        found.sort()
        keys, scores, numbers = zip(*found, strict=True) if found else ((), (), ())
        # the last entry stands for a pair that makes none
        self.pair_keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.pair_scores = np.array([*scores, -math.inf])
        self.pair_pieces = np.array([*numbers, -1], np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs of symbols stand among the known pairs."""
        key = left * (self.stranger + 1) + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, at, len(self.pair_keys) - 1)

    def _learn(self, parts: list[str]) -> None:
        """Merge many short parts side by side, in each the best pair at a time (the leftmost among equals), and keep their ids."""
        if self.symbols is not None or self.unused or not parts:
            return
        number = self.number_of.get
        symbol = np.array([number(c, self.stranger) for c in "".join(parts)], np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        none = len(self.pair_keys) - 1
        pair = np.full(len(symbol), none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair[inner] = self._joined(symbol[inner], symbol[inner + 1])
        owners, symbols = [], []
        while len(symbol):
            score = self.pair_scores[pair]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(owner)])
            best = np.repeat(np.maximum.reduceat(score, first), size)
            open_ = best > -math.inf
            if not open_.all():
                owners.append(owner[~open_])
                symbols.append(symbol[~open_])
                symbol, owner, pair, score, best = symbol[open_], owner[open_], pair[open_], score[open_], best[open_]
            at = np.flatnonzero(score == best)
            at = at[np.r_[True, owner[at][1:] != owner[at][:-1]][: len(at)]]
            symbol[at] = self.pair_pieces[pair[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, owner, pair = symbol[stays], owner[stays], pair[stays]
            at -= np.arange(len(at))
            # the merged symbol's pairs with its neighbours
            changed = np.r_[at, at[at > 0] - 1]
            pair[changed] = none
            changed = changed[changed + 1 < len(symbol)]
            changed = changed[owner[changed] == owner[changed + 1]]
            pair[changed] = self._joined(symbol[changed], symbol[changed + 1])
        owner, symbol = np.concatenate(owners), np.concatenate(symbols)
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(parts)))
        strange = np.bincount(owner[symbol >= len(self.pieces)], minlength=len(parts)) > 0
        ids = symbol.astype(np.int32).tobytes()
        begin = 0
        for part, end, outside in zip(parts, ends.tolist(), strange.tolist(), strict=True):
            if outside:
                self._keep(part, self._with_strangers(part, symbol[begin:end].tolist()))
            else:
                self._keep(part, ids[4 * begin : 4 * end])
            begin = end

    def _with_strangers(self, part: str, symbols: list[int]) -> bytes:
        """Ids of the symbols of a part where a character outside the vocabulary becomes its bytes, or unknown."""
        out, at = [], 0
        for x in symbols:
            if x < len(self.pieces):
                out.append(x)
                at += len(self.pieces[x])
            else:
                out += map(self.byte_ids.__getitem__, part[at].encode("utf-8")) if self.byte_fallback else (self.unknown,)
                at += 1
        return array("i", out).tobytes()

    def _encoded(self, part: str) -> bytes:
        if self.symbols is None:
            pieces = self._merged(part)
        else:
            pieces, start = [], 0
            for symbol in self.symbols.finditer(part):
                pieces += [*self._merged(part[start : symbol.start()]), symbol.group()]
                start = symbol.end()
            pieces += self._merged(part[start:])
        if self.unused:
            pieces = [q for p in pieces for q in self._split_unused(p)]
        known, unknown = self.known, self.unknown
        ids = [known.get(p, unknown) for p in pieces]
        if self.byte_fallback and unknown in ids:
            ids = [n for p, i in zip(pieces, ids, strict=True) for n in (map(self.byte_ids.__getitem__, p.encode("utf-8")) if i == unknown else (i,))]
        return array("i", ids).tobytes()

    def _merged(self, text: str) -> list[str]:
        """The characters after all merges, best score first, the leftmost among equal ones."""
        if len(text) <= SHORT_PART:
            return self._by_search(list(text))
        # no merge crosses a border of characters that no piece holds side by side
        borders = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.neighbours]
        out: list[str] = []
        for i, j in zip([0, *borders], [*borders, len(text)], strict=True):
            out += self._by_search(list(text[i:j])) if j - i <= SHORT_PART else self._by_heap(list(text[i:j]))
        return out

    def _by_search(self, symbols: list[str]) -> list[str]:
        score, none = self.score_of.get, -math.inf
        parts = symbols
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def _by_heap(self, symbols: list[str]) -> list[str]:
        score_of = self.score_of
        parts = symbols
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                joined = parts[left] + parts[right]
                score = score_of.get(joined)
                if score is not None:
                    heapq.heappush(heap, (-score, left, right, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            # out of date where either side has been merged since
            if not parts[left] or not parts[right] or after[left] != right or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def _split_unused(self, piece: str) -> list[str]:
        """A piece that is out of use, as the pieces it was merged of."""
        if len(piece) == 1 or piece not in self.unused:
            return [piece]
        parts = list(piece)
        while len(parts) > 2:
            scored = [(self.score_of[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score_of]
            at = -max(scored)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [q for p in parts for q in self._split_unused(p)]

    # --- decoding ---

    def _surface(self, number: int) -> bytes:
        kind = self.kinds[number]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unknown_surface
        if kind == BYTE:
            return bytes([int(self.pieces[number][3:5], 16)])
        return self.pieces[number].replace(SPACE, " ").encode("utf-8")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; a byte that is no part of a character becomes U+FFFD."""
        out: list[bytes] = []
        first = 0
        if self.dummy_prefix or self.trim:
            # the symbol of a space before the first text is not part of it
            for first, number in enumerate(ids, 1):
                surface = self.surface[number]
                own = self.kinds[number] in (NORMAL, USER_DEFINED, UNUSED)
                stripped = own and self.pieces[number].startswith(SPACE)
                out.append(surface[1:] if stripped else surface)
                if out[-1] or (stripped and not self.trim):
                    break
        surfaces = self.surface
        out += [surfaces[number] for number in ids[first:]]
        if self.silent.isdisjoint(ids):
            return b"".join(out).decode("utf-8", "one_by_one")
        # bytes on both sides of a silent piece are no character
        stops = [i for i, number in enumerate(ids) if number in self.silent]
        return "".join(b"".join(out[i:j]).decode("utf-8", "one_by_one") for i, j in zip([0, *stops], [*stops, len(ids)], strict=True))


@lru_cache(maxsize=4)
def piece_model(model_file: str) -> PieceModel:
    """One for each Python worker and model."""
    with open(model_file, "rb") as content:
        return PieceModel(content.read())


kept_by_worker(piece_model.cache_clear)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, begins, ends (source bytes of each piece) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in chunks(batches):
            columns = list(zip(*model.encode_all(batch.column(1).to_pylist()), strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int64())
            lists = [pa.array([v.tolist() for v in column], pa.list_(kind)) for column, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "ids", "begins", "ends"])

    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text from a table of doc_id, ids; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [model.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of the source, spanned_bytes by its pieces: there and back in one pass."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spanned_bytes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        decimals = model.decimals
        for batch in chunks(batches):
            rows = []
            texts = batch.column(1).to_pylist()
            for text, (ids, begins, ends) in zip(texts, model.encode_all(texts), strict=True):
                numbers = ids.tolist()
                decoded = model.decode(numbers).encode("utf-8")
                digest = hashlib.sha256(",".join([decimals[i] for i in numbers]).encode()).hexdigest()
                spanned = int((ends - begins).sum())
                rows.append((len(numbers), digest, hashlib.sha256(decoded).hexdigest(), len(text.encode("utf-8")), spanned))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spanned_bytes long")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), default_model())
