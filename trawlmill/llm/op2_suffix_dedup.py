"""Removal of repeated byte strings with a Burrows-Wheeler transform.

Contract: a byte is removed when it is covered by a string of MIN_BYTES bytes that also starts anywhere else in the
corpus, the same text included; strings do not cross texts and are judged on the input.

Method, where the repeats are decided (`repeated_starts`): the Burrows-Wheeler transform of a block of segments is
extended backward breadth-first.  All intervals of strings of length l are extended by the byte before them; a child
interval whose right end is new has a common prefix of l with what follows, so common prefixes come up by increasing value.
The search stops at MIN_BYTES: rows that no boundary parts by then share MIN_BYTES bytes.

How blocks are made, so that nothing is lost and no task holds the corpus: every MIN_BYTES window has a key, the least hash
of the GRAM-byte strings in it; equal windows have equal keys.  Consecutive windows with one key form a segment.  Keys
that occur once anywhere are dropped; segments of the others are cut from the texts, equal ones put together (a
segment that is there twice is repeated as a whole), and a block holds all segments of its keys.  A key with more than
BLOCK_BYTES of different segments (a passage in very many different contexts) is split over blocks; the windows of a
split block then meet by their 128-bit digests, one for each kind and block, packed by digest.

Rows: null and empty texts and texts under MIN_BYTES bytes lose nothing.  Repeated rows are copies of each other.  Byte
lists of a text are bounded by its length.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.llm.common import BASE, BASE_INVERSE, BYTE_VALUES, chunks, fresh_names, mix, powers, release_memory, row_key_names, table, text_bytes, texts_with_key, with_row_key
from trawlmill.sources.staging import discard, stage

MIN_BYTES = 400
GRAM = 100
#: Bytes of segments that a task sorts at a time.
BLOCK_BYTES = 1 << 19
#: Windows of split keys that meet in a task, about.
MEETING_WINDOWS = 1_000_000


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on."""
    n = len(data)
    values = BYTE_VALUES[data]
    values *= powers(n, BASE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mix((total[gram:] - total[:-gram]) * powers(n, BASE_INVERSE)[: n - gram + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values, from prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def window_runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: row, first byte in the row, windows, key, and whether the key's string is there twice."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none.view(np.uint64), none.astype(bool)
    grams = gram_hashes(data, gram)
    width = length - gram + 1
    least = sliding_min(grams, width)
    start = np.arange(len(least))
    row = np.searchsorted(at, start, side="right") - 1
    ok = start + length <= at[row + 1]
    start, row, key = start[ok], row[ok], least[ok]
    if not len(start):
        return none, none, none, none.view(np.uint64), none.astype(bool)
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    windows = np.diff(np.r_[first, len(start)])
    key, row, begin = key[first], row[first], start[first]
    # Places of the keys' own strings, to see a string that comes back within one run.
    known, rank = np.unique(key, return_inverse=True)
    found = np.searchsorted(known, grams)
    found[found == len(known)] = 0
    place = np.flatnonzero(known[found] == grams)
    spots = np.sort(found[place] * np.int64(n + 1) + place)
    low = np.searchsorted(spots, rank * np.int64(n + 1) + begin)
    high = np.searchsorted(spots, rank * np.int64(n + 1) + begin + windows + width - 1)
    return row, begin - at[row], windows, key, high - low > 1


def sorted_suffixes(symbols: np.ndarray, separators: int, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least, by prefix doubling; symbol < separators: a unique end."""
    n = len(symbols)
    code = np.where(symbols < separators, 0, symbols - separators + 1).astype(np.int64)
    packed, ends = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(7):
        packed <<= 9
        packed[: n - k] |= code[k:]
        ends[: n - k] |= code[k:] == 0
        if k:
            # Nothing after an end counts.
            packed[: n - k] &= ~np.where(closed[: n - k], np.int64(511), np.int64(0))
        closed = ends.copy()
    order = np.argsort(packed, kind="stable")
    key = packed[order]
    new = np.r_[True, (key[1:] != key[:-1]) | ends[order][1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    h = 7
    while h < depth and not new.all():
        # Only suffixes that still share their rank are sorted again.
        tied = ~(new & np.r_[new[1:], True])
        rows = np.flatnonzero(tied)
        who = order[rows]
        after = np.full(len(who), -1, np.int64)
        inside = who + h < n
        after[inside] = rank[who[inside] + h]
        key = rank[who] * np.int64(n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        order[rows] = who[by]
        key = key[by]
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[rows] |= fresh
        rank[order] = np.cumsum(new) - 1
        h *= 2
    return order


def repeated_starts(symbols: np.ndarray, separators: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each row whether a boundary (a common prefix under `length` with the row before) is there.

    Intervals of strings one byte longer are found from the first and last rows of each byte in an interval of the
    transform.  Every boundary is set once, so all extensions together are linear in the rows.
    """
    n = len(symbols)
    order = sorted_suffixes(symbols, separators, length)
    transform = symbols[order - 1]  # the text ends with a separator, which stands before its first byte
    by_symbol = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)
    same = transform[by_symbol][1:] == transform[by_symbol][:-1]
    following, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    head = symbols[order]
    boundary = np.ones(n + 1, bool)
    boundary[1:n] = head[1:] != head[:-1]
    high = np.flatnonzero(boundary)[1:]
    low = np.r_[0, high[:-1]]
    low, high = low[high < n], high[high < n]
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        last = following[rows] >= high[owner]
        first = before[rows] < low[owner]
        # Intervals of one length do not overlap, so their ends pair up in order.
        begin, end = np.sort(back[rows[first]]), np.sort(back[rows[last]]) + 1
        new = ~boundary[end]
        low, high = begin[new], end[new]
        boundary[high] = True
    return order, boundary[:n]


def match_block(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the segments: segment, offset, whether it is there twice, whether it is the first of its kind."""
    sizes = np.array([len(s) for s in segments])
    separators = len(segments)
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.empty(int(ends[-1]) + 1, np.int32)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int32) + separators
    symbols[ends] = np.arange(separators)
    order, boundary = repeated_starts(symbols, separators, length)
    alone = boundary & np.r_[boundary[1:], True]
    owner = np.searchsorted(ends, order)
    offset = order - (ends - sizes)[owner]
    whole = offset + length <= sizes[owner]
    return owner[whole], offset[whole], ~alone[whole], boundary[whole]


MARKS = "digest binary, at int, n int, part int, windows binary"
#: A kind of window of a split block: its digest, the segment's number in the block, its place there, whether it has a partner in the block.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("segment", "<u4"), ("at", "<u4"), ("partner", "u1")])


def _run_rows(digests: list[bytes], owner: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each run of neighbouring windows."""
    by = np.lexsort((offset, owner))
    o, f = owner[by], offset[by]
    if len(o):
        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (f[1:] != f[:-1] + 1)])
        none = [None] * len(new)
        columns = ([digests[i] for i in o[new]], f[new].tolist(), np.diff(np.r_[new, len(o)]).tolist(), none, none)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _MARK_TYPES, strict=True)], names=_MARK_NAMES)


_MARK_TYPES = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_MARK_NAMES = ["digest", "at", "n", "part", "windows"]


def _block_marks(digests: list[bytes], segments: list[bytes], split: bool, length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows; for a split key also, for each part by digest, its kinds of windows and the segments' digests."""
    owner, offset, twice, first = match_block(segments, length)
    yield from _run_rows(digests, owner[twice], offset[twice])
    if not split:
        return
    windows = np.empty(int(first.sum()), WINDOW)
    windows["segment"], windows["at"], windows["partner"] = owner[first], offset[first], twice[first]
    hashed = (hashlib.blake2b(segments[i][k : k + length], digest_size=16).digest() for i, k in zip(owner[first].tolist(), offset[first].tolist(), strict=True))
    both = np.frombuffer(b"".join(hashed), "<u8").reshape(-1, 2)
    windows["a"], windows["b"] = both[:, 0], both[:, 1]
    part = both[:, 0] % np.uint64(parts)
    names = b"".join(digests)
    for k in np.unique(part).tolist():
        own = windows[part == k]
        blob = len(digests).to_bytes(8, "little") + names + own.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, k, blob), _MARK_TYPES, strict=True)], names=_MARK_NAMES)


def _meet(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that had no partner in their block but have one in another; a block sends a kind once."""
    digests, windows, shift = [], [], 0
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        digests += [blob[8 + 16 * i : 24 + 16 * i] for i in range(n)]
        own = np.frombuffer(blob, WINDOW, offset=8 + 16 * n).copy()
        own["segment"] += np.uint32(shift)
        shift += n
        windows.append(own)
    w = np.concatenate(windows)
    w = w[np.lexsort((w["b"], w["a"]))]
    same = (w["a"][1:] == w["a"][:-1]) & (w["b"][1:] == w["b"][:-1])
    late = (np.r_[False, same] | np.r_[same, False]) & (w["partner"] == 0)
    yield from _run_rows(digests, w["segment"][late].astype(np.int64), w["at"][late].astype(np.int64))


def _meetings(marks: DataFrame) -> DataFrame:
    """Late runs from the rows (part, windows), sorted by part within partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and blobs:
                    yield from _meet(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield from _meet(blobs)

    return marks.select("part", "windows").mapInArrow(run, MARKS)


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in chunks(batches, limit=1 << 17):
            data, at = text_bytes(batch.column(2))
            row, begin, windows, key, again = window_runs(data, at, length, gram)
            if len(row):
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(begin.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(again)],
                    names=["row_id", "row_hash", "at", "n", "key", "again"],
                )

    return docs.select("row_id", "row_hash", "text").mapInArrow(run, "row_id long, row_hash long, at int, n int, key long, again boolean")


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """The runs of each text cut out: row_id, row_hash, at, n, key, again, digest, segment (null where the task has sent it before)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        sent: set[bytes] = set()
        for batch in chunks(batches, limit=1 << 17):
            out: dict[str, list] = {c: [] for c in ("row", "at", "n", "key", "again", "digest", "segment")}
            for i, (text, runs) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for r in runs:
                    segment = text[r["at"] : r["at"] + r["n"] + length - 1]
                    digest = hashlib.blake2b(segment, digest_size=16).digest()
                    for c, v in (("row", i), ("at", r["at"]), ("n", r["n"]), ("key", r["key"]), ("again", r["again"]), ("digest", digest), ("segment", None if digest in sent else segment)):
                        out[c].append(v)
                    sent.add(digest)
            own = batch.take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(out["at"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["key"], pa.int64()),
                 pa.array(out["again"], pa.bool_()), pa.array(out["digest"], pa.binary()), pa.array(out["segment"], pa.binary())],
                names=["row_id", "row_hash", "at", "n", "key", "again", "digest", "segment"],
            )

    return texts.select("row_id", "row_hash", "text", "runs").mapInArrow(
        run, "row_id long, row_hash long, at int, n int, key long, again boolean, digest binary, segment binary"
    )


def _match(blocks: DataFrame, length: int, block_bytes: int, parts: int) -> DataFrame:
    """Marks from rows (key, salt, split, digest, segment) that are sorted by key and salt within partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        digests: dict[bytes, bytes] = {}
        group, size, split = None, 0, False
        for batch in batches:
            for key, salt, hot, digest, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, salt) != group and digests and (hot or split or size >= block_bytes):
                    yield from _block_marks([*digests], [*digests.values()], split, length, parts)
                    digests, size = {}, 0
                group, split = (key, salt), hot
                if digest not in digests:
                    digests[digest] = segment
                    size += len(segment)
        if digests:
            yield from _block_marks([*digests], [*digests.values()], split, length, parts)

    return blocks.select("key", "salt", "split", "digest", "segment").mapInArrow(run, MARKS)


def repeated_ranges(docs: DataFrame, length: int = MIN_BYTES, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row_id, row_hash, ranges (array of (at, n): n windows from byte `at` on are repeated) for texts that hold a repeat."""
    texts = texts_with_key(docs)
    runs = stage(_runs(texts, length, gram), "runs")
    often = runs.groupBy("key").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("often")).where("often > 1").select("key")
    wanted = runs.join(often, "key").groupBy("row_id", "row_hash").agg(F.collect_set(F.struct("at", "n", "key", "again")).alias("runs"))
    cut = stage(_segments(texts.join(wanted, ["row_id", "row_hash"]), length), "segments")
    discard(runs)
    spots = cut.drop("segment")
    kinds = spots.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.max("again").alias("again"))
    kinds = stage(kinds, "kinds")
    keys = kinds.groupBy("key").agg(F.count("*").alias("different"), F.max("again").alias("again"), F.sum(F.col("n") + length - 1).alias("bytes"))
    keys = keys.where("different > 1 OR again").select("key", "bytes", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    blocks = cut.where("segment IS NOT NULL").select("key", "digest", "segment").join(keys, "key")
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("digest"), "blocks").cast("int")).withColumn("split", F.col("blocks") > 1)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split_bytes = keys.where("blocks > 1").agg(F.sum("bytes")).first()[0] or 0
    parts = int(split_bytes // MEETING_WINDOWS + 1)
    marks = _match(blocks.repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt"), length, block_bytes, parts)
    marks = stage(marks, "marks")
    late = _meetings(marks.where("part IS NOT NULL").repartition("part").sortWithinPartitions("part"))
    ranges = marks.where("part IS NULL").select("digest", "at", "n").union(late.select("digest", "at", "n"))
    whole = kinds.where("copies > 1").select("digest", F.lit(0).alias("at"), "n")
    once = kinds.where("copies = 1").select("digest")
    inner = whole.union(ranges.join(once, "digest")).select("digest", F.col("at").alias("inner_at"), F.col("n").alias("inner_n"))
    found = spots.select("row_id", "row_hash", "at", "digest").join(inner, "digest")
    return found.groupBy("row_id", "row_hash").agg(F.collect_set(F.struct((F.col("at") + F.col("inner_at")).alias("at"), F.col("inner_n").alias("n"))).alias("ranges"))


def removed_mask(size: int, ranges: list[dict] | None, length: int) -> np.ndarray:
    change = np.zeros(size + 1, np.int32)
    for r in ranges or ():
        change[r["at"]] += 1
        change[r["at"] + r["n"] + length - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = MIN_BYTES, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row_id, row_hash, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in chunks(batches):
            sizes, removed, spans, kept = [], [], [], []
            for text, ranges in zip(batch.column(3).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist(), strict=True):
                sizes.append(len(text))
                if not ranges:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text)
                    continue
                gone = removed_mask(len(text), ranges, length)
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "row_id", "row_hash", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    ranges = repeated_ranges(docs, length, gram, block_bytes)
    both = texts_with_key(docs).join(ranges, ["row_id", "row_hash"], "left").select("doc_id", "row_id", "row_hash", "text", "ranges")
    return both.mapInArrow(run, "doc_id long, row_id long, row_hash long, n_bytes long, n_removed long, n_spans long, kept binary")


def _long_runs(text: bytes, gone: np.ndarray, words: int) -> np.ndarray:
    """The mask without the runs that have no more than so many words."""
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if len(text[start:stop].split()) <= words:
            gone[start:stop] = False
    return gone


def strip_repeats(docs: DataFrame, length: int = MIN_BYTES, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, words: int = 0) -> DataFrame:
    """The rows of docs with the repeats taken out of `text`; a character that a cut leaves incomplete goes too.

    Runs of no more than ``words`` words stay.  n_chars, where there, is the length of the new text.  A null text stays null.
    """
    columns = docs.columns
    key = row_key_names(docs)
    (mark,) = fresh_names([*columns, *key], "ranges")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in chunks(batches):
            kept = []
            for text, ranges in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ranges:
                    gone = _long_runs(text, removed_mask(len(text), ranges, length), words)
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                kept.append(text.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])

    ranges = repeated_ranges(docs, length, gram, block_bytes)
    ranges = ranges.select(F.col("row_id").alias(key[0]), F.col("row_hash").alias(key[1]), F.col("ranges").alias(mark))
    keyed = with_row_key(docs).join(ranges, key, "left")
    same = [F.col(f"`{c}`") for c in columns]
    whole = keyed.where(F.col(mark).isNull()).select(*same)
    cut = keyed.where(F.col(mark).isNotNull()).select("text", mark, *[F.col(f"`{c}`") for c in columns if c != "text"])
    out = cut.mapInArrow(run, cut.drop(mark).schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(out.select(*same))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
