"""Helpers shared by the operators: table access, row identity, bytes of Arrow texts, word and window hashes.

Row identity is (doc_id, 64-bit text hash) with a null id as its own value, so repeated rows and repeated ids stay
apart where their texts differ and are interchangeable where they don't.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.sources.staging import stage

#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 1 << 19

BATCH_ROWS = 400

#: Stands for a null id in row_id.
NO_ID = -(1 << 62)

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z as a-z.
LOWERED_VALUES = BYTE_VALUES.copy()
LOWERED_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python BATCH_ROWS at a time, where the session hasn't its own number: whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


_kept: list[Callable[[], None]] = []


def kept_by_worker(clear: Callable[[], None]) -> None:
    """Register what empties a cache that an operator keeps in a Python worker from task to task."""
    _kept.append(clear)


def release_memory() -> None:
    """Give back what other operators have left in a reused worker; called where a task of another kind begins."""
    for clear in _kept:
        clear()
    gc.collect()
    ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for a registered query."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def texts_with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), row_id (id without null) and row_hash (of the text); other columns are left out."""
    return docs.select("doc_id", whole_text().alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("row_id"), F.xxhash64("text").alias("row_hash")
    )


def in_order(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """The staged rows dealt by ranges of the keys and sorted; column ``at`` ascends with them, one by one within a range (at >> 33)."""
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys)
    return stage(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()), tag)


def fresh_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that a table doesn't have (names differ by more than case)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def row_key_names(docs: DataFrame) -> list[str]:
    """Names of the row identity beside a table's own columns."""
    return fresh_names(docs.columns, "row_id", "row_hash")


def with_row_key(docs: DataFrame) -> DataFrame:
    """All columns and the row identity, under row_key_names."""
    names = row_key_names(docs)
    return docs.withColumns({names[0]: F.coalesce("doc_id", F.lit(NO_ID)), names[1]: F.xxhash64(whole_text())})


def rows_with_key(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose identity is (left_semi) or is not (left_anti) among the keys (row_id, row_hash)."""
    names = row_key_names(docs)
    keys = keys.select(F.col("row_id").alias(names[0]), F.col("row_hash").alias(names[1]))
    return with_row_key(docs).join(keys, names, how).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for texts up to two chunks long."""
    known = _powers.get(int(base))
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if len(out) <= 2 * CHUNK_BYTES:
        _powers[int(base)] = out
    return out[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column without nulls, and the offsets of its rows in them."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text, or one longer row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


#: 0 for ASCII white space, 1 for the rest.
WORD_BYTES = np.ones(256, np.uint8)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = 0


def tokens_of(
    data: np.ndarray, at: np.ndarray, kind: np.ndarray = WORD_BYTES, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """64-bit hashes of the tokens (runs of bytes of one kind but 0; A-Z lowered), for each its row, and tokens per row.

    With prefixes also, for each length, the hashes of the first bytes of all longer tokens and their rows.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = (*none, np.zeros(len(at) - 1, np.int64))
        return (*out, [none for _ in prefixes]) if prefixes else out
    kinds = kind[data]
    change = np.ones(n + 1, bool)
    change[1:n] = kinds[1:] != kinds[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    start, stop = edges[:-1], edges[1:]
    full = kinds[start] != 0
    start, stop = start[full], stop[full]
    values = LOWERED_VALUES[data]
    values *= powers(n, BASE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    inverse = powers(n, BASE_INVERSE)[start]
    out = mix((total[stop] - total[start]) * inverse + (stop - start).astype(np.uint64))
    row = np.searchsorted(at, start, side="right") - 1
    count = np.bincount(row, minlength=len(at) - 1)
    if not prefixes:
        return out, row, count
    heads = []
    for size in prefixes:
        longer = np.flatnonzero(stop - start > size)
        first = start[longer]
        heads.append((mix((total[first + size] - total[first]) * inverse[longer] + np.uint64(size << 32)), row[longer]))
    return out, row, count, heads


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space), for each its row, and words per row."""
    return tokens_of(data, at)


def shingles_of(words: np.ndarray, row: np.ndarray, count: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words and for each its row; a row of fewer words has one shingle of all of them, none if empty."""
    n = len(words)
    if n == 0:
        return words, row
    first = np.cumsum(count) - count
    place = np.arange(n) - first[row]
    keep = place + size <= np.maximum(count[row], size * (place == 0))
    out = np.zeros(n, np.uint64)
    for k in range(size):
        word = np.zeros(n, np.uint64)
        word[: max(n - k, 0)] = words[k:]
        out = mix(out * np.uint64(0xD1342543DE82EF95) + np.where(place + k < count[row], word, np.uint64(k + 1)))
    return out[keep], row[keep]
