"""Benchmark decontamination by size-partitioned MinHash containment search.

Method: a test item of s shingles (five words each) belongs to the size class j with 2**(j-1) < s <= 2**j.  For each class
in use, documents are cut into tiles of 2**j shingles, so that an item meets sets of about its own size however long
the document is.  A set's sketch is its SKETCH smallest shingle hashes (the whole set where it is no larger).  An item and a
document are a candidate pair when a sketch of the item and one of the document's tiles of that class share a hash; a
candidate is verified by the exact share of the item's different shingles that the whole document holds.  With 32 hashes a
class of up to 32 shingles is found always, and a larger item that a document holds at 0.8 or more is missed with a
probability below 1e-6.

The search joins sketches only.  A shingle that more than COMMON_ITEMS items hold (a usual opening, say) makes no candidate by
itself, unless the item's sketch is mostly such shingles: of a sketch that is the whole item more must be left than may be
missing, of a larger item's at least half.  Shared shingles are then counted for the candidate pairs alone.

The items' shingles go to the tasks as a bitmap of fixed size (2**22 bits), which only saves rows: whatever passes it is
compared by the full hash.  Words are runs without ASCII white space, A-Z in lower case.

Rows: texts without words (null, empty) and items without words match nothing; a text under five words has one
shingle of all its words.  Repeated rows (same id, same text) give one result; items likewise.  An id may be null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.llm.common import NO_ID, chunks, shingles_of, table, text_bytes, texts_with_key, words_of
from trawlmill.sources.staging import stage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
SKETCH = 32
#: A shingle in more items than this is common.
COMMON_ITEMS = 16
PREFIX_BITS = 22


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles in text order, their rows, and their place in the row."""
    data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
    hashes, row = shingles_of(*words_of(data, at), size)
    first = np.searchsorted(row, np.arange(batch.num_rows))
    return hashes, row, np.arange(len(row)) - first[row] if len(row) else row


def _rank_in_group(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rank of each different value within its group, from 0."""
    if not len(group):
        return np.zeros(0, np.int64)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new_group = np.r_[True, g[1:] != g[:-1]]
    new_value = new_group | np.r_[True, v[1:] != v[:-1]]
    step = np.cumsum(new_value) - 1
    out = np.empty(len(group), np.int64)
    out[order] = step - np.maximum.accumulate(np.where(new_group, step, 0))
    return out


def item_shingles(items: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """item_id, item_hash, s (shingle), n (different shingles), class, in_sketch: one row for each different shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s, row, _ = _sets(batch, size)
            order = np.lexsort((s, row))
            s, row = s[order], row[order]
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
            s, row = s[keep], row[keep]
            n = np.bincount(row, minlength=batch.num_rows)[row] if len(s) else row
            rank = np.arange(len(s)) - np.searchsorted(row, row)
            own = batch.take(pa.array(row)) if len(s) else batch.slice(0, 0)
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(s.view(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int32)), pa.array(rank < SKETCH)],
                names=["item_id", "item_hash", "s", "n", "class", "in_sketch"],
            )

    distinct = texts_with_key(items.select(F.col("item_id").alias("doc_id"), "text"))
    distinct = distinct.select(F.col("doc_id").alias("item_id"), F.col("row_hash").alias("item_hash"), "text").dropDuplicates(["item_id", "item_hash"])
    return distinct.mapInArrow(run, "item_id long, item_hash long, s long, n long, class int, in_sketch boolean")


def document_shingles(docs: DataFrame, bitmap: np.ndarray, classes: list[int], size: int = SHINGLE_WORDS) -> DataFrame:
    """Key columns, s, classes (bit j: s is in the sketch of a tile of class j) for shingles that pass the bitmap."""
    packed = np.packbits(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(packed).astype(bool)
        for batch in chunks(batches):
            s, row, place = _sets(batch, size)
            ok = passes[(s >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)]
            mask = np.zeros(len(s), np.int64)
            for j in classes:
                if 1 << j <= SKETCH:
                    mask[ok] |= 1 << j
                    continue
                tile = (row << 32) + (place >> j)
                near = np.isin(tile, np.unique(tile[ok]))
                rank = _rank_in_group(tile[near], s[near])
                mask[np.flatnonzero(near)[rank < SKETCH]] |= 1 << j
            s, row, mask = s[ok], row[ok], mask[ok]
            order = np.lexsort((s, row))
            s, row, mask = s[order], row[order], mask[order]
            if len(s):
                start = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (row[1:] != row[:-1])])
                mask, s, row = np.bitwise_or.reduceat(mask, start), s[start], row[start]
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array(s.view(np.int64)), pa.array(mask)],
                    names=["doc_id", "row_id", "row_hash", "s", "classes"],
                )

    keyed = texts_with_key(docs).select("doc_id", "row_id", "row_hash", "text")
    return keyed.mapInArrow(run, "doc_id long, row_id long, row_hash long, s long, classes long")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row_id, row_hash, item_id, item_hash, n_shared, n_shingles, containment for each pair at or over the threshold."""
    wanted = stage(item_shingles(items, size), "items")
    classes = sorted(r[0] for r in wanted.select("class").distinct().collect())  # at most 31 values
    prefixes = wanted.select(F.shiftrightunsigned("s", 64 - PREFIX_BITS).alias("p")).distinct().toPandas()["p"]  # at most 2**22
    bitmap = np.zeros(1 << PREFIX_BITS, bool)
    bitmap[prefixes.to_numpy(dtype=np.int64)] = True
    found = stage(document_shingles(docs, bitmap, classes, size), "shingles")
    share = F.col("n_shared") / F.col("n_shingles")
    pairs = shared_shingles(sketch_hits(found, wanted, threshold), found, wanted)
    return pairs.where(share >= threshold).select(
        "doc_id", "row_id", "row_hash", "item_id", "item_hash", "n_shared", "n_shingles", share.alias("containment")
    )


def _item_key() -> list[Column]:
    return [F.coalesce("item_id", F.lit(NO_ID)).alias("item_key"), F.col("item_hash")]


def sketch_hits(found: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """row_id, row_hash, item_key, item_hash for every shingle that an item's sketch and a tile's sketch of its class share."""
    held_by = wanted.groupBy("s").agg((F.count("*") > COMMON_ITEMS).alias("common"))
    sketch = wanted.where("in_sketch").join(held_by, "s").select(*_item_key(), "s", "class", "n", "common")
    rare = F.count_if(~F.col("common"))
    enough = F.when(F.max("n") <= SKETCH, rare > F.floor(F.max("n") * (1 - threshold) + 1e-9)).otherwise(rare >= SKETCH // 2)
    told = sketch.groupBy("item_key", "item_hash").agg(enough.alias("enough"))
    used = sketch.join(told, ["item_key", "item_hash"]).where(~F.col("common") | ~F.col("enough"))
    sketches = found.where("classes <> 0").select("row_id", "row_hash", "s", "classes")
    hit = F.col("classes").bitwiseAND(F.expr("shiftleft(1L, class)")) != 0
    return sketches.join(used, "s").where(hit).select("row_id", "row_hash", "item_key", "item_hash")


def shared_shingles(hits: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs with the number of different shingles that both hold, for those with a hit."""
    items = wanted.select(*_item_key(), "item_id", "s", "n")
    # a row stands for one shingle of a text, so repeated rows are put together by shingle first
    texts = found.groupBy("row_id", "row_hash", "s").agg(F.max("doc_id").alias("doc_id"))
    both = hits.distinct().join(items, ["item_key", "item_hash"]).join(texts, ["row_id", "row_hash", "s"])
    return both.groupBy("row_id", "row_hash", "item_key", "item_hash").agg(
        F.max("doc_id").alias("doc_id"), F.max("item_id").alias("item_id"), F.max("n").alias("n_shingles"), F.count("*").alias("n_shared")
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


#: Every pair of document and item by plain shingle sets.
OP9_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), s AS (
  SELECT DISTINCT side, id, t,
    list_filter(string_split_regex(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x : x <> '') AS l
  FROM w
), g AS (
  SELECT DISTINCT side, id, t, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [l]
    ELSE list_transform(range(1, len(l) - 3), lambda k : l[k:k + 4]) END) AS x FROM s
), n AS (SELECT id, t, count(*) AS n FROM g WHERE side = 'i' GROUP BY id, t)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n.n AS n_shingles, count(*) / n.n AS containment
FROM g d JOIN g i ON d.side = 'd' AND i.side = 'i' AND d.x = i.x
JOIN n ON n.id IS NOT DISTINCT FROM i.id AND n.t IS NOT DISTINCT FROM i.t
GROUP BY d.id, d.t, i.id, i.t, n.n HAVING count(*) / n.n >= 0.8
"""
