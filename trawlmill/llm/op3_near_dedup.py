"""Near-duplicate classes by DartMinHash.

Method: a text is the bag of its five-word shingles, the weight of a shingle being how often it occurs.  Hashed darts fall on
weight x rank: each unit of weight of an element gets its own Poisson stream of darts along the rank axis, drawn from the
hash of (shingle, unit), so equal weights share all darts.  Each dart has a coordinate; the earliest dart on a coordinate
is kept.  Ranks are opened in doubling intervals until every coordinate has a dart, so long texts throw about
k ln k darts altogether instead of k for each element.  Two signatures agree on a coordinate with the probability of the
weighted Jaccard similarity.

Candidates come from a banded join (26 bands of 5 coordinates: a pair at 0.8 is missed with probability 3e-5, at 0.9 below
1e-10) and are verified by the exact similarity of the bags.  Texts with the same words are one node before that.
Every member of a bucket is compared with its leader.  Buckets that still hold several components are dealt in blocks to tasks,
the bags beside them: a task verifies inside, keeps a union-find of the components it sees, and gives only links that join two
of them (a spanning forest).  In the end the members outside a bucket's largest component have met all others that are not in
their component, so no link between members of a bucket is lost, and no group is expanded into its pairs.  Classes are the
connected components of the links, found by alternating large-star and small-star steps on staged edge tables.

Rows: one row per input row.  Null and empty texts, and texts of white space only, have no shingles and form one class of
their own (same words: none).  A text under five words has one shingle.  `class_id` is the smallest id in the class,
null only if all ids are null.  Repeated rows share a class.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.llm.common import NO_ID, chunks, mix, release_memory, row_key_names, rows_with_key, shingles_of, table, text_bytes, texts_with_key, with_row_key, words_of
from trawlmill.sources.staging import discard, stage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 26
ROWS = 5
#: Texts, and units of their bags, that a task compares with others at a time.
BLOCK_NODES = 256
BLOCK_UNITS = 1 << 20
#: Texts that stream past such a block.
PASSING_NODES = 4096
#: Matching units that a task holds at a time.
MATCHES = 1 << 18
EDGES_PER_FILE = 200_000
#: Ranks below 2**FIRST_RANK are opened first.
FIRST_RANK = -7


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    k = np.arange(1, int(mean + 12 * mean**0.5 + 30))
    log = np.r_[0.0, np.cumsum(np.log(mean) - np.log(k))] - mean
    return np.cumsum(np.exp(log))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def units_of_weight(shingles: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of (shingle, how many times it was there before in its row): the unit columns of the weighted elements."""
    if not len(shingles):
        return shingles
    order = np.lexsort((shingles, row))
    s, r = shingles[order], row[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])]
    index = np.arange(len(s))
    before = index - np.maximum.accumulate(np.where(new, index, 0))
    out = np.empty_like(shingles)
    out[order] = mix(s + before.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out


def signatures(units: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """rows x k earliest ranks; inf for a row without elements.  A rank has 53 random bits, so it names its dart."""
    best = np.full(rows * k, np.inf)
    unfilled = np.zeros(rows, bool)
    unfilled[np.unique(row)] = True
    j = FIRST_RANK
    low = 0.0
    while unfilled.any():
        high = 2.0**j
        live = unfilled[row]
        element, owner = units[live], row[live]
        seed = mix(element + np.uint64((j + 64) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        darts = np.searchsorted(_poisson(high - low), _unit(seed), side="right")
        hit = np.flatnonzero(darts)
        which = np.repeat(hit, darts[hit])
        number = np.arange(len(which)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
        dart = mix(seed[which] ^ mix(number.astype(np.uint64) + np.uint64(1)))
        rank = low + _unit(dart) * (high - low)
        coordinate = (mix(dart + np.uint64(0x9FB21C651E98DF25)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, owner[which] * k + coordinate, rank)
        unfilled &= np.isinf(best.reshape(rows, k)).any(axis=1)
        low, j = high, j + 1
    return best.reshape(rows, k)


def band_keys(ranks: np.ndarray, bands: int) -> np.ndarray:
    """rows x bands hashes, different from band to band."""
    bits = ranks.view(np.uint64).reshape(len(ranks), bands, -1)
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(ranks), 1))
    for c in range(bits.shape[2]):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + bits[:, :, c])
    return out


def _fixed_lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), pa.array(values.reshape(-1)))


def sketch(docs: DataFrame, size: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """doc_id, row_id, row_hash, node (16 bytes: digest of the word sequence), bands (array of keys, empty without words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in chunks(batches):
            data, at = text_bytes(batch.column(3))
            words, row, count = words_of(data, at)
            first = np.cumsum(count) - count
            node = np.zeros((batch.num_rows, 2), np.uint64)
            for c, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
                # Position-dependent sum: differs with any word or place.
                term = mix(words + mix((np.arange(len(words)) - first[row]).astype(np.uint64) + np.uint64(salt)))
                total = np.r_[np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)]
                node[:, c] = mix(total[first + count] - total[first] + count.astype(np.uint64))
            shingles, owner = shingles_of(words, row, count, size)
            ranks = signatures(units_of_weight(shingles, owner), owner, batch.num_rows, bands * band_rows)
            keys = _fixed_lists(band_keys(ranks, bands).view(np.int64))
            empty = pa.array([[]] * batch.num_rows, keys.type)
            keys = pa.compute.if_else(pa.array(count > 0), keys, empty)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), batch.num_rows, [None, pa.py_buffer(node.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), raw.cast(pa.binary()), keys],
                names=["doc_id", "row_id", "row_hash", "node", "bands"],
            )

    keyed = texts_with_key(docs).select("doc_id", "row_id", "row_hash", "text")
    return keyed.mapInArrow(run, "doc_id long, row_id long, row_hash long, node binary, bands array<long>")


def elements(keyed: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """node, bag (ascending hashes of the units of weight), n (of them) from node, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, at = text_bytes(batch.column(1))
            shingles, owner = shingles_of(*words_of(data, at), size)
            units = units_of_weight(shingles, owner).view(np.int64)
            units = units[np.lexsort((units, owner))]
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(units)), pa.array(np.diff(ends))], names=["node", "bag", "n"])

    return keyed.select("node", "text").mapInArrow(run, "node binary, bag array<long>, n int")


def similar(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose bags' exact weighted Jaccard similarity reaches the threshold."""
    a = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    b = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", shared.alias("i"), (F.size("bag_a") + F.size("bag_b")).alias("n"))
    return both.where(F.col("i") >= threshold * (F.col("n") - F.col("i"))).select("a", "b")


def _bag_values(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row begins."""
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0] : at[-1]], at - at[0]


class _Block:
    """Texts that others are compared with: their bags as one sorted list, and the components seen so far."""

    def __init__(self, batches: list[pa.RecordBatch], threshold: float):
        self.threshold = threshold
        self.parent: dict[bytes, bytes] = {}
        self.roots = [r for b in batches for r in b.column("root").to_pylist()]
        parts = [_bag_values(b.column("bag")) for b in batches]
        values = np.concatenate([v for v, _ in parts])
        self.sizes = np.concatenate([np.diff(at) for _, at in parts])
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def find(self, x: bytes) -> bytes:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while (up := self.parent.get(x, x)) != top:
            self.parent[x], x = top, up
        return top

    def meet(self, batch: pa.RecordBatch) -> list[tuple[bytes, bytes]]:
        """Links from the rows to texts of the block in other components; the components become one."""
        links = []
        roots = batch.column("root").to_pylist()
        values, at = _bag_values(batch.column("bag"))
        low, high = (np.searchsorted(self.values, values, side=s) for s in ("left", "right"))
        matches = np.r_[0, np.cumsum(high - low)]
        row = 0
        while row < len(roots):
            # as many rows as have about MATCHES units in common with the block
            stop = max(row + 1, int(np.searchsorted(matches[at], matches[at[row]] + MATCHES, side="right")) - 1)
            a, b = low[at[row] : at[stop]], (high - low)[at[row] : at[stop]]
            place = np.repeat(a - np.r_[0, np.cumsum(b)[:-1]], b) + np.arange(int(b.sum())) if len(b) else np.zeros(0, np.int64)
            own = np.repeat(np.repeat(np.arange(stop - row), np.diff(at[row : stop + 1])), b)
            shared = np.bincount(own * len(self.sizes) + self.owner[place], minlength=(stop - row) * len(self.sizes)).reshape(stop - row, -1)
            total = np.diff(at[row : stop + 1])[:, None] + self.sizes[None, :]
            for i, j in zip(*np.nonzero((shared >= self.threshold * (total - shared)) & (shared > 0)), strict=True):
                x, y = self.find(roots[row + i]), self.find(self.roots[j])
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    links.append((x, y))
            row = stop
        return links


def _forest(threshold: float):
    """Rows (task, passing, root, bag) sorted by task, those that others are compared with first -> links between components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        now, block, held = None, None, []
        for whole in batches:
            task = whole.column(0).to_numpy()
            passing = whole.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (passing[1:] != passing[:-1]), True]) if len(task) else [0]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                own = whole.slice(start, stop - start)
                if task[start] != now:
                    now, block, held = task[start], None, []
                if not passing[start]:
                    held.append(own)
                    continue
                if block is None and held:
                    block, held = _Block(held, threshold), []
                links = block.meet(own) if block is not None else []
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links, strict=True)], names=["a", "b"])

    return run


def _links(dealt: DataFrame, threshold: float) -> DataFrame:
    """Staged links between components from rows (task, passing, root, bag)."""
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("task", "passing", "root", "bag").repartition(tasks, "task").sortWithinPartitions("task", "passing")
    return stage(dealt.mapInArrow(_forest(threshold), "a binary, b binary"), "links")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Staged: key, node, root of the buckets that hold several components."""
    named = buckets.join(roots, "node")
    several = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    return stage(named.join(several, "key", "left_semi").select("key", "node", "root"), "mixed")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after the links between their roots."""
    new = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    after = stage(roots.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    discard(roots)
    return after


def _blocks(nodes: str, units: str, most: int) -> Column:
    """Number of blocks for so many texts and units."""
    return F.ceil(F.col(nodes) / most + F.col(units) / BLOCK_UNITS)


def _part(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), blocks)


def _within_blocks(mixed: DataFrame, bags: DataFrame, threshold: float, salt: int) -> DataFrame:
    """Links inside blocks, every text being in one: a block of its fullest bucket."""
    sizes = mixed.groupBy("key").agg(F.count("*").alias("size"))
    home = mixed.join(sizes, "key").groupBy("node").agg(F.max(F.struct("size", "key")).alias("h"), F.min("root").alias("root"))
    home = home.select("node", "root", F.col("h.key").alias("key")).join(bags, "node")
    sizes = home.groupBy("key").agg(F.count("*").alias("nodes"), F.sum("n").alias("units")).where("nodes > 1")
    task = F.xxhash64("key", _part(_blocks("nodes", "units", BLOCK_NODES), salt))
    dealt = home.join(sizes, "key").select(task.alias("task"), "root", "bag", F.explode(F.array(F.lit(False), F.lit(True))).alias("passing"))
    return _links(dealt, threshold)


def _across_blocks(mixed: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links of all texts outside their bucket's largest component with all others of the bucket."""
    mixed = mixed.join(bags, "node")
    largest = mixed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("u"))
    largest = largest.groupBy("key").agg(
        F.max(F.struct("c", "u", "root")).alias("l"), F.sum("c").alias("nodes"), F.sum("u").alias("units")
    )
    counts = largest.select(
        "key", F.col("l.root").alias("main"), (F.col("nodes") - F.col("l.c")).alias("outside"), (F.col("units") - F.col("l.u")).alias("outside_units"), "nodes"
    )
    rows = mixed.join(counts, "key")
    fixed = _blocks("outside", "outside_units", BLOCK_NODES)
    passing = F.ceil(F.col("nodes") / PASSING_NODES)
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    leaders = rows.where(F.col("root") != F.col("main")).select(
        "key", _part(fixed, 0).cast("int").alias("i"), every(passing).alias("j"), F.lit(False).alias("passing"), "root", "bag"
    )
    others = rows.select("key", _part(passing, 1).cast("int").alias("j"), every(fixed).alias("i"), F.lit(True).alias("passing"), "root", "bag")
    return _links(leaders.unionByName(others).withColumn("task", F.xxhash64("key", "i", "j")), threshold)


def linked_components(buckets: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """node, root from buckets (key, node): the components of all verified links between members of a bucket.

    First every member is compared with its bucket's leader.  What then is in buckets of several components is compared within
    blocks, each text once, as long as that halves these buckets.  Last, every text outside the largest component of a
    bucket meets all others of it.  A task joins components as it finds links, so a pair is left out only where its texts are
    in one component already.
    """
    leader = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node")).alias("l")).select("key", F.col("l.node").alias("b"))
    pairs = buckets.select("key", F.col("node").alias("a")).join(leader, "key").where(F.col("a") != F.col("b"))
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    first = components(stage(similar(pairs, bags, threshold), "links"))
    nodes = buckets.select("node").distinct()
    roots = stage(nodes.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    discard(pairs)
    before, salt = None, 0
    while True:
        mixed = _mixed(buckets, roots)
        left = mixed.count()
        if not left:
            return roots
        halved, before, salt = before is None or 2 * left <= before, left, salt + 1
        links = _within_blocks(mixed, bags, threshold, salt) if halved else _across_blocks(mixed, bags, threshold)
        if not links.isEmpty():
            roots = _joined(roots, links)
        discard(mixed)
        if not halved:
            return roots


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating algorithm on edges (u > v); both keep the components and pull nodes to the smallest."""
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge, the root being the smallest node of its component."""
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        edges = stage(_stars(_stars(edges, large=True), large=False).coalesce(_parts(before)), "star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _parts(known: tuple | None) -> int:
    """Files of an edge table: by its rows, where they are known."""
    return 1 << 20 if known is None else known[0] // EDGES_PER_FILE + 1


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """doc_id, row_id, row_hash, class_id, node for every row."""
    rows = stage(sketch(docs, size, bands, band_rows), "sketch")
    known_id = F.when(F.col("row_id") != NO_ID, F.col("row_id"))
    nodes = rows.groupBy("node").agg(F.min(F.struct("row_id", "row_hash")).alias("rep"), F.min(known_id).alias("least"))
    single = rows.select("row_id", "row_hash", "node", "bands").join(
        nodes.select("node", F.col("rep.row_id").alias("row_id"), F.col("rep.row_hash").alias("row_hash")), ["node", "row_id", "row_hash"]
    )
    keys = single.dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    keys = stage(keys, "bands")
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = stage(keys.join(full, "key"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes, "node").select("node", "rep.row_id", "rep.row_hash")
    texts = texts_with_key(docs).select("row_id", "row_hash", "text").join(wanted, ["row_id", "row_hash"])
    bags = stage(elements(texts.dropDuplicates(["row_id", "row_hash"]), size), "bags")
    roots = linked_components(buckets, bags, threshold)
    grouped = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = grouped.join(least, "root").select("node", "root", "class_id")
    return rows.join(classes, "node").select("doc_id", "row_id", "row_hash", "class_id", "root")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, one for each class: the least identity, and one of its repeated rows."""
    classes = stage(near_duplicate_classes(docs, threshold).select("row_id", "row_hash", "root"), "classes")
    kept = classes.groupBy("root").agg(F.min(F.struct("row_id", "row_hash")).alias("k")).select("k.row_id", "k.row_hash")
    often = classes.groupBy("row_id", "row_hash").agg(F.count("*").alias("n")).where("n > 1").select("row_id", "row_hash")
    often = stage(often.join(kept, ["row_id", "row_hash"], "left_semi"), "repeated")
    if often.isEmpty():
        return rows_with_key(docs, kept)
    single = kept.join(often, ["row_id", "row_hash"], "left_anti")
    repeated = with_row_key(rows_with_key(docs, often)).dropDuplicates(row_key_names(docs)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return rows_with_key(docs, single).unionByName(repeated)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id")
