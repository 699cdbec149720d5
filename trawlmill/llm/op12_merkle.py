"""Merkle manifest of a dataset with proofs by pointer jumping.

Method: every row has a leaf digest.  The leaves of a source, in the order of their ids, are put together in runs of FAN_OUT,
level by level, up to the source's subroot; the subroots, in the order of the sources, likewise give the root.  A node then
holds the segment towards its parent (the run it lies in, and its place there) and a pointer to it.  In each round of self-joins
a node takes over the segment and the pointer of the node that it points to, so that segments double in length and all nodes
reach the root after log2(depth) rounds.  Leaves stay with their run: the node above them jumps for all of them, and their
own segment is the run itself.

Positions come from one ordering by ranges and the sizes of the pieces of sources in each range, so no task holds a source.
Only DataFrame functions are used.

Rows: any field may be null.  Null ids come before others, ties (repeated ids or rows) go by the leaf digest; equal rows are
leaves of their own.  A null source is a source, before all others.  An empty table has an empty manifest without a root.
Columns that are not among the fields are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlmill.llm.common import in_order, table
from trawlmill.sources.staging import discard, stage

FAN_OUT = 16
#: The fields that a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
WIDTH = 64
#: Key parts of the tree of subroots, and of the root's key.
TOP, ROOT = -1, -2
KEY = ("tree", "level", "place")


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of the fields, each with its length in bytes, or a dash for null."""
    texts = [c.cast("string") for c in fields.values()]
    return digest_of(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


@dataclass
class Manifest:
    """Staged tables of a manifest.

    ``runs``: the nodes above the leaves (key, leaves as an ordered array, lone: the source has only this leaf).
    ``subroots``: (tree, source, subroot).  ``paths``: (key, path as an array of (run, at) up to the root); the root has none.
    ``root``: its digest, None for an empty table.
    """

    runs: DataFrame
    subroots: DataFrame
    paths: DataFrame | None
    root: str | None


def _places(ordered: DataFrame) -> DataFrame:
    """One row for each range and source in it: how many leaves of the source come before, and its size and number."""
    pieces = ordered.groupBy(F.shiftright("at", 33).alias("range"), "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("source").orderBy("range")
    pieces = pieces.withColumns({"before": F.sum("n").over(own) - F.col("n"), "size": F.sum("n").over(Window.partitionBy("source"))})
    pieces = stage(pieces, "pieces")
    starts = pieces.where("before = 0")
    # sources that begin in the ranges before: one row for each range
    earlier = starts.groupBy("range").count().withColumn("earlier", F.sum("count").over(Window.orderBy("range")) - F.col("count"))
    number = F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1
    numbered = starts.withColumn("within", number).join(earlier.select("range", "earlier"), "range")
    trees = numbered.select("source", (F.col("earlier") + F.col("within")).alias("tree"))
    both = pieces.alias("p").join(trees.alias("t"), F.expr("p.source <=> t.source"))
    return both.select("range", "p.source", "first", "before", "size", "tree")


def _key(size: Column, top: bool) -> list[Column]:
    """Key of a node: the last one of a tree is a leaf of the tree of subroots, the last one of that is the root."""
    last = size == 1
    if top:
        return [F.when(last, ROOT).otherwise(F.col("tree")).alias("tree"), "level", "place"]
    return [
        F.when(last, TOP).otherwise(F.col("tree")).alias("tree"),
        F.when(last, 0).otherwise(F.col("level")).alias("level"),
        F.when(last, F.col("tree")).otherwise(F.col("place")).alias("place"),
    ]


def _levels(nodes: DataFrame, height: int, fan_out: int, tag: str) -> list[DataFrame]:
    """Staged levels above the nodes (tree, place, size of the level, digest): tree, level, place, size, run, width, digest."""
    out = []
    for level in range(1, height + 1):
        up = nodes.where("size > 1").withColumns({"at": F.col("place") % fan_out, "place": F.floor(F.col("place") / fan_out)})
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
        size = F.ceil(F.first("size") / fan_out).cast("long")
        grouped = up.groupBy("tree", "place").agg(size.alias("size"), run.alias("run"), F.count("*").cast("int").alias("width"))
        nodes = stage(grouped.withColumns({"digest": digest_of(F.col("run")), "level": F.lit(level)}), f"{tag}-{level}")
        out.append(nodes)
    return out


def _height(size: int, fan_out: int) -> int:
    """Levels above so many leaves."""
    height = 0
    while size > 1:
        size, height = -(-size // fan_out), height + 1
    return height


def _steps(level: DataFrame, top: bool, fan_out: int) -> DataFrame:
    """Each child of the nodes of a level with its segment to them."""
    place = F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("step_at")
    up = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in _key(F.col("size"), top)]).alias("up")
    # a child that is no last node of its tree keeps its own place; the leaves of the top tree are named by their source
    child = [F.col("tree"), (F.col("level") - 1).alias("level"), (F.col("place") * fan_out + F.col("step_at")).alias("place")]
    rows = level.select("tree", "level", "place", "size", "run", place)
    return rows.select(*child, up, F.array(F.struct("run", F.col("step_at").alias("at"))).alias("path"))


def _jumped(steps: DataFrame, depth: int) -> DataFrame:
    """The nodes with their path to the root, by joins that double the distance."""
    at_root = F.col("up.tree") == ROOT
    state = stage(steps, "pointers")
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        ahead = state.select(F.struct(*KEY).alias("up"), F.col("up").alias("up_next"), F.col("path").alias("path_next"))
        moved = state.where(~at_root).join(ahead, "up").select(*KEY, F.col("up_next").alias("up"), F.concat("path", "path_next").alias("path"))
        before, state = state, stage(state.where(at_root).unionByName(moved), "pointers")
        discard(before)
    return state.drop("up")


def build_manifest(leaves: DataFrame, fan_out: int = FAN_OUT) -> Manifest:
    """Manifest of a table (doc_id, source, digest, further columns that stay with the leaf)."""
    carried = [c for c in leaves.columns if c != "source"]
    ordered = in_order(leaves.select("source", F.struct(*carried).alias("item")), ["source", "item.doc_id", "item.digest"], "leaves")
    places = stage(_places(ordered), "places")
    sources, largest = places.where("before = 0").agg(F.count("*"), F.max("size")).first()  # two numbers
    if not sources:
        return Manifest(ordered, ordered, None, None)
    located = ordered.alias("o").join(places.alias("p"), F.expr("shiftright(o.at, 33) = p.range AND o.source <=> p.source")).select(
        "tree", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "size", "item"
    )
    # level 1 with its leaves; the only leaf of a source is its subroot
    at = (F.col("place") % fan_out).cast("int").alias("at")
    leaf_rows = located.select("tree", F.floor(F.col("place") / fan_out).alias("place"), "size", F.struct(at, "item").alias("leaf"))
    grouped = leaf_rows.groupBy("tree", "place").agg(F.first("size").alias("leaves_in_tree"), F.array_sort(F.collect_list("leaf")).alias("leaves"))
    run = F.array_join(F.transform("leaves", lambda x: x["item"]["digest"]), "")
    lone = F.col("leaves_in_tree") == 1
    first = stage(
        grouped.select(
            "tree", F.lit(1).alias("level"), "place", F.ceil(F.col("leaves_in_tree") / fan_out).cast("long").alias("size"), lone.alias("lone"), "leaves",
            run.alias("run"), F.size("leaves").alias("width"), F.when(lone, run).otherwise(digest_of(run)).alias("digest"),
        ),
        "level-1",
    )
    discard(ordered)
    low = [first, *_levels(first, _height(largest, fan_out) - 1, fan_out, "level")]
    low = [low[0], *[x.withColumn("level", F.col("level") + 1) for x in low[1:]]]
    names = places.where("before = 0").select("tree", "source")
    last = reduce(DataFrame.unionByName, [x.where("size = 1").select("tree", F.col("digest").alias("subroot")) for x in low])
    subroots = stage(last.join(names, "tree"), "subroots")
    discard(places)
    heads = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(sources).alias("size"), F.col("subroot").alias("digest"))
    high = _levels(heads, _height(sources, fan_out), fan_out, "top")
    root = (high[-1].select("digest") if high else subroots.select("subroot")).first()[0]  # one digest
    # a tree whose last node is the root itself, where there is one source only
    single = sources == 1
    steps = [_steps(x, single, fan_out) for x in low[1:]] + [_steps(x, True, fan_out) for x in high]
    paths = None
    if steps:
        paths = _jumped(reduce(DataFrame.unionByName, steps), len(low) - 1 + len(high))
    runs = first.select(*_key(F.col("size"), single), F.col("tree").alias("of_tree"), "lone", "leaves", "run")
    return Manifest(runs, subroots, paths, root)


_FOLD = f"sha2(concat(substring(x.run, 1, x.at * {WIDTH}), acc, substring(x.run, x.at * {WIDTH} + {WIDTH + 1})), 256)"
_OTHERS = f"concat(substring(x.run, 1, x.at * {WIDTH}), substring(x.run, x.at * {WIDTH} + {WIDTH + 1}))"


def proofs(manifest: Manifest, claimed: str = "digest") -> DataFrame:
    """One row for each leaf: its columns, subroot, proof_sha256 (of its siblings up to the root), folded_root.

    ``claimed`` names the leaf column that is folded with the siblings; it gives the root when it is the leaf's own digest.
    """
    rows = manifest.runs
    if manifest.root is None:
        return rows.select("item.*", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "proof_sha256", "folded_root")])
    steps = "array<struct<run:string,at:int>>"
    if manifest.paths is None:
        rows = rows.withColumn("path", F.array().cast(steps))
    else:
        rows = rows.join(manifest.paths, [*KEY], "left")
    subroots = manifest.subroots.select(F.col("tree").alias("of_tree"), "subroot")
    rows = rows.join(subroots, "of_tree").withColumn("path", F.coalesce("path", F.array().cast(steps)))
    rows = rows.withColumn("others", F.expr(f"array_join(transform(path, x -> {_OTHERS}), '')"))
    # a leaf's first segment is the run it lies in
    one = rows.select("lone", "run", "path", "others", "subroot", F.explode("leaves").alias("leaf"))
    one = one.withColumn("own", F.when(F.col("lone"), F.array().cast(steps)).otherwise(F.array(F.struct("run", "leaf.at"))))
    siblings = F.concat(F.expr(f"array_join(transform(own, x -> {_OTHERS}), '')"), F.col("others"))
    folded = F.expr(f"aggregate(concat(own, path), leaf.item.`{claimed}`, (acc, x) -> {_FOLD})")
    return one.select("leaf.item.*", "subroot", digest_of(siblings).alias("proof_sha256"), folded.alias("folded_root"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, and claimed: the digest after tampering, where 5 divides the CRC of the id."""
    fields = {name: F.col(name) for name in FIELDS}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(hit, leaf_of({**fields, "text": lowered})).otherwise(leaf_of(fields))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_of(fields).alias("digest"), claimed.alias("claimed"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    manifest = build_manifest(document_leaves(docs))
    root = F.lit(manifest.root).cast("string")
    return proofs(manifest, "claimed").select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_proofs(table(spark, sf_dir, "documents"))


#: Levels that the SQL unrolls: trees of up to 16 ** 7 leaves.
_SQL_LEVELS = 7


def _sql_tree(name: str, tree: str) -> str:
    """CTEs name0..: nodes (tree, pos, n, d) of each level above the table name0, a finished tree staying as it is; nameK_r: their runs."""
    out = []
    for k in range(_SQL_LEVELS):
        out.append(
            f"{name}{k}_r AS (SELECT {tree}, pos // 16 AS pos, max(n) AS n, list(d ORDER BY pos) AS run FROM {name}{k} GROUP BY {tree}, pos // 16), "
            f"{name}{k + 1} AS (SELECT {tree}, pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d FROM {name}{k}_r)"
        )
    return ", ".join(out)


def _sql_fold(name: str, first: str, tree: str, place: str) -> str:
    """CTEs that add the siblings of each level to s and put the claimed digest f through it."""
    out, before = [], first
    for k in range(_SQL_LEVELS):
        at = f"CAST({place} // {16**k} % 16 AS INT)"
        out.append(
            f"{first}_{name}{k} AS (SELECT x.* REPLACE (CASE WHEN r.n = 1 THEN s ELSE s || array_to_string(list_concat(run[1:{at}], run[{at} + 2:]), '') END AS s, "
            f"CASE WHEN r.n = 1 THEN f ELSE sha256(array_to_string(list_concat(run[1:{at}], [f], run[{at} + 2:]), '')) END AS f) "
            f"FROM {before} x JOIN {name}{k}_r r ON x.{tree} IS NOT DISTINCT FROM r.{tree} AND x.{place} // {16 ** (k + 1)} = r.pos)"
        )
        before = f"{first}_{name}{k}"
    return ", ".join(out)


def _sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in fields) + ")"


#: Trees level by level, and each leaf put through the runs above it; CRC-32 by a table of the 256 remainders.
OP12_SQL = f"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
leaf AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c : ord(c))),
        lambda a, b : xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295) % 5 = 0
      THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_sql_leaf("text")} END AS f
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS size, '' AS s FROM leaf
), a0 AS (SELECT source, p AS pos, size AS n, leaf AS d FROM placed), {_sql_tree("a", "source")},
sub AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS q, count(*) OVER () AS size FROM a{_SQL_LEVELS}),
b0 AS (SELECT 0 AS top, q AS pos, size AS n, subroot AS d FROM sub), {_sql_tree("b", "top")},
{_sql_fold("a", "placed", "source", "p")},
high AS (SELECT x.*, q, subroot, 0 AS top FROM placed_a{_SQL_LEVELS - 1} x JOIN sub ON x.source IS NOT DISTINCT FROM sub.source),
{_sql_fold("b", "high", "top", "q")}
SELECT doc_id, leaf, subroot, d AS root, sha256(s) AS proof_sha256, f AS folded_root, f = d AS verified
FROM high_b{_SQL_LEVELS - 1}, b{_SQL_LEVELS}
"""
