"""op3 and op9 against plain sets."""

import collections
import random

import numpy as np

from tests.llm.cases import awkward, corpus, prose, shingles
from trawlmill.llm import op3_near_dedup as op3
from trawlmill.llm import op9_decontaminate as op9
from trawlmill.llm.common import shingles_of


def classes(rows, threshold=0.8):
    bags = [collections.Counter(shingles(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = sum((bags[a] & bags[b]).values())
            if shared >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join("zz" + str(rng.randint(0, 999)) if rng.random() < share else w for w in text.split())


def near_rows():
    rows = awkward()
    for group in range(12):
        base = prose(100 + group, 150)
        rows += [(100 + 20 * group + k, edited(base, 1000 * group + k, 0.012)) for k in range(8)]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = near_rows()
    got = op3.near_duplicate_classes(corpus(spark, rows)).select("doc_id", "class_id").collect()
    root = classes(rows)
    least = collections.defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r].append(i)
    want = collections.Counter((i, min(least[r]) if least[r] else None) for (i, _), r in zip(rows, root, strict=True))
    assert collections.Counter(map(tuple, got)) == want
    assert op3.near_duplicate_classes(corpus(spark, [])).collect() == []


def test_one_row_of_each_class_stays(spark):
    rows = near_rows()
    df = corpus(spark, rows)
    kept = op3.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(classes(rows)))


def test_agreement_is_the_weighted_similarity():
    a = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bags = [np.r_[a[:300], a[:50]], np.r_[a[60:360], a[60:80]]]
    units = [op3.units_of_weight(b, np.zeros(len(b), np.int64)) for b in bags]
    one, two = (op3.signatures(u, np.zeros(len(u), np.int64), 1, 4000)[0] for u in units)
    counts = [collections.Counter(b.tolist()) for b in bags]
    shared = sum((counts[0] & counts[1]).values())
    assert abs((one == two).mean() - shared / (sum(map(len, bags)) - shared)) < 0.03
    assert not np.isinf(op3.signatures(a[:1], np.zeros(1, np.int64), 1, 130)).any()


def test_contained_items_equal_plain_sets(spark):
    items = [(1, prose(50, 30)), (2, prose(51, 12)), (3, prose(52, 5)), (4, "two words"), (5, None), (None, prose(53, 59)), (6, prose(54, 300))]
    rows = awkward()
    for k, (_, t) in enumerate(items):
        if t:
            rows += [(200 + k, prose(60 + k, 3000) + " " + t.upper() + " " + prose(70 + k, 900)), (300 + k, t), (400 + k, " ".join(t.split()[: len(t.split()) // 2]))]
            rows.append((500 + k, prose(80 + k, 200) + " " + edited(t, k, 0.02) + " end"))
    given = spark.createDataFrame([(i, t, 1) for i, t in [*items, items[0]]], "item_id long, text string, doc_id int")
    got = op9.contained_items(corpus(spark, rows), given).select("doc_id", "item_id", "n_shared", "n_shingles").collect()
    want = set()
    for i, t in rows:
        have = set(shingles(t))
        for j, u in items:
            need = set(shingles(u))
            if need and len(need & have) / len(need) >= 0.8:
                want.add((i, j, len(need & have), len(need)))
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    assert op9.contained_items(corpus(spark, []), given).collect() == []
    assert op9.contained_items(corpus(spark), given.limit(0)).collect() == []


def test_one_large_bucket_with_mixed_components(spark, monkeypatch):
    """Many families in the same buckets: blocks smaller than the bucket lose no link, and a task gives a forest only."""
    monkeypatch.setattr(op3, "BLOCK_NODES", 8)
    monkeypatch.setattr(op3, "PASSING_NODES", 16)
    monkeypatch.setattr(op3, "MATCHES", 500)
    rng = random.Random(4)
    base = prose(900, 60).split()
    texts = []
    for _family in range(9):
        own = [w if rng.random() > 0.02 else f"f{rng.randint(0, 99)}" for w in base]
        for _ in range(12):
            copy = list(own)
            copy[rng.randrange(60)] = f"c{rng.randint(0, 9999)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    nodes = spark.createDataFrame([(str(i).zfill(16).encode(), t) for i, t in rows], "node binary, text string")
    bags = op3.elements(nodes)
    buckets = nodes.selectExpr("1L AS key", "node").union(nodes.where("hex(node) > '3'").selectExpr("2L", "node"))
    got = {int(r.node): int(r.root) for r in op3.linked_components(buckets, bags, 0.8).collect()}
    want = classes(rows)
    assert len(set(want)) > 3
    assert {frozenset(i for i in got if got[i] == r) for r in got.values()} == {frozenset(i for i in range(len(want)) if want[i] == r) for r in want}
    mixed = op3._mixed(buckets, nodes.selectExpr("node", "node AS root"))
    links = op3._across_blocks(mixed, bags, 0.8)
    # each task gives fewer links than it has texts
    blocks, passing = -(-len(rows) // 8) + 1, -(-len(rows) // 16)
    assert links.count() <= 2 * blocks * passing * (8 + 2 * 16)


def test_a_common_opening_makes_no_rows(spark, monkeypatch):
    """Items and documents that share only their first words meet nowhere; an item that is in a document still does."""
    opening = "answer the following question with care "
    items = [(i, opening + prose(3000 + i, 40)) for i in range(60)]
    rows = [(i, opening + prose(4000 + i, 120)) for i in range(80)]
    rows.append((900, prose(5000, 300) + " " + items[7][1] + " " + prose(5001, 50)))
    # items that are nearly one text: their common shingles have to do
    twins = [(100 + i, prose(6000, 12) + f" last{i}") for i in range(30)]
    rows.append((901, prose(5002, 60) + " " + twins[4][1]))
    given = spark.createDataFrame([*items, *twins], "item_id long, text string")
    counted = []
    search = op9.sketch_hits

    def watched(*how):
        counted.append(search(*how))
        return counted[-1]

    monkeypatch.setattr(op9, "sketch_hits", watched)
    got = {(r.doc_id, r.item_id) for r in op9.contained_items(corpus(spark, rows), given).collect()}
    want = set()
    for i, t in rows:
        have = set(shingles(t))
        want |= {(i, j) for j, u in [*items, *twins] if len(set(shingles(u)) & have) / len(set(shingles(u))) >= 0.8}
    assert got == want and (900, 7) in got and (901, 104) in got
    # by item and document it would be 80 x 60 for each of the two shared shingles
    # a few share the word after it as well
    assert counted[0].where("row_id < 900").count() < 60
    assert counted[0].count() < 600


def test_chunks_of_few_words():
    for n in range(8):
        words = np.arange(1, n + 1, dtype=np.uint64)
        got, row = shingles_of(words, np.zeros(n, np.int64), np.array([n]))
        assert len(got) == (1 if 0 < n < 5 else max(n - 4, 0)) and not row.any()
