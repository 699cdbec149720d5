"""op12 against a plain tree."""

import collections
import hashlib
import random
import zlib

import pytest

from trawlmill.llm import op12_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, digest string, path string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict) -> str:
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests: list[str]) -> tuple[str, list[list[tuple[list[str], int]]]]:
    """Root, and for each leaf its runs with its places there."""
    paths = [[] for _ in digests]
    own = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, groups = [], []
        for start in range(0, len(digests), 16):
            run = digests[start : start + 16]
            for at, members in enumerate(own[start : start + 16]):
                for m in members:
                    paths[m].append((run, at))
            up.append(h(*run))
            groups.append([m for members in own[start : start + 16] for m in members])
        digests, own = up, groups
    return digests[0], paths


def plain(rows: list[dict]) -> collections.Counter:
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for own in sources.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    below = {s: tree([leaf(r) for r in sources[s]]) for s in names}
    root, above = tree([below[s][0] for s in names]) if names else (None, [])
    out = collections.Counter()
    for s, high in zip(names, above, strict=True):
        for r, low in zip(sources[s], below[s][1], strict=True):
            steps = low + high
            proof = h(*[x for run, at in steps for i, x in enumerate(run) if i != at])
            claim = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                claim["text"] = r["text"].translate(LOWER)
            folded = leaf(claim)
            for run, at in steps:
                folded = h(*run[:at], folded, *run[at + 1 :])
            out[r["doc_id"], leaf(r), below[s][0], root, proof, folded, folded == root] += 1
    return out


def rows_of(sizes: dict, seed: int = 1) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Abc é", "lower", "X" * rng.randint(0, 90)])
            out.append(
                {"doc_id": rng.choice([None, rng.randrange(10**6), rng.randrange(-50, 50)]), "text": text, "lang": rng.choice([None, "", "en"]),
                 "source": source, "n_chars": rng.choice([None, len(text or "")])}
            )
    rng.shuffle(out)
    return out + out[:3]


@pytest.mark.parametrize(
    "sizes",
    [
        {"web": 700, None: 20, "": 1, "é": 16, "z": 17, "b": 2},
        {"only": 300},
        {"only": 1},
        {None: 1, "a": 1},
        {f"s{i}": 1 + i % 3 * 8 for i in range(300)},
    ],
)
def test_against_a_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    if list(sizes.values()) == [1]:
        rows = rows[:1]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "x", "y") for r in rows], SCHEMA)
    got = collections.Counter(map(tuple, op12_merkle.document_proofs(docs.repartition(5)).collect()))
    assert got == plain(rows)


def test_empty_table(spark):
    got = op12_merkle.document_proofs(spark.createDataFrame([], SCHEMA))
    assert got.collect() == []
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_fan_out_and_jumps(spark):
    """Paths are as long as the tree is high, also where rounds of doubling overshoot."""
    rows = [(i, f"t{i}", "en", "a", 1) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = op12_merkle.build_manifest(op12_merkle.document_leaves(docs), fan_out=2)
    assert {len(r.path) for r in made.paths.where("level = 1").collect()} == {6}
    folded = op12_merkle.proofs(made).select("folded_root").distinct().collect()
    assert [r[0] for r in folded] == [made.root]
