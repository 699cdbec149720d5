"""op11 against a plain search over all edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from trawlmill.llm import op11_repair

SCHEMA = "conv_id long, turn long, role string, text string, at string, kind string, piece int"
ALLOWED = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for i, turn, role, text in rows:
        key = f"{' ' if i is None else i}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(i, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not ink else "d" if (role, text) in seen else "-" if ink[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Least (cost, audit, roles) over all edits, by places in the sequence and how many rows are used up."""
    start = (0, "", "")
    found = {"": start}

    def state(roles):
        """All that matters of a sequence: whether it may go on, and how."""
        return roles[:1] == "s", roles[-1:] if roles else ""

    def grown(options):
        best = {}
        todo = list(options)
        while todo:
            option = todo.pop()
            cost, audit, roles = option
            if not re.fullmatch(r"s?(ua)*u?", roles):
                continue
            key = state(roles)
            if key in best and best[key][:2] <= option[:2]:
                continue
            best[key] = option
            todo += [(cost + 2, audit + "I", roles + c) for c in "ua"]
        return list(best.values())

    found = grown([start])
    for (_, role, _), f in zip(rows, fault, strict=True):
        options = []
        for cost, audit, roles in found:
            options.append((cost + 3, audit + "D", roles))
            if f not in "bd":
                more = f == "t"
                options.append((cost + more, audit + "K", roles + (role[:1] if role[:1] in tuple("sua") else "?")))
                options += [(cost + 2 + more, audit + "R", roles + c) for c in "ua"]
        found = grown(options)
    return min(o for o in found if ALLOWED.fullmatch(o[2]))


def plain(conversations, damage_them=True):
    rows = damage(conversations) if damage_them else [(i, t, " " if r is None else r, " " if x is None else x) for i, t, r, x in conversations]
    out = collections.Counter()
    for i in {r[0] for r in conversations}:
        own = sorted(
            [(t, r, x) for j, t, r, x in rows if j == i],
            key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()),
        )
        fault = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, roles = cheapest(own, fault)
        left, names, lines = iter(own), iter(roles), []
        for edit in audit:
            row = next(left) if edit != "I" else (None, "", "")
            if edit != "D":
                name = next(names)
                lines.append(f"{row[1] if edit == 'K' else {'u': 'user', 'a': 'assistant'}[name]}:{row[2]}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[i, gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, digest] += 1
    return out


def made(n, seed=1, longest=12):
    rng = random.Random(seed)
    out = []
    for i in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Unit", "unit"])
            text = rng.choice(["Yes.", "No", " \n", "", None, "Why?\n", f"t{rng.random()}!", "a.\x0b b", " .", "x  "])
            out.append((i, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    return out


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def summaries(spark, rows):
    conversations = given(spark, rows).repartition(3)
    got = op11_repair.repair_summaries(conversations, op11_repair.damaged(conversations))
    return collections.Counter(map(tuple, got.collect()))


def test_small_conversations(spark):
    rows = made(250)
    assert summaries(spark, rows) == plain(rows)


def test_clean_conversations_stay(spark):
    rows = [(i, t, ["user", "assistant"][t % 2], f"text {i} {t}.") for i in range(30) for t in range(4)]
    conversations = given(spark, rows)
    got = op11_repair.repair_summaries(conversations, conversations.select("conv_id", "turn", "role", "text")).collect()
    assert {(r.cost, r.audit) for r in got} == {(0, "KKKK")} and len(got) == 30
    turns = op11_repair.repaired_turns(conversations.select("conv_id", "turn", "role", "text")).collect()
    assert sorted((r.conv_id, r.place, r.role, r.text) for r in turns) == sorted(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_long_conversations_over_many_segments(spark, monkeypatch, size):
    """Segments of a few rows give the same as whole conversations."""
    monkeypatch.setattr(op11_repair, "SEGMENT_ROWS", size)
    rows = made(12, seed=5, longest=90)
    assert summaries(spark, rows) == plain(rows)


def test_one_hot_conversation(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}."])) for t in range(6000)]
    rows += [(8, 1, "user", "Hi."), (9, None, None, None)]
    assert summaries(spark, rows) == plain(rows)


def test_nothing_left_and_no_rows(spark):
    dropped = [(i, t) for i in range(200) for t in range(3) if zlib.crc32(f"{i}:{t}".encode()) % 20 == 0][:5]
    rows = [(i, t, "user", "x.") for i, t in dropped]
    empty = hashlib.sha256(b"").hexdigest()
    assert summaries(spark, rows) == collections.Counter({(i, 0, 0, 0, 0, 0, 0, "", empty): 1 for i in {r[0] for r in rows}})
    assert summaries(spark, []) == collections.Counter()


def test_stacks_are_shared():
    parser = op11_repair.RoleParser()
    assert len(parser.tops) == len(set(parser.tops)) <= 10
    assert all(below < node for node, (_, below) in enumerate(parser.nodes) if node)
    words = [""]
    for _ in range(6):
        words += [w + c for w in words for c in "sua"]
    for word in set(words):
        tops = [0]
        for c in word:
            tops = [n for t in tops for n in parser.shifted(t, c)]
        assert any(t in parser.accepting for t in tops) == bool(ALLOWED.fullmatch(word)), word
