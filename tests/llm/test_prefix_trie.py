import hashlib
import random
import zlib

import pytest

from corpuslake.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes, straight from the definition."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, leaves_of = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, len(seq) == d))
    kids = {p: 0 for p in members}
    saved, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        own_size = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_size
            leaves[p[:d]] += not kids[p]
    return sorted(
        (min(m)[0], len(p), min(members[p[:-1]])[0] if p else -1, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c, ends in sorted(m) if ends).encode()).hexdigest())
        for p, m in members.items())


def answer(spark, rows, limit, schema=SCHEMA):
    got = pt.prefix_trie(spark.createDataFrame(rows, schema), container_rows=limit).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def case(seed, n, words=3, longest=8):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-3, 4 * n), n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn, rng.choice(["user", "bot"]), "é" * rng.randrange(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [3, 40, 10**6])
def test_matches_brute_force_at_every_container_size(spark, limit):
    rows = case(limit, 50, longest=6)
    assert answer(spark, rows, limit) == brute(rows)


def test_copies_and_long_conversations(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 400, 5) for t in range(3)]
    rows += [(1000, t, "user", f"{t % 7}") for t in range(300)] + [(1001, t, "user", f"{t % 7}") for t in range(299)]
    assert answer(spark, rows, 50) == brute(rows)


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    rows = [(5, None, None, None), (5, 0, "user", ""), (5, 0, "bot", "x"), (5, 0, "bot", "x"), (None, 1, "user", "lost"),
            (6, 1, "", None), (7, None, "user", "a\0b"), (7, None, "bot", "y" * 100_000), (1, 3, "user", "far")]
    assert answer(spark, rows, 4) == brute(rows)
    assert answer(spark, [], 4) == []
    # Sorted by place of the hash, equal turns of one role still give one sequence for equal rows.
    twins = [(c, 0, "user", text) for c in (10, 15) for text in ("b", "a")]
    assert sorted(r[:4] for r in answer(spark, twins, 4))[0] == (10, 0, -1, 2)


def test_turnless_conversations_are_members_of_the_root(spark):
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    c = next(c for c in range(1, 1000) if c % 5 and h(c) > 2)
    rows = [(c, 0, "user", "one"), (c, 1, "user", "two")]  # its opening conversation is absent
    assert answer(spark, rows, 5) == brute(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_clashing_columns(spark):
    rows = case(3, 20)
    wide = [(*r, b"box", 1, 2, "t") for r in rows]
    assert answer(spark, wide, 9, SCHEMA + ", box binary, seq long, depth long, t string") == brute(rows)
