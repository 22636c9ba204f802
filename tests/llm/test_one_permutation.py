import hashlib
import random
import re
import struct

import xxhash

from corpuslake.llm import one_permutation as op

SCHEMA = "doc_id long, text string"


def chained(*values, seed=42):
    """Hash of several columns, each with the one before as its seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<i" if abs(v) < 1 << 31 and k32(v) else "<q", v), seed)
    return seed


def k32(v):
    return isinstance(v, Place)


class Place(int):
    """A number that is an int column, not a long."""


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_fingerprint(text):
    words = [signed(chained(w.encode())) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return ""
    seen = {signed(chained(*words[i : i + 5])) for i in range(max(1, len(words) - 4))}
    bins = {}
    for h in seen:
        b = (h >> 56) + 128
        bins[b] = min(h, bins.get(b, h))
    digits = []
    for b, walk in enumerate(op.walks()):
        step = pow(walk["inverse"], -1, 256)
        filled = next(x for t in range(256) if (x := b if b in bins else (walk["start"] + step * t) % 256) in bins)
        digits.append(chained(bins[filled], Place(b)) & 15)
    return "".join(f"{x:x}" for i in range(0, 256, 16) for x in reversed(digits[i : i + 16]))


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(chained(r[1].encode()))))
    out = []
    for k, (d, t) in enumerate(rows):
        other, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        prints = [brute_fingerprint(x) for x in (t, edited, other)]

        def alike(a, b):
            if not a or not b:
                return float(a == b)
            same = sum(x == y for x, y in zip(a, b)) / 256
            return round(max(0.0, (same - 1 / 16) / (1 - 1 / 16)), 9)

        out.append((-1 if d is None else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[0], prints[1],
                    alike(prints[0], prints[1]), alike(prints[0], prints[2])))
    return sorted(out)


def answer(spark, rows, schema=SCHEMA, partitions=3):
    df = spark.createDataFrame(rows, schema).repartition(partitions)
    return sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 9), round(r[6], 9)) for r in op.fingerprints(df).collect())


def prose(rng, n, words=300):
    return rng.choice([" ", "\n", " \t"]).join(f"w{rng.randrange(words)}" for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([1, 3, 5, 6, 20, 80, 400, 1500]))) for i in rng.sample(range(-50, 900), 90)]
    assert answer(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "null id"), (None, "other null id"), (1, None), (2, ""), (3, " \n\t"), (4, "É \U0001F600 ß\x0bend"),
            (4, "tie"), (4, "tie"), (5, "one"), (6, prose(random.Random(1), 60_000, 10**6)), (7, "x" * 300_000)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == []
    assert answer(spark, [(1, "alone a b c d e")]) == brute([(1, "alone a b c d e")])


def test_clashing_columns(spark):
    rows = [(i, f"text {i} of some words here") for i in range(20)]
    wide = [(*r, 3, True, "z", 4) for r in rows]
    assert answer(spark, wide, SCHEMA + ", range int, late boolean, own string, h long") == brute(rows)


def test_estimates_are_close_and_unbiased(spark):
    rng = random.Random(9)
    rows, errors = [], []
    for i in range(300):
        rows.append((i, prose(rng, rng.randrange(30, 900), 10**6)))
    for r, (d, t) in zip(sorted(op.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()), rows):
        edited = t[: len(t) - len(t) // 2] + rows[(d + 1) % 300][1][: len(t) // 2]
        a, b = shingles(t), shingles(edited)
        errors.append(r["near_edited"] - len(a & b) / len(a | b))
        assert r["near_next"] < 0.15
    assert abs(sum(errors) / 300) < 0.01 and max(map(abs, errors)) < 0.16
