import hashlib
import random

from corpuslake.llm import substring_dedup as sd


def brute(rows, window=50):
    starts = {}
    texts = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in texts:
        if doc is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                starts[key] = min(doc, starts.get(key, doc))
    out = []
    for doc, words in texts:
        gone = set()
        if doc is not None:
            for i in range(len(words) - window + 1):
                if starts[tuple(words[i : i + window])] < doc:
                    gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def answer(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted([tuple(r)[:4] for r in sd.dedup(df).collect()], key=str)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    passages = [[f"p{k}_{i}" for i in range(rng.choice([49, 50, 51, 60, 130]))] for k in range(8)]
    rows, texts = [], []
    for i in range(90):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 70))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.choice([0, 0, 1, 7])
                words += p[a:]
        if texts and rng.random() < 0.15:
            words = list(rng.choice(texts))
        texts.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rng.shuffle(rows)
    assert answer(spark, rows) == brute(rows)
    assert sum(r[2] > 0 for r in brute(rows)) > 20


def test_repeats_within_a_document_stay(spark):
    text = " ".join([f"w{i % 3}" for i in range(200)])
    rows = [(5, text), (7, "x " + text), (3, "w0 " * 49)]
    assert answer(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(map(str, range(20_000)))
    rows = [(1, None), (2, ""), (3, long), (4, long + " end"), (4, long), (None, long), (9, "É a " * 60)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == []


def test_cover_has_every_difference():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
