import random

from corpuslake.llm import jaccard_join as jj


def brute(rows):
    """n_shingles and component of each row, by comparing every pair."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        out.append((doc, len(sets[i]), None if doc is None else min(group)))
    return sorted(out, key=str)


def case(seed, n):
    rng = random.Random(seed)
    shared = " ".join(f"s{k}" for k in range(60))
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 6, 8, 10, 14, 40, 90]))] for _ in range(n // 6)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        if rng.random() < 0.1:
            words = words[: rng.randrange(1, len(words) + 1)]
        text = rng.choice([" ", "\n", "\t "]).join(words)
        if rng.random() < 0.3:
            text += " " + shared
        texts.append(text.upper() if rng.random() < 0.1 else text)
    return texts


def answer(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    return sorted([tuple(r) for r in jj.join(df).collect()], key=str)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        texts = case(seed, 150)
        ids = random.Random(seed).sample(range(10_000), len(texts))
        rows = list(zip(ids, texts))
        assert answer(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "É"), (7, "é"), (None, "one"),
            (9, "a b c d e"), (10, "a  b\tc\nd e"), (10, "a b c d e f g"), (12, " ".join(map(str, range(30_000))))]
    assert answer(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, "a b", 8, "y")], "doc_id long, text string, n long, node string")
    assert sorted(map(tuple, jj.join(df).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_boundary_and_subsets():
    assert jj.subset_sizes(5, 8) == [4, 5]
    assert [jj.overlap(10, 10), jj.overlap(9, 10)] == [9, 9]
    assert jj.prefix_size(10) == 3
