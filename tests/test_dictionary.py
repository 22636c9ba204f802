import random
import re

from corpuslake.operators import dictionary, graph_build

WORDS = ["alpha", "beta", "gamma", "delta", "of", "the"]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def brute(texts, names):
    """All matches of all names, but for those inside a longer one."""
    out = {}
    cut = {}
    for name in sorted(n for n in names if n and tokens(n)):
        cut.setdefault(tuple(tokens(name)), name)
    for key, text in texts:
        words = tokens(text or "")
        hits = [(i, i + len(n) - 1, name) for i in range(len(words)) for n, name in cut.items() if tuple(words[i : i + len(n)]) == n]
        longest = sorted(h for h in hits if not any(g[0] <= h[0] and g[1] >= h[1] and g[1] - g[0] > h[1] - h[0] for g in hits))
        if longest:
            out[key] = longest
    return out


def test_every_name_in_every_text_like_brute_force(spark):
    rng = random.Random(3)
    names = ["of", "the", "Alpha", "alpha", "alpha beta", "beta alpha beta", "of the", "the, of the", "delta gamma delta gamma", "x", "", None, "!?"]
    texts = [(f"c{i}", rng.choice([" ", ", ", "\n"]).join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(80)]
    texts += [("long", " ".join(rng.choice(WORDS) for _ in range(20_000))), ("null", None), ("empty", "")]
    df = spark.createDataFrame(texts, "chunk_id string, content string")
    got = dictionary.find_names(df, spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r.chunk_id: [tuple(n) for n in r.names] for r in got.collect()} == brute(texts, names)
    none = spark.createDataFrame([], "name string")
    assert dictionary.find_names(df, none).count() == 0 and dictionary.find_names(df.limit(0), none).count() == 0


def test_neighbours_and_significance_like_brute_force(spark):
    rng = random.Random(4)
    names = ["alpha", "beta", "gamma", "delta"]
    texts = []
    for i in range(60):
        words = [rng.choice(["of", "the", "so"]) for _ in range(30)]
        if i % 3 == 0:  # these two keep close company
            words[5], words[8] = "alpha", "beta"
        words[rng.randrange(9, 30)] = "gamma"
        words[rng.randrange(9, 30)] = "delta"
        texts.append((f"c{i}", " ".join(words)))
    df = spark.createDataFrame(texts, "chunk_id string, content string")
    found = dictionary.find_names(df, spark.createDataFrame([(n,) for n in names], "name string"))
    pairs = dictionary.neighbours(found, window=5)
    want = set()
    for key, hits in brute(texts, names).items():
        for a in hits:
            for b in hits:
                if a[1] < b[0] <= a[1] + 5 and a[2] != b[2]:
                    want.add((key, min(a[2], b[2]), max(a[2], b[2])))
    assert {(r.chunk_id, r["first"], r["second"]) for r in pairs.collect()} == want
    from pyspark.sql import functions as F

    told = {(r["first"], r["second"]): r for r in dictionary.significance(pairs, found, F.lit(len(texts))).collect()}
    assert told["alpha", "beta"].likelihood > 50 and told["alpha", "beta"].n == 20 and told["alpha", "beta"].closeness == 1.0
    assert told["delta", "gamma"].likelihood < 10.83


def test_responses_pass_validation_with_their_evidence(spark):
    texts = [(f"c{i}", "d", 0, f"So ALPHA, the; Beta ran. {i}" if i % 2 else f"nothing {i}") for i in range(40)]
    df = spark.createDataFrame(texts, "chunk_id string, document_id string, chunk_index int, content string")
    answers = dictionary.responses(df, spark.createDataFrame([("alpha",), ("beta",)], "name string"))
    parsed = graph_build.parse_responses(answers).collect()
    assert len(parsed) == 20 and all(r.ok and len(r.entities) == 2 for r in parsed)
    assert all([(x.predicate, x.evidence) for x in r.relations] == [("RELATED_TO", "ALPHA, the; Beta")] for r in parsed)


def test_nested_keys_are_no_fields(spark):
    raw = """{"entities": [
      {"local_id": "e1", "name": "A", "type": "TERM", "meta": {"name": 5}, "props": {"type": ["x"]}},
      {"local_id": "e2", "name": "B", "type": "TERM", "aliases": ["b"], "extra": {"aliases": 3, "description": {}}},
      {"local_id": "e3", "name": 7, "type": "TERM"}, {"local_id": "e4", "name": "D", "type": "TERM", "aliases": "d"}, 5, null],
     "relations": [{"subject": "e1", "predicate": "USES", "object": "e2", "evidence": "A uses B", "note": {"confidence": "no"}},
      {"subject": "e1", "predicate": "USES", "object": "e2", "evidence": "A uses B", "confidence": null},
      {"subject": "e1", "predicate": "USES", "object": "e2", "evidence": ["A"], "confidence": 0.7}]}"""
    df = spark.createDataFrame([("c", "d", "A uses B", raw)], "chunk_id string, document_id string, content string, raw string")
    row = graph_build.parse_responses(df).first()
    assert [e.name for e in row.entities] == ["A", "B"]
    assert [(r.subject, r.object, r.confidence) for r in row.relations] == [("e1", "e2", 0.8)]
