import random

from corpuslake.operators import chunking


def test_split_covers_text_in_order_under_the_limit():
    rng = random.Random(1)
    ends = ["", "。", ". ", "\n", "\n\n", "! "]
    for _ in range(30):
        text = " ".join(f"w{i:04d}{rng.choice(ends)}" for i in range(rng.randrange(1, 400)))
        text += "".join(chr(0x4E00 + i) for i in range(700))
        pieces = chunking.split_text(text, 100, 20)
        # Sizes are summed per piece and rounded down, so a chunk may be half a token
        # per piece longer.
        assert all(len(p) // 2 <= 150 for p in pieces)
        left = "".join(text.split())
        at = 0
        for piece in pieces:
            flat = "".join(piece.split())
            found = at if left.startswith(flat, at) else left.find(flat)
            assert 0 <= found <= at
            at = max(at, found + len(flat))
        assert at == len(left)


def test_tiny_tail_and_dedup(spark):
    rows = [("d", 0, "a" * 400), ("d", 1, "tiny"), ("d", 2, "b" * 400), ("d", 3, "a" * 400), ("e", 0, "tiny"), ("e", 1, "c" * 400)]
    pieces = spark.createDataFrame(rows, "document_id string, pos long, content string")
    merged = {(r.document_id, r.pos): r.content for r in chunking.merge_tiny_tails(pieces).collect()}
    assert merged[("d", 0)] == "a" * 400 + "\ntiny"
    assert merged[("e", 0)] == "tiny" and merged[("e", 1)] == "c" * 400
    kept = sorted((r.document_id, r.chunk_index, r.pos) for r in chunking.dedup_pieces(pieces).collect())
    assert kept == [("d", 0, 0), ("d", 1, 1), ("d", 2, 2), ("e", 0, 0), ("e", 1, 1)]


def test_semantic_pieces_break_at_far_sentences_and_fall_back(spark):
    from pyspark.sql import functions as F

    from corpuslake.operators import vector

    topic = lambda name, n: " ".join(f"{name} {name} {name} w{i}." for i in range(n))
    text = topic("apples", 6) + " " + topic("engines", 6) + " " + topic("rivers", 6)
    pieces = spark.createDataFrame([("d", 0, text), ("d", 1, "One only."), ("e", 0, ""), ("e", 1, None), ("f", 0, "?!")],
                                   "document_id string, pos long, content string")
    embed = lambda rows: vector.hashed_embedding(rows, "content")
    got = {(r.document_id, r.pos, r.group_id): r.content for r in chunking.semantic_pieces(pieces, embed, 0.85).collect()}
    assert [got["d", 0, g].split()[0] for g in range(3)] == ["apples", "engines", "rivers"]
    assert " ".join(got["d", 0, g] for g in range(3)) == text and got["d", 1, 0] == "One only."
    assert set(k[0] for k in got) == {"d"}

    documents = spark.createDataFrame([("x", text * 20), ("y", " ")], "document_id string, text string")
    broken = lambda rows: rows.withColumn("embedding", F.raise_error(F.lit("no model")))
    plain = chunking.semantic_chunks(documents, broken).orderBy("pos").collect()
    whole = chunking.semantic_chunks(documents, embed).orderBy("pos").collect()
    assert plain and whole and {r.document_id for r in plain + whole} == {"x"}
    assert max(len(r.content) for r in plain + whole) < 3 * 384  # sizes of single pieces are rounded down
