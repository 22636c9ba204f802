"""One test for each fault that was once in the library."""

import json

import numpy as np
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.functions.register import register_sql
from corpuslake.operators import fusion, graph_build, vector
from corpuslake.streaming.ingest import StreamTables


def parsed(spark, *answers):
    rows = [(f"c{i}", "d", "Alpha uses Beta daily", json.dumps(a)) for i, a in enumerate(answers)]
    table = spark.createDataFrame(rows, "chunk_id string, document_id string, content string, raw string")
    return {r.chunk_id: r for r in graph_build.parse_responses(table).collect()}


def answer(**change):
    relation = {"subject": "a", "predicate": "USES", "object": "b", "evidence": "Alpha uses Beta"} | change
    return {"entities": [{"local_id": "a", "name": "Alpha", "type": "TERM"}, {"local_id": "b", "name": "Beta", "type": "TERM"}],
            "relations": [relation]}


def test_fields_of_a_wrong_type_drop_their_element(spark):
    predicate = graph_build.PREDICATES[0]
    kept = [answer(predicate=predicate, **c) for c in ({}, {"confidence": 0.9}, {"confidence": "0.7"})]
    gone = [answer(predicate=predicate, **c) for c in ({"confidence": "high"}, {"confidence": None}, {"confidence": [1]}, {"subject": 5})]
    got = parsed(spark, *kept, *gone)
    assert [[r.confidence for r in got[f"c{i}"].relations] for i in range(7)] == [[0.8], [0.9], [0.7], [], [], [], []]
    wrong = answer(predicate=predicate)
    wrong["entities"][0]["aliases"] = "text"
    wrong["entities"][1]["aliases"] = []
    assert [e.local_id for e in parsed(spark, wrong)["c0"].entities] == ["b"]


def test_the_json_of_an_answer_is_read_once(spark):
    table = spark.createDataFrame([("c", "d", "Alpha uses Beta", "{}")], "chunk_id string, document_id string, content string, raw string")
    plan = graph_build.parse_responses(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
    body = json.dumps(answer(predicate=graph_build.PREDICATES[0]))
    raws = (body, f" {body}\n", f"```json\n{body}\n```", f"{body}```", f"<think>{{}}</think>{body}", f"<think>a</think>\n```{body}\n```\n")
    rows = spark.createDataFrame([("c", "d", "Alpha uses Beta daily", r) for r in raws], table.schema)
    got = graph_build.parse_responses(rows).collect()
    assert len(got) == len(raws) and all(r.ok and len(r.entities) == 2 and len(r.relations) == 1 for r in got)


def test_kept_tables_share_their_join(spark):
    predicate = graph_build.PREDICATES[0]
    table = spark.createDataFrame([(c, "d", "Alpha uses Beta daily", json.dumps(answer(predicate=predicate))) for c in ("c", "c", "e", None)],
                                  "chunk_id string, document_id string, content string, raw string")
    answers = graph_build.parse_responses(table)
    plain, kept = graph_build.merge_graph(answers), graph_build.merge_graph(answers, kept=True)
    for name in ("relations", "evidence"):
        assert "Join" not in getattr(kept, name)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("entities", "aliases", "mentions", "relations", "evidence"):
        a, b = getattr(plain, name), getattr(kept, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), name


def test_upsert_keeps_the_highest_confidence(spark):
    predicate = graph_build.PREDICATES[0]
    two = answer(predicate=predicate, confidence=0.6)
    two["relations"].append(dict(two["relations"][0], confidence=0.95))
    table = spark.createDataFrame([("c", "d", "Alpha uses Beta daily", json.dumps(two))],
                                  "chunk_id string, document_id string, content string, raw string")
    answers = graph_build.parse_responses(table)
    graph = graph_build.merge_graph(answers)
    again = graph_build.upsert(graph, answers)
    for name in ("entities", "aliases", "mentions", "relations", "evidence"):
        first, second = getattr(graph, name), getattr(again, name)
        columns = sorted(first.columns)
        rows = lambda df: sorted(map(str, df.select(*columns).collect()))
        assert rows(first) == rows(second), name
    assert [r.confidence for r in again.relations.collect()] == [0.95]


def test_rows_without_chunk_id_are_results_of_their_own(spark):
    rows = [("q", 0, "vector", 1.0, 0, None, ["x"]), ("q", 0, "vector", 1.0, 1, None, None), ("q", 1, "bm25", 1.0, 0, "c", ["y"]),
            ("q", 0, "vector", 1.0, 2, "c", ["x"])]
    lists = spark.createDataFrame(rows, "query_id string, list_pos int, channel string, weight double, rank int, chunk_id string, "
                                        "matched_queries array<string>")
    lists = lists.selectExpr("*", "cast(array() as array<string>) AS graph_facts", "cast(null as double) AS graph_score")
    got = fusion.rrf(lists).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c", None, None]
    assert got[0].matched_queries == ["x", "y"]


def test_a_path_that_changed_its_body_gives_it_free(spark, tmp_path):
    index = StreamTables(spark, str(tmp_path / "index"))
    files = lambda *rows: spark.createDataFrame(rows, "source_path string, file_hash string, file_size long, text string")
    index.apply(files(("p", "A", 1, "body a")), 1)
    index.apply(files(("p", "B", 1, "body b")), 2)
    index.apply(files(("q", "A", 1, "body a"), ("r", "B", 1, "body b")), 3)
    assert {(r.source_path, r.file_hash) for r in index.documents().collect()} == {("p", "B"), ("q", "A")}
    assert [(r.source_path, r.existing_path) for r in index.duplicates().collect()] == [("r", "p")]


def test_sql_tokens_equal_the_column_function(spark):
    register_sql(spark)
    df = spark.createDataFrame([("Ab-c 知识图谱 x1é 中",), ("plain Text",), ("",), (None,)], "t string")
    got = df.selectExpr("t", "corpus_tokens(t) AS a").withColumn("b", tx.tokens(df.t)).collect()
    assert all(r.a == r.b for r in got) and "知识" in got[0].a


def test_lsh_fills_up_to_k_and_tiles_do_not_matter(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id < 10").withColumnRenamed("chunk_id", "query_id")
    exact = {(r.query_id, r.chunk_id) for r in vector.search(queries, vectors, 8).collect()}
    tiled = {(r.query_id, r.chunk_id) for r in vector.search(queries, vectors, 8, tile_cells=50).collect()}
    near = {(r.query_id, r.chunk_id) for r in vector.search_lsh(queries, vectors, 8).collect()}
    assert exact == tiled and len(near) == 80 and len(near & exact) >= 72
