import json

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import chunking, graph_build, graph_query, vector
from corpuslake.session import cut_lineage, shared_dir
from corpuslake.sources.store import Store
from corpuslake.streaming.ingest import StreamTables

TEXT = "The scheduler depends on the queue."


def answers(spark, raw, chunk="c1", doc="d1"):
    return spark.createDataFrame([(chunk, doc, TEXT, raw)], "chunk_id string, document_id string, content string, raw string")


def entity(local, name, kind="MODULE", **more):
    return {"local_id": local, "name": name, "type": kind, **more}


def relation(a, b, predicate="DEPENDS_ON", evidence="scheduler depends  on", **more):
    return {"subject": a, "predicate": predicate, "object": b, "evidence": evidence, **more}


def test_validation(spark):
    body = {"entities": [entity("e1", "Scheduler", aliases=["sched"]), entity("e2", "Queue"), entity("e3", "X", "PLANET")],
            "relations": [relation("e1", "e2"), relation("e1", "e3"), relation("e1", "e1"), relation("e1", "e2", "LIKES"),
                          relation("e1", "e2", evidence="absent"), relation("e1", "e9"), relation("e2", "e1", confidence=0.2)]}
    row = graph_build.parse_responses(answers(spark, f"```json\n{json.dumps(body)}\n```")).first()
    assert row.ok and [e.local_id for e in row.entities] == ["e1", "e2"]
    assert [(r.subject, r.object, r.confidence) for r in row.relations] == [("e1", "e2", 0.8), ("e2", "e1", 0.2)]
    assert not graph_build.parse_responses(answers(spark, "{broken")).first().ok
    assert not graph_build.parse_responses(answers(spark, "[1]")).first().ok


def test_upsert_twice_search_and_delete(spark):
    body = {"entities": [entity("e1", "Scheduler", aliases=["sched"]), entity("e2", "Queue")],
            "relations": [relation("e1", "e2", confidence=0.9)]}
    parsed = cut_lineage(graph_build.confident(graph_build.parse_responses(answers(spark, json.dumps(body)))))
    graph = graph_build.stored(graph_build.merge_graph(parsed))
    counts = lambda g: {r.table_name: r.n for r in graph_query.table_counts(g).collect()}
    want = {"entities": 2, "aliases": 1, "mentions": 2, "relations": 1, "evidence": 1}
    assert counts(graph) == want and counts(graph_build.upsert(graph, parsed)) == want
    asked = spark.createDataFrame([(1, "what does the Scheduler need"), (2, "is sched fast")], "query_id long, query string")
    found = {(r.query_id, r.canonical_name) for r in graph_query.search_entities(asked, graph).collect()}
    assert found == {(1, "Scheduler"), (2, "Scheduler")}
    hits = graph_query.search(asked, graph, answers(spark, "")).collect()
    assert {h.chunk_id for h in hits} == {"c1"}
    assert hits[0].graph_facts == ["Scheduler --DEPENDS_ON--> Queue"]
    empty = cut_lineage(graph_build.parse_responses(answers(spark, '{"entities": [], "relations": []}')))
    assert set(counts(graph_build.upsert(graph, empty)).values()) == {0}


def docs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, source_path string, text string").withColumns({
        "file_hash": F.sha2("text", 256), "file_size": F.length("text").cast("long")})


def embed(chunks):
    return vector.hashed_embedding(chunks.select("chunk_id", "document_id", "content"), "content")


def test_publish_audit_rollback(spark):
    store = Store(spark, shared_dir(spark, "store"))
    first = docs(spark, [("a", "a.txt", "one two\nthree"), ("b", "b.txt", "four")])
    assert store.sync("g1", first, chunking.line_chunks, embed)["status"] == "completed"
    assert store.active() == "g1" and store.read("chunks", "g1").count() == 3
    second = docs(spark, [("a", "a.txt", "one two\nfive\nsix"), ("c", "c.txt", " ")])
    out = store.sync("g2", second, chunking.line_chunks, embed)
    assert out["sync_status"] == "partial" and out["deleted"] == 1
    assert store.active() == "g2" and store.read("chunks", "g2").count() == 3
    assert store.rollback("g1")["status"] == "error" and store.active() == "g2"
    # a build whose vectors are incomplete is not published, the old one stays
    rows = store.read("chunks", "g2")
    lost = store.read("vectors", "g2").limit(1)
    bad = store.publish("g3", store.read("documents", "g2"), rows, lost)
    assert bad["status"] == "validation_failed" and store.active() == "g2"
    assert store.read("chunks", "g3").count() == 0
    assert store.cleanup("g2")["status"] == "error" and store.cleanup("g1")["status"] == "completed"
    assert store.readiness().first().status == "ok"
    with pytest.raises(ValueError):
        store.publish("g2", first, rows, lost)


def test_stream_replay_duplicates_and_retry(spark):
    tables = StreamTables(spark, shared_dir(spark, "stream"))
    batch = lambda *rows: docs(spark, [(None, *r) for r in rows]).drop("document_id")
    tables.apply(batch(("a", "one"), ("b", "one"), ("c", " ")), 0)
    assert {(r.source_path, r.status) for r in tables.documents().collect()} == {("a", "ready"), ("c", "failed")}
    assert [r.source_path for r in tables.duplicates().collect()] == ["b"]
    for _ in range(2):  # a replay of a batch changes nothing
        tables.apply(batch(("c", "now whole"), ("a", "one")), 1)
        assert {(r.source_path, r.status, r.chunk_batch) for r in tables.documents().collect()} == {
            ("a", "ready", 0), ("c", "ready", 1)}
        assert {r.content for r in tables.chunks().collect()} == {"one", "now whole"}


def test_deltas_chains_and_compaction(spark):
    store = Store(spark, shared_dir(spark, "store"), longest_chain=3)
    texts = {f"d{i}": f"line one of {i}\nline two of {i}" for i in range(6)}
    runs = []
    chunker = lambda docs: runs.append(1) or chunking.line_chunks(docs)
    for n in range(6):
        texts[f"d{n}"] = f"new text {n}"
        if n == 4:
            del texts["d0"]
        files = docs(spark, [(d, f"{d}.txt", t) for d, t in texts.items()])
        planned = store.sync(f"g{n}", files, chunker, embed, dry_run=True)
        assert planned["sync_status"] == "dry_run" and store.active() == (f"g{n - 1}" if n else None)
        out = store.sync(f"g{n}", files, chunker, embed)
        assert out["status"] == "completed" and planned["indexed"] == out["indexed"] == (6 if n == 0 else 1)
        assert len(runs) == n + 1 and len(store.chain(f"g{n}")) <= 3
        want = sorted(line for t in texts.values() for line in t.split("\n"))
        assert sorted(r.content for r in store.read("chunks", f"g{n}").collect()) == want
        assert store._stored("chunks").where(f"generation = 'g{n}'").count() == (11 if n == 0 else 1)
        assert store.readiness().first().status == "ok"
    assert store.read("documents", "g5").where("status = 'deleted'").count() == 1
    before = sorted(map(tuple, store.read("chunks", "g3").collect()))
    assert store.cleanup("g2")["status"] == "completed" and store.cleanup("g1")["status"] == "completed"
    assert sorted(map(tuple, store.read("chunks", "g3").collect())) == before
    assert {r.generation for r in store.catalogue().collect()} == {"g0", "g3", "g4", "g5"}


def test_a_failed_document_keeps_its_chunks_in_a_delta(spark):
    store = Store(spark, shared_dir(spark, "store"))
    store.sync("g1", docs(spark, [("a", "a.txt", "one"), ("b", "b.txt", "two")]), chunking.line_chunks, embed)
    out = store.sync("g2", docs(spark, [("a", "a.txt", " "), ("b", "b.txt", "two")]), chunking.line_chunks, embed)
    assert out["sync_status"] == "partial"
    assert sorted(r.content for r in store.read("chunks", "g2").collect()) == ["one", "two"]
    rows = {r.document_id: r for r in store.read("documents", "g2").collect()}
    assert rows["a"].error_message and not rows["b"].error_message and len(rows) == 2


def test_an_answer_is_parsed_once_whatever_reads_it(spark):
    parsed = graph_build.parse_responses(answers(spark, "{}")).withColumn("content", F.upper("content"))
    for read in (parsed.select("chunk_id", F.inline("relations")), parsed.where(F.size("relations") > 0), parsed):
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") + plan.count("jsontostructs(") <= 1 and plan.count("<think>") == 1
