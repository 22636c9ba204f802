"""Queries on graph build and graph retrieval."""

from pyspark.sql import functions as F

from corpuslake.operators import dictionary, graph_build, graph_query
from corpuslake.plans.catalog_tables import THIN_EV, THIN_GM, thinned
from corpuslake.plans.catalog_text import graph_work
from corpuslake.plans.registry import query
from corpuslake.session import cut_lineage


@query("j1_parse_responses", """
SELECT t.chunk_id, v <> 5 AS ok, coalesce(e.n, 0) AS n_entities, coalesce(r.n, 0) AS n_relations
FROM ktexts t LEFT JOIN (SELECT chunk_id, count(*) AS n FROM kents GROUP BY 1) e USING (chunk_id)
LEFT JOIN (SELECT chunk_id, count(*) AS n FROM krels GROUP BY 1) r USING (chunk_id)""")
def j1(k):
    return k.order_parsed().select(
        "chunk_id", "ok", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations")
    )


@query("j1_valid_relations", """
SELECT chunk_id, CASE rpos WHEN 0 THEN 'e1' ELSE 'e2' END AS subject,
       CASE rpos WHEN 0 THEN 'e2' ELSE 'e3' END AS object, evidence, round(confidence, 6) AS confidence FROM krels""")
def j1b(k):
    return k.order_parsed().select("chunk_id", F.inline("relations")).select(
        "chunk_id", "subject", "object", "evidence", F.round("confidence", 6).alias("confidence")
    )


BATCHES = """
SELECT *, document_id || '/' || ((row_number() OVER (PARTITION BY document_id ORDER BY key) - 1) // 6) AS batch_id FROM ktexts"""


@query("j2_batch_check", f"""
SELECT batch_id, count(*) AS n_chunks, CASE WHEN min(key) % 5 = 0 THEN 0 ELSE count(*) END AS n_ok
FROM ({BATCHES}) GROUP BY 1""")
def j2(k):
    members = k.order_batches().select("batch_id", "chunk_id", "document_id", "content")
    parsed = graph_build.parse_batch_responses(k.batch_answers(), members)
    joined = parsed.select("chunk_id", "ok").join(members.select("chunk_id", "batch_id"), "chunk_id")
    return joined.groupBy("batch_id").agg(
        F.count("*").alias("n_chunks"), F.count_if("ok").alias("n_ok")
    )


J3 = """
WITH RECURSIVE o AS MATERIALIZED (
  SELECT chunk_id, document_id, chunk_index, content, length(content) AS chars,
         row_number() OVER (ORDER BY document_id, chunk_index) - 1 AS pos FROM kactive),
e AS MATERIALIZED (
  SELECT pos, 1 + (s1 <= 6000)::INT + (s2 <= 6000)::INT + (s3 <= 6000)::INT + (s4 <= 6000)::INT + (s5 <= 6000)::INT AS step
  FROM (SELECT pos, sum(chars) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s1,
    sum(chars) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s2,
    sum(chars) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s3,
    sum(chars) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s4,
    sum(chars) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s5 FROM o)),
b(start, step) AS (
  SELECT pos, step FROM e WHERE pos = 0
  UNION ALL SELECT e.pos, e.step FROM b JOIN e ON e.pos = b.start + b.step),
m AS (SELECT o.*, b.start::VARCHAR AS batch_id FROM o JOIN b ON o.pos >= b.start AND o.pos < b.start + b.step)
"""


@query("j3_form_batches", J3 + "SELECT chunk_id, document_id, chunk_index, batch_id FROM m")
def j3(k):
    return graph_build.form_batches(k.active_chunks()).select("chunk_id", "document_id", "chunk_index", "batch_id")


@query("j3_requests", J3 + """
SELECT batch_id, count(*) AS n_chunks, string_agg(chunk_id, ',' ORDER BY pos) AS chunk_ids,
       sum(least(chars, 6000))::BIGINT AS n_chars FROM m GROUP BY batch_id""")
def j3b(k):
    """The requests, and what their JSON holds when it is read again."""
    batched = graph_build.form_batches(k.active_chunks())
    asked = F.from_json("payload", "array<struct<chunk_id:string,content:string>>")
    return graph_build.requests(batched).withColumn("asked", asked).select(
        "batch_id", F.size("asked").cast("long").alias("n_chunks"),
        F.array_join(F.transform("asked", lambda a: a["chunk_id"]), ",").alias("chunk_ids"),
        F.aggregate("asked", F.lit(0).cast("long"), lambda s, a: s + F.length(a["content"])).alias("n_chars"))


@query("j4_confident_relations", """
SELECT chunk_id, count(*) AS n FROM krels WHERE confidence >= 0.6 GROUP BY 1""")
def j4(k):
    return graph_build.confident(k.order_parsed()).where(F.size("relations") > 0).select(
        "chunk_id", F.size("relations").alias("n")
    )


@query("j5_merge_entities", """
SELECT entity_id, entity_type, canonical_name, normalized_name, description FROM ge""")
def j5(k):
    return k.order_graph().entities.select(
        "entity_id", "entity_type", "canonical_name", "normalized_name", "description"
    )


@query("j6_merge_aliases", "SELECT entity_id, alias, normalized_alias FROM ga")
def j6(k):
    return k.order_graph().aliases.select("entity_id", "alias", "normalized_alias")


@query("j7_merge_mentions", "SELECT entity_id, chunk_id, document_id, mention, confidence FROM gm")
def j7(k):
    return k.order_graph().mentions.select("entity_id", "chunk_id", "document_id", "mention", "confidence")


@query("j8_merge_relations", """
SELECT relation_id, subject_id, predicate, object_id, round(confidence, 6) AS confidence FROM gr""")
def j8(k):
    return k.order_graph().relations.select(
        "relation_id", "subject_id", "predicate", "object_id", F.round("confidence", 6).alias("confidence")
    )


@query("j9_merge_evidence", """
SELECT relation_id, chunk_id, document_id, quote, round(confidence, 6) AS confidence FROM gev""")
def j9(k):
    return k.order_graph().evidence.select(
        "relation_id", "chunk_id", "document_id", "quote", F.round("confidence", 6).alias("confidence")
    )


@query("j10_replace_chunks", f"""
SELECT 'mention' AS kind, entity_id AS id, chunk_id FROM {THIN_GM}
UNION ALL SELECT 'evidence', relation_id, chunk_id FROM {THIN_EV}""")
def j10(k):
    g = thinned(k)
    return g.mentions.select(F.lit("mention").alias("kind"), F.col("entity_id").alias("id"), "chunk_id").unionByName(
        g.evidence.select(F.lit("evidence").alias("kind"), F.col("relation_id").alias("id"), "chunk_id")
    )


@query("j10_upsert_is_idempotent", """
SELECT 'entities' AS table_name, count(*) AS n FROM ge UNION ALL SELECT 'aliases', count(*) FROM ga
UNION ALL SELECT 'mentions', count(*) FROM gm UNION ALL SELECT 'relations', count(*) FROM gr
UNION ALL SELECT 'evidence', count(*) FROM gev""")
def j10b(k):
    from corpuslake.session import cut_lineage

    parsed = cut_lineage(graph_build.confident(k.order_parsed()))
    graph = graph_build.merge_graph(parsed, nfkc=False)
    return graph_query.table_counts(graph_build.upsert(graph, parsed, nfkc=False))


@query("j11_delete_documents", """
WITH gone AS (SELECT document_id FROM ktexts WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')),
ev AS (SELECT * FROM gev WHERE document_id NOT IN (SELECT document_id FROM gone)),
mn AS (SELECT * FROM gm WHERE document_id NOT IN (SELECT document_id FROM gone)),
rl AS (SELECT * FROM gr WHERE relation_id IN (SELECT relation_id FROM ev)),
en AS (SELECT * FROM ge WHERE entity_id IN (SELECT entity_id FROM mn UNION SELECT subject_id FROM rl UNION SELECT object_id FROM rl))
SELECT 'entities' AS table_name, count(*) AS n FROM en
UNION ALL SELECT 'aliases', count(*) FROM ga WHERE entity_id IN (SELECT entity_id FROM en)
UNION ALL SELECT 'mentions', count(*) FROM mn UNION ALL SELECT 'relations', count(*) FROM rl
UNION ALL SELECT 'evidence', count(*) FROM ev""")
def j11(k):
    gone = k.order_texts().where(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"))
    return graph_query.table_counts(graph_build.drop_documents(k.order_graph(stored=True), gone))


@query("j12_clean_orphans", f"""
WITH rl AS (SELECT * FROM gr WHERE relation_id IN (SELECT relation_id FROM {THIN_EV}))
SELECT entity_id FROM ge WHERE entity_id IN (SELECT entity_id FROM {THIN_GM} UNION SELECT subject_id FROM rl
  UNION SELECT object_id FROM rl)""")
def j12(k):
    return graph_build.clean_orphans(thinned(k)).entities.select("entity_id")


@query("j13_work_status", """
SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id,
       CASE WHEN o_orderkey % 10 = 5 THEN 'failed' ELSE 'completed' END AS graph_status,
       CASE WHEN o_orderkey % 10 = 5 THEN 0 ELSE 1 END AS graph_schema_version,
       CASE WHEN o_orderkey % 10 = 5 THEN 'answer is not a JSON object' END AS graph_error FROM orders""")
def j13(k):
    todo = k.order_texts().select(
        "chunk_id", F.lit("pending").alias("graph_status"), F.lit(0).alias("graph_schema_version"),
        F.lit(None).cast("string").alias("graph_error"),
    )
    return graph_build.work_status(todo, k.order_parsed())


# --- graph retrieval -------------------------------------------------------

@query("k4_entity_search", "SELECT query_id, entity_id, match_score, canonical_name, rank FROM tseeds")
def k4(k):
    return graph_query.search_entities(k.trade_queries(), k.trade_graph(), nfkc=False).select(
        "query_id", "entity_id", "match_score", "canonical_name", "rank"
    )


@query("k4_entity_search_documents", "SELECT query_id, entity_id, match_score, canonical_name, rank FROM dseeds")
def k4b(k):
    return graph_query.search_entities(k.queries(), k.document_graph(), nfkc=False).select(
        "query_id", "entity_id", "match_score", "canonical_name", "rank"
    )


@query("k5_neighbors", """
SELECT query_id, hop, relation_id, subject_name, predicate, object_name, round(confidence, 6) AS confidence FROM thedges""")
def k5(k):
    graph = k.trade_graph()
    seeds = graph_query.search_entities(k.trade_queries(), graph, nfkc=False)
    return graph_query.neighbors(seeds, graph).select(
        "query_id", "hop", "relation_id", "subject_name", "predicate", "object_name",
        F.round("confidence", 6).alias("confidence"),
    )


@query("k6_graph_search", """
SELECT query_id, chunk_id, graph_score, array_to_string(graph_facts, '; ') AS graph_facts, rank FROM tsearch""")
def k6(k):
    return graph_query.search(k.trade_queries(), k.trade_graph(), k.trade_chunks(), nfkc=False).withColumn(
        "graph_facts", F.array_join("graph_facts", "; ")
    ).select("query_id", "chunk_id", "graph_score", "graph_facts", "rank")


@query("g4_entity_topk", """
SELECT query_id, canonical_name, rank FROM tseeds WHERE rank < 3""")
def g4(k):
    return graph_query.search_entities(k.trade_queries(), k.trade_graph(), 3, nfkc=False).select(
        "query_id", "canonical_name", "rank"
    )


@query("g5_graph_chunk_topk", "SELECT query_id, chunk_id, rank FROM dsearch")
def g5(k):
    return graph_query.search(k.queries(), k.document_graph(), k.active_chunks(), nfkc=False).select(
        "query_id", "chunk_id", "rank"
    )


@query("o4_cooccurrence_extractor", """
SELECT chunk_id, count(DISTINCT name) AS n_entities, coalesce(any_value(r.n), 0) AS n_relations
FROM dm LEFT JOIN (SELECT chunk_id, count(*) AS n FROM dlinked GROUP BY 1) r USING (chunk_id) GROUP BY chunk_id""")
def o4(k):
    return graph_build.parse_responses(k.document_answers()).select(
        "chunk_id", F.size("entities").cast("long").alias("n_entities"), F.size("relations").cast("long").alias("n_relations")
    )


@query("o4_dictionary_matches", "SELECT chunk_id, name, start, \"end\" FROM dm")
def o4c(k):
    """Every place of every dictionary name in whole chunks; the longest of nested names."""
    found = dictionary.find_names(k.active_chunks(), k.names())
    return found.select("chunk_id", F.explode("names").alias("n")).select(
        "chunk_id", "n.name", F.col("n.start").cast("long").alias("start"), F.col("n.end").cast("long").alias("end"))


@query("o4_significant_pairs", """
SELECT a AS first, b AS second, n, likelihood, closeness FROM dsig WHERE likelihood >= 10.83""")
def o4d(k):
    chunks = k.active_chunks()
    found = cut_lineage(dictionary.find_names(chunks.select("chunk_id", "content"), k.names()), "found")
    told = dictionary.significance(dictionary.neighbours(found), found, chunks.agg(F.count("*")).scalar())
    return told.where("likelihood >= 10.83")


@query("o4_plugged_extractor")
def o4b(k):
    """A stand-in model that answers every batch with empty lists."""
    import json

    def model(payload: str) -> str:
        return json.dumps({"chunks": [
            {"chunk_id": item["chunk_id"], "entities": [], "relations": []}
            for item in json.loads(payload)
        ]})

    batched = graph_build.form_batches(k.active_chunks())
    answers = graph_build.run_extractor(graph_build.requests(batched), model)
    return graph_build.parse_batch_responses(
        answers, batched.select("batch_id", "chunk_id", "document_id", "content")
    ).select("chunk_id", "ok", "error")
