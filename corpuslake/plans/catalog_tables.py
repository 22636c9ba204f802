"""Queries on chunking, joins, aggregates, windows, top-k and set operations."""

from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS
from corpuslake.functions import text as tx
from corpuslake.operators import (
    bm25, chunking, context, evaluate, fusion, graph_build, graph_query, history, maintain, ranking, vector,
)
from corpuslake.plans.registry import query
from corpuslake.plans.views import BUCKETS, TOKENS
from corpuslake.sources import tables

# --- chunking --------------------------------------------------------------


@query("c1_recursive_split")
def c1(k):
    parts = k.documents().select("document_id", F.lit(0).alias("part_index"), F.col("text").alias("content"))
    return chunking.split_documents(parts, partitions=8).select(
        "document_id", "piece_index", F.length("content").alias("n_chars"), "content"
    )


@query("c2_tail_merge", """
SELECT document_id, (grp - 1)::BIGINT AS group_no, string_agg(content, chr(10) ORDER BY pos) AS content FROM (
  SELECT *, sum(CASE WHEN first OR NOT tiny THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS grp
  FROM (SELECT *, greatest(1, length(content) // 2) < 80 AS tiny,
               row_number() OVER (PARTITION BY document_id ORDER BY pos) = 1 AS first FROM klines))
GROUP BY 1, grp""")
def c2(k):
    merged = chunking.merge_tiny_tails(k.lines().select("document_id", "pos", "content"))
    return ranking.position(merged.withColumn("pos", F.col("pos").cast("long")), ["document_id"], "pos", "group_no").select(
        "document_id", "group_no", "content"
    )


@query("c3_dedup_pieces", """
SELECT document_id, chunk_index, content_hash, content FROM kchunks""")
def c3(k):
    return chunking.dedup_pieces(k.lines().select("document_id", "pos", "content")).select(
        "document_id", "chunk_index", "content_hash", tx.strip(F.col("content")).alias("content")
    )


@query("c4_semantic_groups", """
SELECT document_id, unit_id, distance, group_id::BIGINT AS group_id FROM (
  SELECT *, sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY unit_id) AS group_id
  FROM (SELECT *, quantile_cont(distance, 0.95) OVER (PARTITION BY document_id) AS threshold FROM (
    SELECT label::BIGINT AS document_id, vec_id AS unit_id,
      round(1 - list_dot_product(e, p) / (sqrt(list_dot_product(e, e) * list_dot_product(p, p))), 6) AS distance
    FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e,
                 lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings))))""")
def c4(k):
    units = k.table("embeddings").select(
        F.col("label").alias("document_id"), F.col("vec_id").alias("unit_id"), "embedding"
    )
    return chunking.semantic_groups(units).select("document_id", "unit_id", "distance", "group_id")


@query("c4_semantic_pieces", r"""
WITH s AS (
  SELECT document_id, pos, row_number() OVER (PARTITION BY document_id, pos ORDER BY i) - 1 AS sn, content FROM (
    SELECT document_id, pos, unnest(range(len(l))) AS i, trim(unnest(l)) AS content FROM (
      SELECT document_id, pos, regexp_extract_all(content, '[^.!?。！？]+[.!?。！？]*') AS l FROM klines))
  WHERE content <> ''),
b AS MATERIALIZED (
  SELECT document_id, pos, sn, b, count(*) AS n FROM (
    SELECT document_id, pos, sn, """ + BUCKETS.format(TOKENS.format("content")) + r""" AS b FROM s) GROUP BY ALL),
norm AS (SELECT document_id, pos, sn, sqrt(sum(n * n)) AS z FROM b GROUP BY ALL),
dots AS (SELECT x.document_id, x.pos, y.sn, sum(x.n * y.n) AS dot FROM b x JOIN b y
         ON x.document_id = y.document_id AND x.pos = y.pos AND y.sn = x.sn + 1 AND x.b = y.b GROUP BY ALL),
d AS (SELECT s.*, CASE WHEN m.z IS NOT NULL AND n.z IS NOT NULL THEN round(1 - coalesce(dot, 0) / (m.z * n.z), 6) END AS distance
      FROM s LEFT JOIN norm n USING (document_id, pos, sn)
      LEFT JOIN norm m ON m.document_id = s.document_id AND m.pos = s.pos AND m.sn = s.sn - 1
      LEFT JOIN dots USING (document_id, pos, sn)),
t AS (SELECT *, quantile_cont(distance, 0.95) OVER (PARTITION BY document_id, pos) AS far FROM d),
g AS (SELECT *, sum(CASE WHEN distance > far THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, pos ORDER BY sn) AS group_id FROM t)
SELECT document_id, pos, group_id::BIGINT AS group_id, string_agg(content, ' ' ORDER BY sn) AS content
FROM g GROUP BY document_id, pos, group_id""")
def c4c(k):
    """Every line of every document as a piece."""
    lines = k.lines().select("document_id", F.col("pos").cast("long").alias("pos"), "content")
    return chunking.semantic_pieces(lines, lambda rows: vector.hashed_embedding(rows, "content"))


@query("c4_semantic_chunks")
def c4b(k):
    found = chunking.semantic_chunks(k.documents(), lambda rows: vector.hashed_embedding(rows, "content"), partitions=8)
    return found.select("document_id", "part_index", "piece_index", "content")


@query("c5_chunk_records")
def c5(k):
    return chunking.chunk_documents(k.documents(), partitions=8).select(
        "chunk_id", "document_id", "chunk_index", "token_count", "content",
        F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata_keys"),
    )


# --- joins -----------------------------------------------------------------

@query("d1_active_chunks", "SELECT chunk_id, document_id, chunk_index FROM kactive")
def d1(k):
    return maintain.active_chunks(k.chunks(), k.documents()).select("chunk_id", "document_id", "chunk_index")


@query("d2_chunk_source", """
SELECT c.chunk_id, coalesce(s.source_path, 'unknown') AS source_path
FROM kchunks c LEFT JOIN kstored s ON s.document_id = c.document_id""")
def d2(k):
    return tables.with_source(k.chunks().drop("source_path"), k.stored()).select("chunk_id", "source_path")


@query("d3_owned_messages", """
SELECT conversation_id, turn, role, text FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.conversation_id ORDER BY turn DESC) AS rn
  FROM kmessages m JOIN kreqs r USING (conversation_id) JOIN kconvs c USING (conversation_id, user_id)
  WHERE status = 'completed') WHERE rn <= 10""")
def d3(k):
    return history.messages_for(
        k.history_requests(), k.conversations(), k.messages(), DEFAULTS.max_history_messages
    ).select("conversation_id", "turn", "role", "text")


@query("d4_conversation_detail", """
SELECT conversation_id, user_id, turn, text FROM kmessages JOIN kreqs USING (conversation_id)
JOIN kconvs USING (conversation_id, user_id)""")
def d4(k):
    return history.conversation_detail(k.history_requests(), k.conversations(), k.messages()).select(
        "conversation_id", "user_id", "turn", "text"
    )


@query("d4_user_conversations", """
SELECT conversation_id, user_id, updated_at FROM kconvs WHERE user_id IN (SELECT user_id FROM kreqs)""")
def d4b(k):
    return history.conversations_of(k.history_requests().select("user_id"), k.conversations()).select(
        "conversation_id", "user_id", "updated_at"
    )


@query("d5_snapshot_join", "SELECT source_path, change FROM kdiff")
def d5(k):
    return maintain.classify(k.documents(), k.stored()).select("source_path", "change")


@query("d6_id_differences", """
SELECT chunk_id, 'missing' AS kind FROM kactive WHERE chunk_id NOT IN (SELECT chunk_id FROM kgens WHERE generation = 'g1')
UNION ALL SELECT chunk_id, 'unexpected' FROM kgens WHERE generation = 'g1' AND chunk_id NOT IN (SELECT chunk_id FROM kactive)""")
def d6(k):
    return maintain.id_differences(k.active_chunks(), k.generations().where("generation = 'g1'"))


@query("d7_stale_vectors", """
SELECT chunk_id, document_id FROM kgens
WHERE generation = 'g1' AND document_id IN (SELECT document_id FROM kdocs WHERE status <> 'ready')""")
def d7(k):
    behind = k.documents().where("status <> 'ready'")
    return maintain.stale_vectors(
        k.generations().where("generation = 'g1'"), k.active_chunks(), behind
    ).select("chunk_id", "document_id")


def thinned(k):
    """Order graph after the machinery customers' evidence and mentions are gone."""
    gone = k.order_texts().where("c_mktsegment = 'MACHINERY'").select("chunk_id")
    return graph_build.drop_chunks(k.order_graph(stored=True), gone)


THIN_EV = "(SELECT * FROM gev WHERE chunk_id NOT IN (SELECT chunk_id FROM ktexts WHERE c_mktsegment = 'MACHINERY'))"
THIN_GM = "(SELECT * FROM gm WHERE chunk_id NOT IN (SELECT chunk_id FROM ktexts WHERE c_mktsegment = 'MACHINERY'))"


@query("d8_live_relations", f"""
SELECT relation_id FROM gr WHERE relation_id IN (SELECT relation_id FROM {THIN_EV})""")
def d8(k):
    return graph_build.live_relations(thinned(k)).select("relation_id")


@query("d9_orphan_entities", f"""
WITH live AS (SELECT * FROM gr WHERE relation_id IN (SELECT relation_id FROM {THIN_EV}))
SELECT entity_id FROM ge WHERE entity_id NOT IN (SELECT entity_id FROM {THIN_GM} UNION
  SELECT subject_id FROM live UNION SELECT object_id FROM live)""")
def d9(k):
    graph = thinned(k)
    return graph.entities.join(
        graph_build.clean_orphans(graph).entities.select("entity_id"), "entity_id", "left_anti"
    ).select("entity_id")


@query("d10_dangling_ends", """
SELECT chunk_id, count(*) AS kept FROM krels GROUP BY 1""")
def d10(k):
    return k.order_parsed().where(F.size("relations") > 0).select("chunk_id", F.size("relations").alias("kept"))


@query("d11_duplicate_uploads", """
SELECT d.document_id, s.existing_id FROM kdocs d LEFT JOIN (
  SELECT file_hash, arg_max(document_id, (created_at, document_id)) AS existing_id
  FROM kstored WHERE status <> 'deleted' GROUP BY 1) s USING (file_hash)""")
def d11(k):
    uploads = k.documents().select("document_id", "file_hash")
    return maintain.duplicate_uploads(uploads, k.stored()).select("document_id", "existing_id")


@query("d12_posting_join", """
SELECT query_id, chunk_id, count(*) AS shared_tokens FROM kposts JOIN kqt USING (token) GROUP BY ALL""")
def d12(k):
    return bm25.shared_tokens(k.queries(), k.keyword_index())


@query("d13_name_pairs", """
SELECT query_id, normalized_name AS name_norm FROM tq JOIN (SELECT DISTINCT normalized_name FROM te)
ON contains(query_norm, normalized_name) OR contains(normalized_name, query_norm)""")
def d13(k):
    asked = graph_build.with_normalized(k.trade_queries(), "query", "query_norm", nfkc=False)
    names = k.trade_graph().entities.select(F.col("normalized_name").alias("name_norm"))
    return graph_query.name_pairs(asked, names).select("query_id", "name_norm")


@query("d14_frontier_join", """
SELECT query_id, relation_id, side FROM th1""")
def d14(k):
    from dataclasses import replace

    graph = k.trade_graph()
    seeds = graph_query.search_entities(k.trade_queries(), graph, nfkc=False)
    one = replace(DEFAULTS, graph_max_hops=1)
    return graph_query.neighbors(seeds, graph, one).select("query_id", "relation_id", "side")


@query("d15_evidence_join", """
SELECT v.chunk_id, s.canonical_name AS subject_name, predicate, o.canonical_name AS object_name, v.quote
FROM tr r JOIN tev v USING (relation_id) JOIN te s ON s.entity_id = subject_id JOIN te o ON o.entity_id = object_id""")
def d15(k):
    g = k.trade_graph()
    names = g.entities.select("entity_id", "canonical_name")
    edges = (
        g.relations.join(names.toDF("subject_id", "subject_name"), "subject_id")
        .join(names.toDF("object_id", "object_name"), "object_id")
    )
    return graph_query.relation_evidence(edges, g).select(
        "chunk_id", "subject_name", "predicate", "object_name", "quote"
    )


@query("d16_relevant_hits", """
SELECT query_id, regexp_replace(source, '^data/docs/', '') AS source_key FROM krelevant""")
def d16(k):
    return k.relevant().select("query_id", tx.eval_source(F.col("source")).alias("source_key")).distinct()


# --- aggregates ------------------------------------------------------------

@query("e1_counts", """
SELECT (SELECT count(*) FROM kactive) AS chunks, (SELECT count(*) FROM ge) AS entities,
       (SELECT count(*) FROM gr) AS relations""")
def e1(k):
    g = k.order_graph()
    total = lambda df: df.agg(F.count("*")).scalar()
    return k.active_chunks().agg(F.count("*").alias("chunks")).select(
        "chunks", total(g.entities).alias("entities"), total(g.relations).alias("relations")
    )


@query("e2_graph_stats", """
SELECT 'entities' AS table_name, count(*) AS n FROM ge UNION ALL SELECT 'aliases', count(*) FROM ga
UNION ALL SELECT 'mentions', count(*) FROM gm UNION ALL SELECT 'relations', count(*) FROM gr
UNION ALL SELECT 'evidence', count(*) FROM gev""")
def e2(k):
    return graph_query.table_counts(k.order_graph(stored=True))


@query("e3_token_statistics", f"""
WITH p AS MATERIALIZED (
  SELECT chunk_id, {TOKENS.format('content')} AS t FROM kactive),
c AS MATERIALIZED (SELECT token, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(t) AS token FROM p) GROUP BY token),
s AS MATERIALIZED (SELECT count(*) AS n_chunks, avg(len(t)) AS avg_length FROM p),
r AS MATERIALIZED (
  SELECT token, df, n_chunks, avg_length, ln(n_chunks - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM c, s),
m AS MATERIALIZED (SELECT 0.25::DOUBLE * round(avg(raw), 9) AS least FROM r)
SELECT token, df, round(CASE WHEN raw < 0 THEN least ELSE raw END, 6) AS idf, n_chunks, round(avg_length, 6) AS avg_length
FROM r, m""")
def e3(k):
    index = k.keyword_index()
    return index.tokens.select(
        "token", "df", F.round("idf", 6).alias("idf"), index.stats.select("n_chunks").scalar().alias("n_chunks"),
        F.round(index.stats.select("avg_length").scalar(), 6).alias("avg_length"),
    )


@query("e6_mean_metrics", """
SELECT round(coalesce(avg(recall_at_5) FILTER (WHERE NOT unanswerable), 0), 6) AS recall_at_5,
       round(coalesce(avg(mrr_at_10) FILTER (WHERE NOT unanswerable), 0), 6) AS mrr_at_10
FROM m2 JOIN kquestions USING (query_id)""")
def e6(k):
    from corpuslake.plans.catalog_retrieval import metrics_two

    joined = metrics_two(k).join(k.questions().select("query_id", "unanswerable"), "query_id")
    mean = lambda name: F.round(
        F.coalesce(F.avg(F.when(~F.col("unanswerable"), F.col(name))), F.lit(0.0)), 6
    ).alias(name)
    return joined.agg(mean("recall_at_5"), mean("mrr_at_10"))


@query("e7_stage_percentiles", """
SELECT event_type AS stage, round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50,
       quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def e7(k):
    return evaluate.stage_percentiles(k.timings())


@query("e7_total_time", """
WITH t AS (SELECT event_type AS stage, value FROM events
           UNION ALL SELECT 'total', round(sum(value), 6) FROM events GROUP BY user_id)
SELECT stage, round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM t GROUP BY stage""")
def e7b(k):
    """Stages and whole times, a user's events standing for a question's stages."""
    rows = k.table("events").select("user_id", F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return evaluate.stage_percentiles(rows, "user_id")


@query("e8_run_counters", """
SELECT run_id, count(*) AS total, count(*) AS processed, count(*) FILTER (WHERE ok) AS succeeded,
       count(*) FILTER (WHERE NOT ok) AS failed,
       CASE WHEN count(*) FILTER (WHERE NOT ok) = 0 THEN 'completed' ELSE 'partial' END AS status,
       coalesce(array_to_string((list(error ORDER BY item_id) FILTER (WHERE NOT ok))[1:20], '; '), '') AS errors
FROM (SELECT CAST(ts AS DATE)::VARCHAR AS run_id, event_id AS item_id, event_type <> 'error' AS ok,
             'user ' || user_id AS error FROM events) GROUP BY 1""")
def e8(k):
    items = k.table("events").select(
        F.to_date("ts").cast("string").alias("run_id"), F.col("event_id").alias("item_id"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("error"),
    )
    return maintain.run_counters(items).withColumn("errors", F.array_join("errors", "; "))


@query("e9_unanswerable_rates", """
SELECT metric, value FROM s2 WHERE metric LIKE 'unanswerable%'""")
def e9(k):
    from corpuslake.plans.catalog_retrieval import summary_two

    return summary_two(k).where(F.col("metric").startswith("unanswerable"))


@query("e10_question_set_hash")
def e10(k):
    return maintain.question_set_fingerprint(k.questions().withColumnRenamed("query_id", "id"))


@query("e11_relations_by_entity", """
SELECT subject_id AS entity_id, 'subject' AS side, relation_id, confidence FROM tr
UNION ALL SELECT object_id, 'object', relation_id, confidence FROM tr""")
def e11(k):
    return graph_query.relations_by_entity(k.trade_graph()).select(
        "entity_id", "side", "relation_id", "confidence"
    )


@query("e11_entity_mentions", """
SELECT e.canonical_name, m.chunk_id, m.document_id, m.mention FROM ge e JOIN gm m USING (entity_id)""")
def e11b(k):
    g = k.order_graph()
    return g.mentions.join(g.entities.select("entity_id", "canonical_name"), "entity_id").select(
        "canonical_name", "chunk_id", "document_id", "mention"
    )


# --- windows ---------------------------------------------------------------

@query("f1_rank_in_list", "SELECT query_id, chunk_id, rank FROM kbm25")
def f1(k):
    return bm25.search(k.queries(), k.active_chunks(), index=k.keyword_index()).select("query_id", "chunk_id", "rank")


@query("f2_first_occurrence", """
SELECT content_hash, min(document_id || ':' || lpad(chunk_index::VARCHAR, 9, '0')) AS first_place FROM kchunks GROUP BY 1""")
def f2(k):
    place = F.concat("document_id", F.lit(":"), F.lpad(F.col("chunk_index").cast("string"), 9, "0"))
    rows = k.chunks().select("content_hash", place.alias("first_place"))
    return ranking.first_per_key(rows, ["content_hash"], F.col("first_place"))


@query("f3_source_quota", """
SELECT conversation_id, turn, role FROM (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id, role ORDER BY turn) AS rn FROM kmessages)
  WHERE rn <= 2) WHERE n <= 5""")
def f3(k):
    rows = k.messages().select(
        F.col("conversation_id").alias("query_id"), F.col("turn").alias("rank"),
        F.col("role").alias("source"),
    )
    return context.source_quota(rows).select(
        F.col("query_id").alias("conversation_id"), F.col("candidate_rank").alias("turn"),
        F.col("source").alias("role"),
    )


@query("f4_recent_messages", """
SELECT conversation_id, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS rn FROM kmessages
  WHERE status = 'completed') WHERE rn <= 10""")
def f4(k):
    return ranking.top_k(
        history.completed(k.messages()), ["conversation_id"], [F.desc("turn")],
        DEFAULTS.max_history_messages
    ).select("conversation_id", "turn")


@query("f5_character_budget", "SELECT conversation_id, turn, running_chars FROM ktrim")
def f5(k):
    return history.trim(k.messages()).select("conversation_id", "turn", "running_chars")


@query("f6_hop_edge_limit", """
SELECT query_id, count(*) AS edges, max(hop)::BIGINT AS hops FROM thedges GROUP BY 1""")
def f6(k):
    graph = k.trade_graph()
    seeds = graph_query.search_entities(k.trade_queries(), graph, nfkc=False)
    return graph_query.neighbors(seeds, graph).groupBy("query_id").agg(
        F.count("*").alias("edges"), F.max("hop").alias("hops")
    )


@query("f7_dense_index", """
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events""")
def f7(k):
    return ranking.position(
        k.table("events").select("event_type", "event_id"), ["event_type"], "event_id", "pos", span=1 << 12
    )


@query("f8_first_samples", """
SELECT change, source_path FROM (
  SELECT *, row_number() OVER (PARTITION BY change ORDER BY source_path) AS rn FROM kdiff) WHERE rn <= 5""")
def f8(k):
    diff = maintain.classify(k.documents(), k.stored())
    return ranking.top_k(diff, ["change"], [F.asc("source_path")], 5).select("change", "source_path")


# --- top-k and listings ----------------------------------------------------

@query("g6_newest_listing", """
SELECT document_id, created_at FROM kstored ORDER BY created_at DESC, document_id LIMIT 20""")
def g6(k):
    return tables.newest_documents(k.stored(), 20).select("document_id", "created_at")


# --- set operations --------------------------------------------------------

@query("h1_union_lists", """
SELECT query_id, 0 AS list_pos, 'vector' AS channel, rank, chunk_id FROM kvec
UNION ALL SELECT query_id, 1, 'bm25', rank, chunk_id FROM kbm25""")
def h1(k):
    from corpuslake.plans.catalog_retrieval import text_index
    from corpuslake.plans.retrieval import channel_lists

    return fusion.union_lists(channel_lists(k.queries(), text_index(k))).select(
        "query_id", "list_pos", "channel", "rank", "chunk_id"
    )


@query("h2_source_intersection", """
SELECT document_id FROM kdocs SEMI JOIN (SELECT source_path FROM kstored) s USING (source_path)""")
def h2(k):
    return k.documents().join(k.stored().select("source_path"), "source_path", "left_semi").select("document_id")


@query("h3_id_difference", """
SELECT chunk_id FROM kgens WHERE generation = 'g1' EXCEPT SELECT chunk_id FROM kgens WHERE generation = 'g2'""")
def h3(k):
    g = k.generations()
    ids = lambda name: g.where(F.col("generation") == name).select("chunk_id")
    return ids("g1").join(ids("g2"), "chunk_id", "left_anti").distinct()


@query("h4_entity_id_union", """
SELECT entity_id FROM gm UNION SELECT subject_id FROM gr UNION SELECT object_id FROM gr""")
def h4(k):
    g = k.order_graph(stored=True)
    named = lambda df, c: df.select(F.col(c).alias("entity_id"))
    return named(g.mentions, "entity_id").unionByName(named(g.relations, "subject_id")).unionByName(
        named(g.relations, "object_id")
    ).distinct()


@query("h5_ordered_distinct", f"""
SELECT doc_id, array_to_string(list(w ORDER BY p), ' ') AS words FROM (
  SELECT doc_id, w, min(p) AS p FROM (
    SELECT doc_id, unnest(t) AS w, unnest(generate_series(1, len(t))) AS p
    FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)) GROUP BY ALL) GROUP BY 1""")
def h5(k):
    both = F.concat(tx.tokens(F.col("text")), tx.tokens(F.col("text")))
    return k.table("documents").select("doc_id", F.array_join(F.array_distinct(both), " ").alias("words"))
