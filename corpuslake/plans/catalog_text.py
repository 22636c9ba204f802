"""Queries on sources, text functions, keys and prompts."""

from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS
from corpuslake.functions import text as tx
from corpuslake.operators import history, maintain, vector
from corpuslake.plans.registry import query
from corpuslake.plans.views import MATCH, NORMAL, TOKENS, truncated
from corpuslake.session import shared_dir
from corpuslake.sources import files, questions, store, tables


# SQL form of the text of a page.
HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


def page_files(k):
    """Pages as files on the shared folder, one folder per host."""
    root = shared_dir(k.spark, "files")
    k.table("pages").select(
        F.parse_url("url", F.lit("HOST")).alias("host"),
        F.regexp_replace("html", r"[\r\n]+", " ").alias("value"),
    ).write.partitionBy("host").text(root)
    return root


@query("a1_scan_files")
def a1(k):
    return files.scan(k.spark, page_files(k)).select("source_path", "length")


@query("a2_text_load")
def a2(k):
    good, _ = files.split_rejects(files.load(files.scan(k.spark, page_files(k))))
    return good.select("document_id", "source_path", "file_hash", "file_size", F.length("text").alias("n_chars"))


@query("a2_load_by_type", f"""
SELECT 'pages/' || page_id || '.html' AS source_path, length({HTML}) AS n_chars,
       CASE WHEN {HTML} = '' THEN 'blank' END AS reject_reason FROM pages
UNION ALL
SELECT 'docs/' || doc_id || CASE doc_id % 6 WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' ELSE '.txt' END,
       CASE doc_id % 6 WHEN 0 THEN length(text) WHEN 1 THEN length(lang || chr(10) || source) WHEN 5 THEN 2 ELSE 0 END,
       CASE WHEN doc_id % 6 IN (2, 3) THEN 'needs_parser' WHEN doc_id % 6 = 4 THEN 'not_utf8'
            WHEN doc_id % 6 = 5 OR trim(text) = '' AND doc_id % 6 = 0 THEN 'blank' END
FROM documents""")
def a2b(k):
    """Pages and documents as files of six kinds; half of the documents are rejects."""
    pages = k.table("pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_path"),
        F.col("html").cast("binary").alias("content"))
    v = F.col("doc_id") % 6
    ending = F.when(v == 1, ".md").when(v == 2, ".pdf").when(v == 3, ".docx").otherwise(".txt")
    body = F.when(v == 1, F.concat(F.lit("# "), "lang", F.lit("\n> "), "source")).when(v == 5, " \n").otherwise(F.col("text"))
    bytes_ = F.when(v == 4, F.concat(F.unhex(F.lit("FF")), body.cast("binary"))).otherwise(body.cast("binary"))
    docs = k.table("documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), ending).alias("source_path"), bytes_.alias("content"))
    loaded = files.load(pages.unionByName(docs).withColumn("length", F.octet_length("content").cast("long")))
    return loaded.select("source_path", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "reject_reason")


@query("a3_html_to_text", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS content
FROM pages""")
def a3(k):
    return k.table("pages").select("page_id", tx.html_to_text(F.col("html")).alias("content"))


@query("a4_markdown_to_text")
def a4(k):
    marked = F.concat(
        F.lit("# "), "lang", F.lit("\n\n> **"), "source",
        F.lit("** with [a link](http://example.org) and `code`\n\n* "), "text",
    )
    return k.documents().select("document_id", tx.markdown_to_text(marked).alias("content"))


@query("a5_drop_blank", """
SELECT document_id, count(*) AS kept FROM klines GROUP BY 1""")
def a5(k):
    lines = k.documents().select("document_id", F.explode(F.split("text", "\n")).alias("line"))
    return files.drop_blank(lines, "line").groupBy("document_id").agg(F.count("*").alias("kept"))


def question_lines(k):
    """Benchmark items as JSON lines; five of six kinds break a rule."""
    v = F.col("item_id") % 6
    full = F.struct(
        F.when(v != 1, F.col("item_id").cast("string")).alias("id"),
        F.lit("tuning").alias("split"), F.lit("semantic").alias("category"),
        F.col("text").alias("question"),
        F.when(v == 2, "").otherwise(F.col("text")).alias("ground_truth"),
        F.when(v == 4, F.array(F.struct(F.lit("a.txt").alias("source")))).alias("relevant_sources"),
        F.when(v == 3, F.array().cast("array<string>")).otherwise(F.array(F.col("text")))
        .alias("answer_keywords"),
        (v == 4).alias("unanswerable"),
    )
    text = F.to_json(full)
    return k.table("benchmark").select(
        "item_id", F.when(v == 5, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("value")
    )


@query("a6_read_questions", """
SELECT CASE item_id % 6 WHEN 0 THEN CAST(item_id AS VARCHAR) ELSE NULL END AS id, item_id % 6 = 0 AS valid,
       CASE item_id % 6 WHEN 1 THEN 'missing id' WHEN 2 THEN 'no ground_truth' WHEN 3 THEN 'no answer_keywords'
            WHEN 4 THEN 'unanswerable with sources' WHEN 5 THEN 'invalid JSON' END AS reject_reason
FROM benchmark""")
def a6(k):
    return questions.parse(question_lines(k)).select(
        F.when(F.col("valid"), F.col("id")).alias("id"), "valid", "reject_reason"
    )


@query("a7_newest_documents", """
SELECT document_id, source_path, status, created_at FROM kdocs ORDER BY created_at DESC, document_id""")
def a7(k):
    return tables.newest_documents(k.documents()).select("document_id", "source_path", "status", "created_at")


@query("a7_chunks_of_documents", """
SELECT document_id, chunk_index, chunk_id FROM kactive ORDER BY 1, 2""")
def a7b(k):
    ready = tables.ready_documents(k.documents())
    return tables.chunks_of(k.chunks(), ready).select("document_id", "chunk_index", "chunk_id")


@query("a8_vector_write", """
SELECT chunk_id, document_id, 'g2' AS generation FROM kactive""")
def a8(k):
    target = store.Store(k.spark, shared_dir(k.spark, "store"))
    for generation in ("g1", "g2", "g2"):  # writing again replaces, never doubles
        target.write("vectors", k.chunk_vectors(), generation)
    return target.read("vectors", "g2").select("chunk_id", "document_id", "generation")


@query("a11_generation_catalogue", """
SELECT generation, count(*) AS count, generation = 'g2' AS is_active FROM kgens GROUP BY 1""")
def a11(k):
    return maintain.generation_catalogue(k.generations(), k.index_state())


@query("b1_content_hash", "SELECT doc_id, sha256(trim(text)) AS content_hash FROM documents")
def b1(k):
    return k.table("documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query("b2_chunk_id", "SELECT document_id, chunk_index, chunk_id FROM kchunks")
def b2(k):
    return k.chunks().select("document_id", "chunk_index", "chunk_id")


@query("b3_file_fingerprint", "SELECT page_id, sha256(html) AS file_hash FROM pages")
def b3(k):
    return k.table("pages").select("page_id", tx.file_fingerprint(F.col("html").cast("binary")).alias("file_hash"))


@query("b4_corpus_fingerprint", "SELECT fingerprint FROM kfp")
def b4(k):
    return maintain.corpus_fingerprint(k.documents())


@query("b5_index_signature", """
SELECT 'g2|2|hashing:md5-64|' || fingerprint || '|2024-01-02' AS signature FROM kfp""")
def b5(k):
    s = k.index_state()
    return s.select(tx.index_signature(*[F.col(c) for c in s.columns[1:]]).alias("signature"))


@query("b6_token_count", "SELECT doc_id, greatest(1, length(text) // 2) AS n_tokens FROM documents")
def b6(k):
    return k.table("documents").select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


@query("b7_context_source", """
SELECT document_id, source || '/' || document_id || '.txt' AS source FROM kdocs""")
def b7(k):
    return k.documents().select("document_id", tx.context_source(F.col("source_path")).alias("source"))


@query("b8_eval_source", r"""
SELECT document_id, source || '/' || document_id || '.txt' AS source FROM kdocs""")
def b8(k):
    windows = F.concat(F.lit("D:\\Work\\.\\Data\\DOCS\\\\"), "source", F.lit("\\"), "document_id", F.lit(".txt"))
    return k.documents().select("document_id", tx.eval_source(windows).alias("source"))


@query("b9_retrieval_queries", """
SELECT query_id, unnest(generate_series(0, len(a) - 1)) AS query_index, unnest(a) AS query FROM (
  SELECT query_id, CASE WHEN replace(lower(query), ' ', '') = replace(query, ' ', '')
                        THEN [trim(query)] ELSE [trim(query), trim(lower(query))] END AS a FROM kqueries)""")
def b9(k):
    rewritten = F.concat(F.lit(" "), F.lower("query"), F.lit("\n"))
    queries = tx.retrieval_queries(F.col("query"), rewritten)
    return k.queries().select("query_id", F.posexplode(queries).alias("query_index", "query"))


@query("b10_ready_documents", "SELECT document_id FROM kdocs WHERE status = 'ready'")
def b10(k):
    return tables.ready_documents(k.documents()).select("document_id")


@query("b11_upload_check", """
SELECT page_id, CASE WHEN contains(url, '://') THEN 'unsafe_name' END AS path_reason,
       CASE WHEN page_id % 4 = 0 THEN 'reserved_name' WHEN page_id % 4 = 1 THEN 'unsupported_type'
            WHEN page_id % 4 = 2 THEN 'too_large' END AS reject_reason FROM pages""")
def b11(k):
    v = F.col("page_id") % 4
    listing = k.table("pages").select(
        "page_id", "url",
        F.when(v == 0, "Com1.txt").when(v == 1, F.concat("page_id", F.lit(".exe")))
        .otherwise(F.concat("page_id", F.lit(".HTML"))).alias("name"),
        F.when(v == 2, 50 * 1024 * 1024 + 1).otherwise(F.octet_length("html")).alias("size"),
    )
    return files.check_uploads(listing).select(
        "page_id", tx.upload_reject_reason(F.col("url"), F.col("size")).alias("path_reason"), "reject_reason"
    )


@query("b12_preview", "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents")
def b12(k):
    return k.table("documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


PLAIN = "Answer from the sources only.\nSources:\n{context}\nQuestion:\n{query}\n"
CHAT = "Answer from the sources only.\nHistory:\n{history}\nSources:\n{context}\nQuestion:\n{query}\n"


@query("b13_prompts", r"""
SELECT c.conversation_id, CASE WHEN coalesce(h.history, '') <> ''
  THEN 'Answer from the sources only.' || chr(10) || 'History:' || chr(10) || h.history || chr(10) || 'Sources:' || chr(10)
       || c.user_id || chr(10) || 'Question:' || chr(10) || c.conversation_id || chr(10)
  ELSE 'Answer from the sources only.' || chr(10) || 'Sources:' || chr(10) || c.user_id || chr(10) || 'Question:'
       || chr(10) || c.conversation_id || chr(10) END AS prompt
FROM kconvs c LEFT JOIN khist h USING (conversation_id)""")
def b13(k):
    formatted = history.format_history(history.trim(k.messages()))
    return k.conversations().join(formatted, "conversation_id", "left").select(
        "conversation_id",
        tx.fill_prompt(
            PLAIN, CHAT, F.col("conversation_id").cast("string"), F.col("user_id"), F.col("history")
        ).alias("prompt"),
    )


@query("b14_question_split", """
SELECT query_id FROM kquestions WHERE split = 'tuning'""")
def b14(k):
    from corpuslake.operators import evaluate

    return evaluate.by_split(k.questions().withColumnRenamed("query_id", "id"), "tuning").select(
        F.col("id").alias("query_id")
    )


@query("b15_stale_documents", """
SELECT document_id, status <> 'ready' OR coalesce(error_message, '') <> '' OR index_schema_version <> 2 AS stale
FROM kstored""")
def b15(k):
    return k.stored().select(
        "document_id", maintain.is_stale(F.col("file_hash")).alias("stale")
    )


GRAPH_STATUS = "CASE chunk_index % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END"


def graph_work(k):
    i = F.col("chunk_index") % 5
    return k.chunks().withColumns({
        "graph_status": F.when(i == 0, "pending").when(i == 1, "failed").otherwise("completed"),
        "graph_schema_version": F.when(F.length("content") < 100, 0).otherwise(1),
    })


@query("b16_graph_work", f"""
SELECT chunk_id, 'pending' AS run FROM kactive WHERE {GRAPH_STATUS} = 'pending' OR length(content) < 100
UNION ALL SELECT chunk_id, 'retry' FROM kactive
WHERE {GRAPH_STATUS} IN ('pending', 'failed') OR length(content) < 100
UNION ALL SELECT chunk_id, 'full' FROM kactive""")
def b16(k):
    from corpuslake.operators import graph_build

    pick = lambda name, **how: graph_build.select_work(graph_work(k), k.documents(), **how).select(
        "chunk_id", F.lit(name).alias("run")
    )
    return pick("pending").unionByName(pick("retry", retry_failed=True)).unionByName(
        pick("full", only_pending=False)
    )


# --- scalar functions ------------------------------------------------------

@query("i1_normalize_name", f"""
SELECT query_id, {NORMAL.format('query')} AS name FROM kqueries""")
def i1(k):
    from corpuslake.operators.graph_build import with_normalized

    return with_normalized(k.queries(), "query", "name").select("query_id", "name")


@query("i2_match_score", f"""
SELECT c_custkey, round({MATCH.format(q="'customer ' || lower(c_mktsegment) || ' ' || lower(n_name)", c='lower(n_name)')}, 6) AS in_query,
       round({MATCH.format(q='lower(n_name)', c="lower(n_name) || lower(c_name)")}, 6) AS in_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def i2(k):
    joined = k.table("customer").join(
        k.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    nation = F.lower("n_name")
    question = F.concat(F.lit("customer "), F.lower("c_mktsegment"), F.lit(" "), nation)
    return joined.select(
        "c_custkey", F.round(tx.match_score(question, nation), 6).alias("in_query"),
        F.round(tx.match_score(nation, F.concat(nation, F.lower("c_name"))), 6).alias("in_name"),
    )


@query("i3_alias_score", f"""
SELECT n_nationkey, round(max(greatest(0.0::DOUBLE, {MATCH.format(q="lower(n_name) || ' trade'", c='lower(s_name)')} - 0.25::DOUBLE)), 6) AS other,
       round(max(greatest(0.0::DOUBLE, {MATCH.format(q="lower(n_name) || ' trade'", c='lower(n_name)')} - 0.25::DOUBLE)), 6) AS own
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def i3(k):
    joined = k.table("nation").join(
        k.table("supplier"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    asked = F.concat(F.lower("n_name"), F.lit(" trade"))
    return joined.groupBy("n_nationkey").agg(
        F.round(F.max(tx.alias_score(asked, F.lower("s_name"))), 6).alias("other"),
        F.round(F.max(tx.alias_score(asked, F.lower("n_name"))), 6).alias("own"),
    )


@query("i4_strip_model_noise", "SELECT doc_id, trim(text) AS answer FROM documents")
def i4(k):
    noisy = F.concat(F.lit("<think>a\nb</think> \n```json\n"), "text", F.lit("\n```\n"))
    return k.table("documents").select("doc_id", tx.strip_model_noise(noisy).alias("answer"))


@query("i5_quoted_in", r"""
SELECT chunk_id, true AS own, contains(regexp_replace(content, '\s+', '', 'g'), 'theof') AS phrase FROM kchunks""")
def i5(k):
    spaced = F.regexp_replace("content", " ", "\n  ")
    return k.chunks().select(
        "chunk_id", tx.quoted_in(spaced, F.col("content")).alias("own"),
        tx.quoted_in(F.lit("the \n of"), F.col("content")).alias("phrase"),
    )


@query("i6_json_failure_as_data", """
SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, o_orderkey % 10 <> 5 AS ok,
       CASE WHEN o_orderkey % 10 = 5 THEN 'answer is not a JSON object' END AS error FROM orders""")
def i6(k):
    return k.order_parsed().select("chunk_id", "ok", "error")


@query("i7_truncate", f"""
SELECT doc_id, {truncated('text', '200')} AS cut FROM documents""")
def i7(k):
    return k.table("documents").select(
        "doc_id", tx.truncate_at_sentence(F.col("text"), F.lit(200)).alias("cut")
    )


@query("i8_fact_text", """
SELECT s_suppkey, s_name || ' --PART_OF--> ' || n_name AS fact FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def i8(k):
    joined = k.table("supplier").join(k.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "s_suppkey", tx.fact_text(F.col("s_name"), F.lit("PART_OF"), F.col("n_name")).alias("fact")
    )


@query("i9_quote_hash", "SELECT relation_id, chunk_id, sha256(quote) AS quote_hash FROM gev")
def i9(k):
    return k.order_graph().evidence.select("relation_id", "chunk_id", "quote_hash")


@query("i10_format_history", "SELECT conversation_id, history FROM khist")
def i10(k):
    return history.format_history(history.trim(k.messages()))


@query("i11_decay_and_discount", """
SELECT doc_id, round(pow(0.75::DOUBLE, doc_id % 3), 6) AS decay, round(1.0::DOUBLE / log2(doc_id + 2), 6) AS discount,
       round(1.0::DOUBLE / (doc_id + 1), 6) AS reciprocal FROM documents""")
def i11(k):
    n = F.col("doc_id")
    return k.table("documents").select(
        "doc_id", F.round(F.pow(F.lit(0.75), n % 3), 6).alias("decay"),
        F.round(F.lit(1.0) / F.log2(n + F.lit(2.0)), 6).alias("discount"),
        F.round(F.lit(1.0) / (n + 1), 6).alias("reciprocal"),
    )


@query("i12_keyword_recall", """
SELECT query_id, CASE WHEN len(answer_keywords) = 0 THEN 0.0::DOUBLE ELSE
  round(len(list_filter(answer_keywords, lambda w: contains(lower(substr(query, 1, length(query) // 2)), w)))::DOUBLE
        / len(answer_keywords), 6) END AS recall FROM kquestions""")
def i12(k):
    answer = F.upper(F.substring("query", F.lit(1), F.floor(F.length("query") / 2).cast("int")))
    return k.questions().select(
        "query_id", F.round(tx.keyword_recall(answer, F.col("answer_keywords")), 6).alias("recall")
    )


@query("i13_tokenize", f"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS joined
FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)""")
def i13(k):
    return k.table("documents").withColumn("t", tx.tokens(F.col("text"))).select(
        "doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("joined")
    )


@query("i14_iso_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS written_at FROM events""")
def i14(k):
    return k.table("events").select("event_id", tx.iso_timestamp(F.col("ts")).alias("written_at"))


@query("i16_first_facts", """
SELECT c_custkey, array_to_string(list_sort(list(o_orderkey || ' by ' || o_orderpriority))[1:3], '; ') AS facts
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def i16(k):
    from corpuslake.operators import ranking

    facts = k.table("orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(" by "), "o_orderpriority").alias("fact"),
    )
    first = ranking.top_k(facts, ["c_custkey"], [F.asc("fact")], 3)
    return first.groupBy("c_custkey").agg(
        F.array_join(F.slice(F.array_sort(F.collect_list("fact")), 1, 3), "; ").alias("facts")
    )


@query("o1_hashed_embedding", """
SELECT document_id, 64 AS dims, CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) > 0
       THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM kdocs""")
def o1(k):
    return vector.hashed_embedding(k.documents().select("document_id", "text"), "text").select(
        "document_id", F.size("embedding").alias("dims"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"),
    )
