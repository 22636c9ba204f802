"""SQL forms of the derived inputs, for the checks."""

from corpuslake.plans.registry import VIEWS

TOKENS = (
    "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
)
NORMAL = (
    "translate(trim(regexp_replace(trim({0}), '\\s+', ' ', 'g'), '''!?。，.,;:、'), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
MATCH = """CASE WHEN length({q}) = 0 OR length({c}) = 0 THEN 0.0::DOUBLE
    WHEN {q} = {c} THEN 1.0::DOUBLE
    WHEN contains({q}, {c}) THEN 0.8::DOUBLE + 0.2::DOUBLE * length({c})::DOUBLE / length({q})
    WHEN contains({c}, {q}) THEN 0.5::DOUBLE + 0.3::DOUBLE * length({q})::DOUBLE / length({c})
    ELSE 0.0::DOUBLE END"""

VIEWS["kdocs"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS document_id,
       'data/docs/' || d.source || '/' || d.doc_id || '.txt' AS source_path,
       sha256(d.text) AS file_hash, CAST(strlen(d.text) AS BIGINT) AS file_size,
       CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 0 THEN 'pending' ELSE 'ready' END AS status,
       1704067200 + d.doc_id AS created_at, d.text, d.lang, d.source
FROM documents d LEFT JOIN labels l USING (doc_id)"""

VIEWS["klines"] = """
SELECT document_id, file_hash, source_path, pos - 1 AS pos, content FROM (
  SELECT document_id, file_hash, source_path, unnest(generate_series(1, len(l))) AS pos,
         unnest(l) AS content
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM kdocs))
WHERE trim(content) <> ''"""

VIEWS["kchunks"] = """
SELECT sha256(document_id || ':' || file_hash || ':2:' || chunk_index) AS chunk_id, document_id,
       file_hash, source_path, chunk_index, content, content_hash,
       greatest(1, length(content) // 2) AS token_count
FROM (
  SELECT document_id, file_hash, source_path, trim(content) AS content,
         sha256(trim(content)) AS content_hash,
         row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS chunk_index
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, trim(content) ORDER BY pos) AS rn
        FROM klines)
  WHERE rn = 1)"""

VIEWS["kactive"] = """
SELECT c.*, d.lang FROM kchunks c JOIN kdocs d USING (document_id) WHERE d.status = 'ready'"""

VIEWS["kqueries"] = "SELECT item_id AS query_id, text AS query FROM benchmark"

VIEWS["krelevant"] = """
SELECT q.query_id, d.source_path AS source FROM kqueries q JOIN kdocs d ON contains(d.text, q.query)"""

# --- BM25 ------------------------------------------------------------------
VIEWS["ktok"] = f"""
SELECT chunk_id, document_id, chunk_index, {TOKENS.format('content')} AS t FROM kactive"""
VIEWS["kposts"] = """
SELECT chunk_id, document_id, chunk_index, length, token, count(*) AS tf
FROM (SELECT chunk_id, document_id, chunk_index, len(t) AS length, unnest(t) AS token FROM ktok)
GROUP BY ALL"""
VIEWS["kstats"] = "SELECT count(*) AS n_chunks, avg(len(t)) AS avg_length FROM ktok"
VIEWS["kraw"] = """
SELECT token, df, ln(n_chunks - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
FROM (SELECT token, count(*) AS df FROM kposts GROUP BY token), kstats"""
VIEWS["kidf"] = """
SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT round(avg(raw), 9) FROM kraw)
                       ELSE raw END AS idf FROM kraw"""
VIEWS["kqt"] = f"""
SELECT query_id, token, count(*) AS qtf
FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS token FROM kqueries) GROUP BY ALL"""
VIEWS["kscores"] = """
SELECT query_id, chunk_id, document_id, chunk_index,
       round(sum(qtf * idf * tf * 2.5::DOUBLE
         / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score
FROM kposts JOIN kqt USING (token) JOIN kidf USING (token), kstats
GROUP BY query_id, chunk_id, document_id, chunk_index"""
VIEWS["kbm25"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY score DESC, document_id, chunk_index) - 1 AS rank
  FROM kscores WHERE score > 0) WHERE rank < 8"""

# --- hashed vectors --------------------------------------------------------
BUCKETS = (
    "unnest(list_transform({0}, lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % 64))"
)
VIEWS["kcb"] = f"""
SELECT chunk_id, b, count(*) AS n FROM (
  SELECT chunk_id, {BUCKETS.format('t')} AS b FROM ktok) GROUP BY ALL"""
VIEWS["kqb"] = f"""
SELECT query_id, b, count(*) AS n FROM (
  SELECT query_id, {BUCKETS.format(TOKENS.format('query'))} AS b FROM kqueries) GROUP BY ALL"""
VIEWS["kdots"] = """
SELECT q.query_id, c.chunk_id,
       round(coalesce(p.dot, 0) / (q.norm * c.norm), 6) AS score
FROM (SELECT query_id, sqrt(sum(n * n)) AS norm FROM kqb GROUP BY 1) q
CROSS JOIN (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM kcb GROUP BY 1) c
LEFT JOIN (SELECT query_id, chunk_id, sum(kqb.n * kcb.n) AS dot
           FROM kqb JOIN kcb USING (b) GROUP BY ALL) p USING (query_id, chunk_id)"""
VIEWS["kvec"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank
  FROM kdots) WHERE rank < 8"""

# --- order graph -----------------------------------------------------------
VIEWS["ktexts"] = """
SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS chunk_id,
       CAST(o_custkey AS VARCHAR) AS document_id, o_custkey, c_name, n_name, r_name,
       c_mktsegment, o_orderkey % 10 AS v
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
VIEWS["kents"] = f"""
SELECT *, {NORMAL.format('name')} AS normalized_name,
       sha256(type || '|' || {NORMAL.format('name')}) AS entity_id FROM (
  SELECT key, chunk_id, document_id, 'e1' AS local_id, 0 AS pos, c_name AS name, 'ROLE' AS type,
         'Cust ' || o_custkey AS alias,
         CASE WHEN v >= 5 THEN c_mktsegment ELSE '' END AS description
  FROM ktexts WHERE v <> 5
  UNION ALL
  SELECT key, chunk_id, document_id, 'e2', 1, n_name, 'ENVIRONMENT', NULL, NULL
  FROM ktexts WHERE v <> 5
  UNION ALL
  SELECT key, chunk_id, document_id, 'e3', 2, r_name, 'SYSTEM', NULL, NULL
  FROM ktexts WHERE v NOT IN (1, 5))"""
VIEWS["krels"] = """
SELECT key, chunk_id, document_id, 0 AS rpos, 'ROLE' AS stype, c_name AS subject,
       'ENVIRONMENT' AS otype, n_name AS object, c_name || ' is part of ' || n_name AS evidence,
       CASE WHEN v = 8 THEN 0.4::DOUBLE ELSE round(0.6::DOUBLE + (key % 40)::DOUBLE / 100, 2) END AS confidence
FROM ktexts WHERE v NOT IN (2, 3, 4, 5, 6)
UNION ALL
SELECT key, chunk_id, document_id, 1, 'ENVIRONMENT', n_name, 'SYSTEM', r_name,
       n_name || ' is part of ' || r_name, 0.9::DOUBLE
FROM ktexts WHERE v NOT IN (1, 5)"""
VIEWS["klinked"] = f"""
SELECT *, sha256(subject_id || '|PART_OF|' || object_id) AS relation_id FROM (
  SELECT *, sha256(stype || '|' || {NORMAL.format('subject')}) AS subject_id,
         sha256(otype || '|' || {NORMAL.format('object')}) AS object_id
  FROM krels WHERE confidence >= 0.6)"""
VIEWS["ge"] = """
SELECT entity_id, any_value(type) AS entity_type, any_value(normalized_name) AS normalized_name,
       arg_min(name, chunk_id) AS canonical_name,
       arg_min(description, chunk_id) FILTER (WHERE description <> '') AS description
FROM kents GROUP BY entity_id"""
VIEWS["ga"] = f"""
SELECT entity_id, {NORMAL.format('alias')} AS normalized_alias, min(alias) AS alias,
       sha256(entity_id || '|' || {NORMAL.format('alias')}) AS alias_id
FROM kents WHERE alias IS NOT NULL GROUP BY ALL"""
VIEWS["gm"] = """
SELECT entity_id, chunk_id, any_value(document_id) AS document_id, any_value(name) AS mention,
       1.0::DOUBLE AS confidence FROM kents GROUP BY entity_id, chunk_id"""
VIEWS["gr"] = """
SELECT relation_id, any_value(subject_id) AS subject_id, 'PART_OF' AS predicate,
       any_value(object_id) AS object_id, max(confidence) AS confidence
FROM klinked GROUP BY relation_id"""
VIEWS["gev"] = """
SELECT relation_id, chunk_id, sha256(evidence) AS quote_hash, any_value(document_id) AS document_id,
       any_value(evidence) AS quote, any_value(confidence) AS confidence
FROM klinked GROUP BY relation_id, chunk_id, sha256(evidence)"""

# --- trade graph -----------------------------------------------------------
def _eid(kind: str, name: str) -> str:
    return f"sha256('{kind}|' || {NORMAL.format(name)})"


VIEWS["te"] = f"""
SELECT *, {NORMAL.format('canonical_name')} AS normalized_name,
       sha256(entity_type || '|' || {NORMAL.format('canonical_name')}) AS entity_id FROM (
  SELECT 'ROLE' AS entity_type, c_name AS canonical_name FROM customer
  UNION SELECT 'MODULE', s_name FROM supplier UNION SELECT 'ENVIRONMENT', n_name FROM nation
  UNION SELECT 'SYSTEM', r_name FROM region UNION SELECT 'TERM', p_name FROM part)"""
VIEWS["ta"] = f"""
SELECT {_eid('MODULE', 's_name')} AS entity_id, 'Supp ' || s_suppkey AS alias,
       {NORMAL.format("('Supp ' || s_suppkey)")} AS normalized_alias FROM supplier"""
VIEWS["tstated"] = f"""
SELECT *, sha256(subject_id || '|' || predicate || '|' || object_id) AS relation_id FROM (
  SELECT {_eid('ROLE', 'c_name')} AS subject_id, 'PART_OF' AS predicate,
         {_eid('ENVIRONMENT', 'n_name')} AS object_id, CAST(o_custkey AS VARCHAR) AS document_id,
         CAST(o_orderkey AS VARCHAR) AS chunk_id, c_name || ' is part of ' || n_name AS quote,
         round(0.6::DOUBLE + (c_custkey % 40)::DOUBLE / 100, 2) AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT {_eid('ENVIRONMENT', 'n_name')}, 'PART_OF', {_eid('SYSTEM', 'r_name')},
         CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR),
         n_name || ' is part of ' || r_name, 0.9::DOUBLE
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT {_eid('MODULE', 's_name')}, 'PART_OF', {_eid('ENVIRONMENT', 'n_name')},
         CAST(s_suppkey AS VARCHAR), 's' || s_suppkey, s_name || ' is part of ' || n_name, 0.8::DOUBLE
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT {_eid('MODULE', 's_name')}, 'PROVIDES', {_eid('TERM', 'p_name')},
         CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), s_name || ' provides ' || p_name,
         round(0.6::DOUBLE + (l_suppkey % 40)::DOUBLE / 100, 2)
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
VIEWS["tr"] = """
SELECT relation_id, any_value(subject_id) AS subject_id, any_value(predicate) AS predicate,
       any_value(object_id) AS object_id, max(confidence) AS confidence
FROM tstated GROUP BY relation_id"""
VIEWS["tev"] = """
SELECT relation_id, chunk_id, min(document_id) AS document_id, min(quote) AS quote,
       max(confidence) AS confidence FROM tstated GROUP BY relation_id, chunk_id"""
VIEWS["tq"] = f"""
SELECT query AS query_id, query, {NORMAL.format('query')} AS query_norm FROM (
  SELECT 'Which suppliers are part of ' || n_name || '?' AS query FROM nation
  UNION SELECT 'Who provides a ' || p_name || '?' FROM part)"""


def seeds(queries: str, entities: str, aliases: str | None, k: int = 5) -> str:
    """Entity search as one statement."""
    names = f"SELECT entity_id, normalized_name AS nm, false AS is_alias FROM {entities}"
    if aliases:
        names += f" UNION ALL SELECT entity_id, normalized_alias, true FROM {aliases}"
    score = MATCH.format(q="q.query_norm", c="x.nm")
    return f"""
SELECT query_id, entity_id, match_score, canonical_name, rank FROM (
  SELECT m.*, e.canonical_name, row_number() OVER (PARTITION BY query_id
      ORDER BY match_score DESC, length(normalized_name), canonical_name, m.entity_id) - 1 AS rank
  FROM (SELECT q.query_id, x.entity_id, round(max(CASE WHEN is_alias
               THEN greatest(0.0::DOUBLE, {score} - 0.25::DOUBLE) ELSE {score} END), 6) AS match_score
        FROM {queries} q JOIN ({names}) x
          ON x.nm <> '' AND q.query_norm <> ''
         AND (contains(q.query_norm, x.nm) OR contains(x.nm, q.query_norm))
        GROUP BY ALL) m JOIN {entities} e USING (entity_id)) WHERE rank < {k}"""


def hop_views(prefix: str, seed: str, entities: str, relations: str, limit: int = 50) -> None:
    """Two hops, unrolled: the edges of both are the view ``<prefix>edges``."""
    def hop(frontier: str, blocked: str, used: str, number: int) -> str:
        side = lambda near, far, order: f"""
SELECT f.query_id, {order} AS side, r.*,
       row_number() OVER (PARTITION BY f.query_id ORDER BY r.relation_id) AS sn
FROM {relations} r JOIN {frontier} f ON r.{near} = f.entity_id
WHERE NOT EXISTS (SELECT 1 FROM ({blocked}) b WHERE b.query_id = f.query_id AND b.entity_id = r.{far})"""
        return f"""
SELECT query_id, {number} AS hop, side, relation_id, subject_id, subject_name, predicate,
       object_id, object_name, confidence FROM (
  SELECT u.*, s.canonical_name AS subject_name, o.canonical_name AS object_name, used,
         row_number() OVER (PARTITION BY u.query_id ORDER BY side, relation_id) AS n
  FROM ({side('subject_id', 'object_id', 0)} UNION ALL {side('object_id', 'subject_id', 1)}) u
  JOIN ({used}) x USING (query_id)
  JOIN {entities} s ON s.entity_id = u.subject_id JOIN {entities} o ON o.entity_id = u.object_id
  WHERE sn <= {limit} - used)
WHERE n <= {limit} - used"""

    f0, f1 = f"{prefix}f0", f"{prefix}f1"
    VIEWS[f0] = f"SELECT DISTINCT query_id, entity_id FROM {seed}"
    VIEWS[f"{prefix}1"] = hop(
        f0, f"SELECT * FROM {f0}", f"SELECT DISTINCT query_id, 0 AS used FROM {f0}", 1
    )
    VIEWS[f1] = f"""
SELECT query_id, subject_id AS entity_id FROM {prefix}1
UNION SELECT query_id, object_id FROM {prefix}1
EXCEPT SELECT query_id, entity_id FROM {f0}"""
    VIEWS[f"{prefix}2"] = hop(
        f1, f"SELECT * FROM {f0} UNION ALL SELECT * FROM {f1}",
        f"SELECT query_id, count(*) AS used FROM {prefix}1 GROUP BY 1", 2,
    )
    VIEWS[f"{prefix}edges"] = f"SELECT * FROM {prefix}1 UNION ALL SELECT * FROM {prefix}2"


def graph_search(prefix: str, seed: str, evidence: str, chunks: str, k: int = 8) -> str:
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, chunk_id) - 1 AS rank
  FROM (SELECT e.query_id, v.chunk_id,
               max(round(coalesce(s.match_score, 0.5::DOUBLE) * pow(0.75::DOUBLE, e.hop) * e.confidence, 6)) AS graph_score,
               list_sort(list(DISTINCT e.subject_name || ' --' || e.predicate || '--> ' || e.object_name)) AS graph_facts
        FROM {prefix}edges e JOIN {evidence} v USING (relation_id)
        JOIN {chunks} c ON c.chunk_id = v.chunk_id
        LEFT JOIN {seed} s ON s.query_id = e.query_id AND s.entity_id = e.subject_id
        GROUP BY ALL)) WHERE rank < {k}"""


VIEWS["tseeds"] = seeds("tq", "te", "ta")
hop_views("th", "tseeds", "te", "tr")
VIEWS["tchunks"] = "SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id FROM orders"
VIEWS["tsearch"] = graph_search("th", "tseeds", "tev", "tchunks")

# --- document graph --------------------------------------------------------
VIEWS["dn"] = f"""
SELECT DISTINCT name, n FROM (
  WITH q AS (SELECT {TOKENS.format('query')} AS t FROM kqueries)
  SELECT unnest(list_filter(t, lambda w: length(w) >= 8)) AS name, 1 AS n FROM q
  UNION ALL SELECT t[i] || ' ' || t[i + 1], 2 FROM (SELECT t, unnest(range(1, len(t))) AS i FROM q)
  WHERE length(t[i]) >= 5 AND length(t[i + 1]) >= 5)"""
VIEWS["dtok"] = """
SELECT *, token || ' ' || lead(token) OVER (PARTITION BY chunk_id ORDER BY start) AS two FROM (
  SELECT chunk_id, unnest(t) AS token, unnest(range(len(t))) AS start FROM ktok)"""
VIEWS["docc"] = """
SELECT chunk_id, name, start, start AS "end" FROM dtok JOIN dn ON n = 1 AND token = name
UNION ALL SELECT chunk_id, name, start, start + 1 FROM dtok JOIN dn ON n = 2 AND two = name"""
VIEWS["dm"] = """
SELECT * FROM docc o WHERE NOT EXISTS (
  SELECT 1 FROM docc x WHERE x.chunk_id = o.chunk_id AND x.start <= o.start AND x."end" >= o."end"
    AND x."end" - x.start > o."end" - o.start)"""
VIEWS["dmet"] = """
SELECT DISTINCT x.chunk_id, least(x.name, y.name) AS a, greatest(x.name, y.name) AS b
FROM dm x JOIN dm y ON x.chunk_id = y.chunk_id AND x.name <> y.name AND y.start > x."end" AND y.start <= x."end" + 12"""
_XLOGX = "CASE WHEN {0} > 0 THEN ({0})::DOUBLE * ln(({0})::DOUBLE) ELSE 0.0::DOUBLE END"
_G2 = " ".join(f"{sign} {_XLOGX.format(x)}" for sign, x in [
    ("+", "n"), ("+", "na - n"), ("+", "nb - n"), ("+", "t - na - nb + n"), ("-", "na"), ("-", "(t - na)"), ("-", "nb"),
    ("-", "(t - nb)"), ("+", "t")])
VIEWS["dsig"] = f"""
SELECT a, b, n, round(CASE WHEN n * t >= na * nb THEN 1 ELSE -1 END * 2 * ({_G2}), 6) AS likelihood,
       round(CASE WHEN n >= t THEN 1.0::DOUBLE ELSE ln((n * t)::DOUBLE / (na * nb)) / ln(t::DOUBLE / n) END, 6) AS closeness
FROM (WITH c AS (SELECT name, count(DISTINCT chunk_id) AS m FROM dm GROUP BY 1)
      SELECT a, b, count(*) AS n, any_value(x.m) AS na, any_value(y.m) AS nb, (SELECT count(*) FROM kactive) AS t
      FROM dmet JOIN c x ON x.name = a JOIN c y ON y.name = b GROUP BY a, b)"""
VIEWS["dents"] = f"""
SELECT chunk_id, start AS pos, name, {NORMAL.format('name')} AS normalized_name,
       sha256('TERM|' || {NORMAL.format('name')}) AS entity_id FROM dm"""
VIEWS["de"] = """
SELECT entity_id, any_value(normalized_name) AS normalized_name, any_value(name) AS canonical_name
FROM dents GROUP BY entity_id"""
VIEWS["dlinked"] = f"""
SELECT *, sha256(subject_id || '|RELATED_TO|' || object_id) AS relation_id FROM (
  SELECT chunk_id, round(0.6::DOUBLE + 0.4::DOUBLE * closeness, 2) AS confidence,
         sha256('TERM|' || {NORMAL.format('a')}) AS subject_id, sha256('TERM|' || {NORMAL.format('b')}) AS object_id
  FROM dmet JOIN dsig USING (a, b) WHERE likelihood >= 10.83)"""
VIEWS["dr"] = """
SELECT relation_id, any_value(subject_id) AS subject_id, 'RELATED_TO' AS predicate,
       any_value(object_id) AS object_id, max(confidence) AS confidence
FROM dlinked GROUP BY relation_id"""
VIEWS["dev"] = "SELECT DISTINCT relation_id, chunk_id FROM dlinked"
VIEWS["dq"] = f"SELECT *, {NORMAL.format('query')} AS query_norm FROM kqueries"
VIEWS["dseeds"] = seeds("dq", "de", None)
hop_views("dh", "dseeds", "de", "dr")
VIEWS["dsearch"] = graph_search("dh", "dseeds", "dev", "kactive")

# --- fusion and context ----------------------------------------------------


def fused(lists: str) -> str:
    return f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, fs) - 1 AS rank
  FROM (SELECT query_id, chunk_id, round(sum(weight / (60 + rank + 1)), 9) AS fusion_score,
               min(list_pos * 1000 + rank) AS fs,
               string_agg(channel, ',' ORDER BY list_pos) AS channels,
               coalesce(max(facts), []) AS graph_facts, max(gs) AS graph_score
        FROM ({lists}) GROUP BY query_id, chunk_id)) WHERE rank < 12"""


VIEWS["f2"] = fused("""
SELECT query_id, 0 AS list_pos, 'vector' AS channel, 0.7::DOUBLE AS weight, rank, chunk_id,
       NULL::VARCHAR[] AS facts, NULL::DOUBLE AS gs FROM kvec
UNION ALL SELECT query_id, 1, 'bm25', 1.0::DOUBLE - 0.7::DOUBLE, rank, chunk_id, NULL, NULL FROM kbm25""")
VIEWS["f3"] = fused("""
SELECT query_id, 0 AS list_pos, 'vector' AS channel, 0.5::DOUBLE AS weight, rank, chunk_id,
       NULL::VARCHAR[] AS facts, NULL::DOUBLE AS gs FROM kvec
UNION ALL SELECT query_id, 1, 'bm25', 0.25::DOUBLE, rank, chunk_id, NULL, NULL FROM kbm25
UNION ALL SELECT query_id, 2, 'graph', 0.25::DOUBLE, rank, chunk_id, graph_facts, graph_score FROM dsearch""")
VIEWS["cand"] = """
SELECT f.*, c.content, c.content_hash, c.document_id,
       regexp_replace(c.source_path, '^(data/)?(docs/)?', '') AS source
FROM f3 f JOIN kactive c USING (chunk_id)"""
VIEWS["deduped"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS dn
               FROM cand WHERE rank < 5) WHERE dn = 1"""
VIEWS["quota"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS sn FROM deduped)
  WHERE sn <= 2) WHERE place < 5"""
# Where a cut text ends: the first separator whose last place is past the middle.
_ENDS = ["'。'", "'.'", "'！'", "'?'", "'？'", "chr(10)"]


def truncated(text: str, left: str) -> str:
    cut = f"substr({text}, 1, 2 * ({left}))"
    last = lambda sep: f"(length({cut}) - instr(reverse({cut}), {sep}))"
    whens = " ".join(
        f"WHEN instr({cut}, {sep}) > 0 AND {last(sep)} > ({left}) THEN substr({cut}, 1, {last(sep)} + 1)"
        for sep in _ENDS
    )
    return f"CASE WHEN length({text}) <= 2 * ({left}) THEN {text} {whens} ELSE {cut} END"


VIEWS["budget"] = f"""
SELECT query_id, place, txt, used FROM (
  WITH RECURSIVE fold AS (
    SELECT query_id, -1::BIGINT AS place, ''::VARCHAR AS txt, 0::BIGINT AS used
    FROM (SELECT DISTINCT query_id FROM quota)
    UNION ALL
    SELECT f.query_id, q.place, x.txt, f.used + greatest(1, length(x.txt) // 2)
    FROM fold f JOIN quota q ON q.query_id = f.query_id AND q.place = f.place + 1,
    LATERAL (SELECT {truncated('q.content', '2550 - f.used')} AS txt) x
    WHERE 2550 - f.used > 10)
  SELECT * FROM fold) WHERE place >= 0"""
VIEWS["blocks"] = """
SELECT q.*, b.txt, b.used, '来源' || (b.place + 1) AS citation_id,
       '[来源' || (b.place + 1) || ']' || chr(10) || '文件：' || source || chr(10)
       || CASE WHEN len(graph_facts) > 0
               THEN '图谱事实：' || array_to_string(graph_facts[1:3], '; ') || chr(10) ELSE '' END
       || '内容：' || b.txt AS block
FROM quota q JOIN budget b ON b.query_id = q.query_id AND b.place = q.place"""
VIEWS["contexts"] = """
SELECT k.query_id, k.query,
       coalesce(c.context, '知识库中没有与该问题相关的信息。') AS context, coalesce(c.n, 0) AS n_sources
FROM kqueries k LEFT JOIN (
  SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY place) AS context, count(*) AS n
  FROM blocks GROUP BY query_id) c USING (query_id)"""

# --- metrics ---------------------------------------------------------------


def metric_rows(ranked: str) -> str:
    """Metrics of every query from rows (query_id, rank, source)."""
    return f"""
SELECT q.query_id,
       round(coalesce(h.h5 / t.n, 0), 6) AS recall_at_5, round(coalesce(h.h10 / t.n, 0), 6) AS recall_at_10,
       round(coalesce(1.0::DOUBLE / (h.best + 1), 0), 6) AS mrr_at_10,
       round(coalesce(h.dcg / (SELECT sum(1.0::DOUBLE / log2(i + 2)) FROM range(10) r(i)
                               WHERE i < least(t.n, 10)), 0), 6) AS ndcg_at_10,
       CASE WHEN h.h5 IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS source_hit
FROM kqueries q
LEFT JOIN (SELECT query_id, count(DISTINCT source) AS n FROM krelevant GROUP BY 1) t USING (query_id)
LEFT JOIN (
  SELECT query_id, count(*) FILTER (WHERE rank < 5)::DOUBLE AS h5, count(*) FILTER (WHERE rank < 10)::DOUBLE AS h10,
         min(rank) FILTER (WHERE rank < 10) AS best,
         sum(1.0::DOUBLE / log2(rank + 2)) FILTER (WHERE rank < 10) AS dcg
  FROM (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) - 1 AS rank
        FROM ({ranked}) GROUP BY query_id, source) d
  SEMI JOIN (SELECT query_id, regexp_replace(source, '^data/docs/', '') AS source FROM krelevant) k
       USING (query_id, source)
  GROUP BY query_id) h USING (query_id)"""


VIEWS["m3"] = metric_rows("SELECT query_id, rank, source FROM cand WHERE rank < 5")
VIEWS["m2"] = metric_rows("""
SELECT query_id, rank, regexp_replace(source_path, '^data/docs/', '') AS source
FROM f2 JOIN kactive USING (chunk_id) WHERE rank < 5""")
VIEWS["mfull"] = metric_rows("SELECT query_id, place AS rank, source FROM blocks")
VIEWS["kquestions"] = f"""
SELECT query_id, query, CASE WHEN length(query) < 200 THEN 'tuning' ELSE 'holdout' END AS split,
       query_id NOT IN (SELECT query_id FROM krelevant) AS unanswerable,
       list_sort(list_distinct(list_filter({TOKENS.format('query')}, lambda w: length(w) >= 5))) AS answer_keywords
FROM kqueries"""


def summary_rows(metrics: str, retrieved: str, extra: tuple[str, ...] = ()) -> str:
    names = ["recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10", "source_hit", *extra]
    means = " UNION ALL ".join(
        f"SELECT '{n}' AS metric, round(coalesce(avg({n}) FILTER (WHERE NOT unanswerable), 0), 6) AS value FROM j"
        for n in names
    )
    return f"""
SELECT * FROM (
WITH j AS (SELECT m.*, u.unanswerable, coalesce(r.n, 0) AS n_retrieved FROM ({metrics}) m
           JOIN kquestions u USING (query_id)
           LEFT JOIN (SELECT query_id, count(*) AS n FROM ({retrieved}) GROUP BY 1) r USING (query_id))
{means}
UNION ALL SELECT 'total_questions', count(*)::DOUBLE FROM j
UNION ALL SELECT 'failed_count', 0.0::DOUBLE
UNION ALL SELECT 'unanswerable_count', count(*) FILTER (WHERE unanswerable)::DOUBLE FROM j
UNION ALL SELECT 'unanswerable_wrong_hit_rate', round(coalesce(count(*) FILTER (WHERE unanswerable AND source_hit > 0)
          / nullif(count(*) FILTER (WHERE unanswerable), 0)::DOUBLE, 0), 6) FROM j
UNION ALL SELECT 'unanswerable_nonempty_rate', round(coalesce(count(*) FILTER (WHERE unanswerable AND n_retrieved > 0)
          / nullif(count(*) FILTER (WHERE unanswerable), 0)::DOUBLE, 0), 6) FROM j)"""


VIEWS["s3"] = summary_rows("SELECT * FROM m3", "SELECT query_id FROM cand WHERE rank < 5")
VIEWS["s2"] = summary_rows("SELECT * FROM m2", "SELECT query_id FROM f2 WHERE rank < 5")

# --- maintenance -----------------------------------------------------------
VIEWS["kstored"] = """
SELECT document_id, source_path,
       CASE WHEN lang = 'de' THEN sha256('old:' || text) ELSE file_hash END AS file_hash,
       CASE WHEN status = 'failed' THEN 'failed' ELSE 'ready' END AS status,
       CASE WHEN source = 'src5' THEN 1 ELSE 2 END AS index_schema_version,
       CASE WHEN status = 'pending' THEN 'Vector cleanup failed' END AS error_message, created_at
FROM kdocs WHERE source <> 'src3'
UNION ALL
SELECT 'p' || page_id, 'pages/' || page_id || '.html', sha256(html),
       CASE WHEN starts_with(url, 'https') THEN 'deleted' ELSE 'ready' END, 2, NULL, 1700000000 + page_id
FROM pages"""
VIEWS["kdiff"] = """
SELECT * FROM (
  SELECT coalesce(d.source_path, s.source_path) AS source_path, s.document_id,
         CASE WHEN s.source_path IS NULL THEN 'added'
              WHEN d.source_path IS NULL AND s.status = 'deleted' THEN NULL
              WHEN d.source_path IS NULL THEN 'deleted'
              WHEN s.status <> 'ready' OR coalesce(s.error_message, '') <> '' OR s.file_hash <> d.file_hash
                   OR s.index_schema_version <> 2 THEN 'modified'
              ELSE 'unchanged' END AS change,
         coalesce(d.file_hash, s.file_hash) AS file_hash
  FROM kdocs d FULL OUTER JOIN kstored s USING (source_path)) WHERE change IS NOT NULL"""
VIEWS["kgens"] = """
SELECT chunk_id, document_id, 'g1' AS generation FROM kchunks
WHERE document_id IN (SELECT document_id FROM kdocs WHERE lang <> 'es')
UNION ALL SELECT chunk_id, document_id, 'g2' FROM kactive"""
VIEWS["kfp"] = """
SELECT substr(sha256(string_agg(h, '' ORDER BY b)), 1, 16) AS fingerprint FROM (
  SELECT substr(sha256(source_path), 1, 4) AS b,
         sha256(string_agg(source_path || ':' || file_hash, chr(10) ORDER BY source_path || ':' || file_hash)) AS h
  FROM kdocs GROUP BY 1)"""
VIEWS["kmessages"] = """
SELECT conv_id AS conversation_id, turn, role, text,
       CASE WHEN role = 'system' THEN 'failed' ELSE 'completed' END AS status FROM conversations"""
VIEWS["kconvs"] = """
SELECT conversation_id, max(turn) AS updated_at, 'user' || (conversation_id % 10) AS user_id
FROM kmessages GROUP BY 1"""
VIEWS["kreqs"] = "SELECT conversation_id, 'user' || (conversation_id % 9) AS user_id FROM kconvs"
VIEWS["ktrim"] = """
SELECT * FROM (
  SELECT conversation_id, turn, role, substr(text, 1, 3000) AS text,
         sum(least(length(text), 3000)) OVER (PARTITION BY conversation_id ORDER BY turn DESC)::BIGINT AS running_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS rn FROM kmessages
        WHERE status = 'completed')
  WHERE rn <= 10) WHERE running_chars <= 3000"""
VIEWS["khist"] = """
SELECT conversation_id, string_agg(CASE role WHEN 'user' THEN '用户' WHEN 'assistant' THEN '助手' ELSE role END
                                   || ': ' || text, chr(10) ORDER BY turn) AS history
FROM ktrim GROUP BY 1"""
