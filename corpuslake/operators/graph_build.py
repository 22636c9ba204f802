"""Knowledge graph build: extraction answers in, five graph tables out."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.config import DEFAULTS, ENTITY_TYPES, PREDICATES, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import ranking
from corpuslake.session import cut_lineage

ENTITY = (
    "struct<local_id:string,name:string,type:string,"
    "aliases:array<string>,description:string>"
)
RELATION = (
    "struct<subject:string,predicate:string,object:string,"
    "evidence:string,confidence:double>"
)
LISTS = ("entities", "relations")  # of an answer
BATCH_SPAN = 1 << 15  # chunks that one task cuts into request batches


@dataclass
class Graph:
    """The five tables of a property graph."""

    entities: DataFrame
    aliases: DataFrame
    mentions: DataFrame
    relations: DataFrame
    evidence: DataFrame


TABLES = ("entities", "aliases", "mentions", "relations", "evidence")


class StoredGraph(Graph):
    """A graph whose tables are written to the shared folder when they are first asked for."""

    def __init__(self, graph: Graph, written: tuple[str, ...]):
        self._graph, self._written = graph, written

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = getattr(self._graph, name)
        setattr(self, name, cut_lineage(table, name) if name in self._written else table)
        return self.__dict__[name]


def stored(graph: Graph, written: tuple[str, ...] = TABLES) -> Graph:
    """The tables written to the shared folder: built once, read often, and not at all where no step
    reads them."""
    return StoredGraph(graph, written)


# --- work selection and batches --------------------------------------------

def select_work(
    chunks: DataFrame,
    documents: DataFrame,
    only_pending: bool = True,
    retry_failed: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Chunks of ready documents that still need extraction.

    ``processing`` counts as pending: no worker owns a chunk between two runs.
    """
    wanted = ["pending", "processing"]
    if retry_failed:
        wanted.append("failed")
    elif not only_pending:
        wanted += ["failed", "completed"]
    due = F.col("graph_status").isin(*wanted)
    if only_pending:
        due = due | ~F.col("graph_schema_version").eqNullSafe(
            F.lit(settings.graph_schema_version)
        )
    ready = documents.where(F.col("status") == "ready").select("document_id")
    return chunks.where(due).join(ready, "document_id", "left_semi")


def global_positions(chunks: DataFrame) -> DataFrame:
    """chunk_id, pos (dense, by document and chunk index over all documents) and chars. Documents are
    counted in ranges of their ids and chunks in spans, so that no order needs a single task."""
    rows = chunks.select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id",
        F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"))
    ranges = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut_lineage(rows.groupBy("document_id").agg(F.count("*").alias("n")).repartitionByRange(
        ranges, "document_id").withColumn("part", F.spark_partition_id()), "documents")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.groupBy("part").agg(F.sum("n").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        F.broadcast(offsets), "part").select("document_id", (F.col("offset") + F.col("earlier")).alias("start"))
    placed = ranking.position(rows, ["document_id"], "chunk_index", "_in_document")
    return placed.join(starts, "document_id").select(
        "chunk_id", (F.col("start") + F.col("_in_document")).alias("pos"), "chars")


def form_batches(
    chunks: DataFrame, settings: Settings = DEFAULTS, span: int = BATCH_SPAN
) -> DataFrame:
    """Request batches in document and index order over all documents, limited in chunks and characters.

    The greedy rule looks at one chunk after the other, but where a batch that starts at a chunk ends
    depends on the next few chunks only. So each span of chunks works out, for every place at which its
    first batch may start, where the first batch of the next span starts; these small maps are
    chained by doubling, and then every span cuts its batches. The result is that of the one sequential
    fold, and a document of any length is spread over many tasks. ``batch_id`` is the place of the
    first chunk; the texts stay where they are and join afterwards.
    """
    most, most_chars = settings.graph_batch_size, settings.graph_batch_chars
    places = cut_lineage(global_positions(chunks).withColumn("span", F.floor(F.col("pos") / span).cast("long")), "places")
    # A batch may reach over the end of its span: its first rows are also given to the span before.
    ahead = places.where((F.col("pos") % span < most - 1) & (F.col("span") > 0)).withColumn("span", F.col("span") - 1)
    rows = places.unionByName(ahead).select("span", "pos", "chars", "chunk_id")

    def ends(chars: list[int]) -> list[int]:
        """Where a batch that starts at each row ends (the start of the next one)."""
        out = []
        for i in range(len(chars)):
            held, j = chars[i], i + 1
            while j < len(chars) and j - i < most and held + chars[j] <= most_chars:
                held += chars[j]
                j += 1
            out.append(j)
        return out

    def own_rows(key, table: pa.Table) -> tuple[pa.Table, list[int], int]:
        """The rows in order, where batches end, and how many rows are the span's own."""
        table = table.sort_by("pos")
        own = pc.sum(pc.less(table["pos"], (key[0].as_py() + 1) * span)).as_py() or 0
        return table, ends(table["chars"].to_pylist()), own

    def summary(key, table):
        _, after, own = own_rows(key, table)
        reach = list(range(own + most))
        for i in range(own - 1, -1, -1):  # where a walk from here leaves the span
            reach[i] = reach[after[i]]
        return pa.table({"span": pa.array([key[0].as_py()], pa.int64()),
                         "exits": pa.array([[reach[e] - own for e in range(most)]], pa.list_(pa.int32()))})

    exits = cut_lineage(rows.groupBy("span").applyInArrow(summary, "span long, exits array<int>"), "exits")

    def cut(key, table, entry):
        table, after, own = own_rows(key, table)
        at, taken, batch = entry["entry"][0].as_py() if entry.num_rows else 0, [], []
        pos = table["pos"].to_pylist()
        while at < own:
            to = min(after[at], len(pos))
            taken += range(at, to)
            batch += [pos[at]] * (to - at)
            at = after[at]
        return pa.table({"chunk_id": table["chunk_id"].take(pa.array(taken, pa.int64())), "batch": pa.array(batch, pa.int64())})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    batched = rows.groupBy("span").cogroup(chained(exits).groupBy("span")).applyInArrow(cut, f"chunk_id {kind}, batch long")
    return chunks.select("document_id", "chunk_index", "chunk_id", "content").join(
        batched.withColumn("batch_id", F.col("batch").cast("string")).drop("batch"), "chunk_id")


def chained(exits: DataFrame) -> DataFrame:
    """span, entry: where the first batch of each span starts, from the map of each span (exit for each
    entry). Maps are put together over 2, 4, 8 ... spans; the number of rounds grows with the logarithm."""
    last = exits.agg(F.max("span")).first()[0] or 0
    upto, reach = exits, 1
    while reach <= last:
        before = upto.select((F.col("span") + reach).alias("span"), F.col("exits").alias("_first"))
        joined = upto.join(before, "span", "left")
        then = tx.once(F.col("exits"), lambda own: F.transform("_first", lambda e: F.get(own, e)))
        upto = cut_lineage(joined.select("span", F.when(F.col("_first").isNull(), F.col("exits")).otherwise(then).alias("exits")), "chain")
        reach *= 2
    return upto.select((F.col("span") + 1).alias("span"), F.get("exits", F.lit(0)).alias("entry"))


def requests(batches: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One extraction request per batch: its chunks with cut texts, as JSON."""
    item = F.struct(
        "document_id",
        "chunk_index",
        "chunk_id",
        F.substring("content", 1, settings.graph_batch_chars).alias("content"),
    )
    return batches.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    ).select(
        "batch_id",
        F.transform("_items", lambda i: i["chunk_id"]).alias("chunk_ids"),
        F.to_json(
            F.transform(
                "_items",
                lambda i: F.struct(
                    i["chunk_id"].alias("chunk_id"), i["content"].alias("content")
                ),
            )
        ).alias("payload"),
    )


def run_extractor(
    request_table: DataFrame, model: Callable[[str], str], retries: int = 1
) -> DataFrame:
    """Ask a pluggable model for each request; one more try with the error text."""
    schema = T.StructType(
        request_table.schema.fields
        + [T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())]
    )

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for payload in frame.payload:
                answer, error = None, None
                for _ in range(retries + 1):
                    prompt = payload if error is None else f"{payload}\n\n{error}"
                    try:
                        answer, error = model(prompt), None
                        break
                    except Exception as failure:  # recorded as data
                        error = str(failure)[:500]
                answers.append(answer)
                errors.append(error)
            yield frame.assign(raw=answers, error=errors)

    return request_table.mapInPandas(ask, schema)


# --- parse and validate ----------------------------------------------------

def parse_responses(answers: DataFrame) -> DataFrame:
    """Parse one answer per chunk; failure is a column, not an error.

    ``answers`` has chunk_id, document_id, content and raw. Entities of an
    unknown type or a bad name are dropped; of equal local ids the last stays.
    Relations need a known predicate, two kept entities, no self loop and a quote
    that is in the text. The lists of one answer are in one row, so nothing is
    shuffled.
    """
    read = tx.held(_cleaned(answers), _object=_object())
    lists = [F.try_variant_get("_object", f"$.{name}", "array<variant>").alias(name) for name in LISTS]
    return _validated(tx.held(read.withColumn("ok", F.col("_object").isNotNull()), _data=F.struct(*lists)))


def _cleaned(answers: DataFrame) -> DataFrame:
    return tx.held(answers, _clean=tx.strip_model_noise(F.col("raw")))


def _object():
    """The answer's JSON object; null if it is none."""
    return F.when(F.col("_clean").startswith("{"), F.try_parse_json("_clean"))


def _is_object():
    return _object().isNotNull()


def _kind(element, field: str):
    """Type of one field of a JSON object (VOID for null); no type where the key is absent."""
    return F.schema_of_variant(F.try_variant_get(element, f"$.{field}", "variant"))


def _typed(element, kinds: dict[str, tuple[str, ...]]):
    """Each of these fields is absent or of one of its types; other fields may be anything."""
    checks = [F.coalesce(_kind(element, field).isin(*allowed), F.lit(True)) for field, allowed in kinds.items()]
    return reduce(lambda a, b: a & b, checks)


# Types of whole elements as most answers have them; those need no look at each field.
USUAL_ENTITY = [
    f"OBJECT<{aliases}{description}local_id: STRING, name: STRING, type: STRING>"
    for aliases in ("", "aliases: ARRAY<STRING>, ", "aliases: ARRAY<VOID>, ")
    for description in ("", "description: STRING, ", "description: VOID, ")
]
USUAL_RELATION = r"^OBJECT<(confidence: [A-Z]+(\(\d+,\d+\))?, )?evidence: STRING, object: STRING, predicate: STRING, subject: STRING>$"


def _entity_typed(element):
    text = ("STRING",)
    each = _typed(element, {
        "local_id": text, "name": text, "type": text, "aliases": ("ARRAY<STRING>", "ARRAY<VOID>"),
        "description": ("STRING", "VOID")})
    return F.when(F.schema_of_variant(element).isin(*USUAL_ENTITY), True).otherwise(each)


def _confidence(element):
    """A number or numeric text; the default only where the key is absent."""
    given = F.try_variant_get(element, "$.confidence", "double")
    return F.when(F.try_variant_get(element, "$.confidence", "variant").isNotNull(), given).otherwise(F.lit(0.8))


def _relation_typed(element):
    each = _typed(element, {field: ("STRING",) for field in ("subject", "predicate", "object", "evidence")})
    return F.when(F.schema_of_variant(element).rlike(USUAL_RELATION), True).otherwise(each)


def _text(element, field: str, kind: str = "string"):
    return F.try_variant_get(element, f"$.{field}", kind)


def _validated(parsed: DataFrame) -> DataFrame:
    """Check the lists ``_data`` of each answer element by element: a field of a wrong
    type drops its element, whatever other keys it has."""
    none = F.array().cast("array<variant>")
    told = F.transform(F.coalesce("_data.entities", none), lambda v: F.struct(
        F.struct(_text(v, "local_id").alias("local_id"), _text(v, "name").alias("name"), _text(v, "type").alias("type"),
                 _text(v, "aliases", "array<string>").alias("aliases"),
                 _text(v, "description").alias("description")).cast(ENTITY).alias("e"),
        _entity_typed(v).alias("typed")))
    good_entity = lambda x: (
        x["e"]["local_id"].isNotNull()
        & x["typed"]
        & F.length(x["e"]["name"]).between(1, 255)
        & x["e"]["type"].isin(*ENTITY_TYPES)
    )
    parsed = tx.held(parsed, _told=told)
    usable = tx.held(parsed, _good=F.transform(F.filter("_told", good_entity), lambda x: x["e"]))
    last_wins = F.filter(
        "_good",
        lambda e, i: ~F.exists(
            F.slice(F.col("_good"), i + 2, F.size("_good")),
            lambda later: later["local_id"] == e["local_id"],
        ),
    )
    related = F.transform(F.coalesce("_data.relations", none), lambda v: F.struct(
        *[_text(v, field).alias(field) for field in ("subject", "predicate", "object", "evidence")],
        _confidence(v).alias("confidence"), _relation_typed(v).alias("_typed")))

    def good_relation(r, about):
        return F.coalesce(
            r["_typed"] & r["predicate"].isin(*PREDICATES)
            & F.array_contains(about["ids"], r["subject"])
            & F.array_contains(about["ids"], r["object"])
            & (r["subject"] != r["object"])
            & (F.length(r["evidence"]) > 0)
            & r["confidence"].between(0.0, 1.0)
            & F.contains(about["flat"], tx.squeeze(r["evidence"])), F.lit(False))

    # What all relations of an answer are checked against is worked out once.
    about = F.struct(
        F.transform("_good", lambda e: e["local_id"]).alias("ids"), tx.squeeze(F.col("content")).alias("flat"))
    usable = tx.held(usable, _about=about, _related=related)
    kept = F.filter("_related", lambda r: good_relation(r, F.col("_about")))
    return (
        tx.held(
            usable, relations=F.transform(kept, lambda r: r.dropFields("_typed").cast(RELATION)), entities=last_wins)
        .select(
            "chunk_id", "document_id", "content", "ok", "entities", "relations",
            F.when(~F.col("ok"), F.lit("answer is not a JSON object")).alias("error"),
        )
    )


def parse_batch_responses(batch_answers: DataFrame, members: DataFrame) -> DataFrame:
    """Answers of whole batches, checked against the request.

    ``batch_answers`` has batch_id, chunk_ids and raw; ``members`` has batch_id,
    chunk_id, document_id and content. When the set of ids differs, every chunk
    of the batch fails.
    """
    parsed = _cleaned(batch_answers).withColumn(
        "_chunks", F.when(_is_object(), F.from_json("_clean", "chunks array<string>")["chunks"])
    )
    chunk_id = lambda text: F.get_json_object(text, "$.chunk_id")
    answered = F.array_sort(
        F.array_distinct(
            F.filter(F.transform("_chunks", chunk_id), lambda i: i.isNotNull())
        )
    )
    gated = parsed.select(
        "batch_id",
        F.coalesce(
            answered == F.array_sort(F.array_distinct("chunk_ids")), F.lit(False)
        ).alias("batch_ok"),
        "_chunks",
    )
    # The last answer of equal ids wins, as in a dictionary.
    items = gated.where("batch_ok").select("batch_id", F.posexplode("_chunks").alias("_p", "_c"))
    data = items.groupBy("batch_id", chunk_id(F.col("_c")).alias("chunk_id")).agg(
        F.max_by("_c", "_p").alias("_text")
    )
    joined = (
        members.join(gated.select("batch_id", "batch_ok"), "batch_id", "left")
        .withColumn("ok", F.coalesce("batch_ok", F.lit(False)))
        .join(data, ["batch_id", "chunk_id"], "left")
    )
    return _validated(tx.held(joined, _data=F.from_json("_text", ", ".join(f"{name} array<variant>" for name in LISTS))))


def confident(parsed: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Drop relations under the minimum confidence; the answer itself stays, so
    that an empty one still replaces what was there before."""
    return parsed.withColumn(
        "relations",
        F.filter("relations", lambda r: r["confidence"] >= settings.graph_min_confidence),
    )


def work_status(
    chunks: DataFrame, parsed: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """New graph status of the chunks that were worked on; the rest keep theirs."""
    outcome = parsed.select("chunk_id", "ok", F.col("error").alias("_error"))
    done, failed = F.col("ok") == F.lit(True), F.col("ok") == F.lit(False)
    return (
        chunks.join(outcome, "chunk_id", "left")
        .withColumns({
            "graph_status": F.when(done, "completed").when(failed, "failed")
            .otherwise(F.col("graph_status")),
            "graph_schema_version": F.when(done, settings.graph_schema_version)
            .otherwise(F.col("graph_schema_version")),
            "graph_error": F.when(failed, F.substring("_error", 1, 500))
            .when(done, F.lit(None)).otherwise(F.col("graph_error")),
        })
        .drop("ok", "_error")
    )


# --- names -----------------------------------------------------------------

def with_normalized(df: DataFrame, name: str, out: str, nfkc: bool = True) -> DataFrame:
    """Normalised name column. Only distinct names with characters outside ASCII
    go through Python for NFKC; all others stay in the JVM."""
    if not nfkc:
        return df.withColumn(out, tx.normalize_name(F.col(name)))

    @F.pandas_udf("string")
    def compose(names: pd.Series) -> pd.Series:
        return names.map(lambda n: unicodedata.normalize("NFKC", n))

    special = F.coalesce(F.col(name).rlike(r"[^\x00-\x7f]"), F.lit(False))
    other = df.where(special)
    table = (
        other.select(F.col(name).alias("_name")).distinct().withColumn("_nfkc", compose("_name"))
    )
    # Two branches, not one left join: names without a partner would all meet in
    # the task of the null key.
    composed = (
        other.join(table, F.col(name) == F.col("_name"))
        .withColumn(out, tx.normalize_name(F.col("_nfkc")))
        .drop("_name", "_nfkc")
    )
    plain = df.where(~special).withColumn(out, tx.normalize_name(F.col(name)))
    return plain.unionByName(composed)


def entity_id(kind, normalized):
    return F.sha2(F.concat_ws("|", kind, normalized), 256)


def relation_id(subject, predicate, obj):
    return F.sha2(F.concat_ws("|", subject, predicate, obj), 256)


# --- merge -----------------------------------------------------------------

def merge_graph(parsed: DataFrame, nfkc: bool = True, kept: bool = False) -> Graph:
    """Merge validated answers into graph tables, all chunks in one pass.

    Where several of the tables are wanted, ``kept`` writes what they share: the named entities of
    each answer, and its relations with the entities at both ends.

    Every table is one aggregation on its natural key with partial aggregation,
    so a name that is in every chunk costs one row per task. ``ord`` (chunk, then
    place in the answer) decides which spelling comes first.
    """
    good = parsed.where("ok")
    ents = good.select(
        "chunk_id", "document_id", F.posexplode("entities").alias("pos", "e")
    ).select("chunk_id", "document_id", "pos", "e.*")
    named = (
        with_normalized(ents, "name", "normalized_name", nfkc)
        .where("normalized_name <> ''")
        .withColumn("entity_id", entity_id(F.col("type"), F.col("normalized_name")))
    )
    named = (cut_lineage(named, "named") if kept else named).withColumn("ord", F.struct("chunk_id", "pos"))
    entities = named.groupBy("entity_id").agg(
        F.first("type").alias("entity_type"),
        F.min_by("name", "ord").alias("canonical_name"),
        F.first("normalized_name").alias("normalized_name"),
        F.min_by("description", F.when(F.col("description") != "", F.col("ord")))
        .alias("description"),
    )

    spoken = named.select(
        "entity_id", "chunk_id", "pos", F.posexplode("aliases").alias("apos", "alias")
    )
    aliases = (
        with_normalized(spoken, "alias", "normalized_alias", nfkc)
        .where("normalized_alias <> ''")
        .groupBy("entity_id", "normalized_alias")
        .agg(F.min_by("alias", F.struct("chunk_id", "pos", "apos")).alias("alias"))
        .select(
            F.sha2(F.concat_ws("|", "entity_id", "normalized_alias"), 256).alias("alias_id"),
            "entity_id", "alias", "normalized_alias",
        )
    )

    mentions = named.groupBy("entity_id", "chunk_id").agg(
        F.first("document_id").alias("document_id"),
        F.min_by("name", "ord").alias("mention"),
    ).withColumn("confidence", F.lit(1.0))

    rels = good.select(
        "chunk_id", "document_id", F.posexplode("relations").alias("rpos", "r")
    ).select("chunk_id", "document_id", "rpos", "r.*")
    local = named.select("chunk_id", "local_id", "entity_id")
    linked = (
        rels.join(
            local.withColumnsRenamed(
                {"local_id": "subject", "entity_id": "subject_id"}
            ),
            ["chunk_id", "subject"],
        )
        .join(
            local.withColumnsRenamed({"local_id": "object", "entity_id": "object_id"}),
            ["chunk_id", "object"],
        )
        .where("subject_id <> object_id")
        .withColumn(
            "relation_id",
            relation_id(F.col("subject_id"), F.col("predicate"), F.col("object_id")),
        )
    )
    linked = cut_lineage(linked, "linked") if kept else linked
    evidence = (
        linked.withColumn("quote_hash", F.sha2("evidence", 256))
        .groupBy("relation_id", "chunk_id", "quote_hash")
        .agg(
            F.first("document_id").alias("document_id"),
            F.first("evidence").alias("quote"),
            F.min_by("confidence", "rpos").alias("confidence"),
            F.max("confidence").alias("best_confidence"),
        )
    )
    relations = linked.groupBy("relation_id").agg(
        F.first("subject_id").alias("subject_id"),
        F.first("predicate").alias("predicate"),
        F.first("object_id").alias("object_id"),
        F.max("confidence").alias("confidence"),
    )
    return Graph(entities, aliases, mentions, relations, evidence)


# --- replace, delete, clean ------------------------------------------------

def drop_chunks(graph: Graph, chunks: DataFrame) -> Graph:
    """Remove what the given chunks contributed (mentions and evidence)."""
    ids = chunks.select("chunk_id").distinct()
    return Graph(
        graph.entities,
        graph.aliases,
        graph.mentions.join(ids, "chunk_id", "left_anti"),
        graph.relations,
        graph.evidence.join(ids, "chunk_id", "left_anti"),
    )


def drop_documents(graph: Graph, documents: DataFrame) -> Graph:
    """Remove what the given documents contributed, then clean up."""
    ids = documents.select("document_id").distinct()
    return clean_orphans(
        Graph(
            graph.entities,
            graph.aliases,
            graph.mentions.join(ids, "document_id", "left_anti"),
            graph.relations,
            graph.evidence.join(ids, "document_id", "left_anti"),
        )
    )


def live_relations(graph: Graph) -> DataFrame:
    """Relations that still have evidence; with no evidence at all, none."""
    return graph.relations.join(
        graph.evidence.select("relation_id").distinct(), "relation_id", "left_semi"
    )


def clean_orphans(graph: Graph) -> Graph:
    """Drop relations without evidence, then entities without mention and relation."""
    relations = live_relations(graph)
    used = (
        graph.mentions.select("entity_id")
        .unionByName(relations.select(F.col("subject_id").alias("entity_id")))
        .unionByName(relations.select(F.col("object_id").alias("entity_id")))
        .distinct()
    )
    entities = graph.entities.join(used, "entity_id", "left_semi")
    aliases = graph.aliases.join(entities.select("entity_id"), "entity_id", "left_semi")
    return Graph(entities, aliases, graph.mentions, relations, graph.evidence)


def upsert(graph: Graph, parsed: DataFrame, nfkc: bool = True) -> Graph:
    """Replace the contribution of the answered chunks by their new answers.

    Applying the same answers twice gives the same tables. A relation's
    confidence is the highest among its live evidence and the new answers.
    """
    answered = parsed.where("ok").select("chunk_id")
    old, new = drop_chunks(graph, answered), merge_graph(parsed, nfkc)
    both = lambda a, b: a.withColumn("_age", F.lit(0)).unionByName(
        b.withColumn("_age", F.lit(1))
    )
    entities = both(old.entities, new.entities).groupBy("entity_id").agg(
        F.first("entity_type").alias("entity_type"),
        F.min_by("canonical_name", "_age").alias("canonical_name"),
        F.first("normalized_name").alias("normalized_name"),
        F.min_by("description", F.when(F.col("description") != "", F.col("_age")))
        .alias("description"),
    )
    aliases = both(old.aliases, new.aliases).groupBy(
        "alias_id", "entity_id", "normalized_alias"
    ).agg(F.min_by("alias", "_age").alias("alias")).select(*new.aliases.columns)
    mentions = old.mentions.unionByName(new.mentions)
    evidence = old.evidence.unionByName(new.evidence)
    triples = old.relations.drop("confidence").unionByName(new.relations.drop("confidence"))
    relations = triples.dropDuplicates(["relation_id"]).join(
        evidence.groupBy("relation_id").agg(F.max("best_confidence").alias("confidence")),
        "relation_id",
    )
    return clean_orphans(Graph(entities, aliases, mentions, relations, evidence))
