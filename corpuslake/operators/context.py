"""Candidates to a budgeted, cited context per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.config import (
    CITATION_LABEL,
    CONTENT_LABEL,
    DEFAULTS,
    FACTS_LABEL,
    FILE_LABEL,
    NO_CONTEXT_TEXT,
    PAGE_LABEL,
    SECTION_LABEL,
    Settings,
)
from corpuslake.functions import text as tx
from corpuslake.operators import ranking


def dedup(candidates: DataFrame) -> DataFrame:
    """Keep the first row of each chunk id and of each content hash, in rank order.

    A fold over the short candidate list of a query: a row only counts as seen
    when it was kept.
    """
    rest = [c for c in candidates.columns if c != "query_id"]
    item = F.struct("rank", *[c for c in rest if c != "rank"])
    listed = candidates.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(item),
            lambda a, b: F.when(a["rank"] < b["rank"], -1)
            .when(a["rank"] > b["rank"], 1).otherwise(0),
        ).alias("_items")
    )
    seen = lambda kept, row, name: F.exists(
        kept, lambda old: (old[name] != "") & (old[name] == row[name])
    )
    element = listed.schema["_items"].dataType.elementType
    empty = F.array().cast(f"array<{element.simpleString()}>")
    kept = F.aggregate(
        "_items",
        empty,
        lambda kept, row: F.when(
            F.coalesce(seen(kept, row, "chunk_id"), F.lit(False))
            | F.coalesce(seen(kept, row, "content_hash"), F.lit(False)),
            kept,
        ).otherwise(F.concat(kept, F.array(row))),
    )
    return listed.select("query_id", F.inline(kept)).select(*candidates.columns)


def source_quota(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """At most so many rows per source, then at most so many rows per query.

    The cap on sources and rows is the feature itself.
    """
    labelled = candidates.withColumn("source", tx.context_source(F.col("source")))
    per_source = ranking.top_k(
        labelled, ["query_id", "source"], [F.asc("rank")],
        settings.max_chunks_per_source, out="_in_source",
    ).drop("_in_source")
    return ranking.top_k(
        per_source.withColumnRenamed("rank", "candidate_rank"),
        ["query_id"], [F.asc("candidate_rank")], settings.max_context_chunks,
    )


def fit_budget(selected: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Spend the token budget in rank order, cutting the last text to what is left.

    Cutting at a sentence end leaves room, so the order matters: a fold over the
    at most ``max_context_chunks`` rows of a query.
    """
    columns = [c for c in selected.columns if c not in ("query_id", "rank")]
    listed = selected.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_texts")
    )
    budget = settings.context_budget
    state = "struct<used:int,stopped:boolean,kept:array<struct<rank:int,content:string>>>"
    start = F.struct(
        F.lit(0).alias("used"), F.lit(False).alias("stopped"),
        F.array().cast("array<struct<rank:int,content:string>>").alias("kept"),
    ).cast(state)

    def spend(acc, row):
        left = F.lit(budget) - acc["used"]
        text = tx.truncate_at_sentence(row["content"], left)
        return F.when(
            acc["stopped"] | (left <= 10),
            F.struct(
                acc["used"].alias("used"), F.lit(True).alias("stopped"),
                acc["kept"].alias("kept"),
            ),
        ).otherwise(
            F.struct(
                (acc["used"] + tx.token_count(text)).cast("int").alias("used"),
                F.lit(False).alias("stopped"),
                F.concat(
                    acc["kept"],
                    F.array(F.struct(
                        row["rank"].cast("int").alias("rank"), text.alias("content")
                    )),
                ).alias("kept"),
            )
        )

    fitted = listed.select(
        "query_id", F.aggregate("_texts", start, lambda a, r: spend(a, r).cast(state)).alias("s")
    ).select("query_id", F.inline("s.kept")).withColumnRenamed("content", "cited_text")
    return selected.select("query_id", "rank", *columns).join(fitted, ["query_id", "rank"])


def _optional(df: DataFrame, name: str, kind: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def citation_blocks(fitted: DataFrame) -> DataFrame:
    """Numbered text block of each cited row; absent parts leave no line."""
    page, section = _optional(fitted, "page", "int"), _optional(fitted, "section", "string")
    facts = (
        F.col("graph_facts") if "graph_facts" in fitted.columns
        else F.array().cast("array<string>")
    )
    citation = F.concat(F.lit(CITATION_LABEL), (F.col("rank") + 1).cast("string"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("["), citation, F.lit("]")),
        F.concat(F.lit(FILE_LABEL), F.col("source")),
        F.concat(F.lit(PAGE_LABEL), page.cast("string")),
        F.when(section != "", F.concat(F.lit(SECTION_LABEL), section)),
        F.when(
            F.size(facts) > 0,
            F.concat(F.lit(FACTS_LABEL), F.array_join(F.slice(facts, 1, 3), "; ")),
        ),
        F.concat(F.lit(CONTENT_LABEL), F.col("cited_text")),
    )
    return fitted.withColumn("citation_id", citation).withColumn("block", block)


def source_entry(fitted: DataFrame):
    """The ten fields that describe a cited source."""
    optional = lambda name, kind: _optional(fitted, name, kind).alias(name)
    return F.struct(
        "citation_id",
        F.coalesce(_optional(fitted, "document_id", "string"), F.lit("")).alias("document_id"),
        F.coalesce(F.col("chunk_id"), F.lit("")).alias("chunk_id"),
        "source",
        optional("page", "int"),
        optional("section", "string"),
        tx.preview(F.col("content")).alias("preview"),
        F.coalesce(
            _optional(fitted, "retrieval_channels", "array<string>"),
            F.array().cast("array<string>"),
        ).alias("retrieval_channels"),
        F.coalesce(
            _optional(fitted, "graph_facts", "array<string>"),
            F.array().cast("array<string>"),
        ).alias("graph_facts"),
        F.coalesce(_optional(fitted, "fusion_score", "double"), F.lit(0.0)).alias(
            "fusion_score"
        ),
    )


def build_context(
    candidates: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Context text and sources of every query; queries without candidates get
    the fixed text and no sources."""
    blocks = citation_blocks(fit_budget(source_quota(dedup(candidates), settings), settings))
    in_order = lambda value: F.transform(
        F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))),
        lambda item: item["v"],
    )
    entries = blocks.withColumn("entry", source_entry(blocks))
    packed = entries.groupBy("query_id").agg(
        F.array_join(in_order(F.col("block")), "\n\n").alias("context"),
        F.array_sort(
            F.collect_list(F.struct("rank", "entry")),
            lambda a, b: a["rank"] - b["rank"],
        ).alias("_entries"),
    ).select("query_id", "context", F.transform("_entries", lambda e: e["entry"]).alias("sources"))
    kind = packed.schema["sources"].dataType.simpleString()
    return queries.join(packed, "query_id", "left").withColumns({
        "context": F.coalesce("context", F.lit(NO_CONTEXT_TEXT)),
        "sources": F.coalesce("sources", F.array().cast(kind)),
    })


def snapshot(contexts: DataFrame, created_at=None) -> DataFrame:
    """One nested record per query, as it is written for inspection.

    ``contexts`` has query_id, query, context, sources and, when there was a
    rewrite, retrieval_queries.
    """
    original = F.coalesce(F.col("query"), F.lit(""))
    queries = (
        F.col("retrieval_queries") if "retrieval_queries" in contexts.columns
        else F.array(original)
    )
    facts = F.transform(
        F.filter("sources", lambda s: F.size(s["graph_facts"]) > 0),
        lambda s: F.struct(
            s["citation_id"].alias("citation_id"),
            s["document_id"].alias("document_id"),
            s["chunk_id"].alias("chunk_id"),
            s["graph_facts"].alias("facts"),
        ),
    )
    stamp = created_at if created_at is not None else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    )
    return contexts.select(
        "query_id",
        F.lit(1).alias("schema_version"),
        stamp.alias("created_at"),
        original.alias("original_query"),
        F.coalesce(F.try_element_at(queries, F.lit(-1)), original).alias("retrieval_query"),
        queries.alias("retrieval_queries"),
        F.struct(original.alias("query"), F.col("context")).alias("llm_input"),
        F.length("context").alias("context_character_count"),
        "sources",
        facts.alias("graph_facts"),
    )
