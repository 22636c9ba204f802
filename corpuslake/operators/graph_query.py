"""Graph look-ups and graph retrieval for a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, Settings
from corpuslake.functions import text as tx
from corpuslake.operators import ranking
from corpuslake.operators.graph_build import Graph
from corpuslake.session import cut_lineage


def table_counts(graph: Graph) -> DataFrame:
    """Row counts of the five tables."""
    counts = [
        getattr(graph, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name in ("entities", "aliases", "mentions", "relations", "evidence")
    ]
    return reduce(DataFrame.unionByName, counts)


def relations_by_entity(graph: Graph) -> DataFrame:
    """Every relation under both of its ends, as rows: a hub stays spread out."""
    side = lambda column, name: graph.relations.select(
        F.col(column).alias("entity_id"), F.lit(name).alias("side"),
        "relation_id", "subject_id", "predicate", "object_id", "confidence",
    )
    return side("subject_id", "subject").unionByName(side("object_id", "object"))


# --- entity search ---------------------------------------------------------

GRAM = 3  # characters of a gram; shorter texts are one gram


def _grams(text, size):
    """Substrings of one size with their places (at, gram), from 1."""
    return F.transform(
        F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(
            F.array().cast("array<int>")),
        lambda at: F.struct(at.alias("at"), F.substring(text, at, size).alias("gram")),
    )


def contained(small: DataFrame, large: DataFrame, gram: int = GRAM) -> DataFrame:
    """Pairs (small, large) of texts where the first lies in the second.

    Both tables have distinct, non-empty texts in their one column. Each small text is stored under
    that of its grams which the large ones hold least often, and is left out where they lack one. The
    grams of the large texts fetch the small ones, which are then compared where they would lie.
    """
    own = F.least(F.length("small"), F.lit(gram))
    sizes = [r[0] for r in small.select(own).distinct().collect()]  # at most 1 to GRAM
    places = large.select("large", F.inline(F.concat(*[_grams(F.col("large"), n) for n in sizes] or [F.array().cast(
        "array<struct<at:int,gram:string>>")])))
    held = places.groupBy("gram").agg(F.count("*").alias("n"))
    of_size = F.coalesce(*[F.when(own == n, _grams(F.col("small"), n)) for n in sizes], F.array().cast(
        "array<struct<at:int,gram:string>>"))
    index = small.select("small", F.inline(of_size)).join(held, "gram", "left").groupBy("small").agg(F.min(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("rarest")).where("rarest.n > 0")
    index = cut_lineage(index.select("small", "rarest.gram", F.col("rarest.at").alias("inside")), "grams")
    start = F.col("at") - F.col("inside") + 1
    return places.join(index, "gram").where((start >= 1) & (
        F.substring("large", F.greatest(start, F.lit(1)), F.length("small")) == F.col("small"))).select(
        "small", "large").distinct()


def name_pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of query and name where one holds the other, by equi joins on rare grams.

    ``queries`` has query_id and query_norm, ``names`` has name_norm.
    """
    names = names.select("name_norm").where("name_norm <> ''").distinct()
    asked = queries.select("query_id", "query_norm").where("query_norm <> ''")
    texts = asked.select("query_norm").distinct()
    inside = contained(names.toDF("small"), texts.toDF("large")).toDF("name_norm", "query_norm")
    longest = names.agg(F.max(F.length("name_norm"))).first()[0] or 0
    short = cut_lineage(texts.where(F.length("query_norm") < longest), "short")
    around = names.limit(0).withColumn("query_norm", F.lit("")) if short.isEmpty() else contained(
        short.toDF("small"), names.toDF("large")).where("small <> large").toDF("query_norm", "name_norm")
    return asked.join(inside.unionByName(around), "query_norm").select("query_id", "query_norm", "name_norm")


def search_entities(
    queries: DataFrame, graph: Graph, k: int = DEFAULTS.graph_entity_k, nfkc: bool = True
) -> DataFrame:
    """Best entities of each query by name or alias, with their match score."""
    from corpuslake.operators.graph_build import with_normalized

    # Lengths, substrings and pairs all come from these two short tables.
    asked = cut_lineage(
        with_normalized(queries, "query", "query_norm", nfkc).select("query_id", "query_norm")
    )
    keyed = cut_lineage(graph.entities.select(
        "entity_id", F.col("normalized_name").alias("name_norm"), F.lit(False).alias("is_alias")
    ).unionByName(
        graph.aliases.select(
            "entity_id", F.col("normalized_alias").alias("name_norm"),
            F.lit(True).alias("is_alias"),
        )
    ))
    matches = name_pairs(asked, keyed).join(keyed, "name_norm")
    score = F.when(
        F.col("is_alias"), tx.alias_score(F.col("query_norm"), F.col("name_norm"))
    ).otherwise(tx.match_score(F.col("query_norm"), F.col("name_norm")))
    scored = (
        matches.groupBy("query_id", "entity_id")
        .agg(F.round(F.max(score), 6).alias("match_score"))
        .join(graph.entities, "entity_id")
    )
    return ranking.top_k(
        scored,
        ["query_id"],
        [
            F.desc("match_score"), F.length("normalized_name").asc(),
            F.asc("canonical_name"), F.asc("entity_id"),
        ],
        k,
    )


# --- neighbours ------------------------------------------------------------

EDGE_BLOCK = 64  # edges of an adjacency block


def adjacency(graph: Graph, entities: DataFrame, most: int, block: int = EDGE_BLOCK) -> DataFrame:
    """The first ``most`` relations (by relation id) of each of these entities on either side, in blocks:
    entity_id, side, block and edges. Every task drops what lies beyond before the shuffle, so that a hub
    costs no more than ``most`` rows a task, and no row holds more than a block."""
    near = relations_by_entity(graph).join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    ranked = ranking.top_k(near, ["entity_id", "side"], [F.asc("relation_id")], most, out="_at")
    return ranked.groupBy(
        "entity_id", F.when(F.col("side") == "subject", 0).otherwise(1).alias("side"),
        F.floor(F.col("_at") / block).cast("int").alias("block"),
    ).agg(F.collect_list(F.struct(
        "relation_id", "subject_id", "predicate", "object_id", "confidence",
        F.when(F.col("side") == "subject", F.col("object_id")).otherwise(F.col("subject_id")).alias("far"))).alias("edges"))


def neighbors(
    seeds: DataFrame, graph: Graph, settings: Settings = DEFAULTS
) -> DataFrame:
    """Edges within one or two hops of each query's seeds, hop by hop.

    Edges between two frontier members are skipped and the edge limit holds over
    all hops, so it is applied inside every hop: subject side first, then by
    relation id. A frontier row carries the ids that its query has seen. As there is one
    relation for each predicate between two entities, an entity's first
    ``limit + predicates x seen`` edges hold all that can be among the first ``limit`` unseen ones;
    later blocks of a hub are not opened.
    """
    limit = settings.graph_max_relations
    kinds = max(1, graph.relations.select("predicate").distinct().count())
    ends = graph.entities.select("entity_id", "canonical_name", "entity_type")
    frontier = cut_lineage(seeds.select("query_id", "entity_id").distinct())
    visited, used, hops = None, None, []

    for hop in range(1, settings.graph_max_hops + 1):
        blocked = frontier if visited is None else frontier.unionByName(visited)
        seen = blocked.groupBy("query_id").agg(F.collect_set("entity_id").alias("seen"))
        asking = cut_lineage(frontier.join(seen, "query_id").withColumn(
            "needed", limit + kinds * F.size("seen")), "frontier")
        most = asking.agg(F.max("needed")).first()[0] or 0
        blocks = adjacency(graph, asking, most)
        opened = asking.join(blocks, "entity_id").where(F.col("block") * EDGE_BLOCK < F.col("needed"))
        reach = opened.select("query_id", "side", F.inline(tx.once(F.col("seen"), lambda own: F.filter(
            "edges", lambda e: ~F.array_contains(own, e["far"]))))).drop("far")

        def left_over(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
            first = ranking.top_k(rows, keys, order, limit, out="_at")
            if used is not None:
                first = first.join(used, "query_id", "left").where(
                    F.col("_at") < limit - F.coalesce("_used", F.lit(0))
                ).drop("_used")
            return first.drop("_at")

        first = left_over(reach, ["query_id", "side"], [F.asc("relation_id")])
        named = first.join(
            ends.toDF("subject_id", "subject_name", "subject_type"), "subject_id"
        ).join(ends.toDF("object_id", "object_name", "object_type"), "object_id")
        kept = left_over(named, ["query_id"], [F.asc("side"), F.asc("relation_id")]).withColumn(
            "hop", F.lit(hop)
        )
        # The next hop needs these few rows several times; kept as a table, they are
        # found once, and the plan stays as small as that of one hop.
        kept = cut_lineage(kept)
        hops.append(kept)
        if hop == settings.graph_max_hops:
            break
        visited = blocked.distinct()
        frontier = (
            kept.select("query_id", F.col("subject_id").alias("entity_id"))
            .unionByName(kept.select("query_id", F.col("object_id").alias("entity_id")))
            .distinct()
            .join(visited, ["query_id", "entity_id"], "left_anti")
        )
        used = kept.groupBy("query_id").agg(F.count("*").alias("_used"))
    columns = [
        "query_id", "hop", "side", "relation_id", "subject_id", "subject_name",
        "subject_type", "predicate", "object_id", "object_name", "object_type",
        "confidence",
    ]
    return reduce(DataFrame.unionByName, [kept.select(*columns) for kept in hops])


def relation_evidence(edges: DataFrame, graph: Graph) -> DataFrame:
    """Evidence rows behind the edges of each query."""
    return edges.join(
        graph.evidence.select(
            "relation_id", "document_id", "chunk_id", "quote",
            F.col("confidence").alias("evidence_confidence"),
        ),
        "relation_id",
    )


def search(
    queries: DataFrame,
    graph: Graph,
    chunks: DataFrame,
    settings: Settings = DEFAULTS,
    nfkc: bool = True,
) -> DataFrame:
    """Graph retrieval: seeds, edges, evidence, best chunks with their facts."""
    seeds = cut_lineage(search_entities(queries, graph, settings.graph_entity_k, nfkc))
    return search_from(seeds, neighbors(seeds, graph, settings), graph, chunks, settings)


def search_from(
    seeds: DataFrame,
    edges: DataFrame,
    graph: Graph,
    chunks: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    seed_score = seeds.select(
        "query_id", F.col("entity_id").alias("subject_id"), "match_score"
    )
    scored = cut_lineage(edges.join(seed_score, ["query_id", "subject_id"], "left").select(
        "query_id",
        "relation_id",
        F.round(
            F.coalesce("match_score", F.lit(0.5))
            * F.pow(F.lit(0.75), F.col("hop"))
            * F.col("confidence"),
            6,
        ).alias("_score"),
        tx.fact_text(
            F.col("subject_name"), F.col("predicate"), F.col("object_name")
        ).alias("_fact"),
    ))
    # A chunk among the best k of a query is among the first k chunks of its best
    # relation, since all chunks of that relation score at least as much. So each
    # relation passes on k chunks, whatever the number of its evidence rows.
    support = (
        graph.evidence.select("relation_id", "chunk_id")
        .join(scored.select("relation_id").distinct(), "relation_id", "left_semi")
        .join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        .distinct()
    )
    first = ranking.top_k(
        support, ["relation_id"], [F.asc("chunk_id")], settings.vector_k
    ).drop("rank")
    best = cut_lineage(ranking.top_k(
        first.join(scored, "relation_id")
        .groupBy("query_id", "chunk_id")
        .agg(F.max("_score").alias("graph_score")),
        ["query_id"], [F.desc("graph_score"), F.asc("chunk_id")], settings.vector_k,
    ))
    # All facts of the few chosen chunks; a query has a limited number of edges.
    facts = (
        support.join(best.select("query_id", "chunk_id"), "chunk_id")
        .join(scored, ["query_id", "relation_id"])
        .groupBy("query_id", "chunk_id")
        .agg(F.array_sort(F.collect_set("_fact")).alias("graph_facts"))
    )
    return best.join(facts, ["query_id", "chunk_id"])
