"""Knowledge-corpus tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS
from corpuslake.functions import text as tx
from corpuslake.operators import bm25, chunking, dictionary, graph_build, maintain, ranking, vector
from corpuslake.operators.graph_build import ENTITY, RELATION, Graph
from corpuslake.session import cut_lineage, path_exists, shared_base


class Corpus:
    """All logical inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._kept: dict[str, object] = {}

    def kept(self, name: str, make):
        """What ``make`` gives, worked out once for these inputs."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    SPREAD = ("documents", "pages", "conversations", "orders", "lineitem", "events")

    def table(self, name: str) -> DataFrame:
        """A driver table. One that comes in fewer splits than there are cores is
        spread over all of them; a big one has more splits and stays as it is."""
        rows = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in self.SPREAD and rows.rdd.getNumPartitions() < cores:
            return rows.repartition(cores)
        return rows

    # --- documents and chunks ----------------------------------------------

    def documents(self) -> DataFrame:
        """Document table: status follows the labels, toxic documents have failed
        and low-quality ones are pending."""
        d, l = self.table("documents"), self.table("labels")
        status = (
            F.when(F.col("toxic") == 1, "failed")
            .when(F.col("quality") == 0, "pending").otherwise("ready")
        )
        return d.join(l, "doc_id", "left").select(
            F.col("doc_id").cast("string").alias("document_id"),
            F.concat(
                F.lit("data/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
                F.lit(".txt"),
            ).alias("source_path"),
            F.sha2("text", 256).alias("file_hash"),
            F.octet_length("text").cast("long").alias("file_size"),
            status.alias("status"),
            (F.lit(1704067200) + F.col("doc_id")).alias("created_at"),
            "text", "lang", "source",
        )

    def lines(self) -> DataFrame:
        """Non-blank lines of every document with their place."""
        return self.documents().select(
            "document_id", "file_hash", "source_path",
            F.posexplode(F.split("text", "\n")).alias("pos", "content"),
        ).where(~tx.is_blank(F.col("content")))

    def chunks(self) -> DataFrame:
        return chunking.line_chunks(self.documents())

    def active_chunks(self) -> DataFrame:
        return chunking.line_chunks(self.documents().where("status = 'ready'"))

    def queries(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("query")
        )

    def relevant(self) -> DataFrame:
        """Documents that hold the text of a benchmark item, written once: every text is read for it.

        A document can only hold the text if it has its longest inner word, so
        candidates come from an equi join on that word and are then verified.
        """
        return self.kept("relevant", lambda: cut_lineage(self.holders(), "relevant"))

    def holders(self) -> DataFrame:
        inner = lambda words: F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
        anchors = (
            self.queries()
            .withColumn("_words", inner(tx.tokens(F.col("query"))))
            .withColumn(
                "word",
                F.array_max(F.transform(
                    "_words",
                    lambda w: F.struct(F.length(w).alias("n"), w.alias("w")),
                ))["w"],
            )
            .select("query_id", "query", "word")
        )
        words = self.documents().select(
            "source_path", "text", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word")
        )
        hit = words.join(anchors, "word").where(F.contains("text", "query"))
        return hit.select("query_id", F.col("source_path").alias("source"))

    def fingerprint(self) -> str:
        """Of the ready documents, their texts included."""
        ready = lambda: self.documents().where("status = 'ready'")
        return self.kept("fingerprint", lambda: maintain.corpus_fingerprint(ready()).first()["fingerprint"])

    def keyword_index(self) -> bm25.KeywordIndex:
        """Stored index of the active chunks. It is found again by the fingerprint of the documents it
        was built from, so that one build serves all queries on the same documents."""
        fingerprint = self.fingerprint()
        signature = f"{fingerprint}:{DEFAULTS.index_schema_version}:{DEFAULTS.bm25_k1}:{DEFAULTS.bm25_b}:{DEFAULTS.bm25_epsilon}"
        return bm25.stored_index(self.active_chunks(), f"{shared_base(self.spark)}/keywords-{fingerprint}", signature)

    # --- vectors -----------------------------------------------------------

    def chunk_vectors(self) -> DataFrame:
        """Vectors of the active chunks, stored under the fingerprint of the documents."""
        path = f"{shared_base(self.spark)}/vectors-{self.fingerprint()}-{DEFAULTS.embedding_model}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            vector.hashed_embedding(
                self.active_chunks().select("chunk_id", "document_id", "content"), "content"
            ).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def query_vectors(self) -> DataFrame:
        return vector.hashed_embedding(self.queries(), "query")

    def generations(self) -> DataFrame:
        """Two vector generations: g1 misses Spanish documents and has documents
        that are not ready, g2 equals the active chunks."""
        every = self.documents()
        ids = lambda docs, name: chunking.line_chunks(docs).select(
            "chunk_id", "document_id", F.lit(name).alias("generation")
        )
        return ids(every.where("lang <> 'es'"), "g1").unionByName(
            ids(every.where("status = 'ready'"), "g2")
        )

    def index_state(self) -> DataFrame:
        """Pointer rows; the newest one names g2, built from these documents."""
        fp = maintain.corpus_fingerprint(self.documents())
        return fp.select(
            F.lit(2).alias("seq"), F.lit("g2").alias("active_generation"),
            F.lit(DEFAULTS.index_schema_version).alias("index_schema_version"),
            F.lit(DEFAULTS.embedding_fingerprint).alias("embedding_fingerprint"),
            F.col("fingerprint").alias("corpus_fingerprint"),
            F.lit("2024-01-02").alias("updated_at"),
        )

    def stored(self) -> DataFrame:
        """Document table of an earlier run.

        src3 was not there yet, German texts were different, src5 had an older
        schema, and pages were part of the corpus (the https ones already gone).
        """
        changed = F.when(
            F.col("lang") == "de", F.sha2(F.concat(F.lit("old:"), "text"), 256)
        ).otherwise(F.col("file_hash"))
        docs = self.documents().where("source <> 'src3'").select(
            "document_id", "source_path", changed.alias("file_hash"), "file_size",
            F.when(F.col("status") == "failed", "failed").otherwise("ready").alias("status"),
            F.lit(1).cast("long").alias("chunk_count"),
            F.when(F.col("source") == "src5", 1).otherwise(2).alias("index_schema_version"),
            F.lit(DEFAULTS.embedding_provider).alias("embedding_provider"),
            F.lit(DEFAULTS.embedding_model).alias("embedding_model"),
            F.when(F.col("status") == "pending", "Vector cleanup failed").alias("error_message"),
            "created_at",
        )
        pages = self.table("pages").select(
            F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("document_id"),
            F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
            .alias("source_path"),
            F.sha2("html", 256).alias("file_hash"),
            F.octet_length("html").cast("long").alias("file_size"),
            F.when(F.col("url").startswith("https"), "deleted").otherwise("ready").alias("status"),
            F.lit(1).cast("long").alias("chunk_count"),
            F.lit(2).alias("index_schema_version"),
            F.lit(DEFAULTS.embedding_provider).alias("embedding_provider"),
            F.lit(DEFAULTS.embedding_model).alias("embedding_model"),
            F.lit(None).cast("string").alias("error_message"),
            (F.lit(1700000000) + F.col("page_id")).alias("created_at"),
        )
        return docs.unionByName(pages)

    # --- conversations -----------------------------------------------------

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("conversation_id"), "turn", "role", "text",
            F.when(F.col("role") == "system", "failed").otherwise("completed").alias("status"),
        )

    def conversations(self) -> DataFrame:
        return self.messages().groupBy("conversation_id").agg(
            F.max("turn").alias("updated_at")
        ).withColumn(
            "user_id", F.concat(F.lit("user"), (F.col("conversation_id") % 10).cast("string"))
        )

    def history_requests(self) -> DataFrame:
        """Everybody asks for one conversation each; many are not their own."""
        return self.conversations().select(
            "conversation_id",
            F.concat(F.lit("user"), (F.col("conversation_id") % 9).cast("string")).alias("user_id"),
        )

    # --- questions ---------------------------------------------------------

    def questions(self) -> DataFrame:
        """Benchmark items as questions; items found nowhere are unanswerable."""
        known = self.relevant().select("query_id").distinct().withColumn("_known", F.lit(True))
        return self.queries().join(known, "query_id", "left").select(
            "query_id", "query",
            F.when(F.length("query") < 200, "tuning").otherwise("holdout").alias("split"),
            F.col("_known").isNull().alias("unanswerable"),
            F.array_sort(F.array_distinct(F.filter(
                tx.tokens(F.col("query")), lambda w: F.length(w) >= 5
            ))).alias("answer_keywords"),
        )

    def timings(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("stage"), F.col("value").alias("seconds")
        )

    # --- graphs ------------------------------------------------------------

    def order_texts(self) -> DataFrame:
        """One text per order: the customer, its nation and its region."""
        o, c = self.table("orders"), self.table("customer")
        n, r = self.table("nation"), self.table("region")
        return (
            o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("o_orderkey").alias("key"),
                F.col("o_orderkey").cast("string").alias("chunk_id"),
                F.col("o_custkey").cast("string").alias("document_id"),
                "o_custkey", "c_name", "n_name", "r_name", "c_mktsegment",
                F.concat(
                    "c_name", F.lit(" is part of "), "n_name", F.lit(". "),
                    "n_name", F.lit(" is part of "), "r_name", F.lit("."),
                ).alias("content"),
            )
        )

    def order_body(self, texts: DataFrame) -> DataFrame:
        """Extraction answer per order as a struct; eight of ten kinds have a
        flaw that validation has to deal with."""
        v = F.col("key") % 10
        entity = lambda local, name, kind, aliases, about: F.struct(
            F.lit(local).alias("local_id"), name.alias("name"), kind.alias("type"),
            aliases.alias("aliases"), about.alias("description"),
        )
        none = F.array().cast("array<string>")
        e1 = entity(
            "e1", F.col("c_name"), F.lit("ROLE"),
            F.array(F.concat(F.lit("Cust "), F.col("o_custkey").cast("string"))),
            F.when(v >= 5, F.col("c_mktsegment")).otherwise(F.lit("")),
        )
        wrong = entity("e2", F.lit("Wrong Name"), F.lit("ENVIRONMENT"), none, F.lit(None).cast("string"))
        e2 = entity("e2", F.col("n_name"), F.lit("ENVIRONMENT"), none, F.lit(None).cast("string"))
        e3 = entity(
            "e3", F.col("r_name"), F.when(v == 1, "PLANET").otherwise("SYSTEM"), none,
            F.lit(None).cast("string"),
        )
        entities = F.when(v == 7, F.array(e1, wrong, e2, e3)).otherwise(F.array(e1, e2, e3))
        part = lambda a, b: F.concat(a, F.lit(" is part of "), b)
        r1 = F.struct(
            F.lit("e1").alias("subject"),
            F.when(v == 2, "BELONGS").otherwise("PART_OF").alias("predicate"),
            F.when(v == 3, "e1").when(v == 6, "e9").otherwise("e2").alias("object"),
            F.when(v == 4, "not in the text")
            .otherwise(part(F.col("c_name"), F.col("n_name"))).alias("evidence"),
            F.when(v == 8, F.lit(0.4)).otherwise(
                F.round(F.lit(0.6) + (F.col("key") % 40) / 100, 2)
            ).alias("confidence"),
        )
        r2 = F.struct(
            F.lit("e2").alias("subject"), F.lit("PART_OF").alias("predicate"),
            F.lit("e3").alias("object"),
            part(F.col("n_name"), F.col("r_name")).alias("evidence"),
            F.lit(0.9).alias("confidence"),
        )
        return texts.withColumn(
            "body",
            F.struct(
                F.col("chunk_id"),
                entities.cast(f"array<{ENTITY}>").alias("entities"),
                F.array(r1, r2).cast(f"array<{RELATION}>").alias("relations"),
            ),
        )

    def order_answers(self) -> DataFrame:
        """Raw answers: some fenced, every tenth cut off in the middle."""
        v, plain = F.col("key") % 10, F.to_json("body")
        raw = (
            F.when(v == 0, F.concat(F.lit("<think>step\none</think>\n```json\n"), plain, F.lit("\n```")))
            .when(v == 5, F.substring(plain, F.lit(1), F.length(plain) - 3))
            .otherwise(plain)
        )
        return self.order_body(self.order_texts()).withColumn("raw", raw).select(
            "key", "chunk_id", "document_id", "content", "c_mktsegment", "raw"
        )

    def order_parsed(self) -> DataFrame:
        return graph_build.parse_responses(self.order_answers())

    def order_graph(self, stored: bool = False) -> Graph:
        parsed = cut_lineage(graph_build.confident(self.order_parsed()), "parsed")
        graph = graph_build.merge_graph(parsed, nfkc=False, kept=stored)
        return graph_build.stored(graph) if stored else graph

    def order_batches(self) -> DataFrame:
        """Orders of a customer in batches of six, with the whole-batch answer."""
        placed = ranking.position(
            self.order_texts().withColumn("_doc", F.col("document_id")), ["_doc"], "key", "_seq"
        )
        return self.order_body(placed).withColumn(
            "batch_id",
            F.concat_ws("/", "document_id", F.floor(F.col("_seq") / 6).cast("string")),
        )

    def batch_answers(self) -> DataFrame:
        """One answer per batch; every fifth leaves its first chunk out."""
        listed = self.order_batches().groupBy("batch_id").agg(
            F.array_sort(F.collect_list(F.struct("key", "chunk_id", F.col("body")))).alias("_all"),
            F.min("key").alias("_first"),
        )
        bodies = F.transform(
            F.when(F.col("_first") % 5 == 0, F.slice("_all", 2, 6)).otherwise(F.col("_all")),
            lambda item: item["body"],
        )
        return listed.select(
            "batch_id",
            F.transform("_all", lambda item: item["chunk_id"]).alias("chunk_ids"),
            F.to_json(F.struct(bodies.alias("chunks"))).alias("raw"),
        )

    # Kinds of both ends and predicate of each form of statement in the trade graph.
    TRADE_FORMS = (
        ("ROLE", "PART_OF", "ENVIRONMENT"), ("ENVIRONMENT", "PART_OF", "SYSTEM"),
        ("MODULE", "PART_OF", "ENVIRONMENT"), ("MODULE", "PROVIDES", "TERM"),
    )

    def trade_graph(self) -> Graph:
        """Customers and suppliers in nations, nations in regions, parts provided. Mentions and evidence, with
        a row a statement, are not written: who reads them takes the columns and rows that are wanted."""
        c, s, n, r, p = (
            self.table(t) for t in ("customer", "supplier", "nation", "region", "part")
        )
        named = lambda df, name, kind: df.select(
            F.lit(kind).alias("entity_type"), F.col(name).alias("canonical_name")
        ).distinct()
        eid = lambda kind, name: graph_build.entity_id(
            F.lit(kind), tx.normalize_name(F.col(name))
        )
        entities = (
            named(c, "c_name", "ROLE").unionByName(named(s, "s_name", "MODULE"))
            .unionByName(named(n, "n_name", "ENVIRONMENT")).unionByName(named(r, "r_name", "SYSTEM"))
            .unionByName(named(p, "p_name", "TERM"))
            .withColumn("normalized_name", tx.normalize_name(F.col("canonical_name")))
            .withColumn("entity_id", graph_build.entity_id(F.col("entity_type"), F.col("normalized_name")))
            .withColumn("description", F.lit(None).cast("string"))
        )
        alias = F.concat(F.lit("Supp "), F.col("s_suppkey").cast("string"))
        aliases = s.select(
            eid("MODULE", "s_name").alias("entity_id"), alias.alias("alias"),
            tx.normalize_name(alias).alias("normalized_alias"),
        ).withColumn(
            "alias_id", F.sha2(F.concat_ws("|", "entity_id", "normalized_alias"), 256)
        )
        # Statements carry names; the long ids are made after the rows of a relation have been merged.
        spelled = lambda df, name: df.withColumn(f"{name}_norm", tx.normalize_name(F.col(name)))
        c, s, n, r, p = (
            spelled(df, name).select(*columns, name, f"{name}_norm") for df, name, *columns in (
                (c, "c_name", "c_custkey", "c_nationkey"), (s, "s_name", "s_suppkey", "s_nationkey"),
                (n, "n_name", "n_nationkey", "n_regionkey"), (r, "r_name", "r_regionkey"), (p, "p_name", "p_partkey"))
        )
        key = lambda name: F.col(name).cast("string")

        def statement(form, a, b, doc, chunk, conf):
            verb = " provides " if self.TRADE_FORMS[form][1] == "PROVIDES" else " is part of "
            return F.struct(
                F.lit(form).alias("form"), F.col(f"{a}_norm").alias("subject"), F.col(f"{b}_norm").alias("object"),
                chunk.alias("chunk_id"), doc.alias("document_id"),
                F.concat(F.col(a), F.lit(verb), F.col(b)).alias("quote"), conf.alias("confidence"))

        o, l = self.table("orders"), self.table("lineitem")
        nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        bought = o.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).join(
            nations, F.col("c_nationkey") == F.col("n_nationkey")
        )
        sold = (
            l.select("l_orderkey", "l_suppkey", "l_partkey")
            .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
        )
        based = s.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        stated = (
            bought.select(F.inline(F.array(
                statement(0, "c_name", "n_name", key("o_custkey"), key("o_orderkey"),
                          F.round(F.lit(0.6) + (F.col("c_custkey") % 40) / 100, 2)),
                statement(1, "n_name", "r_name", key("o_custkey"), key("o_orderkey"), F.lit(0.9)))))
            .unionByName(based.select(F.inline(F.array(
                statement(2, "s_name", "n_name", key("s_suppkey"), F.concat(F.lit("s"), key("s_suppkey")), F.lit(0.8))))))
            .unionByName(sold.select(F.inline(F.array(
                statement(3, "s_name", "p_name", key("l_suppkey"), key("l_orderkey"),
                          F.round(F.lit(0.6) + (F.col("l_suppkey") % 40) / 100, 2))))))
        )
        part = lambda place: F.get(F.array(*[F.lit(form[place]) for form in self.TRADE_FORMS]), F.col("form"))
        ends = {
            "subject_id": graph_build.entity_id(part(0), F.col("subject")), "predicate": part(1),
            "object_id": graph_build.entity_id(part(2), F.col("object")),
        }
        named_relation = graph_build.relation_id(*ends.values()).alias("relation_id")
        evidence = stated.groupBy("form", "subject", "object", "chunk_id").agg(
            F.min("document_id").alias("document_id"), F.min("quote").alias("quote"),
            F.max("confidence").alias("confidence"),
        ).select(named_relation, "chunk_id", "document_id", "quote", "confidence", F.sha2("quote", 256).alias("quote_hash"))
        relations = stated.groupBy("form", "subject", "object").agg(F.max("confidence").alias("confidence")).select(
            named_relation, *[value.alias(name) for name, value in ends.items()], "confidence")
        end = lambda place, name: F.struct(part(place).alias("kind"), F.col(name).alias("name"))
        mentions = (
            stated.select("form", "chunk_id", "document_id", F.explode(F.array(end(0, "subject"), end(2, "object"))).alias("end"))
            .groupBy("end.kind", "end.name", "chunk_id").agg(F.min("document_id").alias("document_id"))
            .select(graph_build.entity_id(F.col("kind"), F.col("name")).alias("entity_id"), "chunk_id", "document_id",
                    F.lit(1.0).alias("confidence"))
        )
        return graph_build.stored(
            Graph(entities, aliases, mentions, relations, evidence), ("entities", "aliases", "relations"))

    def trade_chunks(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"))

    def trade_queries(self) -> DataFrame:
        """One question per nation and one per part name."""
        n = self.table("nation").select(
            F.concat(F.lit("Which suppliers are part of "), "n_name", F.lit("?")).alias("query")
        )
        p = self.table("part").select(
            F.concat(F.lit("Who provides a "), "p_name", F.lit("?")).alias("query")
        ).distinct()
        return n.unionByName(p).select(F.col("query").alias("query_id"), "query")

    def names(self) -> DataFrame:
        """Dictionary for the documents: long words of the questions, and neighbouring ones of
        five letters and more."""
        words = self.queries().select(tx.tokens(F.col("query")).alias("w"))
        single = words.select(F.explode("w").alias("name")).where("length(name) >= 8")
        double = words.select(F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
            lambda i: F.slice("w", i, 2))).alias("two")).where(
            (F.size("two") == 2) & ~F.exists("two", lambda x: F.length(x) < 5))
        return single.unionByName(double.select(F.array_join("two", " ").alias("name"))).distinct()

    def document_answers(self) -> DataFrame:
        return dictionary.responses(self.active_chunks(), self.names())

    def document_graph(self) -> Graph:
        """Graph over the active chunks, by the built-in dictionary extractor."""
        answers = self.document_answers()
        parsed = cut_lineage(
            graph_build.confident(graph_build.parse_responses(answers)), "parsed"
        )
        return graph_build.stored(graph_build.merge_graph(parsed, nfkc=False, kept=True))
