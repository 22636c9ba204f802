"""Names of a dictionary in texts, and which of them occur together.

A name of several words is stored under the one of its words that fewest names have. The tokens of a
text fetch the names they may belong to, and only those are compared with the words around. Of matches
that lie inside each other the longest stays. Names that stand near each other more often than chance
allows (log-likelihood ratio) are related.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as tx
from corpuslake.session import cut_lineage

WINDOW = 12  # tokens from the end of a name to the start of the next, at most
LEAST_SIGNIFICANCE = 10.83  # log-likelihood ratio that chance exceeds once in a thousand
# Fixed value: longest name in characters.
LONGEST_NAME = 255


def name_index(names: DataFrame, tokenizer: Callable[[Column], Column] = tx.tokens) -> DataFrame:
    """name, words, offset and token: each name (column ``name``) once, under its rarest word.

    Names with the same words are one; the smallest spelling stands for them. Names without words and
    over-long ones are left out.
    """
    cut = names.where(F.length("name") <= LONGEST_NAME).select("name", tokenizer(F.col("name")).alias("words"))
    cut = cut.where(F.size("words") > 0).groupBy("words").agg(F.min("name").alias("name"))
    tokens = cut.select("name", "words", F.posexplode("words").alias("offset", "token"))
    common = tokens.groupBy("token").agg(F.count_distinct("words").alias("n"))
    return tokens.join(common, "token").groupBy("words", "name").agg(F.min(F.struct(
        "n", (-F.length("token")).alias("short"), "token", "offset")).alias("at")).select(
        "name", "words", F.col("at.offset").alias("offset"), F.col("at.token").alias("token"))


def _longest(found: Column, words: int) -> Column:
    """Matches, by start, that lie inside no longer one. With one name for each sequence of words, a match has at most
    ``words`` * ``words`` others before it that reach so far."""
    def inside(f: Column, i: Column) -> Column:
        before = F.slice(found, F.greatest(i + 1 - words * words, F.lit(1)), F.least(i, F.lit(words * words)))
        return F.exists(before, lambda g: (g["start"] <= f["start"]) & (g["end"] >= f["end"]))

    return F.filter(found, lambda f, i: ~inside(f, i))


def find_names(
    texts: DataFrame, names: DataFrame, key: str = "chunk_id", content: str = "content",
    tokenizer: Callable[[Column], Column] = tx.tokens,
) -> DataFrame:
    """Texts that hold names, with all matches (``names``: array of start, end, name; places are token
    numbers from 0, the end is the last one). ``key`` is unique."""
    index = cut_lineage(name_index(names, tokenizer), "names")
    most = index.agg(F.max(F.size("words"))).first()[0]
    if most is None:
        return texts.limit(0).withColumn("names", F.array().cast("array<struct<start:int,end:int,name:string>>"))
    tokens = texts.select(key, F.posexplode(tokenizer(F.col(content))).alias("pos", "token"))
    # Spark broadcasts the index if it is small, by its size as written; else tokens are shuffled.
    hits = tokens.join(index, "token").where(F.col("pos") >= F.col("offset")).groupBy(key).agg(F.collect_list(
        F.struct((F.col("pos") - F.col("offset")).alias("start"), "words", "name")).alias("_hits"))
    held = texts.join(hits, key)
    # Bound by ``once``: a column used inside a lambda would be worked out anew for each element.
    true = tx.once(tokenizer(F.col(content)), lambda words: F.filter(
        "_hits", lambda h: F.slice(words, h["start"] + 1, F.size(h["words"])) == h["words"]))
    found = F.array_sort(F.transform(true, lambda h: F.struct(
        h["start"].alias("start"), (-F.size(h["words"])).alias("order"),
        (h["start"] + F.size(h["words"]) - 1).alias("end"), h["name"].alias("name"))))
    names_of = F.transform(tx.once(found, lambda f: _longest(f, most)), lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["name"].alias("name")))
    return held.withColumn("names", names_of).drop("_hits").where(F.size("names") > 0)


def neighbours(found: DataFrame, key: str = "chunk_id", window: int = WINDOW) -> DataFrame:
    """Pairs of unlike names (first < second) that stand within ``window`` tokens in a text, with the
    place of their first such meeting: key, first, second, start, end. A name meets at most as many
    others as there are tokens in the window."""
    def met(f: Column, i: Column, names: Column) -> Column:
        after = F.filter(F.slice(names, i + 2, 2 * window), lambda g: (
            (g["start"] > f["end"]) & (g["start"] <= f["end"] + window) & (g["name"] != f["name"])))
        return F.transform(after, lambda g: F.struct(
            F.least(f["name"], g["name"]).alias("first"), F.greatest(f["name"], g["name"]).alias("second"),
            f["start"].alias("start"), g["end"].alias("end")))

    all_met = tx.once(F.col("names"), lambda names: F.flatten(F.transform(names, lambda f, i: met(f, i, names))))
    pairs = found.select(key, F.explode(all_met).alias("p"))
    return pairs.groupBy(key, "p.first", "p.second").agg(
        F.min(F.struct("p.start", "p.end")).alias("at")).select(key, "first", "second", "at.start", "at.end")


def significance(pairs: DataFrame, found: DataFrame, n_texts: Column, key: str = "chunk_id") -> DataFrame:
    """first, second, n (texts in which they meet), likelihood (log-likelihood ratio, negative where they
    meet less often than chance) and closeness (normalised pointwise mutual information)."""
    holds = found.select(key, F.explode(F.array_distinct(F.transform("names", lambda f: f["name"]))).alias("name"))
    counts = holds.groupBy("name").agg(F.count("*").alias("n"))
    both = pairs.groupBy("first", "second").agg(F.count("*").cast("double").alias("n"))
    both = both.join(counts.toDF("first", "a"), "first").join(counts.toDF("second", "b"), "second")
    both = both.withColumn("_all", n_texts.cast("double"))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    n, a, b, all_ = (F.col(c).cast("double") for c in ("n", "a", "b", "_all"))
    ratio = 2 * (xlogx(n) + xlogx(a - n) + xlogx(b - n) + xlogx(all_ - a - b + n)
                 - xlogx(a) - xlogx(all_ - a) - xlogx(b) - xlogx(all_ - b) + xlogx(all_))
    closeness = F.when(n >= all_, 1.0).otherwise(F.log(n * all_ / (a * b)) / F.log(all_ / n))
    return both.select(
        "first", "second", F.col("n").cast("long").alias("n"),
        F.round(F.when(n * all_ >= a * b, ratio).otherwise(-ratio), 6).alias("likelihood"),
        F.round(closeness, 6).alias("closeness"))


def spoken(pieces: Column, start: Column, end: Column) -> Column:
    """The text from one token to another as it stands, from the tokens with what follows each."""
    return F.regexp_replace(F.array_join(F.slice(pieces, start + 1, end - start + 1), ""), r"[^\p{L}\p{N}]+$", "")


def responses(
    chunks: DataFrame, names: DataFrame, window: int = WINDOW, least: float = LEAST_SIGNIFICANCE,
) -> DataFrame:
    """Extraction answers without a model (chunk_id, document_id, content, raw) for all chunks that hold a
    name: each name is a TERM, and names that meet significantly often are RELATED_TO each other, with
    the text between them as evidence."""
    found = cut_lineage(find_names(chunks.select("chunk_id", "document_id", "content"), names), "found")
    pairs = cut_lineage(neighbours(found, window=window), "pairs")
    total = chunks.agg(F.count("*")).scalar()
    told = significance(pairs, found, total).where(F.col("likelihood") >= least)
    related = pairs.join(told.select("first", "second", "closeness"), ["first", "second"]).groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "first", "second", "closeness"))).alias("_related"))
    rows = found.join(related, "chunk_id", "left").withColumn(
        "_names", F.array_distinct(F.transform("names", lambda f: f["name"])))
    local = lambda name: F.concat(F.lit("e"), F.array_position("_names", name).cast("string"))
    cut = F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0))
    entities = F.transform("_names", lambda name, i: F.struct(
        F.concat(F.lit("e"), (i + 1).cast("string")).alias("local_id"), name.alias("name"), F.lit("TERM").alias("type"),
        F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("description")))
    relations = tx.once(cut, lambda pieces: F.transform(F.coalesce(
        "_related", F.array().cast(related.schema["_related"].dataType)), lambda r: F.struct(
        local(r["first"]).alias("subject"), F.lit("RELATED_TO").alias("predicate"), local(r["second"]).alias("object"),
        spoken(pieces, r["start"], r["end"]).alias("evidence"),
        F.round(0.6 + 0.4 * r["closeness"], 2).alias("confidence"))))
    body = F.struct("chunk_id", entities.alias("entities"), relations.alias("relations"))
    return rows.select("chunk_id", "document_id", "content", F.to_json(body).alias("raw"))
