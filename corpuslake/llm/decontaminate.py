"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so that a question with other figures or
persons keeps its template. Windows of a template are hashed and joined between benchmark and
documents; where enough windows of an item meet in a document, the slots of each are compared at its
own place: each slot of the item has to be filled by one value throughout.

Templates are only made of documents that hold a literal word pair of an item. A leak misses at most so
many of an item's windows that it holds at least one of any larger set of them; such a set is chosen
for each item, and of each window in it one pair of words that are no placeholders. Every leak holds
one of these pairs as it stands, so that no leak is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.workspace import Workspace, near

WORDS = 5
SHARE = 0.8  # of an item's distinct windows that a leak contains
LITERALS = 2  # words of a window that are no placeholders; an item without such windows uses all
BROADCAST_WINDOWS = 1_000_000  # windows of the benchmark that are broadcast, beyond it shuffled

# What counts as a unit after a number, number words, and the placeholders.
UNITS = (
    "mm|cm|m|km|in|ft|yd|mi|mg|g|kg|lb|lbs|oz|ml|l|s|sec|min|h|hr|hrs|hour|hours|minute|minutes|second|seconds|"
    "day|days|week|weeks|month|months|year|years|meter|meters|metre|metres|kilometers|miles|mile|feet|inches|"
    "dollar|dollars|cent|cents|euro|euros|usd|eur|percent|degrees"
)
NUMBER_WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|"
    "seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million"
)
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
BEFORE, AFTER = r"[(\[{\"'“‘„«]*", r"[)\]}.,;:!?\"'”’»…]*"  # punctuation that belongs to no slot
IS_NUMBER = (rf"^{BEFORE}(?:[$€£]?[+-]?\d[\d.,:/]*(?i:{UNITS})?[%$€£]?"
             rf"|(?i:{NUMBER_WORDS})(?:-(?i:{NUMBER_WORDS}))*){AFTER}$")
IS_UNIT = rf"^(?i:{UNITS}){AFTER}$"
IS_NAME = rf"^{BEFORE}\p{{Lu}}[\p{{Ll}}'’]*\p{{Ll}}(?:['’]s)?{AFTER}$"
SLOT_EDGE = rf"^{BEFORE}|(?:['’]s)?{AFTER}$"


def words(text: Column) -> Column:
    """Words of a text (runs of anything but ASCII white space and the marks 1 to 3); none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x01-\x03\x09-\x0D\x20]+"), lambda w: w != "")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once (a lambda's variable)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def marked(text: Column) -> Column:
    """Words of a text; a slot begins with a control character: numbers and number words (1), units
    after a number (2), and words with a capital (3), wherever they stand in a sentence. What is in the
    slot stays; other words are lower-cased. How many blanks part two words does not matter."""
    def mark(own: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            after_number = (i > 0) & F.coalesce(F.rlike(F.get(own, i - 1), F.lit(IS_NUMBER)), F.lit(False))
            return (F.when(F.rlike(w, F.lit(IS_NUMBER)), F.concat(F.lit("\x01"), w))
                    .when(F.rlike(w, F.lit(IS_UNIT)) & after_number, F.concat(F.lit("\x02"), w))
                    .when(F.rlike(w, F.lit(IS_NAME)), F.concat(F.lit("\x03"), w)).otherwise(F.lower(w)))
        return F.transform(own, one)

    return once(words(text), mark)


def template(of_marked: Column) -> Column:
    """Template words: placeholders, and all other words in lower case."""
    def one(w: Column) -> Column:
        kind = F.substring(w, 1, 1)
        return F.when(kind == "\x01", NUMBER).when(kind == "\x02", UNIT).when(kind == "\x03", NAME).otherwise(w)

    return F.transform(of_marked, one)


def hashed(of_words: Column) -> Column:
    return F.transform(of_words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column) -> Column:
    """Hashes of all windows; a shorter text is one window, one without words none."""
    def of(h: Column) -> Column:
        last = F.greatest(F.size(h) - WORDS, F.lit(0))
        return F.when(F.size(h) > 0, F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))).otherwise(
            F.array().cast("array<bigint>"))

    return once(hashes, of)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_pos, window, n_windows (distinct windows that count for the item), and a literal
    pair of the window: the hash of its first two words that are no placeholders next to each other, else of
    the first two at all, else of the only one (pair; null if all are placeholders), how far apart
    they are (apart, 0 for a single word), and how long (length)."""
    own = benchmark.where("item_id is not null").select("item_id", template(marked(F.col("text"))).alias("t"))
    own = own.select("item_id", "t", window_hashes(hashed(F.col("t"))).alias("w"))
    rows = own.select("item_id", F.posexplode("w").alias("item_pos", "window"), "t")
    rows = rows.withColumn("own", F.slice("t", F.col("item_pos") + 1, WORDS))
    literal = lambda w: ~w.isin(NUMBER, UNIT, NAME)
    options = []
    for apart in [*range(1, WORDS), 0]:
        for k in range(WORDS - apart):
            a, b = F.get("own", F.lit(k)), F.get("own", F.lit(k + apart))
            options.append(F.when(literal(a) & literal(b), F.struct(
                pair_of(F.xxhash64(a), F.xxhash64(b), apart).alias("pair"), F.lit(apart).alias("apart"),
                (F.length(a) + F.length(b)).alias("length"))))
    rows = rows.withColumn("p", F.coalesce(*options)).withColumn(
        "told", F.size(F.filter("own", lambda w: ~literal(w))) <= WORDS - LITERALS)
    sizes = rows.groupBy("item_id").agg(
        F.count_distinct(F.when(F.col("told"), F.col("window"))).alias("n"),
        F.count_distinct("window").alias("all"))
    return rows.join(sizes, "item_id").where("told or n = 0").select(
        "item_id", "item_pos", "window", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("all")).alias("n_windows"),
        "p.pair", "p.apart", "p.length")


def pair_of(a: Column, b: Column, apart: int) -> Column:
    return F.xxhash64(a, b, F.lit(apart))


def literal_pairs(items: DataFrame) -> DataFrame:
    """pair, apart: of each item as many windows as no leak can miss, those with neighbouring and
    long literal words first. A null pair stands for windows that any text may hold."""
    distinct = items.groupBy("item_id", "window", "n_windows").agg(
        F.min(F.struct(F.coalesce(F.col("apart") + (F.col("apart") == 0).cast("int") * WORDS, F.lit(2 * WORDS)).alias("far"),
                       (-F.col("length")).alias("short"), "pair", "apart")).alias("p"))
    order = Window.partitionBy("item_id").orderBy("p", "window")  # an item's windows
    needed = F.col("n_windows") - F.ceil(F.lit(SHARE) * F.col("n_windows")) + 1
    return distinct.withColumn("place", F.row_number().over(order)).where(F.col("place") <= needed).select(
        "p.pair", "p.apart").distinct()


def suspects(docs: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """Documents (doc_id, text_hash) that hold one of the pairs; all of them if a pair is null."""
    kinds = [r[0] for r in pairs.select("apart").distinct().orderBy("apart").collect()]  # at most 0 to 4 and null
    if None in kinds:
        return work.keep(docs.select("doc_id", "text_hash").distinct(), "suspects")
    found = [c for c in kinds if c is not None]

    def of(h: Column) -> Column:
        def all_pairs(apart: int) -> Column:
            return F.transform(h, lambda x, i: pair_of(x, F.get(h, i + apart), apart))

        return F.flatten(F.array(*[all_pairs(a) for a in found])) if len(found) > 1 else all_pairs(found[0])

    if not found:
        return work.keep(docs.select("doc_id", "text_hash").limit(0), "suspects")
    seen = docs.select("doc_id", "text_hash", F.explode(once(hashed(words(F.lower("text"))), of)).alias("pair"))
    return work.keep(seen.join(near(pairs.select("pair").distinct(), BROADCAST_WINDOWS), "pair").select(
        "doc_id", "text_hash").distinct(), "suspects")


def bare(word: Column) -> Column:
    """A slot's value in lower case, without the punctuation around it; other words as they are."""
    inside = F.regexp_replace(F.substring(word, 2, 1 << 30), SLOT_EDGE, "")
    return F.when(F.substring(word, 1, 1).isin("\x01", "\x02", "\x03"), F.lower(inside)).otherwise(word)


def places() -> Column:
    """Each window of the item at each of its places in the document: item_pos, offset, window, and
    its slots (what the item has, what the document has there)."""
    def slots(pos: Column, offset: Column) -> Column:
        at = F.filter(F.array(*[pos + k for k in range(WORDS)]), lambda p: F.coalesce(
            F.substring(F.get("asked", p), 1, 1).isin("\x01", "\x02", "\x03"), F.lit(False)))
        return F.transform(at, lambda p: F.struct(
            bare(F.get("asked", p)).alias("asked"), bare(F.get("said", p + offset)).alias("said")))

    return F.flatten(F.transform("hits", lambda h: F.transform(h["w"], lambda x: F.struct(
        x["item_pos"].alias("item_pos"), h["offset"].alias("offset"), x["window"].alias("window"),
        slots(x["item_pos"], h["offset"]).alias("slots")))))


def verbatim() -> Column:
    """The item's words stand in the document one after the other."""
    def there(offset: Column) -> Column:
        own = F.slice("said", offset + 1, F.size("asked"))
        return F.transform("asked", bare) == F.transform(own, bare)

    return F.exists("hits", lambda h: F.when(h["offset"] >= 0, there(F.greatest(h["offset"], F.lit(0)))).otherwise(False))


def as_asked() -> Column:
    """All shared windows occur with the item's own values."""
    same = F.filter("places", lambda x: ~F.exists(x["slots"], lambda y: ~y["asked"].eqNullSafe(y["said"])))
    positions = lambda p: F.array_distinct(F.transform(p, lambda x: x["item_pos"]))
    return F.size(positions(same)) == F.size(positions(F.col("places")))


def one_value() -> Column:
    """Around some offset, enough windows (each at its place next to that offset) fill every slot of
    the item by one value."""
    def first_places(at: Column) -> Column:
        near_by = F.array_sort(F.transform(
            F.filter("places", lambda x: F.abs(x["offset"] - at) < F.size("asked")),
            lambda x: F.struct(x["item_pos"].alias("item_pos"), F.abs(x["offset"] - at).alias("away"),
                               x["window"].alias("window"), x["slots"].alias("slots"))))
        return F.flatten(F.transform(F.array(near_by), lambda own: F.filter(
            own, lambda x, i: (i == 0) | (F.get(own, i - 1)["item_pos"] != x["item_pos"]))))

    def told(own: Column) -> Column:
        slots = F.array_distinct(F.flatten(F.transform(own, lambda x: x["slots"])))
        enough = F.size(F.array_distinct(F.transform(own, lambda x: x["window"]))) >= SHARE * F.col("n_windows")
        return enough & (F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda x: x["asked"]))))

    # The offsets with the most windows first: the search ends at the first that fits.
    offsets = F.transform(F.sort_array(F.transform("hits", lambda h: F.struct(
        F.size(h["w"]).alias("n"), h["offset"].alias("offset"))), False), lambda x: x["offset"])
    return F.exists(offsets, lambda at: F.exists(F.array(
        first_places(at), F.filter("places", lambda x: x["offset"] == at).cast(
            "array<struct<item_pos:int,away:int,window:bigint,slots:array<struct<asked:string,said:string>>>>")), told))


def leaks(docs: DataFrame, benchmark: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document text and benchmark item that it leaks: doc_id, text_hash, item_id,
    n_windows, n_shared, share, verbatim (the words are the item's), consistent.

    Null and empty texts leak nothing and items without words are leaked by nothing; rows without
    doc_id or item_id take no part. Equal texts of one doc_id give one row. A leak holds ``SHARE`` of
    the item's windows; it is verbatim, or all shared windows also occur with the item's own values,
    or around one place in the document every slot of the item has one value throughout the windows,
    each compared where it is (words may be inserted or missing in between). Other columns are dropped.
    """
    work = work or Workspace(docs.sparkSession, "leaks")
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    items = work.keep(item_windows(benchmark), "items")
    some = suspects(docs, work.keep(literal_pairs(items), "pairs"), work)
    picked = docs.join(near(some), ["doc_id", "text_hash"], "left_semi")
    seen = picked.select("doc_id", "text_hash", F.posexplode(
        window_hashes(hashed(template(marked(F.col("text")))))).alias("pos", "window"))
    items = items.select("item_id", "item_pos", "window", "n_windows")
    hits = seen.join(near(items, BROADCAST_WINDOWS), "window").groupBy(
        "doc_id", "text_hash", "item_id", "n_windows", (F.col("pos") - F.col("item_pos")).alias("offset"),
    ).agg(F.collect_set(F.struct("window", "item_pos")).alias("w"))  # an item's windows at most
    own = F.array_distinct(F.transform(F.flatten(F.collect_list("w")), lambda x: x["window"]))
    found = hits.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(
        F.size(own).alias("n_shared"), F.collect_list(F.struct("offset", "w")).alias("hits"),
    ).where(F.col("n_shared") >= SHARE * F.col("n_windows"))
    found = work.keep(found, "found")

    asked = benchmark.where("item_id is not null").select("item_id", marked(F.col("text")).alias("asked"))
    # Only the few texts with enough windows are shuffled.
    keys = work.keep(found.select("doc_id", "text_hash").distinct(), "keys")
    picked = docs.join(near(keys), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    pairs = picked.join(found.hint("shuffle_hash"), ["doc_id", "text_hash"])
    pairs = pairs.withColumn("said", marked(F.col("text"))).drop("text").join(asked, "item_id")
    # Written, or the filter on the result would work out the places anew at each of its steps.
    pairs = work.keep(pairs.withColumn("places", places()).withColumn("verbatim", verbatim()).drop("said"), "pairs")
    return pairs.select(
        "doc_id", "text_hash", "item_id", F.col("n_windows").cast("long"), F.col("n_shared").cast("long"),
        (F.col("n_shared") / F.col("n_windows")).alias("share"), "verbatim",
        (F.col("verbatim") | as_asked() | one_value()).alias("consistent"),
    ).where("consistent")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item; all columns stay. Rows without doc_id are judged by their text like others."""
    work = Workspace(docs.sparkSession, "leaks")
    named = F.coalesce(docs["doc_id"], F.xxhash64(docs["text"]))
    bad = work.keep(leaks(docs.withColumn("doc_id", named), benchmark, work).select("doc_id", "text_hash").distinct(), "bad")
    bad = near(bad.select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")))
    return docs.join(bad, (named == bad["leak_id"]) & (F.xxhash64(docs["text"]) == bad["leak_hash"]), "left_anti")


@query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
