"""Document fingerprints: one-permutation MinHash.

Every shingle of a text is hashed once. The upper bits of a hash choose its bin, the smallest hash of a
bin stands for it, and an empty bin borrows from a bin that the text does fill (optimal densification:
each empty bin walks its own fixed permutation of the bins up to the first filled one). Of each bin four
bits are stored, packed into longs. Likeness is the share of equal places, corrected for those that
are equal by chance. All of it is column functions.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.words import mix
from corpuslake.llm.workspace import near

WORDS = 5  # words of a shingle
BINS = 256
BITS = 4
WORD_BINS = 64 // BITS  # bins in one packed long
PROBES = 6  # bins that an empty one tries before all filled bins are ranked in its own order
RANGES = 4  # ranges of documents for each shuffle partition, or more if they had
RANGE_ROWS = 20_000  # over so many rows each


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once (a lambda's variable)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def none() -> Column:
    return F.array().cast("array<bigint>")


def shingle_hashes(text: Column) -> Column:
    """Sorted distinct hashes of all windows of five words (runs of anything but ASCII white space, lower
    case); a shorter text is one window; none without words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(h) - WORDS, F.lit(0)))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))

    return F.sort_array(F.array_distinct(once(hashes, lambda h: F.when(F.size(h) > 0, windows(h)).otherwise(none()))))


def bin_of(h: Column) -> Column:
    """Bin of a hash: its upper bits, in the order of the hashes."""
    return (F.shiftright(h, 64 - BINS.bit_length() + 1) + BINS // 2).cast("int")


def smallest(hashes: Column) -> Column:
    """First of the sorted hashes of each filled bin."""
    return once(hashes, lambda all_: F.filter(
        all_, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(all_, i - 1)))))


def spread(firsts: Column) -> Column:
    """One place for each bin: its smallest hash, null where the bin is empty."""
    def filled(f: Column) -> Column:
        def gap(h: Column, i: Column) -> Column:
            upto = F.coalesce(bin_of(F.get(f, i + 1)), F.lit(BINS))
            return F.concat(F.array(h), F.array_repeat(F.lit(None).cast("long"), (upto - bin_of(h) - 1).cast("int")))

        lead = F.array_repeat(F.lit(None).cast("long"), bin_of(F.get(f, F.lit(0))))
        return F.concat(lead, F.flatten(F.transform(f, gap)))

    return once(firsts, filled)


def walks() -> list[dict]:
    """Walk of each bin over all bins: its first tries, its start, and the inverse of its odd step."""
    drawn = mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for m in drawn.tolist():
        start, step = m % BINS, (m >> 32) % (BINS // 2) * 2 + 1
        out.append({"start": start, "inverse": pow(step, -1, BINS), "tries": [(start + step * t) % BINS for t in range(PROBES)]})
    return out


def densified(firsts: Column) -> Column:
    """A hash for every bin (null without hashes). An empty bin takes that of the first filled bin on its
    walk; where the first tries find none, the filled bins are ranked by their place on the same walk."""
    known = F.from_json(F.lit(json.dumps(walks())), "array<struct<start:int,inverse:int,tries:array<int>>>")

    def borrowed(f: Column, bins: Column, i: Column) -> Column:
        walk = F.get(known, i)
        tries = [F.get(bins, F.get(walk["tries"], F.lit(k))) for k in range(PROBES)]
        ranked = F.transform(f, lambda h: F.struct(
            ((bin_of(h) - walk["start"]) * walk["inverse"]).bitwiseAND(BINS - 1).alias("place"), h.alias("h")))
        return F.coalesce(*tries, F.array_min(ranked)["h"])

    return once(firsts, lambda f: F.when(F.size(f) > 0, once(
        spread(f), lambda bins: F.transform(bins, lambda h, i: F.coalesce(h, borrowed(f, bins, i))))))


def packed(bins: Column) -> Column:
    """The low bits of each bin's hash (mixed with the bin's number, so that bins that borrowed one hash
    still tell texts apart), 16 bins a long."""
    low = F.transform(bins, lambda h, i: F.xxhash64(h, i).bitwiseAND((1 << BITS) - 1))

    def words(b: Column) -> Column:
        def word(w: Column) -> Column:
            total = F.get(b, w * WORD_BINS)
            for k in range(1, WORD_BINS):
                total = total.bitwiseOR(F.shiftleft(F.get(b, w * WORD_BINS + k), BITS * k))
            return total

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // WORD_BINS - 1)), word)

    return once(low, words)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text; no longs for a text without words (or null)."""
    return once(shingle_hashes(F.coalesce(text, F.lit(""))), lambda h: F.when(
        F.size(h) > 0, packed(densified(smallest(h)))).otherwise(none()))


def as_text(print_: Column) -> Column:
    """A hexadecimal digit for each bin."""
    return F.concat_ws("", F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: equal places, without those that are equal by chance (one in
    2**BITS of the others). Two texts without words are alike, one of them is like no other text."""
    low = sum(1 << (BITS * k) for k in range(WORD_BINS))

    def unlike(d: Column) -> Column:
        any_ = d
        for k in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(any_.bitwiseAND(low))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, d: n + unlike(d))
    chance = 1 / (1 << BITS)
    share = (F.lit(1.0) - differing / F.lit(float(BINS)) - chance) / (1 - chance)
    both = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(both == 2, 1.0).when(both == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def first_of_ranges(docs: DataFrame) -> list[tuple]:
    """(doc_id, h) of the first document of each range of documents, ascending. One small row a range
    reaches the driver, as with Spark's own range partitioning."""
    spark = docs.sparkSession
    ranges = max(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    lows = docs.select("doc_id", "h").repartitionByRange(ranges, "doc_id", "h").groupBy(F.spark_partition_id()).agg(
        F.min(F.struct("doc_id", "h")).alias("low")).select("low.doc_id", "low.h").distinct().collect()
    return sorted(((r[0], r[1]) for r in lows), key=lambda x: (x[0] is not None, x))


def range_of(cuts: list[tuple]) -> Column:
    """Number of the range that a row (doc_id, h) lies in, found in two steps."""
    width = max(1, math.isqrt(len(cuts)))
    kind = "array<struct<doc_id:bigint,h:bigint>>"
    rows = [{"doc_id": d, "h": h} for d, h in cuts]
    every, coarse = (F.from_json(F.lit(json.dumps(x)), kind) for x in (rows, rows[::width]))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "h")
    before = lambda some: F.size(F.filter(some, lambda c: c <= own)) - 1
    return once(before(coarse), lambda g: g * width + before(F.slice(every, g * width + 1, width)))


def followed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, text, own: the fingerprint) with the text and fingerprint of the next one (next).
    Every range of documents also gets a copy of the first row of the range after it (the last one:
    of the first), so that each text is shuffled once and ranges are handled apart."""
    cuts = first_of_ranges(docs) or [(None, 0)]
    heads = docs.sparkSession.createDataFrame(
        [(d, h, (i - 1) % len(cuts)) for i, (d, h) in enumerate(cuts)], "head_id long, head_h long, range int")
    after = docs.join(near(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
    after = after.dropDuplicates(["range"]).drop("head_id", "head_h").withColumn("late", F.lit(True))
    rows = docs.withColumn("range", range_of(cuts)).withColumn("late", F.lit(False)).unionByName(after)
    rows = rows.withColumn("own", fingerprint(F.col("text")))
    place = Window.partitionBy("range").orderBy("late", "doc_id", "h")
    return rows.withColumn("next", F.lead(F.struct("text", "own")).over(place)).where("not late").drop("range", "late")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    In the edited text the last half of the code points (rounded down) gives way to the first as many (or
    all) of the next document's. Documents follow each other by doc_id (null first), then by the
    hash of the text; repeated rows are documents of their own; a single one follows itself. Null texts
    are empty. A text without words has an empty fingerprint. Other columns are dropped.
    """
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    rows = followed(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)))
    rows = rows.withColumn("changed", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next.own")).alias("near_next"))


@query("op13_fingerprints")
def op13_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
