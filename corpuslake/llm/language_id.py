"""Language identification by compression.

One raw-content zstandard dictionary is cut from training texts of each language. A text gets the
language whose dictionary compresses it to the fewest bytes; where the runner-up is close, the
prediction is not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.llm.registry import query, table

UNKNOWN = "und"
PARTS = 32  # of a language while its sample is drawn
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def is_held_out(doc_id):
    """Rows whose crc32 (of the id as text) divides by 5; they are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_texts: int = 256) -> dict[str, bytes]:
    """Dictionary content per language, from at most ``sample_texts`` whole texts of each language: the
    rows with the smallest hashes of their ids. Of rows that repeat an id, the one with the smallest
    language, then text, counts. Rows without id, text or language teach nothing; no such row gives no
    language."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                       & (F.length("text") > 0) & ~is_held_out(F.col("doc_id")))
    # One row an id first; then the first rows of each part of a language, so that a language that most
    # rows have is spread over ``PARTS`` tasks and a bounded number of its rows meets in one.
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn(
        "mark", F.xxhash64(F.col("doc_id").cast("string"))).withColumn("part", F.pmod("mark", F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        place = Window.partitionBy(*keys).orderBy("mark", "doc_id")
        ids = ids.withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample_texts).drop("place")
    chosen = ids.select("doc_id", "lang")
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    content: dict[str, list[bytes]] = {}
    for r in texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").toLocalIterator():
        content.setdefault(r["lang"], []).append(letters(r["text"]))
    return {lang: b" ".join(parts) for lang, parts in content.items()}


def letters(text: str) -> bytes:
    """Lower-cased letters with single spaces in place of everything else."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def classify(text: str | None, models: list, narrow: float) -> tuple[str, float, bool]:
    """Language, margin over the runner-up (0 to 1) and whether it is accepted."""
    if not text or not models or not _LETTER.search(text):
        return UNKNOWN, 0.0, False
    raw = letters(text)
    sizes = sorted((len(model.compress(raw)), lang) for lang, model in models)
    best, lang = sizes[0]
    if len(sizes) == 1:
        return lang, 1.0, True
    margin = (sizes[1][0] - best) / sizes[1][0]
    return lang, margin, margin >= narrow


def predict(
    docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = 0.01, level: int = 6,
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted.

    ``lang_pred`` is ``und`` for null texts, texts without a letter, and where nothing was learned.
    Equal sizes go to the language first in the alphabet; ``accepted`` is false where the margin
    is below ``narrow``. Repeated rows are judged one by one; other columns are dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = []
        for lang, content in sorted(dictionaries.items()):
            shared = zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level)
            models.append((lang, zstandard.ZstdCompressor(
                dict_data=shared, write_content_size=False, write_dict_id=False)))
        for batch in batches:
            found = [classify(t.as_py(), models, narrow) for t in batch["text"]]
            lang, score, accepted = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()),
                 pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    doc_id = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {doc_id}, held_out boolean, lang_pred string, score double, accepted boolean")


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
