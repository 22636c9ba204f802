import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus in which every stage has something to do."""
    rng = random.Random(8)
    rows, labels = [], []
    item = "Maria counts 14 red marbles and 9 blue marbles before lunch, so how many marbles does Maria count in total today?"
    for i in range(240):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 70))]
        toxic = i % 4 == 1
        if toxic:
            words[5] = "scum"
        labels.append((i, 1, int(toxic)))
        rows.append([i, " ".join(words), "en", "s", 0])
    rows[40][1] = rows[36][1] + " one more"
    rows[44][1] = rows[36][1]
    rows[48][1] = f"{rows[48][1]} {item.replace('14', '23')} and so on"
    rows[52][1] += " token=abcdefghijkl0123 end"
    rows += [[900, None, None, None, None], [901, "", "en", "s", 0], [None, "no id here", "en", "s", 0]]
    base = tmp_path_factory.mktemp("sf")
    save = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{base}/{name}.parquet")
    save(rows, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save(labels, "doc_id long, quality int, toxic int", "labels")
    save([(1, item)], "item_id long, text string", "benchmark")
    return str(base), rows


def test_run_matches_the_stages_done_by_hand(spark, folder):
    base, rows = folder
    sp = pytest.importorskip("sentencepiece")
    lib = sp.SentencePieceProcessor(model_file=cp.sentencepiece_bpe.default_model())
    want = {}
    for i, text, *_ in rows:
        if text and "scum" in text or i in (40, 44, 48):
            continue
        if i == 52:
            text = text.replace("token=abcdefghijkl0123", "[SECRET]")
        want[i] = lib.encode(text or "")
    got = {r.doc_id: list(r.ids) for r in cp.run(spark, base).collect()}
    assert got == want


def test_stages_keep_the_columns_and_stand_empty_tables(spark, folder):
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs.limit(0), base)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == 0, name
    assert cp.STAGES[-1][1](spark, docs.limit(0), base).count() == 0


def test_held_out_labels_are_not_used(spark, folder):
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    ids = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    a = cp.toxicity.fit(docs, labels)
    b = cp.toxicity.fit(docs, labels.where(~labels.doc_id.isin(ids)))
    assert (a.out == b.out).all() and (a.embedding == b.embedding).all()


def test_every_run_scans_all_texts_whatever_the_ledger_holds(spark, folder, tmp_path, monkeypatch):
    text = "this run scans password=qwertyuiop1234 itself"
    ledger = f"{tmp_path}/ledger"
    monkeypatch.setattr(cp.secret_scan, "shared_ledger", lambda spark: ledger)
    names = [r.name for r in cp.secret_scan.RULES]
    blob = hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([(blob, names, [])], cp.secret_scan.LEDGER).write.parquet(f"{ledger}/run=earlier")
    fresh = "a text that no run has seen token=zyxwvutsrq98"
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (2, fresh, "en", "s", 0), (3, fresh, "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    masked = {r.doc_id: r.text for r in cp.mask_secrets(spark, docs, folder[0]).collect()}
    assert masked == {1: "this run scans [SECRET] itself", **dict.fromkeys((2, 3), "a text that no run has seen [SECRET]")}
    kept = spark.read.parquet(ledger).where(F.col("blob").isin(blob, hashlib.sha256(fresh.encode()).hexdigest()))
    assert sorted(r["n"] for r in kept.groupBy("blob").agg(F.count("*").alias("n")).collect()) == [1, 1]


def test_leaks_without_doc_id_go(spark, folder):
    base, _ = folder
    item = spark.read.parquet(f"{base}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame(
        [(None, f"before {item} after", "en", "s", 0), (None, "no leak", "en", "s", 0), (None, None, "en", "s", 0), (7, item, "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in cp.drop_leaks(spark, docs, base).collect()} == {"no leak", None}


def test_encoded_documents_hold_the_text_their_ids_give(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "s", 7), (2, None, "en", "s", None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in cp.encode(spark, docs, "").collect()}
    assert got[1].decoded == "one two" and got[2].decoded == "" and got[1].n_tokens == len(got[1].ids) > 0
