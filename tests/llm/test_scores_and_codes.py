"""Language, toxicity, secrets, urls and token codes on small inputs."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslake.llm import language_id, secret_scan, sentencepiece_bpe, toxicity, url_filter
from corpuslake.llm.words import Hasher, blocks

WORDS = {
    "en": "the and of to in that with from there their which would these about people",
    "de": "der die und nicht ein eine schön über für zwischen wurde gegen können müssen Straße",
    "fr": "le la les des être avec pour dans était après même où déjà français garçon",
}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        text = [rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(8, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["Idiot!", "scum", "moron,"]))
        rows.append((i, " ".join(text), lang, int(toxic)))
    return rows


def test_language_by_compression(spark):
    rows = [(i, t, lang) for i, t, lang, _ in corpus()]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "de"), (1002, "", None), (None, "the people of which", "en"),
             (1003, "der die und " * 20_000, None), (1003, "der die und " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {}
    for r in language_id.predict(df, language_id.fit(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(got[i][0].lang_pred == lang for i, _, lang in rows[:400] if held_out(i)) >= 0.95 * sum(
        held_out(i) for i in range(400))
    assert all(r.held_out == held_out(i) for i in range(400) for r in got[i])
    assert [got[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert [r.lang_pred for r in got[1003]] == ["de", "de"] and got[None][0].held_out is False
    assert all(0 <= r.score <= 1 for own in got.values() for r in own)
    none = df.limit(0)
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    assert language_id.predict(df, {}).where("lang_pred <> 'und'").count() == 0


def test_toxicity_is_learned_and_labels_are_no_input(spark):
    rows = corpus(900, 1)
    df = spark.createDataFrame([(i, t, lang, "x") for i, t, lang, _ in rows] + [
        (5000, None, None, None), (5001, "", "en", "x"), (None, "idiot", "en", "x")],
        "doc_id long, text string, lang string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    wrong = sum(got[i].predicted != y for i, _, _, y in rows if held_out(i))
    assert wrong <= 0.05 * sum(held_out(i) for i, *_ in rows)
    assert got[5000].predicted == got[5001].predicted == 0 and got[5000].score == got[5001].score
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    flat = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df, flat).where("predicted = 1").count() == 0
    assert toxicity.score(df.limit(0), flat).count() == 0


def test_toxicity_learns_from_all_labelled_rows(spark):
    # One word in fifty toxic texts, among more than the 4,000 of a label that were once learned from.
    rows = [(i, f"filler w{i % 7} " + ("vermin" if i % 250 == 1 else "idiot" if i % 2 else "calm") + " end", i % 2)
            for i in range(24_000)]
    df = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learned = [(t, y) for i, t, y in rows if not held_out(i)]
    chosen, number = toxicity.learnable(df, labels, toxicity.Workspace(spark, "test"))
    assert number == {y: sum(own == y for _, own in learned) for y in (0, 1)} and min(number.values()) > 4000
    n, toxic, _ = toxicity.count_words(chosen)
    row = int(toxicity.word_rows(next(toxicity.blocks(toxicity.pa.array(["vermin"]))), toxicity.Model.ROWS)[0])
    assert n[row] == toxic[row] == sum("vermin" in t for t, _ in learned)
    one, two = toxicity.fit(df, labels), toxicity.fit(df.repartition(7), labels.repartition(3))  # several chunks
    assert all((a == b).all() for a, b in zip(one.weights(), two.weights()))
    got = {r.doc_id: r.predicted for r in toxicity.score(df, one).collect()}
    assert all(got[i] == y for i, _, y in rows if held_out(i))


def test_shortened_texts_give_the_same_responses():
    rng = toxicity.np.random.default_rng(1)
    model = toxicity.Model(5)
    model.embedding[0] = 0
    for share in (0.05, 0.5, 1):
        sizes = rng.integers(0, 30, 40)
        first = toxicity.np.concatenate([[0], sizes.cumsum()])
        ids = rng.integers(1, 5, first[-1]) * (rng.random(first[-1]) < share)
        short, bounds = toxicity.shortened(ids, first)
        assert share == 1 or len(short) < len(ids)
        want, _ = toxicity.pooled(model, model.tables(), ids, first)
        got, _ = toxicity.pooled(model, model.tables(), short, bounds)
        assert (want == got).all()


def test_learning_does_not_depend_on_partitions_repeats_or_other_columns(spark):
    rows = corpus(500, 3)
    df = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    again = df.union(df.where("doc_id % 3 = 0")).repartition(9).withColumns({
        "place": F.lit(1), "mark": F.lit("x"), "part": F.lit(2), "score": F.lit(0.5), "predicted": F.lit(7),
        "held_out": F.lit(True), "label": F.lit("y"), "ids": F.lit(b"z")})
    assert language_id.fit(df) == language_id.fit(again)
    found = {r.doc_id: tuple(r) for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert {tuple(r) for r in language_id.predict(again, language_id.fit(again)).collect()} == set(found.values())
    one, two = toxicity.fit(df, labels), toxicity.fit(again, labels.withColumn("text", F.lit("t")).union(
        labels.withColumn("text", F.lit("u"))).repartition(5))
    assert all((a == b).all() for a, b in zip(one.weights(), two.weights()))
    assert {tuple(r) for r in toxicity.score(again, two).collect()} == {tuple(r) for r in toxicity.score(df, one).collect()}


def test_many_languages_and_very_long_texts(spark):
    rows = [(i, f"l{i % 300:03} " + " ".join(f"w{i % 300}x{k}" for k in range(30)), f"l{i % 300:03}") for i in range(1200)]
    rows.append((5000, "idiot " + "the people of which " * 60_000, "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(df)) >= 290  # no bound on the number of languages
    labels = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels)).where("doc_id = 5000").count() == 1


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_a_later_run_scans_only_texts_that_the_ledger_lacks(spark, tmp_path):
    import corpus_pipeline

    texts = [f"a ledger test says token=abcdefghijkl{i}" for i in range(4)]
    for step in (2, 3):
        spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts[:step])],
                              "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{step}/documents.parquet")
        assert secret_scan.op2_secret_scan(spark, f"{tmp_path}/{step}").where("n_assign = 1").count() == step
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    masked = corpus_pipeline.mask_secrets(spark, docs, str(tmp_path))
    assert [r.text for r in masked.collect()] == ["a ledger test says [SECRET]"] * 4
    own = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    ledger = spark.read.parquet(secret_scan.shared_ledger(spark)).where(F.col("blob").isin(own))
    assert sorted(r["blob"] for r in ledger.collect()) == sorted(own)


def test_secret_spans_like_plain_regular_expressions(spark):
    rng = random.Random(2)
    parts = ["token=", "Secret : \"", "api_key='", "APIKEY:", "password", "=", ":", "AKIA", "A" * 15, "0123456789abcdef", "ab12",
             "Zz9+/_.=-" * 2, " ", "\n", "é😀", "x", "token=token:", "AKIAAKIA"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from corpuslake.llm.workspace import Workspace
    ledger = f"{Workspace(spark, 'test').base}/ledger"
    base = secret_scan.scan(df, ledger, rules=secret_scan.BASE)
    got = base.select("doc_id", secret_scan.joined(F.col("spans")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted((str(i), base_spans(t or "")) for i, t in rows)
    # A second scan with more rules runs those only; blobs that are known stay known.
    before = spark.read.parquet(ledger).count()
    secret_scan.scan(df, ledger, rules=secret_scan.BASE).count()
    assert spark.read.parquet(ledger).count() == before
    more = secret_scan.scan(df, ledger)
    assert spark.read.parquet(ledger).where("size(rules) = 5").count() == before
    assert more.count() == len(rows)
    assert secret_scan.scan(df.limit(0), ledger).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdefghijklmnop b"), (2, "plain"), (3, None)], "doc_id long, text string")
    from corpuslake.llm.workspace import Workspace
    found = secret_scan.scan(df, f"{Workspace(spark, 'test').base}/ledger").join(df, "doc_id")
    got = {r.doc_id: r.t for r in found.select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "a [SECRET] b", 2: "plain", 3: None}


def test_masked_texts_hold_nothing_of_keys_and_passwords(spark):
    rng = random.Random(5)
    body = ["".join(rng.choice("abcdefghABCDEFGH0123456789+/") for _ in range(64)) for _ in range(20)] + ["Zk9+"]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n"
    long = "x" * 40 + "Y" * 40
    texts = {
        1: (f"a {begin}\n" + "\n".join(body) + f"\n{end} b", "a [SECRET] b"),
        2: (f"a {begin}\n{head}" + "\r\n".join(body) + f"\r\n{end}\nb", "a [SECRET]\nb"),
        3: (f"a {begin}\n" + "\n".join(body) + "\n\nb is not of it", "a [SECRET]\n\nb is not of it"),
        4: (f'k="{begin}' + "\\n" + "\\n".join(body) + '"; b', 'k="[SECRET]"; b'),
        5: (f"{begin} " + " ".join(body[:-1]) + " Zg== b c", "[SECRET] b c"),
        6: (f"{begin}\n" + "\n".join(body) + f"\n-- b - {begin}\n" + "\n".join(body) + f"\n{end}", "[SECRET]\n-- b - [SECRET]"),
        7: (f"a https://bot:{long}@host/x b", "a [SECRET]host/x b"),
        8: ("redis://:pass0word@host", "[SECRET]host"),
        9: (f"https://{long}:{long}@host", "[SECRET]host"),
        10: ("averyveryveryverylongscheme+ssh://u:pass0word@host", "[SECRET]host"),
        11: ("http://h.org:80/a@b http://h.org/:abcd@x", "http://h.org:80/a@b http://h.org/:abcd@x"),
        12: (f"{begin}\n" + "\n".join(body * 3000), "[SECRET]"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    from corpuslake.llm.workspace import Workspace
    found = secret_scan.scan(df, f"{Workspace(spark, 'test').base}/ledger").join(df, "doc_id")
    got = {r.doc_id: r.t for r in found.select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {i: t for i, (_, t) in texts.items()}
    assert {r.name for r in secret_scan.RULES if r.version == 2} == {"pem@2", "userinfo@2"}


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.STATED
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(e, host + path) for _, _, e in url_filter.EXPRESSIONS)
    return host, path, None, "block" if bad else "allow"


def test_urls_like_all_rules_tried(spark):
    urls = [None, "", "x", "http://", "HTTP://A.EXAMPLE.COM/en/71?x#y", "http://example.com/en/8", "http://com/en/", "a://notcom/en/1",
            "http://b.example.net/de/8x", "http://k.net/de/", "http://adult-x.example.org/es/", "http://adult-x.de/q",
            "http://s.org/es", "http://s.org/es/é", "http://u:p@x.com:80/en/", "//x.com/en/", "http://a.com//en/", "http://casino.x.fr",
            "http://É.com/en/1", "http://x.com/en/?a=://b.net/de/1"] * 2
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[5])], "page_id long, url string").withColumn("host", F.lit(1))
    got = url_filter.filter_pages(df, url_filter.rule_table(spark)).collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == sorted(
        (str(i), *judge(u)) for i, u in [*enumerate(urls), (None, urls[5])])
    assert url_filter.filter_pages(df.limit(0), url_filter.rule_table(spark)).count() == 0


def test_stated_urls_have_the_contract_verdicts(spark):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://k.net/de/1": ("net/de/", "allow"), "http://casino.k.net/de/": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://s.org/es/": ("org/es/", "block"),
        "http://k.net/fr/": (None, "allow"), "http://casino.k.net/fr/": (None, "block"),
    }
    df = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    urls, got = list(want), url_filter.filter_pages(df, url_filter.rule_table(spark)).collect()
    assert {urls[r.page_id]: (r.rule, r.verdict) for r in got} == want


def test_codes_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    path = sentencepiece_bpe.default_model()
    lib = sp.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    vocab = sentencepiece_bpe.vocabulary(path)
    texts = [None, "", " ", "a", "  a b ", "a\n▁b", "日本\x00é", "<s>a</s>", "<0x0A>", " " * 5000, "x" * 3000, "👍🏽 ok", "\n" * 300,
             "ab" * 2000 + " " * 33 + "t"]
    texts += [" " * n + "the" for n in range(1, 50)] + ["q" + " " * n for n in range(1, 50)]
    texts += ["".join(vocab.pieces[rng.randrange(259, vocab.n)] for _ in range(12)).replace("▁", " ") for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece_bpe.encode(df, path, "doc_id").collect():
        want = lib.encode(texts[r.doc_id] or "")
        assert list(r.ids) == want and r.decoded == lib.decode(want)
    for r in sentencepiece_bpe.digests(df, path).collect():
        want = lib.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    assert sentencepiece_bpe.digests(df.limit(0), path).count() == 0


def test_word_hashes_do_not_depend_on_blocks():
    import pyarrow as pa
    texts = pa.array(["the Cat\tsat", None, "", " sat  the ", "É cat"])
    h = Hasher(1, lower=True)
    of = lambda limit: [x for b in blocks(texts, limit) for x in b.hashes(h).tolist()]
    assert of(1) == of(1 << 20)
    the, cat, sat, sat2, the2, _, cat2 = of(1)
    assert (the, cat, sat) == (the2, cat2, sat2) and len({the, cat, sat}) == 3
