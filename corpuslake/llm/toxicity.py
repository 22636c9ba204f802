"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are hashed into a table of embeddings; filters of several widths run over the sequence, each
keeps its largest response anywhere in the text, and a logistic layer weighs them. All labelled
texts are learned from: shards of them train side by side in plain numpy, and after each pass Spark
averages what they found. Thresholds are calibrated by language, where the language is guessed from
the text itself, so that neither labels nor the lang column take part in a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.language_id import is_held_out
from corpuslake.llm.registry import query, table
from corpuslake.llm.words import BARE, Block, Hasher, blocks
from corpuslake.llm.workspace import Workspace, near

WIDTHS = (1, 2, 3)
CALIBRATED = 20  # checked rows of either label that a threshold of a language needs
CHUNK_ROWS = 8000  # texts that a shard shuffles and holds at a time, on average
SHARDS = 32  # learners side by side; each goes through its chunks one after the other
PIECE = 1 << 18  # weights averaged at a time
CELLS = 1 << 16  # scores are counted in so many cells of equal width
LANGUAGES_HELD = 32  # whose counts a task holds before it passes them on
HASHER = Hasher(seed=6, lower=True)


class Model:
    """Weights; ``rows`` embeddings of ``dim`` numbers, ``filters`` filters of each width."""

    ROWS = 1 << 17

    def __init__(self, rows: int = ROWS, dim: int = 16, filters: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.embedding = rng.normal(0, 0.1, (rows, dim)).astype(np.float32)
        self.filters = [rng.normal(0, 0.25, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(filters, 0.05, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.languages = np.zeros((1, rows), np.float32)
        self.thresholds = np.full(1, 0.5, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Response of each embedding row to each place of each filter."""
        return [[self.embedding @ f[k] for k in range(len(f))] for f in self.filters]


def word_rows(block: Block, rows: int) -> np.ndarray:
    return (block.hashes(HASHER) % np.uint64(rows)).astype(np.int64)


def pooled(model: Model, tables, ids: np.ndarray, first: np.ndarray):
    """Largest response of each filter in each document, and the place where it lies.

    A text shorter than a filter gets 0 there, as does one without words."""
    n = len(first) - 1
    features, places = [], []
    for w, rows, bias in zip(WIDTHS, tables, model.bias):
        best = np.zeros((n, bias.size), np.float32)
        where = np.full((n, bias.size), -1)
        has = np.flatnonzero(np.diff(first) >= w)
        if has.size:
            size = len(ids) - w + 1
            out = rows[0][ids[:size]]
            for k in range(1, w):
                out += rows[k][ids[k : size + k]]
            for d in has:
                part = out[first[d] : first[d + 1] - w + 1]
                at = part.argmax(0)
                where[d] = first[d] + at
                best[d] = part[at, np.arange(bias.size)]
            best[has] += bias
        live = best > 0
        features.append(np.where(live, best, 0))
        places.append(np.where(live, where, -1))
    return np.concatenate(features, 1), places


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def guess_language(languages: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Language (its number) whose words fit best; 0 for a text without words."""
    n = len(first) - 1
    if len(languages) == 1 or not len(ids):
        return np.zeros(n, int)
    doc = np.repeat(np.arange(n), np.diff(first))
    fit = np.stack([np.bincount(doc, words[ids], n) for words in languages])
    return fit.argmax(0)


def calibrated(raw: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Raise or lower scores so that the threshold of a language becomes 0.5."""
    odds = np.log(threshold) - np.log1p(-threshold)
    raw = np.clip(raw, 1e-7, 1 - 1e-7)
    return sigmoid(np.log(raw) - np.log1p(-raw) - odds)


def significant(n: np.ndarray, toxic: np.ndarray, n0: int, n1: int, min_docs: int, errors: float) -> np.ndarray:
    """Words that say something: in at least ``min_docs`` of the texts (``n``, of which ``toxic`` have
    label 1), with shares of the texts that differ between the labels by ``errors`` standard errors."""
    share = n / (n0 + n1)
    z = (toxic / n1 - (n - toxic) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    return np.flatnonzero((n >= min_docs) & (np.abs(z) >= errors))


def shortened(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with runs of more zeros (words that say nothing) than the widest filter has places cut to
    that number: no filter meets other words, as it finds a place among zeros alone in either."""
    if not len(rows):
        return rows, first
    at = np.arange(len(rows))
    begin = np.zeros(len(rows), bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    begin[1:] |= (rows[1:] != 0) | (rows[:-1] != 0)
    kept = (rows != 0) | (at - np.maximum.accumulate(np.where(begin, at, 0)) < max(WIDTHS))
    return rows[kept], np.concatenate([[0], np.cumsum(kept)])[first]


def parts_of(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a chunk that are trained on, and the fifth that thresholds are learned from."""
    return order[len(order) // 5 :], order[: len(order) // 5]


def train_chunk(
    model: Model, state: list, step: float, ids: np.ndarray, first: np.ndarray, labels: np.ndarray,
    epoch: int, seed: int, batch: int, rate: float,
) -> float:
    """One pass over the trained rows of a chunk, in an order of this pass; returns the step reached."""
    rng = np.random.default_rng(seed)
    tuned, _ = parts_of(rng.permutation(len(labels)))
    for _ in range(epoch + 1):
        rng.shuffle(tuned)
    for at in range(0, len(tuned), batch):
        own, bounds = texts_at(ids, first, tuned[at : at + batch])
        step += 1
        gradients = _gradients(model, own, bounds, labels[tuned[at : at + batch]])
        gradients[0][0] = 0  # row 0 stands for all words that say nothing
        _adam(model, gradients, state, step, rate)
    return step


def texts_at(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.concatenate([ids[first[d] : first[d + 1]] for d in rows])
    return own, np.concatenate([[0], np.cumsum(first[rows + 1] - first[rows])]).astype(np.int64)


def _raw_scores(model, tables, ids, first):
    features, _ = pooled(model, tables, ids, first)
    return sigmoid(features @ model.out + model.out_bias)


def _gradients(model, ids, first, labels):
    features, places = pooled(model, model.tables(), ids, first)
    error = ((sigmoid(features @ model.out + model.out_bias) - labels) / len(labels)).astype(np.float32)
    g_embedding = np.zeros_like(model.embedding)
    g_filters, g_bias = [np.zeros_like(f) for f in model.filters], []
    size = model.bias[0].size
    for i, (w, at, filt) in enumerate(zip(WIDTHS, places, model.filters)):
        down = error[:, None] * model.out[i * size : (i + 1) * size] * (at >= 0)
        g_bias.append(down.sum(0))
        doc, f = np.nonzero(at >= 0)
        for k in range(w):
            row = ids[at[doc, f] + k]
            pull = down[doc, f][:, None]
            np.add.at(g_embedding, row, pull * filt[k, :, f])
            np.add.at(g_filters[i][k].T, f, pull * model.embedding[row])
    return [g_embedding, *g_filters, *g_bias, features.T @ error, np.array([error.sum()])]


def _adam(model, gradients, state, step, rate):
    for weight, g, (m, v) in zip(model.weights(), gradients, state):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        weight -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


def _best_threshold(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float | None:
    """Middle of the widest gap between cells of scores (from ``low`` to ``high``, ascending, with
    ``n`` rows of which ``hits`` have label 1) with the best F1; None where either label has fewer
    than ``CALIBRATED`` rows to go by."""
    if min(hits.sum(), (n - hits).sum()) < CALIBRATED:
        return None
    down, up = np.concatenate([[0], high]), np.concatenate([low, [1]])
    above = lambda x: np.concatenate([x[::-1].cumsum()[::-1], [0]])
    f1 = np.round(2 * above(hits) / (hits.sum() + above(n)), 6)
    f1[up <= down] = -1
    gap = np.where(f1 == f1.max(), up - down, -1)
    return float(np.clip((down + up)[gap.argmax()] / 2, 0.2, 0.8))


def learnable(docs: DataFrame, labels: DataFrame, work: Workspace) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label, text and lang of all rows to learn from, one for each id, and their number by
    label. Texts are shuffled only where their id repeats, or where the ids are too many to be
    broadcast."""
    marked = work.keep(
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~is_held_out(F.col("doc_id"))).groupBy("doc_id")
        .agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).where("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label")), "marked")
    known = work.keep(
        docs.select("doc_id").join(near(marked), "doc_id").groupBy("doc_id", "label")
        .agg((F.count("*") > 1).alias("again")), "known")
    number, again = {}, False
    for r in known.groupBy("label").agg(F.count("*").alias("n"), F.max("again").alias("again")).collect():
        number[r["label"]], again = r["n"], again or r["again"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(near(known), "doc_id")
    chosen = rows.where(~F.col("again")).select("doc_id", "label", "text", "lang")
    if again:
        least = rows.where("again").groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("x"))
        chosen = chosen.unionByName(least.select("doc_id", "label", "x.text", "x.lang"))
    return chosen, number


def count_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str | None, tuple]]:
    """Texts that hold each word row, those of label 1 among them, and the word rows that each language
    (null: None) uses with how often it does. Counted over all rows; the driver gets at most
    ``Model.ROWS`` counts for each language, one language at a time."""
    size = Model.ROWS

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            word = np.union1d(np.flatnonzero(counts[0]), [0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(word), pa.string()), pa.array(word.astype(np.int32)), *map(pa.array, counts[:, word])],
                ["lang", "word", "n", "toxic", "uses"])
        held.clear()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            langs, label = batch["lang"].to_pylist(), batch["label"].to_numpy()
            for block in blocks(batch["text"], read_as=BARE):
                pair, uses = np.unique(block.doc * size + word_rows(block, size), return_counts=True)
                doc, word = pair // size, pair % size
                of = {lang: k for k, lang in enumerate(dict.fromkeys(langs[block.rows]))}
                code = np.array([of[lang] for lang in langs[block.rows]])[doc]
                for lang, k in of.items():
                    if lang not in held and len(held) >= LANGUAGES_HELD:
                        yield from flushed(held)
                    counts = held.setdefault(lang, np.zeros((3, size), np.int64))
                    own = code == k
                    for row, more in zip(counts, (1, label[block.rows][doc[own]], uses[own])):
                        np.add.at(row, word[own], more)
        yield from flushed(held)

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        word, *counts = (group[c].to_numpy() for c in ("word", "n", "toxic", "uses"))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "word": pa.array([word.tobytes()], pa.binary()),
                         "counts": pa.array([np.stack(counts).tobytes()], pa.binary())})

    words = rows.select("label", "lang", "text").mapInArrow(counted, "lang string, word int, n long, toxic long, uses long")
    words = words.groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("n", "toxic", "uses")])
    n, toxic, languages = np.zeros(size), np.zeros(size), {}
    for r in words.groupBy("lang").applyInArrow(packed, "lang string, word binary, counts binary").toLocalIterator():
        word, counts = np.frombuffer(r["word"], np.int32), np.frombuffer(r["counts"], np.int64).reshape(3, -1)
        n[word] += counts[0]
        toxic[word] += counts[1]
        languages[r["lang"]] = word, counts[2]
    return n, toxic, languages


def encoded(rows: DataFrame, small: np.ndarray, languages: np.ndarray, chunks: int) -> DataFrame:
    """doc_id, label, guessed language and shortened word rows of each text, and where it is learned:
    its chunk, by the hash of its id, and the shard of that."""
    shared = rows.sparkSession.sparkContext.broadcast((small, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, languages = shared.value
        for batch in batches:
            at = 0
            for block in blocks(batch["text"], read_as=BARE):
                ids = word_rows(block, len(small))
                own, first = shortened(small[ids], block.first)
                part = batch.slice(at, len(block.n_words))
                at += len(block.n_words)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["label"], pa.array(guess_language(languages, ids, block.first).astype(np.int32)),
                     pa.array([own[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                    ["doc_id", "label", "language", "ids"])

    doc_id = dict(rows.dtypes)["doc_id"]
    found = rows.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {doc_id}, label int, language int, ids binary")
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(chunks)).cast("int")
    return found.withColumn("chunk", chunk).withColumn("shard", F.col("chunk") % min(SHARDS, chunks))


def by_shard(rows: DataFrame, shards: int, path: str) -> DataFrame:
    """The rows written as a file for each shard, in the order of chunk and id: the passes read them as
    they lie, so that they are shuffled once only. A file beyond a split is read, and learned, in parts."""
    rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "chunk", "doc_id").write.partitionBy(
        "shard").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def kind_of(words: int) -> type:
    """Type of the numbers of so many words that are learned."""
    return np.uint16 if words < 1 << 16 else np.int32


def by_chunk(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple]:
    """Shard, chunk, labels, languages and texts (flat, with their bounds) of each chunk, from rows in
    the order of shard, chunk and id; one chunk is held at a time."""
    def whole(parts):
        label, language = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("label", "language"))
        ids = [np.frombuffer(x.as_py(), kind) for p in parts for x in p["ids"]]
        first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return (parts[0]["shard"][0].as_py(), parts[0]["chunk"][0].as_py(), label.astype(np.float32), language,
                np.concatenate(ids), first)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch["chunk"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[0]["chunk"][0].as_py() != chunk[a]:
                yield whole(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole(held)


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float32)


def load(model: Model, values: np.ndarray) -> tuple[list, float]:
    """Put flat weights into the model; returns moments and step, which follow them."""
    sizes = [w.size for w in model.weights()]
    parts = np.split(values[:-1].copy(), np.cumsum(sizes * 3)[:-1])
    shaped = [part.reshape(w.shape) for part, w in zip(parts, model.weights() * 3)]
    n, f = len(sizes), len(WIDTHS)
    model.embedding, model.filters, model.bias = shaped[0], shaped[1 : 1 + f], shaped[1 + f : 1 + 2 * f]
    model.out, model.out_bias = shaped[n - 2], shaped[n - 1]
    return list(zip(shaped[n : 2 * n], shaped[2 * n :])), float(values[-1])


def averaged(states: DataFrame) -> np.ndarray:
    """Mean of the shards' states, weighted by their rows and summed in the order of the shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total, weight = None, None, 0

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())],
                ["piece", "state"])

        for batch in batches:
            for at, n, state in zip(batch["piece"].to_pylist(), batch["n"].to_pylist(), batch["state"]):
                own = np.frombuffer(state.as_py(), np.float32).astype(float) * n
                if at != piece:
                    if piece is not None:
                        yield done()
                    piece, total, weight = at, own, n
                else:
                    total += own
                    weight += n
        if piece is not None:
            yield done()

    sums = states.repartition("piece").sortWithinPartitions("piece", "shard", "n").mapInArrow(run, "piece int, state binary")
    return np.concatenate([np.frombuffer(r["state"], np.float32) for r in sorted(sums.collect())])


def fit(
    docs: DataFrame, labels: DataFrame, epochs: int = 8, batch: int = 32, rate: float = 0.01, min_docs: int = 5,
    significance: float = 5.0, seed: int = 0, chunk_rows: int = CHUNK_ROWS,
) -> Model:
    """Train on all labelled documents. Labels of held-out rows, nulls and ids that carry both labels are
    not used; of rows that repeat an id the one with the smallest text, then language, is learned.

    All texts weigh the same, so that a text that says nothing gets the share of label 1 among such
    texts. Words that are not ``significant`` keep an embedding of zeros: chance words say nothing. Rows are
    dealt to chunks of about ``chunk_rows`` by the hash of their id, and the chunks to at most ``SHARDS`` shards. In
    each pass every shard goes on from the same weights, chunk by chunk; the driver gets only the mean of
    the shards' weights and moments. A fifth of each chunk is not trained on: thresholds are learned from
    these rows, counted in ``CELLS`` cells of their scores. With one label only, all scores lean
    to it; without rows they are 0.5 and above nowhere."""
    work = Workspace(docs.sparkSession, "toxicity")
    model = Model(seed=seed)
    rows, number = learnable(docs, labels, work)
    if len(number) < 2:
        model.out[:] = 0
        model.out_bias[:] = 4 if 1 in number else -4
        return model
    n, toxic, languages = count_words(rows)
    common = significant(n, toxic, number[0], number[1], min_docs, significance)
    names = sorted(name for name in languages if name is not None)
    if len(names) > 1:
        model.languages = np.empty((len(names), model.rows), np.float32)
        for k, name in enumerate(names):
            uses = np.full(model.rows, 0.1)
            uses[languages[name][0]] += languages[name][1]
            model.languages[k] = np.log(uses / uses.sum())
    del languages
    small = np.zeros(model.rows, kind_of(len(common)))
    small[common] = np.arange(1, len(common) + 1)
    whole, model.embedding = model.embedding, np.concatenate(
        [np.zeros((1, model.embedding.shape[1]), np.float32), model.embedding[common]])

    chunks = -(-sum(number.values()) // chunk_rows)
    dealt = by_shard(encoded(rows, small, model.languages, chunks), min(SHARDS, chunks), f"{work.base}/rows")
    values = flat(model.weights() + [np.zeros_like(w) for w in model.weights() * 2] + [np.zeros(1)])
    for epoch in range(epochs):
        values = averaged(dealt.mapInArrow(
            _learner(docs, values, len(common), epoch, seed, batch, rate), "shard int, piece int, n long, state binary"))
    load(model, values)
    scored = dealt.mapInArrow(_checker(docs, values, len(common), seed), "language int, raw double, label int")
    thresholds = _thresholds(scored)
    other = thresholds.get(-1) or 0.5
    model.thresholds = np.array([thresholds.get(k) or other for k in range(len(model.languages))], np.float32)
    whole[:] = 0
    whole[common] = model.embedding[1:]
    model.embedding = whole
    work.drop("marked", "known", "rows")
    return model


def _learner(docs: DataFrame, values: np.ndarray, words: int, epoch: int, seed: int, size: int, rate: float):
    """One pass of each shard, from the shared weights; its state leaves in pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, n, state, step = Model(words + 1), None, 0, [], 0.0

        def pieces():
            out = flat(model.weights() + [m for m, _ in state] + [v for _, v in state] + [np.array([step])])
            for k, at in enumerate(range(0, len(out), PIECE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now], pa.int32()), pa.array([k], pa.int32()), pa.array([n], pa.int64()),
                     pa.array([out[at : at + PIECE].tobytes()], pa.binary())], ["shard", "piece", "n", "state"])

        for shard, chunk, label, _, ids, first in by_chunk(batches, kind_of(words)):
            if shard != now:
                if now is not None:
                    yield from pieces()
                now, n = shard, 0
                state, step = load(model, shared.value)
            step = train_chunk(model, state, step, ids, first, label, epoch, seed + chunk, size, rate)
            n += len(label)
        if now is not None:
            yield from pieces()

    return run


def _checker(docs: DataFrame, values: np.ndarray, words: int, seed: int):
    """Raw scores of the rows that were not trained on."""
    shared = docs.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(words + 1)
        load(model, shared.value)
        tables = model.tables()
        for _, chunk, label, language, ids, first in by_chunk(batches, kind_of(words)):
            _, checked = parts_of(np.random.default_rng(seed + chunk).permutation(len(label)))
            for at in range(0, len(checked), 256):
                rows = checked[at : at + 256]
                raw = _raw_scores(model, tables, *texts_at(ids, first, rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(language[rows], pa.int32()), pa.array(raw.astype(float)),
                     pa.array(label[rows].astype(np.int32))], ["language", "raw", "label"])

    return run


def _thresholds(scored: DataFrame) -> dict[int, float]:
    """Best threshold of each language that has enough rows, and of all rows under -1."""
    def best(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("cell")
        found = _best_threshold(*[group[c].to_numpy() for c in ("low", "high", "n", "hits")])
        return pa.table({"language": pa.array([key[0].as_py()], pa.int32()), "threshold": pa.array([found], pa.float64())})

    cells = scored.groupBy("language", F.floor(F.col("raw") * CELLS).alias("cell")).agg(
        F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("*").alias("n"), F.sum("label").alias("hits"))
    over = cells.groupBy(F.lit(-1).alias("language"), "cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    found = cells.unionByName(over).groupBy("language").applyInArrow(best, "language int, threshold double")
    return {r["language"]: r["threshold"] for r in found.collect()}


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the columns in ``keep``.

    Whole texts are scored; null and empty texts get the score of a text without words. Repeated
    rows are scored one by one; null ids are kept and never held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: rows x dim floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            scores = [np.zeros(0)]
            for block in blocks(batch["text"], read_as=BARE):
                ids = word_rows(block, model.rows)
                raw = _raw_scores(model, tables, ids, block.first)
                language = guess_language(model.languages, ids, block.first)
                scores.append(calibrated(raw, model.thresholds[language].astype(float)))
            out = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in names] + [pa.array(out, pa.float64()),
                                             pa.array((out >= 0.5).astype(np.int32), pa.int32())],
                [*names, "score", "predicted"])

    names = ["doc_id", "held_out", *keep]
    source = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"),
                         *keep, *[c for c in ["text"] if c not in keep])
    kinds = dict(source.dtypes)
    return source.mapInArrow(
        run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, predicted int")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
