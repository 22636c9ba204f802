"""Chroma fingerprints of audio columns, and alignment of recordings.

Audio becomes frames of twelve pitch classes. Filters over areas of these frames (sums from an
integral image) give two bits each, packed into one integer per frame. Recordings meet where two
successive integers are equal; a histogram of offsets aligns them, and the share of differing bits
along the alignment decides.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.links import linked
from corpuslake.llm.registry import query, table
from corpuslake.llm.words import mix, ragged
from corpuslake.llm.workspace import Workspace, components

FRAME, HOP = 0.256, 0.064  # seconds
LOWEST, HIGHEST = 100.0, 1900.0  # Hz that count
MAX_ERROR = 0.2  # share of differing bits of aligned recordings
MIN_OVERLAP = 8  # frames, and at least half of the shorter recording
# Fixed values of this operator: sixteen filters (kind, first pitch class, classes, frames) and the
# thresholds of the two bits. Kinds: 0 lower against upper classes, 1 earlier against later frames,
# 2 checkerboard, 3 middle against outer classes, 4 middle against outer frames, 5 area against 1.
FILTERS = (
    (0, 0, 4, 4), (0, 4, 6, 8), (0, 8, 4, 3), (1, 0, 3, 6), (1, 3, 3, 4), (1, 6, 6, 8), (2, 0, 6, 4), (2, 5, 6, 6),
    (2, 2, 10, 4), (3, 0, 6, 5), (3, 6, 6, 7), (3, 1, 9, 3), (4, 0, 4, 6), (4, 4, 8, 9), (5, 2, 2, 4), (5, 9, 3, 6),
)
LEVELS = (-0.2, 0.0, 0.2)
GRAY = np.array([0, 1, 3, 2], np.uint32)
SPAN = max(w for *_, w in FILTERS)


def pcm(media: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a 16-bit wav file; nothing for null and what is no such file."""
    try:
        with wave.open(io.BytesIO(media or b"")) as f:
            if f.getsampwidth() != 2 or not f.getframerate():
                return np.zeros(0, np.float32), 0
            samples = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32)
            n = f.getnchannels()
            return samples[: len(samples) // n * n].reshape(-1, n).mean(1), f.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32), 0


_CLASSES: dict[tuple[int, int], np.ndarray] = {}


def pitch_classes(size: int, rate: int) -> np.ndarray:
    """Which of the spectrum's bins belong to which of twelve pitch classes."""
    if (size, rate) not in _CLASSES:
        hz = np.fft.rfftfreq(size, 1 / rate)
        out = np.zeros((len(hz), 12), np.float32)
        used = np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST))
        out[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
        _CLASSES[size, rate] = out
    return _CLASSES[size, rate]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of pitch-class energies, each of length 1 (0 for silence)."""
    size, hop = int(FRAME * rate), int(HOP * rate)
    if not rate or len(samples) < size or hop < 1:
        return np.zeros((0, 12), np.float32)
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    for at in range(0, len(frames), 256):
        spectrum = np.fft.rfft(frames[at : at + 256] * np.hanning(size).astype(np.float32))
        out.append((spectrum.real ** 2 + spectrum.imag ** 2) @ pitch_classes(size, rate))
    out = np.concatenate(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that has ``SPAN`` frames from itself on."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, t1, c0, c1):
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    packed = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        m, half, third, wide = c + h // 2, w // 2, h // 3, w // 3
        whole = area(0, w, c, c + h)
        if kind == 0:
            a = area(0, w, c, m)
        elif kind == 1:
            a = area(0, half, c, c + h)
        elif kind == 2:
            a = area(0, half, c, m) + area(half, w, m, c + h)
        elif kind == 3:
            a = area(0, w, c + third, c + h - third)
        elif kind == 4:
            a = area(wide, w - wide, c, c + h)
        else:
            a = whole
        b = whole - a if kind != 5 else h * w / 12 ** 0.5 * np.ones(n)
        level = np.searchsorted(LEVELS, np.log((1 + a) / (1 + b)))
        packed = (packed << np.uint32(2)) | GRAY[level]
    return packed


def compare(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int]:
    """Offset (of y in x), equal integers there, frames that overlap, and bits that differ. The
    offset is that of the most equal integers; of several the one nearest to 0, then the smaller."""
    hist = np.zeros(len(x) + len(y), np.int64)
    for at in range(0, len(x), 1024):
        i, j = np.nonzero(x[at : at + 1024, None] == y[None, :])
        hist += np.bincount(i + at - j + len(y), minlength=len(hist))
    best = np.flatnonzero(hist == hist.max()) - len(y)
    offset = int(best[np.lexsort((best, np.abs(best)))[0]])
    a, b = max(offset, 0), max(-offset, 0)
    n = min(len(x) - a, len(y) - b)
    return offset, int(hist.max()), n, int(np.bitwise_count(x[a : a + n] ^ y[b : b + n]).sum())


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) < MIN_OVERLAP or len(y) < MIN_OVERLAP:
        return False
    _, _, n, errors = compare(x, y)
    return n >= max(MIN_OVERLAP, min(len(x), len(y)) / 2) and errors <= MAX_ERROR * 32 * n


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rec_id, n_frames, node, prints (packed integers as bytes) of rec_id, media."""
    for batch in batches:
        prints = [fingerprint(chroma(*pcm(m.as_py()))) for m in batch["media"]]
        flat = np.concatenate([np.zeros(0, np.uint32), *prints]).astype(np.uint64)
        sizes = np.array([len(p) for p in prints], np.int64)
        ends = np.cumsum(sizes)
        place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        total = np.append(np.uint64(0), np.cumsum(mix(flat ^ mix(place.astype(np.uint64)))))
        node = mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)) >> np.uint64(1)
        yield pa.RecordBatch.from_arrays(
            [batch["rec_id"], pa.array(sizes), pa.array(node.astype(np.int64)),
             pa.array([p.tobytes() for p in prints], pa.binary())], ["rec_id", "n_frames", "node", "prints"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """Fingerprints of a table with columns rec_id and media (16-bit wav files). Null and unreadable
    media and those that are too short have no frames."""
    return recordings.select("rec_id", "media").mapInArrow(
        described, f"rec_id {dict(recordings.dtypes)['rec_id']}, n_frames long, node long, prints binary")


def _tokens(nodes: DataFrame) -> DataFrame:
    """token, node: each pair of successive integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p in batch["prints"].to_pylist():
                p = np.frombuffer(p, np.uint32).astype(np.uint64)
                found.append(np.unique((p[:-1] << np.uint64(32)) | p[1:]))
            sizes = np.array([len(f) for f in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["node"], ragged(sizes, np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64), pa.int64())],
                ["node", "tokens"])

    return nodes.select("node", "prints").mapInArrow(run, "node long, tokens array<long>").select(
        F.explode("tokens").alias("token"), "node", F.lit(0).alias("size"), F.lit(0).alias("place"))


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    x = nodes.select(F.col("node").alias("a"), F.col("prints").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("prints").alias("y"))
    return pairs.join(x, "a").join(y, "b")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))
                    for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _compared(pairs, nodes).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _aligned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, offset, n_equal, n_overlap, bit_error of each b against its a."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [compare(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))
                    for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            offset, equal, n, errors = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch["b"], pa.array(offset), pa.array(equal), pa.array(n), pa.array(errors / np.maximum(32 * n, 1))],
                ["node", "offset", "n_equal", "n_overlap", "bit_error"])

    return _compared(pairs, nodes).select("a", "b", "x", "y").mapInArrow(
        run, "node long, offset long, n_equal long, n_overlap long, bit_error double")


def align(prints: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per recording: rec_id, n_frames, class_id (smallest rec_id reachable by links),
    lead_id (the recording it is aligned with), offset, n_equal, n_overlap, bit_error.

    Recordings link if they share two successive integers and are alike at the offset with the
    most equal integers. Recordings with the same integers are one class and are compared once.
    Those without frames and those without rec_id link with nothing; the latter have no class. A
    recording that links with nothing is aligned with itself.
    """
    work = work or Workspace(prints.sparkSession, "audio")
    rows = work.keep(prints, "rows")
    real = rows.where(F.col("rec_id").isNotNull() & (F.col("n_frames") > 0))
    nodes = work.keep(real.groupBy("node").agg(
        F.min("rec_id").alias("lead"), F.first("prints").alias("prints")), "nodes")
    frames = int(rows.agg(F.sum("n_frames")).first()[0] or 0)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), frames // 1_000_000)
    entries = work.keep(_tokens(nodes), "tokens").where("token is not null").repartition(n, "token")
    links = linked(entries, "0", lambda pairs: _alike(pairs, nodes), work)
    found = components(links, work, "all").select("node", "component")
    placed = nodes.select("node", "lead").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min(F.struct("lead", "node")).alias("m")).select(
        "component", F.col("m.lead").alias("class_id"), F.col("m.node").alias("a"))
    placed = work.keep(placed.join(least, "component").select("node", "class_id", "a"), "placed")
    aligned = work.keep(_aligned(placed.select("a", F.col("node").alias("b")), nodes), "aligned")
    known = placed.join(aligned, "node").select(
        "node", F.col("class_id").alias("lead_id"), "offset", "n_equal", "n_overlap", "bit_error")
    own = F.col("n_frames") > 0
    return rows.join(known, "node", "left").select(
        "rec_id", "n_frames",
        F.when(F.col("rec_id").isNotNull(), F.when(own, F.col("lead_id")).otherwise(F.col("rec_id"))).alias("class_id"),
        *[F.when(own & F.col("rec_id").isNotNull(), F.col(c)).alias(c)
          for c in ("lead_id", "offset", "n_equal", "n_overlap", "bit_error")])


# --- recordings from vectors ---------------------------------------------------------

RATE, NOTE = 4000, 0.064


def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rec_id, media: a wav file that plays a vector. Each number opens a note of twelve tones
    whose strengths follow the numbers after it; vectors that are close sound alike."""
    size = int(RATE * NOTE)
    tones = 440 * 2 ** (np.arange(12) / 12)
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            batch = whole.slice(start, 64)
            media = []
            for vector in batch["embedding"].to_pylist():
                v = np.array([x or 0.0 for x in vector or []], np.float64)
                if not len(v):
                    media.append(None)
                    continue
                v = v / max(np.linalg.norm(v), 1e-9) * len(v) ** 0.5
                at = (np.arange(len(v))[:, None] + 5 * np.arange(12)) % len(v)
                strength = 1 / (1 + np.exp(-3 * v[at]))
                t = np.arange(size * len(v)).reshape(len(v), size) / RATE
                waves = np.sin(2 * np.pi * tones[:, None] * t.ravel()).reshape(12, len(v), size)
                sound = np.einsum("nc,cns->ns", strength, waves).ravel()
                out = io.BytesIO()
                with wave.open(out, "wb") as f:
                    f.setnchannels(1)
                    f.setsampwidth(2)
                    f.setframerate(RATE)
                    f.writeframes((sound * 2500).astype("<i2").tobytes())
                media.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch["rec_id"], pa.array(media, pa.binary())], ["rec_id", "media"])


@query("op10_audio_fingerprints")
def op10_audio_fingerprints(spark, sf_dir):
    """Each row of embeddings is played and matched; sound is made and read within a task."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), "embedding")
    prints = vectors.mapInArrow(lambda batches: described(recorded(batches)),
                                "rec_id long, n_frames long, node long, prints binary")
    return align(prints)
