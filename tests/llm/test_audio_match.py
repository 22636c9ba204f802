import random

import numpy as np
import pyarrow as pa

from corpuslake.llm import audio_match as am


def wav(vector):
    batch = pa.RecordBatch.from_pydict({"rec_id": pa.array([0]), "embedding": pa.array([vector])})
    return next(am.recorded(iter([batch])))["media"][0].as_py()


def prints(media):
    return am.fingerprint(am.chroma(*am.pcm(media)))


def test_groups_match_brute_force_and_shifted_copies_align(spark):
    rng = random.Random(3)
    bases = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = []
    for i in range(40):
        base = rng.choice(bases)
        noise = rng.choice([0, 0.02, 0.05, 1.5])
        rows.append((i, wav([x + rng.gauss(0, noise) for x in base])))
    shifted = am.pcm(rows[0][1])[0][2048:]  # eight hops later
    import io
    import wave
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 2, am.RATE, 0, "NONE", ""))
        f.writeframes(shifted.astype("<i2").tobytes())
    rows += [(100, out.getvalue()), (101, None), (102, b"no sound"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "rec_id long, media binary")
    got = {r.rec_id: r for r in am.align(am.fingerprints(df)).collect()}

    all_prints = {i: prints(m) for i, m in rows if i is not None}
    pairs = lambda p: set(zip(p[:-1].tolist(), p[1:].tolist()))
    root = {i: i for i in all_prints}
    for i in all_prints:
        for j in all_prints:
            if i < j and pairs(all_prints[i]) & pairs(all_prints[j]) and am.alike(all_prints[i], all_prints[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert {i: got[i].class_id for i in root} == root
    assert len(set(root.values())) < 40
    offset, _, n, errors = am.compare(all_prints[0], all_prints[100])
    assert offset == 8 and errors / (32 * n) < 0.05
    assert got[None].class_id is None and got[101].n_frames == 0 and got[102].class_id == 102
    assert am.align(am.fingerprints(df.limit(0))).count() == 0


def test_area_sums_match_plain_sums():
    frames = np.random.default_rng(0).random((30, 12))
    got = am.fingerprint(frames)
    assert len(got) == 30 - am.SPAN + 1
    kind, c, h, w = am.FILTERS[0]
    low, high = frames[5 : 5 + w, c : c + h // 2].sum(), frames[5 : 5 + w, c + h // 2 : c + h].sum()
    level = np.searchsorted(am.LEVELS, np.log((1 + low) / (1 + high)))
    assert got[5] >> np.uint32(30) == am.GRAY[level]
