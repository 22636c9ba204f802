import random
from dataclasses import replace

import pytest

from corpuslake.config import DEFAULTS
from corpuslake.operators import graph_build


def fold(rows, most, chars):
    """The rule, one chunk after the other."""
    out, batch, held = {}, [], 0
    for n, (doc, index, chunk, text) in enumerate(sorted(rows)):
        if batch and (len(batch) >= most or held + len(text or "") > chars):
            batch, held = [], 0
        if not batch:
            start = n
        batch.append(chunk)
        held += len(text or "")
        out[chunk] = str(start)
    return out


@pytest.mark.parametrize("span", [7, 64, 10**6])
def test_batches_equal_a_sequential_fold(spark, span):
    rng = random.Random(span)
    rows = [(f"d{rng.randrange(12):02}", i, f"c{i}", "x" * rng.choice([0, 10, 300, 900, 2500, 7000])) for i in range(300)]
    rows += [("huge", i, f"h{i}", "y" * (i % 50)) for i in range(200)] + [("zz", 0, "null", None)]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_id string, content string").repartition(5)
    for most, chars in ((6, 6000), (1, 6000), (3, 100)):
        got = graph_build.form_batches(df, replace(DEFAULTS, graph_batch_size=most, graph_batch_chars=chars), span=span)
        assert {r.chunk_id: r.batch_id for r in got.collect()} == fold(rows, most, chars)


def test_no_chunks(spark):
    df = spark.createDataFrame([], "document_id string, chunk_index int, chunk_id string, content string")
    assert graph_build.form_batches(df).count() == 0
