import hashlib
import os
import re

import pytest

from corpuslake.operators.graph_build import TABLES
from corpuslake.plans.catalog import QUERIES
from corpuslake.plans.inputs import Corpus
from corpuslake.session import shared_base

# Keys and names that come twice or are null, and names that differ in case and blanks only.
ROWS = {
    "customer": ("c_custkey long, c_name string, c_nationkey long",
                 [(1, "Cust A", 0), (2, "cust  a", 0), (3, None, 1), (4, "Cust D", None), (1, "Cust A", 0)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "Supp 1", 1), (2, "SUPP 1", 1), (None, "Supp X", 0)]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "North", 0), (1, "South", 0), (2, "West", None)]),
    "region": ("r_regionkey long, r_name string", [(0, "Earth")]),
    "part": ("p_partkey long, p_name string", [(1, "red bolt"), (2, "Red Bolt"), (3, "old nut"), (4, None)]),
    "orders": ("o_orderkey long, o_custkey long", [(10, 1), (10, 2), (11, 3), (12, 4), (13, None), (None, 2), (14, 1), (14, 1)]),
    "lineitem": ("l_orderkey long, l_suppkey long, l_partkey long",
                 [(10, 1, 1), (10, 2, 2), (11, 1, 3), (11, 2, 4), (12, None, 1), (None, 1, 1), (10, 1, 1)]),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("trade")
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")
    return str(base)


def norm(name):
    return re.sub(r"\s+", " ", (name or "").strip()).lower()


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def statements():
    def matching(table, place, key):
        return [row for row in ROWS[table][1] if key is not None and row[place] == key]

    text = lambda v: None if v is None else str(v)

    def stated(a, subject, predicate, b, obj, doc, chunk, conf):
        verb = " provides " if predicate == "PROVIDES" else " is part of "
        ends = sha(a, norm(subject)), sha(b, norm(obj))
        return (sha(ends[0], predicate, ends[1]), ends[0], predicate, ends[1], text(chunk), text(doc),
                None if None in (subject, obj) else subject + verb + obj, round(conf, 2))

    for order, custkey in ROWS["orders"][1]:
        for c in matching("customer", 0, custkey):
            for n in matching("nation", 0, c[2]):
                for r in matching("region", 0, n[2]):
                    yield stated("ROLE", c[1], "PART_OF", "ENVIRONMENT", n[1], custkey, order, 0.6 + custkey % 40 / 100)
                    yield stated("ENVIRONMENT", n[1], "PART_OF", "SYSTEM", r[1], custkey, order, 0.9)
    for s in ROWS["supplier"][1]:
        for n in matching("nation", 0, s[2]):
            for r in matching("region", 0, n[2]):
                yield stated("MODULE", s[1], "PART_OF", "ENVIRONMENT", n[1], s[0], None if s[0] is None else f"s{s[0]}", 0.8)
    for order, suppkey, partkey in ROWS["lineitem"][1]:
        for s in matching("supplier", 0, suppkey):
            for p in matching("part", 0, partkey):
                yield stated("MODULE", s[1], "PROVIDES", "TERM", p[1], suppkey, order, 0.6 + suppkey % 40 / 100)


def least(values):
    return min((v for v in values if v is not None), default=None)


def grouped(rows, key):
    out = {}
    for row in rows:
        out.setdefault(key(row), []).append(row)
    return out


def test_tables_hold_every_statement_once(spark, folder):
    rows = list(statements())
    graph = Corpus(spark, folder).trade_graph()
    table = lambda name, *columns: sorted(
        (tuple(r) for r in getattr(graph, name).select(*columns).collect()), key=repr)
    relations = {key: max(r[7] for r in g) for key, g in grouped(rows, lambda r: r[:4]).items()}
    assert table("relations", "relation_id", "subject_id", "predicate", "object_id", "confidence") == sorted(
        ((*key, best) for key, best in relations.items()), key=repr)
    evidence = []
    for (relation, chunk), g in grouped(rows, lambda r: (r[0], r[4])).items():
        quote = least(r[6] for r in g)
        evidence.append((relation, chunk, least(r[5] for r in g), quote, max(r[7] for r in g), None if quote is None else sha(quote)))
    assert table("evidence", "relation_id", "chunk_id", "document_id", "quote", "confidence", "quote_hash") == sorted(evidence, key=repr)
    ends = [(end, r[4], r[5]) for r in rows for end in (r[1], r[3])]
    mentions = [(*key, least(r[2] for r in g), 1.0) for key, g in grouped(ends, lambda r: r[:2]).items()]
    assert table("mentions", "entity_id", "chunk_id", "document_id", "confidence") == sorted(mentions, key=repr)


@pytest.mark.parametrize("name, read", [
    ("e11_relations_by_entity", {"relations"}), ("d15_evidence_join", {"entities", "relations"}),
    ("k4_entity_search", {"entities", "aliases"}), ("k5_neighbors", {"entities", "aliases", "relations"}),
])
def test_only_tables_that_are_read_are_written(spark, folder, name, read):
    before = set(os.listdir(shared_base(spark)))
    assert QUERIES[name](spark, folder).count() > 0
    written = {f.rsplit("-", 1)[0] for f in set(os.listdir(shared_base(spark))) - before}
    assert written & {*TABLES, "stated"} == read
