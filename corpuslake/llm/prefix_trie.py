"""Conversation prefix trie, built as a burst trie.

A container holds the suffixes of all conversations below one trie head, as flat rows of turn ids. A
container with too many rows bursts: the turns that all of its members share become a run of nodes,
and the members move on to containers by their next turn id. Containers that are small enough are
sorted and swept into nodes, many of them in one task. Totals of subtrees pass from the containers to
the runs above them, one burst level after the other.

Copies of a conversation are counted once and travel as one member; no conversation, container or
group of copies is held whole by a task unless it has at most ``CONTAINER_ROWS`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.registry import query, table
from corpuslake.llm.workspace import Workspace, near
from corpuslake.operators.ranking import running_sum

CONTAINER_ROWS = 20_000  # turns of a container that is swept; beyond it, it bursts
CHUNK_IDS = 4_096  # ids joined to one piece of a list that is hashed
FIRST_TURN = -(1 << 63)  # place of a null turn

NODE = ("box binary, under binary, is_top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, end_seq long, end_n long")


def short_hash(value: Column) -> Column:
    """The first 16 bytes of sha256."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """c, turn, t (id of the turn's role and text), size (UTF-8 bytes of the text), role."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST_TURN)).alias("turn"),
        short_hash(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("t"),
        F.octet_length(text).cast("long").alias("size"), role.alias("role"))


def placed(rows: DataFrame, work: Workspace) -> DataFrame:
    """Turns with their place (pos, from 0): by turn, among equal ones by role and t. Turn numbers are
    counted and summed over spans, so that a conversation may hold most of the rows."""
    counts = rows.groupBy("c", "turn").agg(F.count("*").alias("n"))
    starts = running_sum(counts, ["c"], "turn", F.col("n"), "upto").select(
        "c", "turn", (F.col("upto") - F.col("n")).alias("start"))
    inside = Window.partitionBy("c", "turn").orderBy("role", "t")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1)
    return work.keep(ranked.join(starts, ["c", "turn"]).select(
        "c", (F.col("start") + F.col("r")).alias("pos"), "t", "size"), "turns")


def rebuilt(own: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (c, pos, t, size), and one row for each (c, len)."""
    convs = own.groupBy("c").agg(F.count("*").alias("own_len"))
    convs = convs.withColumn("h", F.crc32(F.col("c").cast("string")) % 9).withColumn("base", F.col("c") - F.col("c") % 5)
    lengths = convs.where("c % 5 = 0").select(F.col("c").alias("base"), F.col("own_len").alias("base_len"))
    convs = convs.join(lengths, "base", "left").select(
        "c", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("borrowed"),
        F.greatest(F.col("own_len") - F.col("h"), F.lit(0)).alias("kept"))
    convs = work.keep(convs, "convs")
    opening = own.where("c % 5 = 0 and pos < 8").withColumnRenamed("c", "base")
    head = convs.where("borrowed > 0").join(opening, "base").where("pos < borrowed").select("c", "pos", "t", "size")
    tail = own.join(convs.where("kept > 0"), "c").where("pos >= h").select(
        "c", (F.col("pos") - F.col("h") + F.col("borrowed")).alias("pos"), "t", "size")
    return (work.keep(head.unionByName(tail), "rebuilt"),
            convs.select("c", (F.col("borrowed") + F.col("kept")).alias("len")))


def sequences(turns: DataFrame, convs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the hash of its turns (c, len, f, g), and each distinct sequence once:
    seq (smallest conversation), len, f, g, n (conversations)."""
    marks = turns.groupBy("c").agg(
        F.bit_xor(F.xxhash64("pos", "t")).alias("f"), F.bit_xor(F.xxhash64(F.lit("g"), "t", "pos")).alias("g"))
    marked = work.keep(convs.join(marks, "c", "left").select(
        "c", "len", F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("g", F.lit(0)).alias("g")), "marked")
    return marked, work.keep(marked.groupBy("len", "f", "g").agg(F.min("c").alias("seq"), F.count("*").alias("n")), "seqs")


def first_container(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """All members in the container under the root; each has a last row without a turn."""
    own = seqs.select("seq", "len", "n")
    rows = turns.withColumnRenamed("c", "seq").join(own.select("seq", "n"), "seq").select("seq", "pos", "t", "size", "n")
    ends = own.select("seq", F.col("len").alias("pos"), F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("size"), "n")
    return rows.unionByName(ends).select(
        F.lit(b"").alias("box"), F.lit(None).cast("binary").alias("under"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("top"), "seq", "pos", "t", "size", "n")


def measured(live: DataFrame) -> DataFrame:
    """One row per container: its rows, members (n_seqs), conversations and smallest one."""
    ended = F.col("t").isNull()
    return live.groupBy("box").agg(
        F.min("under").alias("under"), F.min("depth").alias("depth"), F.min("top").alias("top"),
        F.count("*").alias("n_rows"), F.count_if(ended).alias("n_seqs"), F.sum(F.when(ended, F.col("n"))).alias("n_convs"),
        F.min("seq").alias("conv"))


def burst(live: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of the containers in ``big`` (box, stop), the turns of the runs (box, pos, size), and the
    rows of the containers below. A run ends where the members do not all go on with one turn."""
    inside = live.join(near(big.select("box", "n_seqs")), "box")
    places = inside.groupBy("box", "pos").agg(
        F.count("t").alias("going"), F.min("t").alias("a"), F.max("t").alias("b"), F.min("size").alias("size"),
        F.max("n_seqs").alias("n_seqs"))
    split = (F.col("going") < F.col("n_seqs")) | (F.col("a") != F.col("b"))
    stops = places.where(split).groupBy("box").agg(F.min("pos").alias("stop"))
    return stops, places.select("box", "pos", "size"), inside


def below(inside: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows of the containers below burst ones."""
    cut = inside.join(near(stops), "box")
    heads = cut.where("pos = stop and t is not null").select(
        "seq", short_hash(F.concat("box", "t")).alias("next"), F.col("box").alias("under"),
        (F.col("stop") + 1).alias("depth"), F.col("size").alias("top"))
    rest = cut.where("pos > stop").select("seq", "pos", "t", "size", "n")
    return rest.join(heads, "seq").select(F.col("next").alias("box"), "under", "depth", "top", "seq", "pos", "t", "size", "n")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of small containers, from rows sorted by box, seq and pos; whole containers at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = pa.Table.from_batches([batch])
        held = got if held is None else pa.concat_tables([held, got])
        if held.num_rows < CONTAINER_ROWS:
            continue
        last = held["box"][-1]
        cut = pc.index(pc.equal(held["box"], last), True).as_py()
        if cut:
            yield _nodes(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _nodes(held)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Number of each value (null: -1), and the values."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _nodes(rows: pa.Table) -> pa.RecordBatch:
    box, boxes = _codes(rows["box"])
    code, _ = _codes(rows["t"])
    seq, size, weight = (rows[c].to_numpy() for c in ("seq", "size", "n"))
    starts = np.flatnonzero(np.concatenate([[True], (box[1:] != box[:-1]) | (seq[1:] != seq[:-1])]))
    lens = np.diff(np.append(starts, len(box))) - 1  # the last row of a member holds no turn
    # Sort the members of each container; a member that ends sorts before those that go on.
    raw = (code + 1).astype(">i4").tobytes()
    own = [int(box[s]).to_bytes(4, "big") + raw[4 * s : 4 * (s + n + 1)] for s, n in zip(starts.tolist(), lens.tolist())]
    order = np.array(sorted(range(len(own)), key=own.__getitem__))
    starts, lens = starts[order], lens[order]
    m_box, m_seq, m_n = box[starts], seq[starts], weight[starts]

    # Sweep: level by level, a node begins where a member differs from the one before it.
    active = np.arange(len(starts))
    same = np.concatenate([[False], m_box[1:] == m_box[:-1]])
    top = rows["top"].to_numpy()
    depth0 = rows["depth"].to_numpy()
    levels, node_of = [], np.zeros(len(starts), np.int64)
    r = 0
    while len(active):
        if r:
            at = code[starts[active] + r - 1]
            before = active - 1
            there = lens[before] >= r
            same_code = np.zeros(len(active), bool)
            same_code[there] = code[starts[before[there]] + r - 1] == at[there]
            same[active] &= there & same_code
        new = ~same[active]
        first = np.flatnonzero(new)
        head = active[first]
        parent = node_of[head]
        node_of[active] = np.cumsum(new) - 1
        ends = np.full(len(first), -1)
        done = active[lens[active] == r]
        ends[node_of[done]] = done
        levels.append({
            "head": head, "parent": parent, "n": np.add.reduceat(m_n[active], first),
            "conv": np.minimum.reduceat(m_seq[active], first), "end": ends,
            "size": size[starts[head] + r - 1] if r else top[starts[head]]})
        r += 1
        active = active[lens[active] >= r]

    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        level["saved"] = (level["n"] - 1) * level["size"]
        level["leaves"] = np.ones(len(level["n"]), np.int64)
        level["kids"] = np.zeros(len(level["n"]), np.int64)
        if k + 1 < len(levels):
            down = levels[k + 1]
            np.add.at(level["kids"], down["parent"], 1)
            np.add.at(level["saved"], down["parent"], down["saved"])
            leaves = np.zeros(len(level["n"]), np.int64)
            np.add.at(leaves, down["parent"], down["leaves"])
            level["leaves"] = np.where(level["kids"] > 0, leaves, 1)

    def column(f):
        return np.concatenate([f(k, level) for k, level in enumerate(levels)])

    head = column(lambda k, x: x["head"])
    end = column(lambda k, x: x["end"])
    is_top = column(lambda k, x: np.full(len(x["n"]), k == 0))
    parent = column(lambda k, x: levels[k - 1]["conv"][x["parent"]] if k else x["conv"])
    under = rows["under"].combine_chunks()
    return pa.RecordBatch.from_arrays([
        boxes.take(pa.array(m_box[head])), under.take(pa.array(starts[head])), pa.array(is_top),
        pa.array(column(lambda k, x: x["conv"])), pa.array(column(lambda k, x: depth0[starts[x["head"]]] + k)),
        pa.array(parent, mask=is_top), pa.array(column(lambda k, x: x["n"])), pa.array(column(lambda k, x: x["kids"])),
        pa.array(column(lambda k, x: x["leaves"])), pa.array(column(lambda k, x: x["saved"])),
        pa.array(m_seq[end], mask=end < 0), pa.array(m_n[end], mask=end < 0),
    ], [c.split()[0] for c in NODE.split(", ")])


def run_nodes(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes of runs: one at the head of the container and one after each turn that all members share."""
    sums = running_sum(steps, ["box"], "pos", F.col("size"), "upto")
    totals = steps.groupBy("box").agg(F.sum("size").alias("run_size"))
    runs = runs.join(totals, "box", "left").withColumn("run_size", F.coalesce("run_size", F.lit(0)))
    top = runs.withColumn("d", F.col("depth")).withColumn("rest", F.col("top") + F.col("run_size"))
    later = runs.join(sums, "box").withColumn("d", F.col("pos") + 1).withColumn(
        "rest", F.col("run_size") - F.col("upto") + F.col("size")).drop("pos", "size", "upto")
    is_top, bottom = F.col("d") == F.col("depth"), F.col("d") == F.col("stop")
    return top.unionByName(later).select(
        "box", "under", is_top.alias("is_top"), F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.when(~is_top, F.col("conv")).alias("parent_conv_id"), "n_convs",
        F.when(bottom, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("rest") + F.col("saved")).cast("long").alias("saved_tokens"),
        F.when(bottom, F.col("end_seq")).alias("end_seq"), F.when(bottom, F.col("end_n")).alias("end_n"))


def joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined pieces of id lists, from rows sorted by seq and c."""
    out: list[tuple[int, int, str]] = []
    at, ids = None, []

    def flush():
        if ids:
            out.append((at, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for seq, c in zip(batch["seq"].to_pylist(), batch["c"].to_pylist()):
            if seq != at or len(ids) >= CHUNK_IDS:
                flush()
                at = seq
            ids.append(c)
        if out:
            yield _batch(out, ("seq", "first", "piece"))
            out = []
    flush()
    if out:
        yield _batch(out, ("seq", "first", "piece"))


def hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each list, fed piece after piece."""
    at, state, out = None, None, []
    for batch in batches:
        for seq, piece in zip(batch["seq"].to_pylist(), batch["piece"].to_pylist()):
            if seq != at:
                if at is not None:
                    out.append((at, state.hexdigest()))
                at, state = seq, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if len(out) > 1000:
            yield _batch(out, ("seq", "sha"))
            out = []
    if at is not None:
        yield _batch([*out, (at, state.hexdigest())], ("seq", "sha"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], list(names))


def copy_hashes(marked: DataFrame, seqs: DataFrame) -> DataFrame:
    """seq and the sha256 of the ids of all its conversations, for sequences with copies. The ids are
    joined piecewise in range partitions, so that one list may span many tasks; only the hash itself,
    which has to read the list from end to end, is one task's stream."""
    copies = marked.join(seqs.where("n > 1").drop("n"), ["len", "f", "g"]).select("seq", "c")
    pieces = copies.repartitionByRange("seq", "c").sortWithinPartitions("seq", "c").mapInArrow(
        joined_pieces, "seq long, first long, piece string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed_lists, "seq long, sha string")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def prefix_trie(conversations: DataFrame, work: Workspace | None = None, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), equal turns by role and then by the hash of role and text;
    repeated rows are turns of their own. Null roles and texts are empty. Rows without conv_id take no
    part; without conversations there is no node. Other columns are dropped. Sequences are told apart
    by 128 bits of hash. A container bursts above ``container_rows`` rows, unless it has one member.
    """
    work = work or Workspace(conversations.sparkSession, "trie")
    own = placed(numbered_turns(conversations), work)
    turns, convs = rebuilt(own, work)
    marked, seqs = sequences(turns, convs, work)
    live = work.keep(first_container(turns, seqs), "live-0")
    work.drop("turns", "convs", "rebuilt")

    small, levels, steps = [], [], []
    for step in range(1 << 30):
        boxes = work.keep(measured(live), f"boxes-{step}")
        large = boxes.where(F.col("n_rows") > container_rows)
        big = large.where("n_seqs > 1")
        small.append(live.join(near(large.select("box")), "box", "left_anti"))
        # A single long member is a run to its end.
        alone = live.join(near(large.where("n_seqs = 1").select("box")), "box", "left_semi")
        ended = alone.where("t is null").select("box", F.col("pos").alias("stop"), F.col("seq").alias("end_seq"), F.col("n").alias("end_n"))
        levels.append(large.where("n_seqs = 1").join(ended, "box"))
        steps.append(alone.where("t is not null").select("box", "pos", "size"))
        if big.isEmpty():
            break
        stops, places, inside = burst(live, big)
        stops = work.keep(stops, f"stops-{step}")
        closing = inside.where("t is null").join(near(stops), "box").where("pos = stop").select(
            "box", F.col("seq").alias("end_seq"), F.col("n").alias("end_n"))
        levels[-1] = levels[-1].unionByName(big.join(stops, "box").join(closing, "box", "left"), allowMissingColumns=True)
        steps[-1] = steps[-1].unionByName(places.join(near(stops), "box").where("pos < stop").select("box", "pos", "size"))
        live = work.keep(below(inside, stops), f"live-{step + 1}")

    rows = union(small).repartition("box").sortWithinPartitions("box", "seq", "pos")
    swept = work.keep(rows.select("box", "under", "depth", "top", "seq", "pos", "t", "size", "n").mapInArrow(sweep, NODE), "swept")
    nodes, parents = [swept], []
    tops = swept.where("is_top").select("under", "n_leaves", "saved_tokens")
    under = None
    for step in range(len(levels) - 1, -1, -1):
        kids = tops if under is None else tops.unionByName(under)
        kids = kids.where("under is not null").groupBy("under").agg(
            F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        runs = levels[step].join(kids.withColumnRenamed("under", "box"), "box", "left").fillna(0, ["kids", "leaves", "saved"])
        made = work.keep(run_nodes(runs, steps[step]), f"runs-{step}")
        under = made.where("is_top").select("under", "n_leaves", "saved_tokens")
        nodes.append(made)
        parents.append(levels[step].select(F.col("box").alias("under"), F.col("conv").alias("above")))

    whole = union(nodes).join(near(work.keep(union(parents), "parents")), "under", "left")
    whole = whole.withColumn("parent_conv_id", F.when(F.col("is_top"), F.col("above")).otherwise(F.col("parent_conv_id")))
    hashes = work.keep(copy_hashes(marked, seqs), "hashes")
    ended = F.when(F.col("end_seq").isNull(), F.lit("")).otherwise(F.col("end_seq").cast("string"))
    many = F.coalesce(F.col("end_n") > 1, F.lit(False))
    told = whole.where(~many).withColumn("ends_sha256", F.sha2(ended, 256)).unionByName(
        whole.where(many).join(hashes.select(F.col("seq").alias("end_seq"), F.col("sha").alias("ends_sha256")), "end_seq"))
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op11_prefix_trie", r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY c),
b AS (
  SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc FROM o),
h AS (SELECT c, xor(crc, 4294967295) % 9 AS h FROM b),
r AS (
  SELECT o.c, list_concat(coalesce(list_slice(s.turns, 1, h.h), []), coalesce(list_slice(o.turns, h.h + 1, len(o.turns)), [])) AS seq
  FROM o JOIN h USING (c) LEFT JOIN o s ON s.c = o.c - o.c % 5),
p AS (SELECT c, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
n AS (
  SELECT depth, list_slice(seq, 1, depth) AS prefix, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(strlen(any_value(seq[depth].text)), 0) AS own
  FROM p GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
u AS (SELECT unnest(range(0, depth + 1)) AS d, prefix, own, n_children FROM w),
s AS (SELECT d AS depth, list_slice(prefix, 1, d) AS prefix, sum(own) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM u GROUP BY 1, 2),
f AS (SELECT w.*, s.saved, s.n_leaves FROM w JOIN s USING (depth, prefix))
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, f.n_leaves, f.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f LEFT JOIN f q ON q.depth = f.depth - 1 AND q.prefix = list_slice(f.prefix, 1, f.depth - 1)
""")
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
