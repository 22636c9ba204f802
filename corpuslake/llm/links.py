"""Links among the members of inverted lists, without comparing all pairs of a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.workspace import Workspace, components


def linked(
    entries: DataFrame, most: str, check: Callable[[DataFrame], DataFrame], work: Workspace,
) -> DataFrame:
    """Links (a, b) with the same components as all links among nodes that share a token.

    ``entries`` are (token, node, size, place), partitioned by token; ``check`` keeps the pairs (a, b)
    that link. ``most`` is an expression of size and place: the largest size of a partner that the
    entry can stand for. Each link needs a list in which both entries allow the other's size.

    First every list compares its members with the one whose entry has the first place. Members
    that are then in one component need no comparison; all other pairs of a list are checked, so
    that no link between components is lost.
    """
    # One shuffle serves both the lists' heads and their members; hot lists are only counted.
    heads = entries.groupBy("token").agg(F.count("*").alias("c"), F.min_by("node", "place").alias("head"),
        F.max("size").alias("s")).where("c > 1 and s >= 0")
    lists = work.keep(entries.join(heads.hint("shuffle_hash"), "token").select(
        "token", "node", "size", F.expr(most).cast("long").alias("most"), "head"), "lists")
    del entries, heads
    work.drop()

    to_head = lists.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    first = work.keep(check(to_head), "links-1")
    known = components(first, work, "first")

    member = lists.join(known, "node", "left").select(
        "token", "node", "size", "most", "head", F.coalesce("component", "node").alias("component"))
    mixed = member.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    member = work.keep(member.where("node <> head").join(mixed, "token", "left_semi"), "members")
    other = member.select("token", F.col("node").alias("b"), F.col("component").alias("other"),
                          F.col("size").alias("size_b"), F.col("most").alias("most_b"))
    rest = member.withColumnRenamed("node", "a").join(other, "token").where(
        "a < b and component <> other and size <= most_b and size_b <= most").select("a", "b").distinct()
    second = work.keep(check(rest), "links-2")
    work.drop("lists", "members")
    return first.union(second)
