"""Ranks, running sums and exact percentiles that survive hot keys.

A plain window puts a whole key into one task. The functions here cut each key
into spans of its order column, work inside the spans in parallel and add the
totals of the earlier spans, so a key that holds a third of all rows is spread
over many tasks and the result is the same as that of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 16


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    out: str,
    span: int = SPAN,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in the order of ``order``.

    ``order`` is an integer column, unique within a key.
    """
    work = df.withColumn("_value", value).withColumn(
        "_span", F.floor(F.col(order) / span).cast("long")
    )
    totals = work.groupBy(*keys, "_span").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys, "_span", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        work.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_span"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_value", "_span", "_inside", "_offset")
    )


def position(
    df: DataFrame, keys: list[str], order: str, out: str, span: int = SPAN
) -> DataFrame:
    """0-based dense position of each row in its key."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, span).withColumn(
        out, F.col(out) - 1
    )


def previous(
    df: DataFrame, keys: list[str], pos: str, columns: dict[str, str]
) -> DataFrame:
    """Columns of the preceding row, by an equi join on the dense position."""
    back = df.select(
        *keys,
        (F.col(pos) + 1).alias(pos),
        *[F.col(name).alias(alias) for name, alias in columns.items()],
    )
    return df.join(back, [*keys, pos], "left")


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int | Column | None,
    out: str = "rank",
) -> DataFrame:
    """First ``k`` rows per key (all for None) with their 0-based rank.

    The row-number filter is recognised by the optimizer, which drops all but
    the first ``k`` rows of each key in every task before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(out, F.row_number().over(window))
    if k is not None:
        numbered = numbered.where(F.col(out) <= k)
    return numbered.withColumn(out, F.col(out) - 1)


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one with the smallest ``order``; partial aggregation
    keeps a hot key down to one row per task before the shuffle."""
    rest = [name for name in df.columns if name not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), order).alias("_first")
    )
    return picked.select(
        *keys, *[F.col(f"_first.{name}").alias(name) for name in rest]
    ).select(*df.columns)


def values_at_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    targets: DataFrame,
    ps: list[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact order statistics: the value at 1-based rank ``target`` of each key.

    ``targets`` holds the keys, a ``slot`` (index into ``ps``) and the rank
    ``target``, which is within one place of ``ps[slot] * n``. Equal values are
    counted before the shuffle. Every key is narrowed, by a mergeable sketch with a
    known error, to the few values around the wanted rank; the values below are only
    counted. Where those counts show that the range misses the rank, the key's whole
    list of values is used.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n")
    )
    slack = 3.0 / accuracy
    edges = [q for p in ps for q in (max(0.0, p - slack), min(1.0, p + slack))]
    bounds = df.groupBy(*keys).agg(
        F.percentile_approx(value, edges, accuracy).alias("_q"),
    )
    limits = bounds.select(
        *keys,
        F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("slot"),
                F.when(F.lit(p - slack > 0), F.col("_q")[2 * i]).alias("lo"),
                F.when(F.lit(p + slack < 1), F.col("_q")[2 * i + 1]).alias("hi"),
            )
            for i, p in enumerate(ps)
        ])),
    )
    spread = counts.join(targets.join(limits, [*keys, "slot"]), keys)
    below = spread.groupBy(*keys, "slot").agg(
        F.coalesce(
            F.sum(F.when(F.col(value) < F.col("lo"), F.col("_n"))), F.lit(0)
        ).alias("_below"),
        F.sum(F.when(
            F.col("hi").isNull() | (F.col(value) <= F.col("hi")), F.col("_n")
        )).alias("_upto"),
    )
    spread = spread.join(below, [*keys, "slot"])
    missed = (F.col("_below") >= F.col("target")) | (F.col("_upto") < F.col("target"))
    spread = spread.withColumn("_missed", F.coalesce(missed, F.lit(True)))
    near = spread.where(
        F.col("_missed")
        | (F.col("lo").isNull() | (F.col(value) >= F.col("lo")))
        & (F.col("hi").isNull() | (F.col(value) <= F.col("hi")))
    ).withColumn("_below", F.when(F.col("_missed"), 0).otherwise(F.col("_below")))
    running = Window.partitionBy(*keys, "slot").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        near.withColumn("_running", F.sum("_n").over(running))
        .where(F.col("_running") + F.col("_below") >= F.col("target"))
        .groupBy(*keys, "slot")
        .agg(F.min(value).alias(value))
    )


def nearest_rank_percentiles(
    df: DataFrame, keys: list[str], value: str, ps: list[float], **options
) -> DataFrame:
    """Nearest-rank percentiles ``p``: the value at rank ``ceil(p * n)``."""
    levels = F.array(*[
        F.struct(F.lit(i).alias("slot"), F.lit(p).alias("p")) for i, p in enumerate(ps)
    ])
    targets = (
        df.groupBy(*keys)
        .agg(F.count(value).alias("_n"))
        .select(*keys, "_n", F.inline(levels))
        .select(
            *keys,
            "slot",
            F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("_n"))).alias("target"),
        )
    )
    found = values_at_ranks(df, keys, value, targets, ps, **options)
    return found.select(
        *keys, F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("slot") + 1).alias("p"),
        value,
    )


def interpolated_percentile(
    df: DataFrame, keys: list[str], value: str, p: float, out: str, **options
) -> DataFrame:
    """Percentile with linear interpolation between the two nearest ranks."""
    spot = (
        df.groupBy(*keys)
        .agg(F.count(value).alias("_n"))
        .where("_n > 0")
        .withColumn("_at", F.lit(p) * (F.col("_n") - 1))
    )
    ranks = F.array(*[
        F.struct(
            F.lit(step).alias("slot"),
            F.least(F.floor("_at") + 1 + step, F.col("_n")).alias("target"),
        )
        for step in (0, 1)
    ])
    found = values_at_ranks(
        df, keys, value, spot.select(*keys, F.inline(ranks)), [p, p], **options
    )
    ends = found.groupBy(*keys).agg(
        F.min(F.when(F.col("slot") == 0, F.col(value))).alias("_low"),
        F.min(F.when(F.col("slot") == 1, F.col(value))).alias("_high"),
    )
    weight = F.col("_at") - F.floor("_at")
    return spot.join(ends, keys).select(
        *keys,
        (F.col("_low") + (F.col("_high") - F.col("_low")) * weight).alias(out),
    )
