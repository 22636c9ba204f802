"""Intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.session import shared_dir


class Workspace:
    """Tables below one fresh folder of the shared file system.

    ``keep`` writes a table and reads it back, so that later steps survive lost executors and
    nothing is computed twice; ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base = spark, shared_dir(spark, purpose)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.free()
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        """Spark deletes the shuffle files of plans that were collected as garbage, and only
        those; ask for that between the stages, so that they do not add up on the disks."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def near(small: DataFrame, limit: int = 500_000) -> DataFrame:
    """A written table of a few numbers a row, broadcast if it has at most so many rows (counted);
    a longer one is shuffled and hashed, so that the other side is never sorted."""
    return F.broadcast(small) if small.count() <= limit else small.hint("shuffle_hash")


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns a, b); the component is the
    smallest node reachable. Alternating large and small stars: in each round every node hands its
    neighbours to its smallest neighbour. No group is gathered: minima are aggregated and joined
    back, and the number of rounds grows with the logarithm of the longest path."""
    edges = work.keep(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        edges = work.keep(small, f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        # Stars are a fixed point: nothing changes any more.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
