"""Session helpers: a local session for tests, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", app: str = "corpuslake"):
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_base(spark: SparkSession) -> str:
    """The shared folder that the cluster names.

    A machine-local folder is used only when nothing is configured and the
    master is local, where driver and executors share one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
        base = tempfile.mkdtemp(prefix="corpuslake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder."""
    return os.path.join(shared_base(spark), f"{purpose}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has this path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cut_lineage(df, purpose: str = "stage"):
    """Write an intermediate to the shared folder and read it back.

    The result survives the loss of executors and is computed once, which a
    cached plan does not promise.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
