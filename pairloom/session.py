"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pairloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
        folder = context.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, never deleted here."""
    return os.path.join(shared_dir(spark), f"pairloom-{uuid.uuid4().hex}", name)


def pinned(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, survives lost executors, fixes values that depend on the run
    (partition numbers), and gives the optimizer true sizes and column pruning.
    ``group_bytes``: size of parquet's row groups, for wide rows; a reader holds up to one.
    """
    path = scratch_path(df.sparkSession, "table")
    options = {} if group_bytes is None else {"parquet.block.size": str(group_bytes)}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
