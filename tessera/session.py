"""Session settings, table access and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "tessera") -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE, Arrow)."""
    width = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores if its files make fewer, as a small table in one file does.

    A table of more files than that is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``); where that is unset, a local session gets one of its own.

    On a cluster without one this raises: a folder of one machine would lose what other machines need. Files there go
    when their frames do if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as ``build_session`` sets it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not folder:
        if current.isDefined():
            folder = current.get()
        elif context.master == "local" or context.master.startswith("local["):
            folder = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if current.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session was sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
