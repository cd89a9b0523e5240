"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "mossbrook", master: str | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's session is used as it is."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("MOSSBROOK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's ``spark.checkpoint.dir``, or a new one in local mode only.

    On a cluster without the setting this raises, because a machine-local folder would lose data with an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY, None)
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="mossbrook-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so later plans start from files that survive executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
