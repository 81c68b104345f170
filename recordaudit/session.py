"""Session and plan helpers shared by every operator.

On a cluster the checkpoint folder is whatever ``spark.checkpoint.dir`` names, and
a job that needs one raises without it.  Only a local session (tests, bench) gets a
scratch folder, and only when the setting is missing.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "recordaudit") -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder of the session, or None."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; a local session (tests, bench) that names none gets a fresh scratch folder.

    On a cluster a folder of one machine is of no use to the others, so there this raises."""
    current = checkpoint_dir(spark)
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recordaudit-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint when the session has a shared folder.

    Without one the plan is returned unchanged.  Only counted tables and reports go
    through here (their rows do not depend on how often they are evaluated).
    """
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    return df
