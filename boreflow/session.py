"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "boreflow") -> SparkSession:
    """Local session for tests and the bench. On a cluster, build your own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BOREFLOW_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    apply_recommended_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


# Session settings the forecasters rely on for speed; applied only where the user has not set them.
# hugeMethodLimit: the regression models evaluate sums of 20-60 products per row. A fused stage
# whose generated method passes 8,000 bytes of bytecode is not JIT-compiled by the JVM and runs
# about 10x slower; with the limit at 8,000 Spark splits such a stage into per-operator code.
RECOMMENDED_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def apply_recommended_conf(spark: SparkSession) -> None:
    """Set the recommended settings that are still at Spark's default (user values win)."""
    defaults = {"spark.sql.codegen.hugeMethodLimit": "65535"}
    for k, v in RECOMMENDED_CONF.items():
        cur = spark.conf.get(k, None)
        if cur is None or cur == defaults.get(k):
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names a shared folder and is used as is. Only a local
    session without the setting (tests, bench) gets a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset on a cluster; set it to a shared folder")
    path = tempfile.mkdtemp(prefix="boreflow-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint).

    A frame this function returned is given back as it is. The rows keep their partitioning and
    order, a lost executor re-reads them, and nothing stays in the executors' storage; Spark
    removes the files with the frame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    if getattr(df, "_boreflow_cut", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._boreflow_cut = True
    return out


reuse = cut_lineage  # a frame that several branches of one plan read
