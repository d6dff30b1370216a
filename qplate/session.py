"""Session helpers (local tests and benches; a cluster session is passed in)."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale, independent of the data size.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",                       # runtime broadcast conversion, coalescing
    "spark.sql.adaptive.skewJoin.enabled": "true",              # split hot partitions of the join-backs
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.codegen.cache.maxEntries": "2000",               # an analysis generates ~200 classes
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "qplate") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def sized_conf(input_bytes: int, executor_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle partitions and scan split size for an input of ``input_bytes``.

    About 256 MB of shuffle data per partition (AQE coalesces smaller ones and
    splits skewed ones), never fewer partitions than cores.
    """
    parts = max(executor_cores, math.ceil(input_bytes / target_partition_bytes))
    return {"spark.sql.shuffle.partitions": str(parts),
            "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 << 20)),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2)}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local-mode session (tests, bench) gets a scratch folder when the
    setting is unset; on a cluster an unset folder is an error, because a
    machine-local path is not visible to the executors.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder (pinned intermediates are written there)")
    path = tempfile.mkdtemp(prefix="qplate-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path
