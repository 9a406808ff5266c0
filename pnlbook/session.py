"""SparkSession defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Target bytes per shuffle / scan partition on a cluster: large enough to keep
# task overhead low, small enough that a partition's aggregation buffers and
# sort runs fit an executor core's share of memory without heavy spilling.
PARTITION_BYTES = 256 * 1024 ** 2


def cluster_conf(input_bytes: int, cores: int) -> dict:
    """Settings for a cluster run over ``input_bytes`` of parquet.

    The initial shuffle partition count is sized for the largest shuffle
    (at most the whole projected input) at PARTITION_BYTES each, and at
    least 3 waves of the cores; AQE then coalesces small partitions to the
    advisory size and splits skewed ones (a partition 3x the median and over
    1 GiB). Scan splits are 512 MiB of compressed parquet.
    """
    parts = max(3 * cores, -(-input_bytes // PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        # honour the advisory size instead of maximising task count
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(2 * PARTITION_BYTES),
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pnlbook", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a
    cluster leave them to the submit command.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a folder every executor can reach). Only
    when it is unset, as in local tests, a fresh folder under the system
    temp dir is made and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="pnlbook-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
