"""Session helpers: sizing for a cluster run and the shared scratch folder."""

from pnlbook.session import PARTITION_BYTES, checkpoint_root, cluster_conf, scratch_dir


def test_cluster_conf_sizes_partitions_from_input():
    c = cluster_conf(100 * 1024 ** 4, cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // PARTITION_BYTES
    small = cluster_conf(1024, cores=64)
    assert int(small["spark.sql.shuffle.partitions"]) == 3 * 64
    assert c["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == c["spark.sql.shuffle.partitions"]


def test_scratch_lives_under_the_configured_checkpoint_folder(spark):
    root = checkpoint_root(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/").split(":")[-1] in root
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)
