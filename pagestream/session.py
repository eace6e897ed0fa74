"""Session settings and the shared folder for checkpoints."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# What every job here wants, whatever the cluster size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Keyed state can outgrow the executor heap, RocksDB keeps it on local disk
    # and uploads changes to the checkpoint.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name="pagestream", master=None, **settings):
    """A session with SETTINGS; keyword settings use `__` for the dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark):
    """The cluster's `spark.checkpoint.dir`, set on the context if it is not yet.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.getCheckpointDir():
            return context.getCheckpointDir()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pagestream-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def run_dir(spark, name):
    """A fresh folder of this run below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_released(spark):
    """Frames built within give their shuffle files back when their action ends.

    For a row of actions on frames that are used once; a second use would make the files again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
