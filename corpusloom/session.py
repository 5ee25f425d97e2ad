"""Session defaults, and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with deterministic settings; a cluster's own settings win through ``conf``.

    ``shuffle_partitions`` is 8 on a local master and left to the cluster otherwise.
    """
    if shuffle_partitions is None and master.startswith("local"):
        shuffle_partitions = 8
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        **({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.master(master)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local folder for a local master, deleted at exit."""
    known = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_loom_shared_dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loom-core-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        known = spark._loom_shared_dir = f"file://{path}"
    return known.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
