"""Session builder and reuse of an expensive result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Every timestamp in the model is zone-free; UTC keeps NTZ and LTZ arithmetic equal.
SESSION_SETTINGS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming state on the executors' disks instead of their heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_spark_session(
    app_name: str = "caudal", settings: Mapping[str, str] | None = None
) -> SparkSession:
    """Get or create the session.

    Master, memory and shuffle partitions belong to the deployment
    (``spark-submit``), so they are set only if the caller passes them.
    """
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**SESSION_SETTINGS, **(settings or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder, or None where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


@contextmanager
def reused(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep ``df`` while several results read it, then release it.

    Lost blocks are computed again from the lineage, so losing an executor
    costs time and never rows. Meant for frames already aggregated (one row per
    client or account); wide row-level frames are written as a table instead.
    """
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


_OWN_FOLDERS: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared one and read it again.

    What computed it is done once and does not come back into the plans of its readers.
    Without a shared folder a temporary one serves, on a local master only.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = _OWN_FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="caudal-"))
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
