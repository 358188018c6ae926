"""Tables written once to the folder that all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir. Only a local session (tests) may leave that unset."""
    top, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        top = _local[app]
    path = f"{top.rstrip('/')}/quillspark-{app}"
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, top: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder goes with spark.checkpoint.dir
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df as a written table: it cuts lineage, outlives executors, and is computed once."""
    path = new_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
