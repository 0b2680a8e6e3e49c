"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else its checkpoint dir; a temp folder on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="bitweave-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def keep(df: DataFrame, name: str = "rows", codec: str = "lz4") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    folder = f"{shared_folder(df.sparkSession)}/bitweave-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._kept_in = folder
    return back


def local_frame(spark: SparkSession, rows, schema: str | StructType) -> DataFrame:
    """A small table of Python rows, handed over as Arrow: no Python worker has to start for it on any executor."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names), schema)


def discard(*frames: DataFrame | None) -> None:
    """Delete the files behind kept frames that nothing will read any more; other frames are left alone."""
    for df in frames:
        folder = getattr(df, "_kept_in", None)
        if folder:
            remove(df.sparkSession, folder)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _hadoop(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    where, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
