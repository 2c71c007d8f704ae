"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application, where the session names none.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one of our own if the session is local, as in tests.

    On a cluster without the setting this is an error: executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in OWN:
        OWN[app] = tempfile.mkdtemp(prefix="parlance-shared-")
    return OWN[app]


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_at = path
    return found


def dropped(df: DataFrame) -> None:
    """Delete what saved() wrote, when nothing will read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
