"""Written tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in a local session; on a cluster, which wouldn't see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(spark.sparkContext.applicationId)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _temporary[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="provrank-")
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back."""
    path = f"{workspace(df.sparkSession)}/provrank/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    path = getattr(df, "written_to", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
