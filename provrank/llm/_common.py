"""What the operators share: a shared folder for written tables, batch size, streaming over sorted groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 256
_temporary: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in a local session; on a cluster, which wouldn't see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(spark.sparkContext.applicationId)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _temporary[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="provrank-")
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/provrank/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    path = getattr(df, "written_to", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Long texts: fewer rows in an Arrow batch than Spark's default, unless the session has its own figure."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(df: DataFrame, new: dict) -> DataFrame:
    """df with these columns; columns of df with such a name, in whatever case, give way."""
    clash = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash], *[v.alias(k) for k, v in new.items()])


def by_group(keys: list[str], each: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over partitions sorted by keys: each() gets the rows of one key, which must be few."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> pd.DataFrame | None:
            return each(held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))

        last = None
        for pdf in batches:
            if pdf.empty:
                continue
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().copy()
            first = tuple(pdf[keys].iloc[0])
            new[0] = first != last
            cuts = [0, *[i for i in new.nonzero()[0] if i], len(pdf)]
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if new[a] and held:
                    found.append(flush())
                    held.clear()
                held.append(pdf.iloc[a:b].reset_index(drop=True))
            last = tuple(pdf[keys].iloc[-1])
            found = [x for x in found if x is not None and len(x)]
            if found:
                yield pd.concat(found, ignore_index=True)
        if held:
            out = flush()
            if out is not None and len(out):
                yield out

    return run
