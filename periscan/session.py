"""Session helpers: tables, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) is a
    temporary folder used; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="periscan-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/periscan/{name}-{uuid.uuid4().hex[:12]}"


#: Whether the files of a write's shuffles go when it ends, or some time after the driver has collected its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors. With ``tidy``, the shuffles behind it take no disk afterwards."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes to the shared folder and drops when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((back, path))
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of these tables. Call it once all that derives from them is written."""
        for k, (df, path) in reversed(list(enumerate(self.paths))):
            if any(df is t for t in tables):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                del self.paths[k]


#: Rows of one or two longs that are broadcast at most: about 200 MB in each executor.
BROADCAST_ROWS = 4_000_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of a few longs a row, marked for a broadcast if it has ``most`` rows or fewer; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
