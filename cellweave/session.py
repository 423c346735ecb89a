"""Session helpers: local sessions for tests, tables in the shared folder, joins with a checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine; on a cluster use the session that is there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellweave")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset, a fresh temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cellweave-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_SCOPES: list[list[Stored]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Deletes on leaving all tables that were stored inside; what was computed from them must be written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for t in _SCOPES.pop():
            t.drop()


class Stored:
    """A DataFrame written to the shared folder, to cut its lineage; drop(), or the end of a `scope`, deletes the files once nothing
    reads them."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/cellweave/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder; an executor's loss costs none of the work before."""
    return Stored(df).df


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else df, which then joins by shuffle. df should be stored."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
