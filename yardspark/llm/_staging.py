"""Tables written to the folder that driver and executors share, to cut lineage and reuse costly results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a local session gets one own temporary folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="yardspark-"))
    return _own[0]


class Staging:
    """Parquet tables of one operator call under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over the session's cores where its files have fewer splits than that (a small table in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def join_counted(rows: DataFrame, facts: DataFrame, on: list[str], times: str, total: int, most: int = 1 << 16) -> DataFrame:
    """rows with the columns of facts, which has each key once, with the number of rows that hold it.

    Keys that more than one in `most` of all `total` rows hold, so fewer than `most` keys, are broadcast; so no key of
    the shuffled rest has more rows than that share.
    """
    bound = total // most
    if total <= most:
        return rows.join(F.broadcast(facts), on)
    often, rest = facts.filter(F.col(times) > bound), facts.filter(F.col(times) <= bound)
    return rows.join(F.broadcast(often), on).unionByName(rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(rest.hint("merge"), on))
