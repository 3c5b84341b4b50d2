"""Session factory and helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "marlstone", master: str | None = None, shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a temporary one is taken, in local mode only:
    on a cluster other machines would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir() or at
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lineage is short and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the one all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str) -> DataFrame:
    """df as a Parquet table at a new place, read back. Loops of many rounds use it in place of cut: the planner sees the table's true
    size, where that of a checkpoint is the estimate of the plan behind it, which grows with the square from round to round."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, rows: int, *keys: str, each: int = 500_000) -> DataFrame:
    """df of so many rows by hash of the keys, about `each` rows to a task, where the session's partitions would get more: what a task
    holds of a grouping by these keys does not grow with the input then."""
    spark = df.sparkSession
    n = -(-rows // each)
    return df.repartition(n, *keys) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by hash of the keys over the session's partitions, where a table of many rows that cost much each is a few blocks of a file:
    their number is fixed, so that adaptive execution, which sees bytes only, does not put them together again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


class Rounds:
    """Tables of one run of a loop, in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.folder, self.n = new_folder(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return stored(df, f"{self.folder}/{self.n}")


def removed(spark: SparkSession, at: str) -> None:
    """Takes away a table of an earlier round, through whatever file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
