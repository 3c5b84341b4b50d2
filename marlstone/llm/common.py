"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import shared_dir

#: A word is a run of characters other than space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast; above it joins shuffle.
BROADCAST_ROWS = 100_000


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return let(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it is known to hold few rows; otherwise leave the join to the optimiser."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the one all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, at: str) -> DataFrame:
    """df as a Parquet table at a new place, read back: rows and their ids stay as they are whatever executor is lost."""
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, at: str) -> None:
    """Takes away a table of an earlier round, through whatever file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def literals(values: list, kind: str) -> Column:
    """The values as one array constant of a plan (strings must not hold commas)."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
