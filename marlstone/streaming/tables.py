"""Tables as streams, and streams drained into tables of the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import shared_dir


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of a Parquet table as a stream; files that arrive later come in later batches."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern, as the file source takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def drain(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """Run the stream over all that is there now. Without `each` its rows go to folder/out, which is returned.

    The checkpoint stands beside the output: a second call goes on where the first one ended.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{folder}/out")).start()
    query.awaitTermination()
    return None if each else stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
