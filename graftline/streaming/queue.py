"""The work queue: messages as JSON files of a folder, drained by a stream (STR01-STR04, SRC19, SNK08).

The stream's checkpoint remembers which messages are done; a batch is a job over all of its messages, and what fails for one message becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def produce(projects: DataFrame, folder: str, column: str = "projectNameFolder") -> None:
    """A message for each project, in order of name."""
    projects.select(F.col(column)).orderBy(column).write.mode("append").json(folder)


def drain(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give every message that is there and not done yet to work, once; work must tolerate a repeated batch number."""
    messages = spark.readStream.schema(schema).json(folder)
    messages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def worker(pipeline: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """The work of a batch: pipeline over its messages, written to out/results, and a row for every message in out/status.

    A batch that fails is done again message by message, so that an error is a row of its message and the others finish.  A repeated batch writes the same folders.
    """

    def work(batch: DataFrame, number: int) -> None:
        at = lambda kind, part="all": f"{out}/{kind}/batch={number}/part={part}"
        status = lambda df, error: df.withColumn("error", F.lit(error).cast("string"))
        try:
            pipeline(batch).write.mode("overwrite").parquet(at("results"))
            status(batch, None).write.mode("overwrite").parquet(at("status"))
        except Exception:  # whatever a project does must not stop the queue
            for i, row in enumerate(batch.distinct().toLocalIterator()):
                one, error = batch.sparkSession.createDataFrame([row], batch.schema), None
                try:
                    pipeline(one).write.mode("overwrite").parquet(at("results", str(i)))
                except Exception as x:
                    error = str(x).split("\n")[0][:500]
                status(one, error).write.mode("overwrite").parquet(at("status", str(i)))

    return work
