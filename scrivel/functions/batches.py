"""Arrow batches of bounded size for functions that run in Python."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: rows that a Python worker gets at once, and bytes of text that a function takes at once, one row at least
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, unless the session has its own setting. It is read when a plan runs, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own default
        spark.conf.set(key, str(BATCH_ROWS))


def pieces(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of at most BATCH_ROWS rows and about so many bytes, BATCH_BYTES by default; a longer row is a
    run of its own."""
    most = most or BATCH_BYTES
    at = 0
    while at < batch.num_rows:
        n = min(BATCH_ROWS, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def map_pieces(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int | None = None) -> DataFrame:
    """mapInArrow of a function from batch to batch over pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(fn, pieces(batch, most))

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
