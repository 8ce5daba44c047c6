"""What the operators share: the shared working folder, written tables and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows that a Python worker gets at once; whole texts may be long, so batches are short
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set, a master on one machine (local) gets a folder of its own; a cluster gets an error, as a folder
    of one machine would be lost with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scrivel-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables written below the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._ended)

    def _ended(self) -> None:
        """Results read the tables, so they stay as long as the program runs, and no longer."""
        with contextlib.suppress(Exception):  # the session may be gone
            self.clear()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema, path = df.schema, self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        """Deletes all of it, once nothing that was made from it is read any more."""
        self.drop("")

    def free(self) -> None:
        """Lets Spark delete the shuffle files of steps whose result is written."""
        gc.collect()
        self.spark._jvm.System.gc()


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Within, a write's shuffle files go as soon as it is done; the session's setting is put back after it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def short(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into ones of at most so many rows, so that what is made of one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches have BATCH_ROWS rows at most, unless the session says otherwise itself.

    The setting is read when a plan runs, and frames that are returned run later, so it stays. It saves buffers outside
    the heap; what functions make of a batch is bounded by short(), whatever the setting.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":  # Spark's own default
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow of a function from batch to batch (None: nothing to emit), over batches of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, rows):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return bounded(df).mapInArrow(run, schema)


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch with the names and types of a DDL schema such as 'a long, b array<int>'."""
    fields = []
    for part in re.split(r",\s*(?![^<]*>)", schema):
        name, kind = part.strip().split(" ", 1)
        fields.append((name, ARROW[kind.strip()]))
    return pa.RecordBatch.from_arrays(
        [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, type=k) for c, (_, k) in zip(columns, fields)],
        names=[n for n, _ in fields],
    )


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
}


#: a key is heavy when it has over one in so many rows; there are at most so many heavy keys, so they can be broadcast
HEAVY_ONE_IN = 10_000
#: and this many rows
HEAVY_ROWS = 10_000
SALTS = 64


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """big joined with small, which has one row for each key; rows of heavy keys are spread over SALTS tasks.

    counts: the written (keys..., k), how many rows of big each key has. Only rows of small with a heavy key are
    repeated, and the list of heavy keys has at most HEAVY_ONE_IN rows whatever the input. Null keys match nothing.
    """
    total = counts.agg(F.sum("k")).first()[0] or 0
    heavy = counts.where(F.col("k") * HEAVY_ONE_IN > max(total, HEAVY_ONE_IN * HEAVY_ROWS)).select(*keys, F.lit(True).alias("_hot"))
    found = heavy.collect()
    if not found:
        return big.join(small, keys, how)
    heavy = big.sparkSession.createDataFrame(found, heavy.schema)
    at = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    left = big.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_hot"), at).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened where a table has them already."""
    have = {n.lower() for n in names}
    return [next(w + "_" * k for k in range(len(have) + 1) if (w + "_" * k).lower() not in have) for w in wanted]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
