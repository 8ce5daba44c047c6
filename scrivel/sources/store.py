"""Tables that a query writes on its way, below the folder that the cluster shares."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a folder of its own for a master on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="scrivel-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def fresh(spark: SparkSession, name: str) -> str:
    """A folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """The frame once written, so that plans made from it stay short."""
    schema = df.schema
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
