"""Streams: page ingest, heartbeats, seen-url de-duplication, windows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions.text import parse_documents
from scrivel.operators.index import append_index
from scrivel.sources.store import fresh

PAGES = "page_id bigint, url string, html string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_of(spark: SparkSession, sf_dir: str, name: str, schema: str, per_trigger: int = 100) -> DataFrame:
    # as a pattern the table may be a file or a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """The result table of a stream once all that is there has been read. Results go to a folder, never to the driver.

    In complete and update mode each micro-batch replaces what it says again: the last batch's rows are the table in
    complete mode; in append mode all batches are. A retried batch writes its own folder once more.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, "flow")
    schema, last = df.schema, [0]

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        last[0] = number

    df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    where = f"{path}/out/batch={last[0]}" if mode == "complete" else f"{path}/out"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(where)


def ingest(pages: DataFrame, path: str, checkpoint: str):
    """Parses and indexes pages as they come; every micro-batch is a batch of the index at path, and counts once however
    often it is tried."""
    return pages.writeStream.foreachBatch(lambda batch, k: append_index(parse_documents(batch), path, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stamped(events: DataFrame) -> DataFrame:
    """Events with a zoned timestamp, as watermarks need it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def last_beats(events: DataFrame) -> DataFrame:
    return stamped(events).groupBy(F.col("user_id").alias("addr")).agg(F.max("ts").alias("last_beat"))


def unseen_urls(pages: DataFrame, late: str | None = None) -> DataFrame:
    """Each url once. late: forget urls that long after their ts, so that the state is bounded."""
    if late:
        return pages.select("url", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"]).select("url")
    return pages.select("url").dropDuplicates(["url"])


def beat_changes(events: DataFrame, late: str = "40 hours", ttl: int = 40) -> DataFrame:
    """addr, start, end: how long each address was alive; it is dead ttl hours after its last beat. Sessions that no beat
    can reach any more leave the state."""
    w = F.session_window("ts", f"{ttl} hours")
    alive = stamped(events).withWatermark("ts", late).groupBy(w.alias("w"), F.col("user_id").alias("addr")).agg(F.count("*").alias("beats"))
    return alive.select("addr", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return stamped(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "40 seconds") -> DataFrame:
    w = F.session_window("ts", gap)
    return stamped(events).withWatermark("ts", gap).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
