"""Sources and sinks: pages, key-value files, seeds, cached results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions.web import type_allowed

MAX_BYTES = 5 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages as JSON lines of url and document."""
    return spark.read.schema("url string, document string").json(path)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """name, value of `key=value` lines; blank lines and # comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("="))
    parts = F.split("line", "=", 2)
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("value"))


def missing_keys(properties: DataFrame, required: list[str]) -> list[str]:
    there = {r.name for r in properties.where(F.col("name").isin(required)).select("name").distinct().collect()}
    return [k for k in required if k not in there]


def downloadable(responses: DataFrame) -> DataFrame:
    """Responses (status, content_type, body) that a crawl keeps: HTML, found, of bounded size."""
    return responses.where((F.col("status") == 200) & F.col("content_type").contains("text/html") & type_allowed(F.col("content_type")) & (F.length("body") <= MAX_BYTES))


def to_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def cache_results(hits: DataFrame, query: str, now: int, path: str, ttl: int = 12 * 3600) -> None:
    """Appends a query's hits as JSON with their expiry; nothing is written for no hits."""
    hits.select(F.lit(query).alias("query"), F.to_json(F.struct("*")).alias("item"), F.lit(now + ttl).alias("expires_at")).write.mode("append").parquet(path)


def cached_results(spark: SparkSession, query: str, now: int, path: str, schema: str) -> DataFrame:
    rows = spark.read.parquet(path).where((F.col("query") == query) & (F.col("expires_at") > now))
    return rows.select(F.from_json("item", schema).alias("i")).select("i.*")


def sharded(pages: DataFrame, n: int) -> DataFrame:
    """Pages with a shard each, the same on every run."""
    return pages.withColumn("shard", F.col("page_id") % n)
