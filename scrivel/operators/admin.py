"""Ban lists, configuration, liveness, monitoring and login over ordinary tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIVE_SECONDS = 40
#: words of a ban list that are searched for at once
MAX_WORDS = 1_000
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")


def banned(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Queries (query, ...) that hold any word (keyword) of a maintained list. The list goes to the executors in blocks of
    MAX_WORDS, so no more is broadcast at once; a query is let through by all blocks or kept by one."""
    numbered = words.where("keyword <> ''").select("keyword").distinct()
    blocks = max(1, -(-numbered.count() // MAX_WORDS))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("keyword"), F.lit(blocks)))
    hit = F.lit(False)
    for k in range(blocks):
        listed = [r.keyword for r in numbered.where(F.col("block") == k).collect()]
        # a literal array, bounded by the block
        hit = hit | F.exists(F.array(*map(F.lit, listed)), lambda w: F.contains("query", w)) if listed else hit
    return queries.where(hit)


def to_bool(s: Column, default: bool) -> Column:
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False).otherwise(default)


def to_long(s: Column, default: int) -> Column:
    return F.coalesce(F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("long")), F.lit(default))


def config_row(pairs: DataFrame, defaults: dict) -> DataFrame:
    """One typed row of (name, value) pairs; what is missing or can't be read keeps its default."""
    raw = pairs.groupBy().agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in defaults])
    typed = {k: to_bool(F.col(k), d) if isinstance(d, bool) else to_long(F.col(k), d) if isinstance(d, int) else F.coalesce(F.col(k), F.lit(d)) for k, d in defaults.items()}
    return raw.select(*[c.alias(k) for k, c in typed.items()])


def liveness(beats: DataFrame, now: Column | int) -> DataFrame:
    """addr, last_beat, alive: the latest beat (addr, ts in seconds) of each address, alive if younger than ALIVE_SECONDS."""
    last = beats.groupBy("addr").agg(F.max("ts").alias("last_beat"))
    return last.withColumn("alive", (now if isinstance(now, Column) else F.lit(now)) - F.col("last_beat") < ALIVE_SECONDS)


def rates(events: DataFrame) -> DataFrame:
    """addr, crawled, failed, failure_rate of (addr, failed boolean) events."""
    got = events.groupBy("addr").agg(F.count("*").alias("crawled"), F.count_if(F.col("failed")).alias("failed"))
    return got.withColumn("failure_rate", F.when(F.col("crawled") != 0, F.col("failed") / F.col("crawled")).otherwise(0.0))


def with_dead(alive: DataFrame, dead: DataFrame) -> DataFrame:
    return alive.withColumn("alive", F.lit(True)).unionByName(dead.withColumn("alive", F.lit(False)), allowMissingColumns=True)


def login_ok(admins: DataFrame, user: str, password: str, salt: str) -> DataFrame:
    """One row, ok: whether a row (username, password hash) fits."""
    want = F.sha2(F.lit(password + salt).cast("binary"), 256)
    return admins.agg((F.count_if((F.col("username") == user) & (F.col("password") == want)) > 0).alias("ok"))


def split_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with rows put in place of those with the same key."""
    return table.join(rows, key, "left_anti").unionByName(rows)


def removed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")
