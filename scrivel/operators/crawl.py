"""Crawl frontier: links, robots rules, seen-sets, breadth-first rounds and page importance."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivel.functions.text import host_of
from scrivel.sources.store import fresh, written

LINK = r'(?is)<a.+?href.?=.?"(.+?)"'
SEEDS = (31, 37, 61, 17, 13)


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, url, link: anchors without fragment and without javascript, relative ones behind the page's url."""
    found = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    rows = pages.select("page_id", "url", F.explode(found).alias("raw")).withColumn("cut", F.substring_index("raw", "#", 1))
    rows = rows.where(~F.col("cut").startswith("javascript:"))
    whole = F.col("cut").startswith("http") | F.col("cut").startswith("HTTP")
    return rows.select("page_id", "url", F.when(whole, F.col("cut")).otherwise(F.concat("url", F.lit("/"), "cut")).alias("link"))


def polynomial_hash(s: Column, seed: int) -> Column:
    """|h| of h = h * seed + code point in 64-bit wrap-around arithmetic, done in decimals as overflow is an error."""
    wide = "decimal(38,0)"
    top = F.lit("18446744073709551616").cast(wide)
    codes = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast(wide))
    h = F.aggregate(codes, F.lit(0).cast(wide), lambda a, c: ((a * seed + c) % top).cast(wide))
    return F.when(h >= F.lit("9223372036854775808").cast(wide), (top - h).cast(wide)).otherwise(h)


def bloom_bits(s: Column, n_bits: int) -> Column:
    """The five bit numbers of a string."""
    return F.array(*[(polynomial_hash(s, k) % F.lit(n_bits).cast("decimal(38,0)")).cast("long") for k in SEEDS])


def bloom_filter(urls: DataFrame, n_bits: int) -> DataFrame:
    """bit: the bits that are set; at most n_bits rows."""
    return urls.select(F.explode(bloom_bits(F.col("url"), n_bits)).alias("bit")).distinct()


def bloom_unseen(urls: DataFrame, bits: DataFrame, n_bits: int) -> DataFrame:
    """Distinct urls of which some bit isn't set."""
    asked = urls.select("url").distinct().select("url", F.explode(F.array_distinct(bloom_bits(F.col("url"), n_bits))).alias("bit"))
    return asked.join(bits, "bit", "left_anti").select("url").distinct()


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """The exact form: distinct urls that are not in seen."""
    return urls.select("url").distinct().join(seen, "url", "left_anti")


def robots_regex(rule: str) -> str:
    """A rule as a pattern to be searched in `path?query`."""
    suffix = rule.endswith("$")
    parts = [re.escape(p) for p in (rule[:-1] if suffix else rule).split("*")]
    if len(parts) == 1:
        return f"^{parts[0]}$" if suffix else f"^{parts[0]}"
    body = ".*?".join(parts)
    return f"(?s){body}" + (f"(?:.*{parts[-1]})?$" if suffix and parts[-1] else "")


def parse_robots(text: str, agent: str) -> list[tuple[str, str]]:
    """(kind, rule) of the lines that concern an agent; empty rules are skipped. Lines before any agent count."""
    out, ours = [], True
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        key, value = key.lower(), value.strip()
        if not colon:
            continue
        if key in ("user-agent", "useragent"):
            ours = value in (agent, "*")
        elif key in ("allow", "disallow") and ours and value:
            out.append((key, value))
    return out


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed. urls: (url, host, path); rules: (host, kind, pattern), few for a host. An allow beats a disallow."""
    hit = lambda kind: F.coalesce(F.bool_or((F.col("kind") == kind) & F.rlike("path", F.col("pattern"))), F.lit(False))
    both = urls.join(rules, "host", "left").groupBy("url").agg(hit("allow").alias("yes"), hit("disallow").alias("no"))
    return both.select("url", (F.col("yes") | ~F.col("no")).alias("allowed"))


def breadth_first(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """node, depth of what is reached in so many rounds."""
    path = fresh(edges.sparkSession, "walk")
    # edges and every round are written: a round's plan is the same whatever its number
    edges = written(edges.select("src", "dst"), f"{path}/edges")
    reached = seeds.select("node").distinct()
    for depth in range(rounds + 1):
        front = written(reached, f"{path}/seen/depth={depth}")
        if depth == rounds or not front.limit(1).count():
            break
        seen = edges.sparkSession.read.schema("node string").option("recursiveFileLookup", "true").parquet(f"{path}/seen")
        reached = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
    return edges.sparkSession.read.schema("node string, depth int").parquet(f"{path}/seen").select("node", "depth")


def crawl_rounds(edges: DataFrame, cash: DataFrame, rounds: int) -> DataFrame:
    """node, cash after so many rounds of online importance; every round is a written table."""
    path = fresh(edges.sparkSession, "cash")
    edges = written(edges.select("src", "dst"), f"{path}/edges")
    for k in range(rounds):
        cash = written(spread_cash(edges, cash), f"{path}/round{k}")
    return cash


def push(frontier: str, urls: DataFrame, batch: int) -> None:
    """Adds urls to the frontier at a path, as a batch of a number; the same batch again replaces itself."""
    urls.select("url").distinct().write.mode("overwrite").parquet(f"{frontier}/batch={batch}")


def pop(spark: SparkSession, frontier: str, seen: DataFrame, rules: DataFrame, per_host: int) -> DataFrame:
    """url, host, turn: what to fetch next, per_host urls of each host at most, in turns: neither seen nor forbidden."""
    urls = spark.read.schema("url string").option("recursiveFileLookup", "true").parquet(frontier)
    fresh_urls = unseen(urls, seen).select("url", host_of(F.col("url")).alias("host"), path_query(F.col("url")).alias("path"))
    allowed = robots_allowed(fresh_urls, rules).where("allowed").select("url")
    return per_host_order(allowed.withColumn("host", host_of(F.col("url")))).where(F.col("turn") <= per_host)


def path_query(url: Column) -> Column:
    """`path?query` of a url, what robots rules are matched against."""
    plain = F.substring_index(url, "#", 1)
    asked = F.when(plain.contains("?"), F.split_part(plain, F.lit("?"), F.lit(2))).otherwise("")
    return F.concat(F.regexp_extract(plain, "^[^:]*://[^/?#]*([^?]*)", 1), F.lit("?"), asked)


def spread_cash(edges: DataFrame, cash: DataFrame) -> DataFrame:
    """One round of online importance: every leader shares its cash evenly, new members start with one more."""
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    share = edges.join(out, "src").join(cash.withColumnsRenamed({"node": "src", "cash": "own"}), "src")
    given = share.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("own") / F.col("k")).alias("got"))
    kept = cash.join(share.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    both = kept.join(given, "node", "full")
    return both.select("node", (F.coalesce("cash", F.lit(1.0)) + F.coalesce("got", F.lit(0.0))).alias("cash"))


def richest(cash: DataFrame, n: int) -> DataFrame:
    return cash.orderBy(F.desc("cash"), "node").limit(n)


def partition_of(host: Column, n: int) -> Column:
    """A partition number that any engine can compute: the first seven hex digits of the md5."""
    return F.conv(F.substring(F.md5(host.cast("binary")), 1, 7), 16, 10).cast("long") % n


def per_host_order(urls: DataFrame) -> DataFrame:
    return urls.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("url")))
