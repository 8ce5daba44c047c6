"""Boolean search with TF-IDF, phrase boost and title weight over an index of postings.

A query reads the postings of all its keywords' and exclusions' tokens in one scan with a pushed-down token filter, and
groups them by document once: a keyword matches where all of its tokens are there, its phrases are offsets that stand in
every token's shifted positions. Document counts of the tokens come from the index's statistics. Texts are never read.
"""

import re
from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions.text import INDEXED, host_of
from scrivel.operators.index import Index, index_of
from scrivel.sources.store import fresh, written

_PAIR = re.compile(f"(?=([{INDEXED}]{{2}}))")
SHARD_HITS = 50
PAGE = 10
MAX_PAGE = 10


@dataclass
class Query:
    keywords: list[str] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    site: str = ""


def parse_query(text: str) -> Query:
    """`word`, `-word` and `site:host` parts, split by single spaces; the first site that isn't empty counts."""
    q = Query()
    for part in text.split(" "):
        if part.startswith("-"):
            q.exclusions += [part[1:]] if part[1:] else []
        elif part.startswith("site:"):
            q.site = q.site or part[5:]
        elif part:
            q.keywords.append(part)
    return q


def parsed_queries(query: Column) -> Column:
    """parse_query as a struct column, for tables of queries."""
    parts = F.filter(F.split(query, " "), lambda x: x != "")
    words = F.filter(parts, lambda x: ~x.startswith("-") & ~x.startswith("site:"))
    minus = F.transform(F.filter(parts, lambda x: x.startswith("-") & (x != "-")), lambda x: F.substring(x, F.lit(2), F.length(x)))
    site = F.transform(F.filter(parts, lambda x: x.startswith("site:") & (x != "site:")), lambda x: F.substring(x, F.lit(6), F.length(x)))
    return F.struct(words.alias("keywords"), minus.alias("exclusions"), F.coalesce(F.get(site, F.lit(0)), F.lit("")).alias("site"))


def page_number(s: Column) -> Column:
    """A page number as users give it: 1 where it can't be read or is below."""
    return F.greatest(F.coalesce(F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int")), F.lit(1)), F.lit(1))


def page_count(hits: DataFrame) -> DataFrame:
    """total, pages: hits and the pages that show them, MAX_PAGE at most."""
    return hits.agg(F.count("*").alias("total")).select("total", F.least(F.ceil(F.col("total") / PAGE), F.lit(MAX_PAGE)).cast("long").alias("pages"))


def query_tokens(keyword: str) -> list[tuple[str, int]]:
    """Bigrams of a keyword with their offsets; repeated ones keep every offset."""
    return [(m[1], m.start()) for m in _PAIR.finditer(keyword)]


def place(field: str, token: str) -> Column:
    return F.element_at("found", token)[field]


def has_all(keyword: str) -> Column:
    """True where a document has each bigram; a keyword without bigrams matches nothing."""
    found = [F.map_contains_key("found", t) for t, _ in query_tokens(keyword)]
    return reduce(lambda a, b: a & b, found) if found else F.lit(False)


def phrases(field: str, keyword: str) -> Column:
    """At how many offsets every bigram of the keyword stands in its place."""
    def shifted(token: str, by: int) -> Column:
        return F.transform(place(field, token), lambda p: p - by)

    return F.size(reduce(F.array_intersect, [shifted(t, b) for t, b in query_tokens(keyword)]))


def gathered(index: Index, keywords: list[str], site: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and by) and found: token to (title_pos, body_pos), of the documents with any of the keywords' tokens."""
    tokens = sorted({t for k in keywords for t, _ in query_tokens(k)})
    rows = index.postings.where(F.col("token").isin(tokens))
    rows = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("title_pos", "body_pos").alias("at")))).alias("found"))
    if by or site:
        docs = index.docs.where(host_of(F.col("url")).endswith(site)) if site else index.docs
        rows = rows.join(docs.select("doc_id", *by), "doc_id")
    return rows


def _weights(index: Index, tokens: list[str], by: tuple[str, ...]) -> tuple[DataFrame | None, list[Column]]:
    """ln(documents / documents with the token) of each token: numbers, or columns of a table with a row for each shard."""
    if not by:
        n, df = index.docs.count(), index.document_counts(tokens)
        return None, [F.lit(log(n / df[t]) if t in df else 0.0) for t in tokens]
    rows = index.postings.where(F.col("token").isin(tokens)).select("doc_id", "token").join(index.docs.select("doc_id", *by), "doc_id")
    df = rows.groupBy(*by).agg(*[F.count_if(F.col("token") == t).alias(f"df_{i}") for i, t in enumerate(tokens)])
    n = index.docs.groupBy(*by).agg(F.count("*").alias("n_docs"))
    return n.join(df, list(by)), [F.ln(F.col("n_docs") / F.col(f"df_{i}")) for i in range(len(tokens))]


def _scored(index: Index, hits: DataFrame, keyword: str, by: tuple[str, ...], phrase_boost: bool) -> DataFrame:
    tokens = list(dict.fromkeys(t for t, _ in query_tokens(keyword)))
    counts, weights = _weights(index, tokens, by)
    hits = hits.join(counts, list(by)) if counts is not None else hits
    tf = lambda t: F.size(place("title_pos", t)) + F.size(place("body_pos", t))
    base = reduce(lambda a, b: a + b, [(1 + F.ln(tf(t))) * w for t, w in zip(tokens, weights)])
    hits = hits.select("doc_id", *by, base.alias("base"), phrases("title_pos", keyword).alias("title_phrases"), phrases("body_pos", keyword).alias("body_phrases"))
    boost = lambda c: F.when(F.col(c) > 0, 3 + F.ln(c)).otherwise(1.0)
    score = F.col("base") * (boost("title_phrases") * 3 + boost("body_phrases")) if phrase_boost else F.col("base")
    return hits.select("doc_id", *by, score.alias("score"), "title_phrases", "body_phrases")


def _nothing(index: Index, by: tuple[str, ...]) -> DataFrame:
    return index.docs.where(F.lit(False)).select("doc_id", *by, F.lit(0.0).alias("score"), F.lit(0).alias("title_phrases"), F.lit(0).alias("body_phrases"))


def keyword_scores(index: Index | DataFrame, keyword: str, site: str = "", by: tuple[str, ...] = (), phrase_boost: bool = True) -> DataFrame:
    """doc_id (and by), score, title_phrases, body_phrases of the documents that match a keyword."""
    index = index if isinstance(index, Index) else index_of(index)
    if not query_tokens(keyword):
        return _nothing(index, by)
    return _scored(index, gathered(index, [keyword], site, by).where(has_all(keyword)), keyword, by, phrase_boost)


def search(index: Index | DataFrame, text: str, by: tuple[str, ...] = (), compat_and: bool = False) -> DataFrame:
    """doc_id (and by) and score of the documents that match a query; the first keyword's score counts.

    compat_and: as many of the last keyword's hits, by id, as the intersection so far holds, with the last one's score.
    """
    index = index if isinstance(index, Index) else index_of(index)
    q = parse_query(text)
    keys = ["doc_id", *by]
    if not q.keywords or not query_tokens(q.keywords[0]) or not compat_and and not all(map(query_tokens, q.keywords)):
        return _nothing(index, by).select(*keys, "score")
    if not compat_and:
        rows = gathered(index, [*q.keywords, *q.exclusions], q.site, by)
        for k in q.keywords:
            rows = rows.where(has_all(k))
        for x in q.exclusions:
            rows = rows.where(~has_all(x)) if query_tokens(x) else rows
        return _scored(index, rows, q.keywords[0], by, True).select(*keys, "score")
    out = keyword_scores(index, q.keywords[0], q.site, by).select(*keys, "score")
    for k in q.keywords[1:]:
        other = ranked(keyword_scores(index, k, q.site, by).select(*keys, "score"), *by)
        both = out.select(*keys).join(other.select(*keys), keys, "left_semi")
        size = both.groupBy(*by).agg(F.count("*").alias("k"))
        other = other.join(size, list(by)) if by else other.crossJoin(F.broadcast(size))
        out = other.where("rank <= k").select(*keys, "score")
    for x in q.exclusions:
        if query_tokens(x):
            out = out.join(gathered(index, [x], q.site, by).where(has_all(x)).select(*keys), keys, "left_anti")
    return out


def ranked(hits: DataFrame, *by: str) -> DataFrame:
    """hits with rank: their place by id, of each shard. Ranges of ids are numbered apart and moved on by the sizes of those
    before, so no task gets all hits, however many are asked for."""
    spark = hits.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits = written(hits.repartitionByRange(parts, *by, "doc_id").withColumn("_range", F.spark_partition_id()), fresh(spark, "hits"))
    keys = [*by, "_range"]
    sizes = hits.groupBy(*keys).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select(*keys, (F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))
    return hits.withColumn("_at", at).join(F.broadcast(before), keys).withColumn("rank", F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def first_hits(hits: DataFrame, n: int = SHARD_HITS, *by: str) -> DataFrame:
    """The first hits by id, of each shard."""
    if not by:
        return hits.orderBy("doc_id").limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def page_of(hits: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of hits by score, best first, ties by id; pages count from 1, none beyond MAX_PAGE."""
    if not 1 <= number <= MAX_PAGE:
        return hits.limit(0)
    return hits.orderBy(F.desc("score"), "doc_id").offset((number - 1) * size).limit(size)
