"""The registered queries and their oracle SQL. Doubles are rounded to six places on both sides, counts are BIGINT."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions import codec, web
from scrivel.functions.text import bigrams, host_of, parse_documents
from scrivel.operators import admin, crawl, highlight, index, search
from scrivel.operators.search import parse_query, query_tokens
from scrivel.sources import store, tables
from scrivel.sources.tables import table
from scrivel.streaming import flows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def docs_of(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """parts: pages are spread over so many before they are parsed, however few row groups their files have."""
    pages = table(spark, sf_dir, "pages")
    return parse_documents(pages.repartition(parts, "page_id") if parts else pages)


_BUILT: dict[tuple[str, str, str], str] = {}


def built(spark: SparkSession, sf_dir: str, name: str = "pages") -> index.Index:
    """The index of a table, written once in a session; searches read postings, never pages."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), store.fresh(spark, f"index-{name}")
        if name == "pages":
            index.save_index(docs_of(spark, sf_dir, parts), path)
        else:
            docs = table(spark, sf_dir, name).select("doc_id", F.col("source").alias("url"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("body"))
            index.save_index(docs, path, parts)
        _BUILT[key] = path
    return index.open_index(spark, _BUILT[key])


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


# --- SQL building blocks ------------------------------------------------------------------------------------------

_TRIM = r"regexp_replace({}, '^[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+$', '', 'g')"
_TITLE = r"(?is)<title.*?>(.*?)</title>"
_MARKUP = r"(?is)<!--.*?-->|<script.*?>.*?</script>|<style.*?>.*?</style>|<title.*?>.*?</title>|<.+?>"
_BODY = rf"regexp_replace(regexp_replace(html, '{_MARKUP}', ' ', 'g'), '[\t\n\f\r ]+', ' ', 'g')"
DOCS = f"""docs AS (SELECT page_id AS doc_id, url, {_TRIM.format(f"regexp_extract(html, '{_TITLE}', 1)")} AS title, {_TRIM.format(_BODY)} AS body
FROM pages WHERE regexp_matches(html, '{_TITLE}'))"""
_IS = r"regexp_matches(tok, '^[A-Za-z0-9\x{4E00}-\x{9FA5}]{2}$')"
POS = f"""fields AS (SELECT doc_id, 0 AS field, title AS s FROM docs UNION ALL SELECT doc_id, 1, body FROM docs),
pos AS (SELECT doc_id, field, i AS pos, tok FROM (SELECT doc_id, field, i, substr(s, i + 1, 2) AS tok FROM (SELECT doc_id, field, s, unnest(range(0, greatest(length(s) - 1, 0))) AS i FROM fields)) WHERE {_IS})"""
_HOST = r"regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[^:]*$', '')"
DOCS_ALL = "docs AS (SELECT doc_id, source AS url, '' AS title, coalesce(text, '') AS body FROM documents)"


def scored_sql(name: str, keyword: str, site: str = "", shard: bool = False, phrase: bool = True) -> str:
    """CTE name(doc_id, [shard,] score, tp, bp) over docs and pos."""
    tokens = query_tokens(keyword)
    values = ", ".join(f"('{t}', {b})" for t, b in tokens)
    k, m = len({t for t, _ in tokens}), len(tokens)
    key, of = ("doc_id % 4", "AND d.shard = n.shard") if shard else ("0", "")
    where = f"WHERE suffix({_HOST}, '{site}')" if site else ""
    score = "b.base * ((CASE WHEN tp > 0 THEN 3 + ln(tp) ELSE 1 END) * 3 + (CASE WHEN bp > 0 THEN 3 + ln(bp) ELSE 1 END))" if phrase else "b.base"
    return f"""
{name}_q(tok, base) AS (VALUES {values}),
{name}_hit AS (SELECT p.doc_id, p.tok, count(*) AS tf FROM pos p WHERE p.tok IN (SELECT tok FROM {name}_q) GROUP BY ALL),
{name}_df AS (SELECT tok, {key} AS shard, count(*) AS df FROM {name}_hit GROUP BY ALL),
{name}_n AS (SELECT {key} AS shard, count(*) AS n FROM docs GROUP BY ALL),
{name}_b AS (SELECT h.doc_id, d.shard, sum((1 + ln(tf)) * ln(n / df)) AS base FROM {name}_hit h JOIN {name}_df d ON d.tok = h.tok AND d.shard = {key.replace("doc_id", "h.doc_id")} JOIN {name}_n n ON n.shard = d.shard GROUP BY ALL HAVING count(*) = {k}),
{name}_o AS (SELECT doc_id, field, pos - base AS o FROM pos JOIN {name}_q USING (tok) GROUP BY ALL HAVING count(*) = {m}),
{name}_p AS (SELECT doc_id, count(*) FILTER (field = 0) AS tp, count(*) FILTER (field = 1) AS bp FROM {name}_o GROUP BY ALL),
{name} AS (SELECT b.doc_id, b.shard, tp, bp, {score} AS score FROM {name}_b b JOIN docs USING (doc_id)
  LEFT JOIN (SELECT doc_id AS pid, tp, bp FROM {name}_p) ON pid = b.doc_id {where})"""


def search_sql(text: str, docs: str = DOCS, tail: str = "SELECT doc_id, round(score, 6) AS score FROM hits", shard: bool = False) -> str:
    q = parse_query(text)
    parts = [scored_sql(f"k{i}", k, q.site, shard) for i, k in enumerate(q.keywords)]
    parts += [scored_sql(f"x{i}", k, q.site, shard) for i, k in enumerate(q.exclusions)]
    conds = [f"doc_id IN (SELECT doc_id FROM k{i})" for i in range(1, len(q.keywords))] + [f"doc_id NOT IN (SELECT doc_id FROM x{i})" for i in range(len(q.exclusions))]
    where = " WHERE " + " AND ".join(conds) if conds else ""
    return f"WITH {docs}, {POS}, {','.join(parts)}, hits AS (SELECT doc_id, shard, score FROM k0{where}) {tail}"


# --- documents and index ------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id, url, title, body FROM docs")
def parse_documents_all(spark, sf_dir):
    return docs_of(spark, sf_dir)


@query(f"WITH {DOCS}, {POS} SELECT doc_id, tok AS token, count(*) AS n FROM pos GROUP BY ALL")
def bigram_tokens(spark, sf_dir):
    return index.token_counts(docs_of(spark, sf_dir))


@query(f"WITH {DOCS}, {POS} SELECT tok AS token, count(DISTINCT doc_id) AS document_count, count(*) AS positions_count FROM pos GROUP BY ALL")
def token_stats(spark, sf_dir):
    return index.token_stats(docs_of(spark, sf_dir))


@query(f"WITH {DOCS}, {POS} SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(DISTINCT tok) FROM pos) AS vocabulary, (SELECT round(avg(length(body)), 6) FROM docs) AS mean_chars")
def corpus_stats(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    words = docs.select(F.explode(F.array_distinct(F.concat(bigrams(F.col("title")), bigrams(F.col("body"))))).alias("token")).distinct()
    size = docs.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.length("body")), 6).alias("mean_chars"))
    return size.crossJoin(words.agg(F.count("*").alias("vocabulary"))).select("n_docs", "vocabulary", "mean_chars")


@query(f"""WITH {DOCS}, {POS} SELECT tok AS token, doc_id, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (field = 0), '') AS title_pos,
coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (field = 1), '') AS body_pos, count(*) FILTER (field = 0) AS title_end FROM pos GROUP BY ALL""")
def postings_list(spark, sf_dir):
    p = built(spark, sf_dir).postings
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return p.select("token", "doc_id", flat("title_pos").alias("title_pos"), flat("body_pos").alias("body_pos"), F.size("title_pos").cast("long").alias("title_end"))


@query(ORACLE_SQL["token_stats"])
def index_merge(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return index.merge_stats(*[index.token_stats(docs.where(F.col("doc_id") % 2 == k)) for k in (0, 1)])


# --- search -------------------------------------------------------------------------------------------------------

_ASKED = ("the that", "onon -the", "site:example.com anan", "-", "  ", "site: site:a.b x", "a--b -x -y", "site:-x -site:y")


@query(f"""WITH q(query) AS (VALUES {", ".join(f"('{q}')" for q in _ASKED)}), p AS (SELECT query, list_filter(string_split(query, ' '), lambda x: x <> '') AS parts FROM q)
SELECT query, array_to_string(list_filter(parts, lambda x: NOT starts_with(x, '-') AND NOT starts_with(x, 'site:')), ',') AS keywords,
array_to_string(list_transform(list_filter(parts, lambda x: starts_with(x, '-') AND x <> '-'), lambda x: substr(x, 2)), ',') AS exclusions,
coalesce(list_transform(list_filter(parts, lambda x: starts_with(x, 'site:') AND x <> 'site:'), lambda x: substr(x, 6))[1], '') AS site FROM p""")
def query_parse(spark, sf_dir):
    """The parser that search uses, of every query text."""
    rows = [(q, ",".join(p.keywords), ",".join(p.exclusions), p.site) for q in _ASKED for p in [parse_query(q)]]
    return spark.createDataFrame(rows, "query string, keywords string, exclusions string, site string")


_USER_SQL = "SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS parts FROM conversations WHERE role = 'user'"


@query(f"""SELECT conv_id, turn, array_to_string(list_filter(parts, lambda x: NOT starts_with(x, '-') AND NOT starts_with(x, 'site:')), ' ') AS keywords,
len(list_filter(parts, lambda x: starts_with(x, '-') AND x <> '-')) AS n_exclusions FROM ({_USER_SQL})""")
def query_parse_table(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", search.parsed_queries(F.col("text")).alias("q"))
    return rows.select("conv_id", "turn", F.array_join("q.keywords", " ").alias("keywords"), F.size("q.exclusions").cast("long").alias("n_exclusions"))


@query(search_sql("that", tail="SELECT count(*) AS total, least(ceil(count(*) / 10), 10)::BIGINT AS pages FROM hits"))
def search_page_count(spark, sf_dir):
    return search.page_count(search.search(built(spark, sf_dir), "that"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 1 ELSE o_orderkey END::INT AS page FROM orders")
def lenient_page(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    given = F.when(F.col("o_orderkey") % 3 == 0, F.concat(k, F.lit("x"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), k)).otherwise(k)
    return table(spark, sf_dir, "orders").select("o_orderkey", search.page_number(given).alias("page"))


@query(f"WITH {DOCS}, {POS} SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(DISTINCT tok) FROM pos) AS n_tokens, (SELECT count(*) FROM (SELECT DISTINCT doc_id, tok FROM pos)) AS n_postings, (SELECT count(*) FROM pos) AS n_positions")
def index_monitor(spark, sf_dir):
    return index.index_size(built(spark, sf_dir))


@query(f"WITH {DOCS}, {POS}, {scored_sql('k', 'that', phrase=False)} SELECT doc_id, round(score, 6) AS score FROM k")
def search_tfidf(spark, sf_dir):
    return rounded(search.keyword_scores(built(spark, sf_dir), "that", phrase_boost=False).select("doc_id", "score"))


@query(search_sql("that"))
def search_keyword(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir), "that"))


@query(search_sql("ththth"))
def search_repeated_token(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir), "ththth"))


@query(search_sql("onon,the"))
def search_punctuated(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir), "onon,the"))


@query(f"WITH {DOCS}, {POS}, {scored_sql('k', 'anan')} SELECT doc_id, coalesce(tp, 0) AS title_phrases, coalesce(bp, 0) AS body_phrases FROM k")
def phrase_count(spark, sf_dir):
    got = search.keyword_scores(built(spark, sf_dir), "anan")
    return got.select("doc_id", F.col("title_phrases").cast("long").alias("title_phrases"), F.col("body_phrases").cast("long").alias("body_phrases"))


@query(search_sql("that anan"))
def search_and(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir), "that anan"))


@query(search_sql("that anan", tail="""SELECT k1.doc_id, round(k1.score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM k1) k1
WHERE r <= (SELECT count(*) FROM hits)"""))
def search_and_compat(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir), "that anan", compat_and=True))


@query(search_sql("that -ererer"))
def search_not(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir), "that -ererer"))


@query(search_sql("that site:example.net"))
def search_site(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir), "that site:example.net"))


@query(search_sql("that", tail="SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM hits ORDER BY doc_id LIMIT 50) ORDER BY hits.score DESC, doc_id LIMIT 10 OFFSET 10").replace("hits.score DESC", "score DESC"))
def search_topk_page(spark, sf_dir):
    hits = rounded(search.search(built(spark, sf_dir), "that"))
    return search.page_of(search.first_hits(hits), 2)


@query(search_sql("that", shard=True, tail="SELECT doc_id, shard::BIGINT AS shard, round(score, 6) AS score FROM hits QUALIFY row_number() OVER (PARTITION BY shard ORDER BY doc_id) <= 50"))
def search_sharded(spark, sf_dir):
    pages = built(spark, sf_dir)
    pages.docs = pages.docs.withColumn("shard", F.col("doc_id") % 4)
    return rounded(search.first_hits(search.search(pages, "that", by=("shard",)), 50, "shard"))


@query(search_sql("that", DOCS_ALL))
def doc_search(spark, sf_dir):
    return rounded(search.search(built(spark, sf_dir, "documents"), "that"))


_ISLANDS = f"""WITH {DOCS}, {POS}, hit AS (SELECT DISTINCT doc_id, field, pos FROM pos WHERE tok IN ({", ".join(f"'{t}'" for t in dict(query_tokens("that")))})),
cuts AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 2 THEN 0 ELSE 1 END AS brk FROM hit WINDOW w AS (PARTITION BY doc_id, field ORDER BY pos)),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, field ORDER BY pos) AS g FROM cuts),
iv AS (SELECT doc_id, field, g, min(pos) AS s, max(pos) + 1 AS e FROM isl GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY e - s DESC, s) AS r, max(e - s + 1) OVER (PARTITION BY doc_id, field) AS top FROM iv),
best AS (SELECT * FROM ranked WHERE r = 1 OR top > 100)"""


@query(f"{_ISLANDS} SELECT doc_id, field::INT AS field, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM best GROUP BY ALL")
def highlight_intervals(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    out = highlight.with_intervals(highlight.with_intervals(docs, "that", "title", "h0"), "that", "body", "h1")
    rows = out.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"h{k}").alias("h")) for k in (0, 1)])).alias("x")).where(F.size("x.h") > 0)
    return rows.select("doc_id", F.col("x.field"), F.array_join(F.transform("x.h", lambda i: F.concat(i["s"].cast("string"), F.lit("-"), i["e"].cast("string"))), ",").alias("spans"))



@query(f"""{_ISLANDS}, {scored_sql("k", "that").strip()}, first AS (SELECT doc_id FROM k ORDER BY doc_id LIMIT 50),
b AS (SELECT * FROM best WHERE field = 1 AND top <= 100), t AS (SELECT * FROM best WHERE field = 0 AND top <= 100),
j AS (SELECT d.doc_id, url, title, body, b.s, b.e, (100 - (b.e - b.s + 1)) // 2 AS pad, t.s AS ts, t.e AS te FROM docs d JOIN first USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN t ON t.doc_id = d.doc_id),
w AS (SELECT *, greatest(s - pad, 0) AS st FROM j),
x AS (SELECT *, greatest(least(length(body), CASE WHEN st - pad >= 0 THEN e + pad ELSE e + pad - st END), e + 1) AS en FROM w)
SELECT doc_id, url, CASE WHEN ts IS NULL THEN title ELSE substr(title, 1, ts) || '<span style=''color:red''>' || substr(title, ts + 1, te - ts + 1) || '</span>' || substr(title, te + 2) END AS title,
CASE WHEN s IS NULL THEN substr(body, 1, 100) ELSE substr(body, st + 1, s - st) || '<span style=''color:red''>' || substr(body, s + 1, e - s + 1) || '</span>' || substr(body, e + 2, en - e - 1) END AS abstract FROM x""")
def search_abstract(spark, sf_dir):
    pages = built(spark, sf_dir)
    first = search.first_hits(search.search(pages, "that").select("doc_id"))  # at most 50 ids, so texts are read last
    out = highlight.highlighted(pages.docs.join(F.broadcast(first), "doc_id"), "that")
    return out.select("doc_id", "url", F.col("title_marked").alias("title"), "abstract")


# --- crawl --------------------------------------------------------------------------------------------------------

_WORDS = ("ththth", "erer", "zzz", "anan")


@query(f"""SELECT conv_id, turn FROM conversations WHERE role = 'user' AND ({" OR ".join(f"contains(text, '{w}')" for w in _WORDS)})""")
def banned_queries(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumnRenamed("text", "query")
    return admin.banned(asked, spark.createDataFrame([(w,) for w in _WORDS], "keyword string")).select("conv_id", "turn")


_LINKS = r"""links AS (SELECT page_id, url, CASE WHEN starts_with(cut, 'http') OR starts_with(cut, 'HTTP') THEN cut ELSE url || '/' || cut END AS link
FROM (SELECT page_id, url, split_part(raw, '#', 1) AS cut FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a.+?href.?=.?"(.+?)"', 1)) AS raw FROM pages)) WHERE NOT starts_with(cut, 'javascript:'))"""


@query(f"WITH {_LINKS} SELECT page_id, link, count(*) AS n FROM links GROUP BY ALL")
def extract_links(spark, sf_dir):
    return crawl.extract_links(table(spark, sf_dir, "pages")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT host, count(*) AS n FROM (SELECT {_HOST.replace('(url,', '(link,')} AS host FROM links) GROUP BY ALL")
def link_hosts(spark, sf_dir):
    return crawl.extract_links(table(spark, sf_dir, "pages")).select(host_of(F.col("link")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


@query(f"SELECT part, count(*) AS n FROM (SELECT ('0x' || substr(md5({_HOST}), 1, 7))::BIGINT % 16 AS part FROM pages) GROUP BY ALL")
def host_partitions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(crawl.partition_of(host_of(F.col("url")), 16).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def _hash_sql(url: str, seed: int) -> str:
    h = f"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({url}, ''), lambda c: ascii(c)::HUGEINT)), lambda a, c: (a * {seed} + c) % 18446744073709551616)"
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN 18446744073709551616 - {h} ELSE {h} END % {{n}})::BIGINT"


_BITS = "unnest([" + ", ".join(_hash_sql("url", s) for s in crawl.SEEDS) + "])"


@query(f"SELECT DISTINCT {_BITS.format(n=65536)} AS bit FROM pages")
def bloom_bits(spark, sf_dir):
    return crawl.bloom_filter(table(spark, sf_dir, "pages"), 65536)


@query(f"""WITH seen AS (SELECT DISTINCT {_BITS.format(n=4096)} AS bit FROM pages WHERE page_id % 2 = 0),
asked AS (SELECT url, {_BITS.format(n=4096)} AS bit FROM pages) SELECT DISTINCT url FROM asked WHERE bit NOT IN (SELECT bit FROM seen)""")
def bloom_dedup(spark, sf_dir):
    """The oracle's 4096 bits are the least; beyond 512 urls the filter has the reference's 8 bits for each."""
    pages = table(spark, sf_dir, "pages")
    n_bits = max(4096, 8 * pages.count())
    return crawl.bloom_unseen(pages, crawl.bloom_filter(pages.where("page_id % 2 = 0"), n_bits), n_bits)


_EDGES = f"edges AS (SELECT DISTINCT {_HOST} AS src, 'lang:' || regexp_extract(html, '<html lang=\"(..)\"', 1) AS dst FROM pages), both_ways AS (SELECT * FROM edges UNION SELECT dst, src FROM edges)"


def _edges(spark, sf_dir) -> DataFrame:
    """A host graph with languages as hubs: the pages' own links never leave their host."""
    e = table(spark, sf_dir, "pages").select(host_of(F.col("url")).alias("src"), F.concat(F.lit("lang:"), F.regexp_extract("html", '<html lang="(..)"', 1)).alias("dst")).distinct()
    return e.union(e.select("dst", "src")).distinct()


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT min(src) AS node, 0 AS depth FROM edges UNION SELECT b.dst, depth + 1 FROM walk JOIN both_ways b ON node = src WHERE depth < 3)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY ALL""")
def frontier_bfs(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    seeds = edges.where(~F.col("src").startswith("lang:")).agg(F.min("src").alias("node"))
    return crawl.breadth_first(edges, seeds, 3)


@query(f"""WITH {_EDGES}, seeds AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS cash FROM edges), k AS (SELECT src, count(*) AS k FROM edges GROUP BY ALL),
got AS (SELECT dst AS node, sum(cash / k) AS got FROM edges JOIN k USING (src) JOIN seeds ON node = src GROUP BY ALL)
SELECT node, round(1.0 + got, 6) AS cash FROM got""")
def opic_round(spark, sf_dir):
    edges = _edges(spark, sf_dir).where(~F.col("src").startswith("lang:"))
    seeds = edges.select(F.col("src").alias("node"), F.lit(1.0).alias("cash")).distinct()
    return crawl.spread_cash(edges, seeds).select("node", F.round("cash", 6).alias("cash"))


_ROBOTS = (("example.net", "disallow", "/en/"), ("example.net", "allow", "/en/*1*?"), ("example.org", "disallow", "*.html"), ("example.org", "disallow", "/es/*?$"), ("example.com", "allow", "/fr"), ("example.com", "disallow", "/"))
_ROBOT_ROWS = [(h, k, crawl.robots_regex(r)) for h, k, r in _ROBOTS]
_SITE = r"regexp_extract(url, '([a-z]+\.[a-z]+)(?:[/?#:]|$)', 1)"


@query(f"""WITH rules(host, kind, pattern) AS (VALUES {", ".join(f"('{h}', '{k}', '{p}')" for h, k, p in _ROBOT_ROWS)}),
u AS (SELECT url, {_SITE} AS host, regexp_extract(split_part(url, '#', 1), '^[^:]*://[^/?#]*([^?]*)', 1) || '?' || CASE WHEN contains(split_part(url, '#', 1), '?') THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END AS path FROM pages)
SELECT url, coalesce(bool_or(kind = 'allow' AND regexp_matches(path, pattern)), false) OR NOT coalesce(bool_or(kind = 'disallow' AND regexp_matches(path, pattern)), false) AS allowed FROM u LEFT JOIN rules USING (host) GROUP BY url""")
def robots_eval(spark, sf_dir):
    path = crawl.path_query(F.col("url"))
    urls = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"([a-z]+\.[a-z]+)(?:[/?#:]|$)", 1).alias("host"), path.alias("path"))
    return crawl.robots_allowed(urls, F.broadcast(spark.createDataFrame(_ROBOT_ROWS, "host string, kind string, pattern string")))


# --- functions, administration, streams -----------------------------------------------------------------------------

_PADS = [bytes(b ^ x for b in web.KEY.ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]
_HMAC = f"sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode({{0}}))))"
_PLAIN = "split_part(url, '#', 1)"


@query(f"SELECT page_id, {_HMAC.format('url')} AS signature FROM pages")
def hmac_sha256(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.hmac_hex(F.col("url")).alias("signature"))


@query(f"""SELECT page_id, '/proxy?url=' || replace(replace(url_encode({_PLAIN}), '%20', '+'), '~', '%7E') || '&key=' || {_HMAC.format(_PLAIN)} || CASE WHEN length(url) > length({_PLAIN}) + 1 THEN substr(url, length({_PLAIN}) + 1) ELSE '' END AS address FROM pages""")
def signed_proxy_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.signed_address(F.col("url")).alias("address"))


@query()
def sanitize_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.sanitize_html(F.col("url"), F.col("html")).alias("clean"))


@query()
def sanitize_css(spark, sf_dir):
    css = F.concat(F.lit("p{background:url('/img/"), F.col("page_id").cast("string"), F.lit(".png')}"))
    return table(spark, sf_dir, "pages").select("page_id", web.sanitize_css(F.col("url"), css).alias("css"))


@query(f"WITH {DOCS}, {POS} SELECT tok AS token, doc_id, count(*) AS n, sum(pos)::BIGINT AS total FROM pos WHERE field = 1 GROUP BY ALL")
def varint_codec(spark, sf_dir):
    """Postings through the codec and back."""
    p = built(spark, sf_dir).postings.where(F.size("body_pos") > 0)
    raw = p.select("token", "doc_id", codec.encoded(F.col("body_pos").cast("array<long>")).alias("raw"))
    back = raw.select("token", "doc_id", codec.decoded(F.col("raw")).alias("p"))
    return back.select("token", "doc_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))



@query(f"""SELECT user_id AS addr, max(floor(epoch(ts)))::BIGINT AS last_beat, max(floor(epoch(ts))) > (SELECT max(floor(epoch(ts))) FROM events) - 40 * 3600 AS alive FROM events GROUP BY ALL""")
def liveness(spark, sf_dir):
    """Beats are hours apart here, so a tick is an hour instead of a second."""
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("addr"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    now = beats.agg(F.max("ts")).first()[0] or 0
    hours = beats.withColumn("ts", F.col("ts") / 3600)
    return admin.liveness(hours, now / 3600).withColumn("last_beat", F.round(F.col("last_beat") * 3600).cast("long"))


@query("SELECT user_id AS addr, count(*) AS crawled, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_rate FROM events GROUP BY ALL")
def monitor_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("addr"), (F.col("event_type") == "error").alias("failed"))
    return admin.rates(e).withColumn("failure_rate", F.round("failure_rate", 6))


_CONFIG = (("useragent", "bot/2"), ("interval", "250"), ("suspend", "T"), ("retry", "many"), ("other", "x"))
_DEFAULTS = {"useragent": "bot/1", "interval": 100, "suspend": False, "retry": 3, "timeout": 5}


@query("SELECT 'bot/2' AS useragent, 250 AS interval, true AS suspend, 3 AS retry, 5 AS timeout")
def config_pivot(spark, sf_dir):
    row = admin.config_row(spark.createDataFrame(_CONFIG, "name string, value string"), _DEFAULTS)
    return row.select("useragent", F.col("interval").cast("int").alias("interval"), "suspend", F.col("retry").cast("int").alias("retry"), F.col("timeout").cast("int").alias("timeout"))


@query("SELECT c_custkey, sha256(c_name || 'salt') AS stored, c_custkey % 2 = 0 AS ok FROM customer")
def login_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("stored", web.password_hash(F.col("c_name"), F.lit("salt")))
    given = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("x")))
    return c.select("c_custkey", "stored", (web.password_hash(given, F.lit("salt")) == F.col("stored")).alias("ok"))


@query("SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(' ' || c_name || ' | ' || c_mktsegment || '||', '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS parts FROM customer")
def split_list(spark, sf_dir):
    joined = F.concat(F.lit(" "), "c_name", F.lit(" | "), "c_mktsegment", F.lit("||"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(admin.split_list(joined), ";").alias("parts"))


@query(ORACLE_SQL["token_stats"])
def stream_ingest(spark, sf_dir):
    """Pages read as a stream and indexed batch by batch; the statistics are those of the batch index."""
    path = store.fresh(spark, "ingest")
    flows.ingest(flows.stream_of(spark, sf_dir, "pages", flows.PAGES), f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return index.open_index(spark, f"{path}/index").stats


@query("SELECT user_id AS addr, epoch_us(max(ts)) AS last_beat FROM events GROUP BY ALL")
def stream_heartbeat(spark, sf_dir):
    last = flows.drained(flows.last_beats(flows.stream_of(spark, sf_dir, "events", flows.EVENTS)), "complete")
    return last.select("addr", F.unix_micros("last_beat").alias("last_beat"))


@query("SELECT DISTINCT url FROM pages")
def stream_dedup(spark, sf_dir):
    return flows.drained(flows.unseen_urls(flows.stream_of(spark, sf_dir, "pages", flows.PAGES)), "append")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    got = flows.windowed(table(spark, sf_dir, "events"))
    return got.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("""WITH b AS (SELECT user_id AS addr, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT addr, ts, count(*) FILTER (gap IS NULL OR gap > INTERVAL 40 HOUR) OVER (PARTITION BY addr ORDER BY ts, gap) AS no FROM b)
SELECT addr, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 40 HOUR) AS dead, count(*) AS beats FROM s GROUP BY addr, no""")
def heartbeat_expiry(spark, sf_dir):
    got = flows.beat_changes(table(spark, sf_dir, "events"))
    return got.select("addr", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("dead"), "beats")


@query("SELECT DISTINCT event_type AS url FROM events")
def stream_dedup_bounded(spark, sf_dir):
    """Types stand for urls; the state forgets what is older than the watermark, which is beyond the table's span."""
    events = flows.stamped(flows.stream_of(spark, sf_dir, "events", flows.EVENTS)).select(F.col("event_type").alias("url"), "ts")
    return flows.drained(flows.unseen_urls(events, "3650 days"), "append")


# --- frontier, sinks and sources --------------------------------------------------------------------------------------

_CASH = """r{k} AS (SELECT node, sum(cash) AS cash FROM (
  SELECT dst AS node, cash / k AS cash FROM edges JOIN outs USING (src) JOIN r{p} ON node = src
  UNION ALL SELECT node, cash FROM r{p} WHERE node NOT IN (SELECT src FROM edges)
  UNION ALL SELECT DISTINCT dst, 1.0 FROM edges JOIN r{p} o ON o.node = src WHERE NOT EXISTS (FROM r{p} x WHERE x.node = dst AND x.node NOT IN (SELECT src FROM edges))) GROUP BY node)"""


@query(f"""WITH {_EDGES.replace("edges AS", "one AS").replace("FROM edges", "FROM one").replace("both_ways", "edges")}, outs AS (SELECT src, count(*) AS k FROM edges GROUP BY ALL),
r0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS cash FROM edges), {", ".join(_CASH.format(k=k, p=k - 1) for k in (1, 2, 3))},
ranked AS (SELECT node, round(cash, 6) AS cash FROM r3) SELECT node, cash FROM ranked ORDER BY cash DESC, node LIMIT 20""")
def opic_rounds(spark, sf_dir):
    """The richest after three rounds, the next to be crawled."""
    edges = _edges(spark, sf_dir)
    cash = crawl.crawl_rounds(edges, edges.select(F.col("src").alias("node"), F.lit(1.0).alias("cash")).distinct(), 3)
    return crawl.richest(cash.select("node", F.round("cash", 6).alias("cash")), 20)


@query(f"""WITH {_LINKS}, rules(host, kind, pattern) AS (SELECT * FROM (SELECT DISTINCT {_HOST} AS host FROM pages), (VALUES ('disallow', '^/.*?/[^?]*7[?]'), ('allow', '^/en/'))),
u AS (SELECT DISTINCT link AS url, {_HOST.replace("(url,", "(link,")} AS host, regexp_extract(split_part(link, '#', 1), '^[^:]*://[^/?#]*([^?]*)', 1) || '?' || split_part(split_part(link, '#', 1), '?', 2) AS path FROM links WHERE link NOT IN (SELECT url || '/' FROM pages)),
ok AS (SELECT url, any_value(host) AS host FROM u LEFT JOIN rules USING (host) GROUP BY url HAVING coalesce(bool_or(kind = 'allow' AND regexp_matches(path, pattern)), false) OR NOT coalesce(bool_or(kind = 'disallow' AND regexp_matches(path, pattern)), false))
SELECT url, host, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS turn FROM ok) WHERE turn <= 3""")
def frontier_pop(spark, sf_dir):
    """Seeds and links are pushed, what is seen or forbidden goes, and each host gives three urls in turns."""
    pages, path = table(spark, sf_dir, "pages"), store.fresh(spark, "frontier")
    links = crawl.extract_links(pages).select(F.col("link").alias("url"))
    for k in range(2):
        crawl.push(path, links.where(F.pmod(F.xxhash64("url"), F.lit(2)) == k), k)
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    kinds = spark.createDataFrame([("disallow", "^/.*?/[^?]*7[?]"), ("allow", "^/en/")], "kind string, pattern string")
    return crawl.pop(spark, path, pages.select(F.concat("url", F.lit("/")).alias("url")), hosts.crossJoin(F.broadcast(kinds)), 3)


@query("SELECT DISTINCT url FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def seen_exact(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return crawl.unseen(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0").select("url"))


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def json_ingest(spark, sf_dir):
    """Pages through JSON lines and back, as they come in over the wire."""
    path = store.fresh(spark, "json")
    pages = table(spark, sf_dir, "pages")
    tables.to_json_lines(pages.select(F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("url"), F.col("html").alias("document")), path)
    back = tables.read_pages_json(spark, path)
    return back.select(F.substring_index("url", " ", 1).cast("long").alias("page_id"), F.expr("substring(url, instr(url, ' ') + 1)").alias("url"), F.length("document").cast("long").alias("n_chars"))


@query(search_sql("that", tail="SELECT doc_id, round(score, 6) AS score FROM hits ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10"))
def cached_page(spark, sf_dir):
    """A query's hits, cached for twelve hours, and the second page of what the cache holds."""
    path = store.fresh(spark, "cache")
    hits = rounded(search.search(built(spark, sf_dir), "that"))
    tables.cache_results(hits, "that", 1_000, path)
    tables.cache_results(hits, "that", -1_000_000, path)  # long expired
    return search.page_of(tables.cached_results(spark, "that", 2_000, path, "doc_id bigint, score double"), 2)


@query("SELECT c_custkey, c_name, c_custkey % 10 = 0 AS replaced FROM customer WHERE c_custkey % 7 <> 0")
def table_changes(spark, sf_dir):
    """Rows inserted, replaced and deleted by key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(False).alias("replaced"))
    late = c.where("c_custkey % 10 = 0").withColumn("replaced", F.lit(True))
    there = admin.upserted(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 3 = 0"), "c_custkey")
    return admin.removed(admin.upserted(there, late, "c_custkey"), c.where("c_custkey % 7 = 0").select("c_custkey"), "c_custkey")


@query("SELECT s_suppkey, s_acctbal >= 0 AS alive FROM supplier")
def alive_with_dead(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return admin.with_dead(s.where("s_acctbal >= 0").select("s_suppkey"), s.where("s_acctbal < 0 OR s_acctbal IS NULL").select("s_suppkey"))


@query(f"SELECT page_id, page_id % 2 = 0 AS holds FROM pages")
def signature_check(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("key", F.when(F.col("page_id") % 2 == 0, web.hmac_hex(F.col("url"))).otherwise(F.lit("00")))
    return pages.select("page_id", web.signature_holds(F.col("url"), F.col("key")).alias("holds"))


@query("""SELECT page_id, '<p class="x">' || replace(replace(replace(replace(replace(url, '&', '&amp;'), chr(39), '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;') || '</p>' AS shown FROM pages""")
def escaped_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<p class="x">'), web.escaped(F.col("url")), F.lit("</p>")).alias("shown"))
