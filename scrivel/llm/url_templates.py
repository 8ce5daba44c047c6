"""URL filter: allow and block rules, and for the rest a path-template tree of each host.

Digits in a path become 0, and the distinct shapes of a host form a tree of segments, of any depth. From the root down,
level by level, each node's branches are generalised:

1. a branch stays named while its node has few branches or it holds a good share of the node's pages; the others become
   the wildcard *, so a node keeps at most MAX_BRANCHES + SHARE_ONE_IN + 1 branches;
2. statistically similar branches merge: of branches with MIN_PAGES pages each, those whose pages go on alike. For every
   continuation (next segment and number of segments left) the two relative frequencies may differ by no more than the
   Hoeffding bound of two samples, CONFIDENCE * (1/sqrt(n) + 1/sqrt(m)), nor by more than MAX_DIFFERENCE, and so may the
   blocked shares of their labelled pages. A branch joins the largest branch that it is similar to, and so on up;
3. the merged branches are the nodes of the next level. A node with fewer than MIN_PAGES pages says nothing, so what
   follows it is one open-ended wildcard; rounds end when no node is left, at whatever depth that is.

Pages carry no labels, so the urls that a rule decides are the labels. A template is rejected when it has MIN_PAGES
labelled pages or more and its smoothed purity (blocked + 1) / (labelled + 2) reaches PURITY_TENTHS; its pages without a
rule are blocked. Thus where a host's /es/ and /fr/ are blocked by rule and its /de/ is built just alike, /de/ goes too.

Edge cases: null urls and urls without :// have an empty host and path and no rule; they share the tree of the empty
host, which has no labels, so they are allowed. Repeated rows count and are returned as often as they stand there; an
empty table gives no rows; other columns are ignored. Only counts by shape meet in the tree; every level is a written
table. A shape with many pages is spread over tasks when verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, spread_join

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
MAX_BRANCHES, SHARE_ONE_IN, MIN_PAGES, PURITY_TENTHS = 8, 20, 5, 8
CONFIDENCE, MAX_DIFFERENCE = 1.36, 0.3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, said (the rule's verdict) and shape of every row."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    df = pages.select("page_id", rest.alias("rest")).withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), "^[^?#]*", 0)
    df = df.select("page_id", F.translate("raw", _UPPER, _UPPER.lower()).alias("host"), path.alias("path"))
    rule = said = F.lit(None).cast("string")
    # the longest rule is asked first, so it is built last
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, said = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return df.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), F.regexp_replace("path", "[0-9]+", "0").alias("shape"))


def _differ(f: Column, g: Column, n: Column, m: Column) -> Column:
    """True where two relative frequencies of n and m cases are too far apart to be of one kind."""
    return F.abs(f - g) > F.least(CONFIDENCE * (1 / F.sqrt(n) + 1 / F.sqrt(m)), F.lit(MAX_DIFFERENCE))


def _level(live: DataFrame, space: Workspace, k: int) -> DataFrame:
    """live with next_node: the node of level k that each row (node, segments, n, labelled, bad) goes on to."""
    rows = live.withColumns({
        "token": F.get("segments", F.lit(k)),
        "onward": F.concat(F.coalesce(F.get("segments", F.lit(k + 1)), F.lit("")), F.lit("/"), (F.size("segments") - k - 1).cast("string")),
    })
    branches = rows.groupBy("node", "token").agg(F.sum("n").alias("c"))
    nodes = branches.groupBy("node").agg(F.sum("c").alias("node_n"), F.count("*").alias("branches"))
    named = (F.col("branches") <= MAX_BRANCHES) | (F.col("c") * SHARE_ONE_IN >= F.col("node_n"))
    # = marks a segment, so that one that is called * is no wildcard
    kept = branches.join(nodes, "node").select("node", "token", F.when(named, F.concat(F.lit("="), "token")).otherwise("*").alias("branch"))
    rows = space.write(rows.join(kept, ["node", "token"]), f"rows{k}")
    sizes = space.write(rows.groupBy("node", "branch").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "labelled", "bad")]), f"sizes{k}")
    enough = sizes.where(F.col("n") >= MIN_PAGES)
    onward = rows.groupBy("node", "branch", "onward").agg(F.sum("n").alias("c"))
    shares = space.write(onward.join(enough.select("node", "branch", "n"), ["node", "branch"]).withColumn("f", F.col("c") / F.col("n")), f"shares{k}")
    # of each two branches of a node (at most MAX_BRANCHES + SHARE_ONE_IN + 1) the continuations of one, sought in the other
    other = enough.select("node", F.col("branch").alias("other"), F.col("n").alias("m"))
    sought = shares.join(other, "node").where("branch <> other")
    there = shares.select("node", F.col("branch").alias("other"), "onward", F.col("f").alias("g"))
    sought = sought.join(there, ["node", "other", "onward"], "left").where(_differ(F.col("f"), F.coalesce("g", F.lit(0.0)), F.col("n"), F.col("m")))
    unlike = sought.select("node", F.least("branch", "other").alias("one"), F.greatest("branch", "other").alias("two")).distinct()
    a, b = (enough.select("node", *[F.col(c).alias(f"{c}_{x}") for c in ("branch", "n", "labelled", "bad")]) for x in "ab")
    # b may join a: a has more pages, or as many and comes first
    pairs = a.join(b, "node").where((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("branch_a") < F.col("branch_b"))))
    both = (F.col("labelled_a") > 0) & (F.col("labelled_b") > 0)
    quarrel = both & _differ(F.col("bad_a") / F.col("labelled_a"), F.col("bad_b") / F.col("labelled_b"), F.col("labelled_a"), F.col("labelled_b"))
    pairs = pairs.where(~F.coalesce(quarrel, F.lit(False))).withColumns({"one": F.least("branch_a", "branch_b"), "two": F.greatest("branch_a", "branch_b")})
    pairs = pairs.join(unlike, ["node", "one", "two"], "left_anti")
    tops = pairs.groupBy("node", F.col("branch_b").alias("branch")).agg(F.min_by("branch_a", F.struct(-F.col("n_a"), "branch_a")).alias("top"))
    tops = sizes.select("node", "branch").join(tops, ["node", "branch"], "left").withColumn("top", F.coalesce("top", "branch"))
    # all branches of a node, a bounded number, in one map: "joins the larger" is followed to its end
    tops = tops.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("branch", "top"))).alias("up"))
    climbed = F.transform(F.map_keys("up"), lambda b: F.struct(b.alias("branch"), F.aggregate(F.sequence(F.lit(1), F.size("up")), b, lambda x, _: F.element_at("up", x)).alias("top")))
    tops = tops.select("node", climbed.alias("each"))
    members = lambda x: F.size(F.filter("each", lambda y: y["top"] == x["top"]))
    into = F.transform("each", lambda x: F.struct(x["branch"].alias("branch"), F.concat("node", F.lit("/"), F.when(members(x) > 1, F.concat(F.lit("~"), x["top"])).otherwise(x["top"])).alias("next_node")))
    into = tops.select("node", F.inline(into))
    return rows.join(into, ["node", "branch"])


def templates(shapes: DataFrame, space: Workspace) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) with the template that each belongs to."""
    segments = F.filter(F.split("shape", "/", -1), lambda _, i: i > 0)
    live = space.write(shapes.select("*", F.col("host").alias("node"), segments.alias("segments")), "live0")
    keys, done, k = ["host", "shape", "n", "labelled", "bad"], [], 0
    while live.limit(1).count():
        ends = F.size("segments") <= k
        done.append(space.write(live.where(ends).select(*keys, F.concat("node", F.lit("/")).alias("template")), f"ended{k}"))
        nodes = live.where(~ends).groupBy("node").agg(F.sum("n").alias("node_n"))
        going = live.where(~ends).join(nodes, "node")
        done.append(space.write(going.where(F.col("node_n") < MIN_PAGES).select(*keys, F.concat("node", F.lit("/**")).alias("template")), f"sparse{k}"))
        going = going.where(F.col("node_n") >= MIN_PAGES).select(*keys, "node", "segments")
        live = space.write(_level(going, space, k).select(*keys, F.col("next_node").alias("node"), "segments"), f"live{k + 1}")
        for name in (f"live{k}", f"rows{k}", f"sizes{k}", f"shares{k}"):
            space.drop(name)
        k += 1
    out = done[0] if done else live.select(*keys, F.col("node").alias("template"))
    for d in done[1:]:
        out = out.union(d)
    return out


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every row."""
    space = Workspace(pages.sparkSession, "urls")
    rows = parsed(pages.select("page_id", "url"), rules)
    counted = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("bad")
    )
    counted = space.write(counted, "shapes")
    named = space.write(templates(counted, space), "templates")
    rejected = named.groupBy("template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    rejected = rejected.where((F.col("l") >= MIN_PAGES) & (10 * (F.col("b") + 1) >= PURITY_TENTHS * (F.col("l") + 2))).select("template")
    refused = space.write(named.join(rejected, "template", "left_semi").select("host", "shape", F.lit(1).alias("hit")), "refused")
    counts = counted.select("host", "shape", F.col("n").alias("k"))
    judged = spread_join(rows, refused, ["host", "shape"], counts, "left")
    verdict = F.coalesce("said", F.when(F.col("hit") == 1, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: levels that the oracle below goes down; the given tables have three
_ORACLE_LEVELS = 8


def _oracle() -> str:
    """The same tree in DuckDB, written apart, unrolled to a number of levels that is beyond what the tables hold."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN ends_with('.' || host, '.{h}') AND starts_with(path, '{p}') THEN '{pick(h, p, v)}'" for h, p, v in rules) + " END"
    far = lambda f, g, n, m: f"abs({f} - {g}) > least({CONFIDENCE} * (1 / sqrt({n}) + 1 / sqrt({m})), {MAX_DIFFERENCE})"
    q = f"""WITH RECURSIVE a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said, regexp_replace(path, '[0-9]+', '0', 'g') AS shape FROM b),
live0 AS (SELECT host, shape, host AS node, string_split(shape, '/')[2:] AS seg, count(*) AS n, count(said) AS l, count(*) FILTER (said = 'block') AS b FROM c GROUP BY ALL)"""
    ends = []
    for k in range(_ORACLE_LEVELS):
        q += f""",
on{k} AS MATERIALIZED (SELECT *, seg[{k + 1}] AS tok, coalesce(seg[{k + 2}], '') || '/' || (len(seg) - {k + 1}) AS onward, sum(n) OVER (PARTITION BY node) AS nn FROM live{k} WHERE len(seg) > {k}),
tok{k} AS (SELECT node, tok, sum(n) AS c FROM on{k} WHERE nn >= {MIN_PAGES} GROUP BY ALL),
br{k} AS (SELECT node, tok, CASE WHEN count(*) OVER w <= {MAX_BRANCHES} OR {SHARE_ONE_IN} * c >= sum(c) OVER w THEN '=' || tok ELSE '*' END AS br FROM tok{k} WINDOW w AS (PARTITION BY node)),
r{k} AS MATERIALIZED (SELECT o.*, br FROM on{k} o JOIN br{k} USING (node, tok) WHERE nn >= {MIN_PAGES}),
s{k} AS MATERIALIZED (SELECT node, br, sum(n)::DOUBLE AS n, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b FROM r{k} GROUP BY ALL),
f{k} AS MATERIALIZED (SELECT r.node, r.br, onward, sum(r.n) / any_value(s.n) AS f FROM r{k} r JOIN s{k} s USING (node, br) GROUP BY ALL),
p{k} AS MATERIALIZED (SELECT x.node, x.br AS big, y.br AS small, x.n AS nx, y.n AS ny FROM s{k} x JOIN s{k} y ON x.node = y.node AND x.n >= {MIN_PAGES} AND y.n >= {MIN_PAGES} AND (x.n > y.n OR (x.n = y.n AND x.br < y.br))
  WHERE x.l = 0 OR y.l = 0 OR NOT {far("x.b / x.l", "y.b / y.l", "x.l", "y.l")}),
d{k} AS (SELECT p.node, p.big, p.small, o.onward, max(CASE WHEN o.br = p.big THEN f ELSE 0 END) AS f, max(CASE WHEN o.br = p.small THEN f ELSE 0 END) AS g, any_value(nx) AS nx, any_value(ny) AS ny
  FROM p{k} p JOIN f{k} o ON o.node = p.node AND o.br IN (p.big, p.small) GROUP BY ALL),
ok{k} AS (SELECT node, big, small, any_value(nx) AS nx FROM d{k} GROUP BY ALL HAVING NOT bool_or({far("f", "g", "nx", "ny")})),
up{k} AS (SELECT node, small AS br, arg_min(big, (-nx, big)) AS top FROM ok{k} GROUP BY ALL),
climb{k} AS (SELECT node, br, br AS top FROM s{k} UNION ALL SELECT c.node, c.br, u.top FROM climb{k} c JOIN up{k} u ON u.node = c.node AND u.br = c.top),
top{k} AS (SELECT c.node, c.br, c.top FROM climb{k} c WHERE NOT EXISTS (FROM up{k} u WHERE u.node = c.node AND u.br = c.top)),
named{k} AS (SELECT node, br, node || '/' || CASE WHEN count(*) OVER (PARTITION BY node, top) > 1 THEN '~' || top ELSE top END AS next FROM top{k}),
live{k + 1} AS (SELECT host, shape, next AS node, seg, n, l, b FROM r{k} JOIN named{k} USING (node, br))"""
        ends += [f"SELECT host, shape, node || '/' AS t, l, b FROM live{k} WHERE len(seg) <= {k}", f"SELECT host, shape, node || '/**', l, b FROM on{k} WHERE nn < {MIN_PAGES}"]
    q += f""",
t AS ({" UNION ALL ".join(ends)}),
bad AS (SELECT t FROM t GROUP BY t HAVING sum(l) >= {MIN_PAGES} AND 10 * (sum(b) + 1) >= {PURITY_TENTHS} * (sum(l) + 2)),
hit AS (SELECT host, shape FROM t WHERE t IN (FROM bad))
SELECT page_id, c.host, path, rule, coalesce(said, CASE WHEN h.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM c LEFT JOIN hit h ON c.host = h.host AND c.shape = h.shape"""
    return q


ORACLE_SQL = _oracle()
