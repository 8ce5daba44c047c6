import math
import random
import re

from pyspark.sql import functions as F

from scrivel.operators import highlight, index, search
from scrivel.operators.search import parse_query, query_tokens


def brute_score(docs, keyword, site=""):
    tokens = query_tokens(keyword)
    find = lambda s, t: [i for i in range(len(s)) if s[i : i + 2] == t]
    out = {}
    for i, url, title, body in docs:
        tf = {t: len(find(title, t)) + len(find(body, t)) for t, _ in tokens}
        if not tokens or 0 in tf.values():
            continue
        base = sum((1 + math.log(n)) * math.log(len(docs) / sum(t in d[2] or t in d[3] for d in docs)) for t, n in tf.items())
        score = 0.0
        for s, weight in ((title, 3), (body, 1)):
            k = sum(all(o + b >= 0 and s[o + b : o + b + 2] == t for t, b in tokens) for o in range(-len(keyword), len(s)))
            score += base * weight * (3 + math.log(k) if k else 1)
        host = re.sub(":[^:]*$", "", re.sub(r"^\w+://([^/]*).*", r"\1", url))
        if host.endswith(site):
            out[i] = score
    return out


def corpus(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab1é-中国") for _ in range(rng.randint(1, 7)))
    rows = [(i, f"http://h{i % 3}.example.com:80/{i}", " ".join(word() for _ in range(2)), " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, url string, title string, body string")


def test_scores_match_brute_force(spark):
    rows, docs = corpus(spark)
    for keyword in ("ab", "aaaa", "aba", "a中国", "ab-1a", "x", "é"):
        got = {r.doc_id: r.score for r in search.search(docs, keyword).collect()}
        want = brute_score(rows, keyword)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want), keyword


def test_and_not_site(spark):
    rows, docs = corpus(spark)
    a, b, x = (brute_score(rows, k, "1.example.com") for k in ("ab", "ba", "中国"))
    got = {r.doc_id for r in search.search(docs, "ab ba -中国 -q site:1.example.com").collect()}
    assert got == (a.keys() & b.keys()) - x.keys()
    assert search.search(docs, "-ab").count() == 0 == search.search(docs, "ab z").count()
    compat = {r.doc_id: r.score for r in search.search(docs, "ab ba", compat_and=True).collect()}
    a, b = brute_score(rows, "ab"), brute_score(rows, "ba")
    assert compat.keys() == set(sorted(b)[: len(a.keys() & b.keys())])


def test_query_parts():
    q = parse_query("a  -b site: site:x site:y - --c")
    assert (q.keywords, q.exclusions, q.site) == (["a"], ["b", "-c"], "x")


def brute_spans(positions):
    out = []
    for p in sorted(positions):
        if out and p - out[-1][1] <= 1:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    if not out:
        return []
    best = max(out, key=lambda s: s[1] - s[0])
    return out if best[1] - best[0] + 1 > 100 else [best]


def test_highlight(spark):
    texts = ["xx ab yy abab z", "ab" * 70 + " q ab", "none", "", "y" * 300 + "ab" + "z" * 300, "ab" + "-" * 200, "ab" * 50 + "a", "ab " * 60]
    rows = [(i, "u", t, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, title string, body string")
    for r in highlight.highlighted(docs, "ab").collect():
        t = texts[r.doc_id]
        want = brute_spans([i for i in range(len(t)) if t[i : i + 2] == "ab"])
        assert [list(x) for x in r.body_spans] == want
        plain = r.abstract.replace(highlight.OPEN, "").replace(highlight.CLOSE, "")
        assert plain in t and r.title_marked.replace(highlight.OPEN, "").replace(highlight.CLOSE, "") == t
        assert r.abstract.count(highlight.OPEN) == len(want) and (want or plain == t[:100])


def test_index_agrees_with_containment(spark, tmp_path):
    rows, docs = corpus(spark)
    stats = {r.token: r.document_count for r in index.token_stats(docs).collect()}
    assert all(n == sum(t in d[2] or t in d[3] for d in rows) for t, n in stats.items())
    halves = index.merge_stats(*[index.token_stats(docs.where(F.col("doc_id") % 2 == k)) for k in (0, 1)])
    assert {r.token: r.document_count for r in halves.collect()} == stats
    path = f"file://{tmp_path}/i"
    index.save_index(docs.where("doc_id < 30"), path, 2)
    for _ in range(2):  # a batch that is retried replaces itself
        index.append_index(docs.where("doc_id >= 30"), path, batch=7)
    found = index.lookup(spark, path, ["ab"])
    assert {r.doc_id for r in found.collect()} == {d[0] for d in rows if "ab" in d[2] or "ab" in d[3]}
    whole = index.open_index(spark, path)
    assert {r.token: r.document_count for r in whole.stats.collect()} == stats
    size = index.index_size(whole).first()
    assert (size.n_docs, size.n_tokens, size.n_postings) == (60, len(stats), sum(stats.values()))
    # a saved index answers as one that is made on the fly, and its scan filters tokens
    for text in ("ab ba -中国", "aba", "ab site:1.example.com"):
        one, two = (sorted((r.doc_id, round(r.score, 9)) for r in search.search(x, text).collect()) for x in (whole, docs))
        assert one == two
    plan = search.search(whole, "aba")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(token, [ab,ba])]" in plan and plan.count("FileScan") == 1


def test_pages_and_shards(spark):
    hits = spark.createDataFrame([(i, float(i % 7)) for i in range(80)], "doc_id long, score double")
    first = search.first_hits(hits)
    assert {r.doc_id for r in first.collect()} == set(range(50))
    page = [r.doc_id for r in search.page_of(first, 2).collect()]
    assert page == [i for _, i in sorted((-(i % 7), i) for i in range(50))][10:20]
    assert search.page_of(first, 11).count() == 0
