from pyspark.sql import functions as F

from scrivel.functions import codec, web
from scrivel.functions.text import bigram_positions, bigrams, host_of, parse_documents
from scrivel.operators import admin, crawl


def test_page_is_parsed(spark):
    html = '<html><title lang="x">==title==\n</title><style>p{}</style><div>text1 <span>text2</span> text3</div><script>var a;</script>'
    rows = spark.createDataFrame([(1, "u", html), (2, "u", "<p>no title</p>")], "page_id long, url string, html string")
    got = parse_documents(rows).collect()
    assert [(r.doc_id, r.title, r.body) for r in got] == [(1, "==title==", "text1 text2 text3")]


def test_bigrams_have_code_point_offsets(spark):
    s = "hello,你好，world.世界。😀ab"
    row = spark.createDataFrame([(s,), ("",), ("a",), ("é1",)], "s string").select(bigrams(F.col("s")).alias("b"), bigram_positions(F.col("s")).alias("p")).collect()
    want = [("he", 0), ("el", 1), ("ll", 2), ("lo", 3), ("你好", 6), ("wo", 9), ("or", 10), ("rl", 11), ("ld", 12), ("世界", 15), ("ab", 19)]
    assert [tuple(x) for x in row[0].p] == want and row[0].b == [t for t, _ in want]
    assert all(r.b == [] and r.p == [] for r in row[1:])


def test_hosts(spark):
    urls = ["http://a_b.example.com:80/x?y", "https://u:p@h.org#f", "nothing", "ftp://x"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in rows] == ["a_b.example.com", "h.org", "", "x"]


def test_codec_round_trip_and_merge():
    p = [(5, 0, [1, 2, 3]), (6, 1, [4, 6, 8]), (-7, 0, []), (1 << 40, 2, [0, 127, 128, 1 << 33])]
    assert codec.decode_postings(codec.encode_postings(p)) == p
    a, b = [(5, 0, [1]), (6, 0, [1]), (7, 0, [1])], [(0, 0, [1]), (1, 0, [1]), (2, 0, [1])]
    assert [x[0] for x in codec.merge_postings(a, b)] == [0, 1, 2, 5, 6, 7]


BASE = "http://base.com/a/b?p=x"


def test_addresses():
    assert web.address(BASE, "jAvascript:x()") is None
    assert web.address(BASE, "data:text/html;xx") is None
    assert web.address(BASE, "data:image/jpeg;xx") == "data:image/jpeg;xx"
    assert web.address(BASE, "#top") == "#top"
    got = web.address(BASE, "/c?id=2#frag")
    assert got.startswith("/proxy?url=http%3A%2F%2Fbase.com%2Fc%3Fid%3D2&key=") and got.endswith("#frag")


def test_signed_address_matches_the_function(spark):
    urls = ["http://test.com/a/b?id=1", "http://x.org/ü#f", "http://x.org/a b"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", web.signed_address(F.col("u")).alias("a")).collect()
    assert all(r.a == web.address("", r.u) for r in rows)


def test_css_and_tags():
    css = web.clean_css(BASE, "x{a:url('/i.png')}y{b:url(javascript:z)}")
    assert "url('/proxy?url=http%3A%2F%2Fbase.com%2Fi.png&key=" in css and "url(javascript:z)" in css
    assert web.clean_attributes(BASE, [("src", "/s"), ("id", "id1"), ("onclick", "x")]).endswith('  id="id1" ')
    assert web.clean_link(BASE, [("rel", "not_safe")]) == web.clean_link(BASE, [("as", "script")]) == ""
    assert web.clean_link(BASE, [("rel", "stylesheet"), ("src", "/s")]).startswith('<link rel="stylesheet"  src="/proxy?url=')
    assert web.clean_meta(BASE, [("charset", "utf-8")]) == "" == web.clean_meta(BASE, [("http-equiv", "set-cookie")])
    assert 'content="3; url=/proxy?url=http%3A%2F%2Fbase.com%2Fnext' in web.clean_meta(BASE, [("http-equiv", "Refresh"), ("content", "3; url='/next'")])


def test_html_is_cleaned():
    out = web.clean_html(BASE, "<!DOCTYPE html><body onload='x'><script>bad()</script><noscript><b>hi</b></noscript><a href='/n'>n&amp;m</a><svg><p>in</p></svg><form action='/go'></form>")
    assert "bad" not in out and "onload" not in out and "<b>hi</b>" in out and "n&amp;m" in out and ">in<" not in out
    assert 'name="url" value="http://base.com/go"' in out


def test_robots():
    import re

    hit = lambda rule, path: bool(re.search(crawl.robots_regex(rule), path))
    assert hit("/a", "/ab?") and not hit("/a", "/b?") and hit("/a?$", "/a?") and not hit("/a?$", "/a?x")
    assert hit("x*.gif", "/q/x/1.gif?") and hit("/a*b$", "/a/c/b") and not hit("/a*b$", "/a/b/c")
    txt = "Disallow: /early\nUser-agent: other\nDisallow: /o\nUser-agent: *\nDisallow:\nAllow: /x\nnonsense"
    assert crawl.parse_robots(txt, "me") == [("disallow", "/early"), ("allow", "/x")]


def test_polynomial_hash_wraps_around(spark):
    urls = ["", "http://www.example.com/a/long/enough/path?to=wrap", "é中😀"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", *[crawl.polynomial_hash(F.col("u"), k).cast("string").alias(str(k)) for k in crawl.SEEDS]).collect()
    for r in rows:
        for k in crawl.SEEDS:
            h = 0
            for c in r.u:
                h = (h * k + ord(c)) % 2**64
            h = h - 2**64 if h >= 2**63 else h
            assert int(r[str(k)]) == abs(h)


def test_bloom_has_no_false_negatives(spark):
    seen = spark.createDataFrame([(f"http://s{i}.com",) for i in range(50)], "url string")
    asked = seen.union(spark.createDataFrame([(f"{i * 61}base",) for i in range(50)], "url string"))
    new = {r.url for r in crawl.bloom_unseen(asked, crawl.bloom_filter(seen, 1 << 16), 1 << 16).collect()}
    assert not any(u.startswith("http") for u in new) and len(new) > 45


def test_admin(spark):
    row = admin.config_row(spark.createDataFrame([("a", "7"), ("b", "T"), ("c", "zz")], "name string, value string"), {"a": 1, "b": False, "c": 3, "d": "x"}).first()
    assert row.asDict() == {"a": 7, "b": True, "c": 3, "d": "x"}
    beats = spark.createDataFrame([("x", 10), ("x", 50), ("y", 5)], "addr string, ts long")
    assert {r.addr: r.alive for r in admin.liveness(beats, 60).collect()} == {"x": True, "y": False}
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, admin.upserted(t, spark.createDataFrame([(2, "z"), (3, "c")], "k long, v string"), "k").collect())) == [(1, "a"), (2, "z"), (3, "c")]
    u = spark.createDataFrame([("admin", None)], "username string, password string").withColumn("password", F.sha2(F.lit("pws").cast("binary"), 256))
    assert admin.login_ok(u, "admin", "pw", "s").first().ok and not admin.login_ok(u, "admin", "no", "s").first().ok
