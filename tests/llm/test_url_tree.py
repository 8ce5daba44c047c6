"""The path-template tree decides urls that no rule does; answers worked out by hand, and the SQL written apart."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from scrivel.llm import url_templates


def verdicts(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = pages.withColumns({c: F.lit("x") for c in ("_hot", "_salt", "node", "n", "hit", "host", "template")})
    got = url_templates.filter_urls(pages).collect()
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = con.sql(url_templates.ORACLE_SQL).fetchall()
    assert Counter(map(tuple, got)) == Counter(want)
    return {urls[r.page_id]: r.verdict for r in got}


def test_branches_built_alike_share_their_verdict(spark):
    alike = [f"http://a.net/{lang}/{i}{'.html' if i % 3 == 0 else ''}" for lang in ("es", "fr", "de", "it") for i in range(30)]
    unlike = [f"http://a.net/blog/{i}/c/{i}" for i in range(30)]
    free = [f"http://b.org/{lang}/{i}" for lang in ("es", "de") for i in range(30)]
    got = verdicts(spark, alike + unlike + free)
    assert {got[u] for u in alike} == {"block"}  # 60 blocked of 60 labelled in one template
    assert {got[u] for u in unlike + free} == {"allow"}


def test_branches_whose_labels_quarrel_stay_apart(spark):
    urls = [f"http://x.example.com/{lang}/{i}" for lang in ("en", "de", "fr") for i in range(40)]
    assert {u: v for u, v in verdicts(spark, urls).items() if v == "block"} == {u: "block" for u in urls if "/en/" in u}


@pytest.mark.parametrize("depth", [1, 4])
def test_templates_reach_any_depth(spark, depth):
    deep = "/".join(f"d{i}" for i in range(depth))
    # two hosts: rules label /es/; below it nothing is shared, beside it the deep branch is alone and stays
    urls = [f"http://c.net/es/{deep}/{i}" for i in range(20)] + [f"http://c.net/de/{deep}/{i}" for i in range(20)] + [f"http://c.net/de/{deep}x/{'y/' * i}" for i in range(3)]
    got = verdicts(spark, urls)
    assert all(got[u] == "block" for u in urls if "/es/" in u)
    assert all(got[u] == "block" for u in urls if u.startswith(f"http://c.net/de/{deep}/"))  # merged with /es/ at the top


def test_deeper_than_the_oracle_goes(spark):
    deep = "/".join("abcdefghijkl")
    urls = [f"http://c.net/{lang}/{deep}/{i}" for lang in ("es", "de") for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.verdict for r in url_templates.filter_urls(pages).collect()} == {"block"}


def test_rare_segments_become_a_wildcard(spark):
    names = [f"http://d.net/{'es' if i % 2 else 'u' + chr(97 + i % 26) * (1 + i // 26)}/p/{i}" for i in range(400)]
    got = verdicts(spark, names)
    assert {got[u] for u in names if "/es/" in u} == {"block"} and {got[u] for u in names if "/es/" not in u} == {"block"}
    few = [f"http://e.net/es/{i}" for i in range(3)] + [f"http://e.net/de/{i}" for i in range(50)]
    got = verdicts(spark, few)
    assert [got[u] for u in few] == ["block"] * 3 + ["allow"] * 50  # three labelled pages say nothing about the others
