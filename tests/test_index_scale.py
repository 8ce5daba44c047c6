import random
import re

from pyspark.sql import functions as F

from scrivel.functions.text import body_of
from scrivel.operators import index, search


def brute_postings(rows):
    out = {}
    for i, title, body in rows:
        for field, s in enumerate((title, body)):
            for m in re.finditer("(?=([A-Za-z0-9一-龥]{2}))", s or ""):
                out.setdefault((m[1], i), ([], []))[field].append(m.start())
    return {k: tuple(map(sorted, v)) for k, v in out.items()}


def some_text(rng):
    return None if rng.random() < 0.1 else "".join(rng.choice("abz1AZ09é-中国一龥龦䷿\U00020000 \n") for _ in range(rng.randint(0, 60)))


def test_postings_are_made_where_the_texts_are(spark):
    rng = random.Random(5)
    rows = [(i, some_text(rng), some_text(rng)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    made = index.postings(docs)
    got = made.collect()
    assert len(got) == len({(r.token, r.doc_id) for r in got})
    assert {(r.token, r.doc_id): (r.title_pos, r.body_pos) for r in got} == brute_postings(rows)
    assert "Exchange" not in made._jdf.queryExecution().toString()  # positions of all documents were shuffled and gathered


def test_documents_that_share_an_id(spark, tmp_path):
    rows = [(1, "ab", "ab cd"), (1, "", "xx ab"), (2, "q", "ab"), (None, "ab", "b"), (None, "b", "ab")]
    docs = spark.createDataFrame([(i, "u", t, b) for i, t, b in rows], "doc_id long, url string, title string, body string")
    got = {(r.token, r.doc_id): (r.title_pos, r.body_pos) for r in index.postings(docs).collect()}
    assert got == brute_postings(rows)
    index.save_index(docs, f"file://{tmp_path}/i", 3)
    assert search.search(index.open_index(spark, f"file://{tmp_path}/i"), "ab").count() == 3


def test_bodies_are_those_of_the_plain_patterns(spark):
    rng = random.Random(6)
    parts = ["<", ">", "<!--", "-->", "<script", "</script>", "<STYLE", "</style>", "<title>", "</Title>", "<p a='b'>", " ", "  ", "\n", "\t\r", " ", " ", "x", "é中", "&amp;"]
    pages = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))),) for _ in range(4000)]
    html = F.col("html")
    markup = r"(?is)<!--.*?-->|<script.*?>.*?</script>|<style.*?>.*?</style>|<title.*?>.*?</title>|<.+?>"
    edges = r"^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, markup, " "), r"[\t\n\f\r ]+", " "), edges, "")
    rows = spark.createDataFrame(pages, "html string").select(html, body_of(html).alias("got"), plain.alias("want"))
    assert not [r for r in rows.collect() if r.got != r.want]
