import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from scrivel.functions.text import EDGE, trimmed
from scrivel.operators import index

COLUMNS = "doc_id long, url string, title string, body string"


def test_a_block_holds_what_many_documents_have_of_a_token(spark, tmp_path):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice(("ab", "ba", " ", "中国", "é", "x" + " " * rng.choice((1, 300, 20000)))) for _ in range(rng.randint(0, 30)))
    rows = [(i * 3 if i % 50 else None, "u", text() if i % 3 else None, text()) for i in range(400)]  # eight share the null id
    docs = spark.createDataFrame(rows, COLUMNS)
    index.save_index(docs, f"file://{tmp_path}/i", 2)
    found = index.open_index(spark, f"file://{tmp_path}/i")
    posts = lambda p: sorted(((r.token, str(r.doc_id), r.title_pos, r.body_pos) for r in p.collect()))
    want = posts(index.postings(docs))
    assert posts(found.postings) == want
    stats = {r.token: (r.document_count, r.positions_count) for r in found.stats.collect()}
    assert sum(d for d, _ in stats.values()) == len(want) and sum(n for _, n in stats.values()) == sum(len(t) + len(b) for _, _, t, b in want)
    written = sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/i/postings/*.parquet"))
    assert written < len(want) / 10  # there was a row for each token of each document, with its own lists


def test_texts_without_edges_are_not_matched_again(spark):
    rng = random.Random(12)
    texts = [("".join(rng.choice(" ab\t\n  \u0085é中　\U00020000") for _ in range(rng.randint(0, 6))),) for _ in range(3000)] + [(None,)]
    s = F.col("s")
    rows = spark.createDataFrame(texts, "s string").select(s, trimmed(s).alias("got"), F.regexp_extract(s, f"(?s)^[{EDGE}]*(.*[^{EDGE}])", 1).alias("want"))
    assert not [r for r in rows.collect() if r.got != r.want]
