import random
from collections import defaultdict

from pyspark.sql import functions as F

from scrivel.operators import index, search


def made(spark, n=400):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(("abab", "ba", "aba", "x-y", "中国ab")) for _ in range(rng.randint(0, 4)))
    rows = [(i * 7 % 997, f"http://h{i % 3}.net/{i}", text(), text()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, url string, title string, body string")


def test_ranks_are_places_by_id(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 3), float(i)) for i in rng.sample(range(5000), 900)]
    hits = spark.createDataFrame(rows, "doc_id long, shard int, score double")
    order = sorted(i for i, _, _ in rows)
    assert {r.doc_id: r["rank"] for r in search.ranked(hits).collect()} == {d: k + 1 for k, d in enumerate(order)}
    shards = defaultdict(list)
    for i, s, _ in sorted(rows):
        shards[s].append(i)
    got = {(r.shard, r.doc_id): r["rank"] for r in search.ranked(hits, "shard").collect()}
    assert got == {(s, d): k + 1 for s, ids in shards.items() for k, d in enumerate(ids)}
    assert search.ranked(hits.where("false")).count() == 0


def test_compat_and_cuts_without_one_task_that_holds_all_hits(spark):
    rows, docs = made(spark)
    hits = {k: {d for d, _, t, b in rows if k in t or k in b} for k in ("ab", "ba")}
    got = search.search(docs, "ab ba", compat_and=True)
    assert {r.doc_id for r in got.collect()} == set(sorted(hits["ba"])[: len(hits["ab"] & hits["ba"])])
    plan = got._jdf.queryExecution().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan  # all of the last keyword's hits were sorted and cut in one task
    sharded = docs.withColumn("shard", F.col("doc_id") % 3)
    by = search.search(search.index_of(sharded), "ab ba", by=("shard",), compat_and=True)
    want = set()
    for s in range(3):
        a, b = ({d for d in hits[k] if d % 3 == s} for k in ("ab", "ba"))
        want |= set(sorted(b)[: len(a & b)])
    assert {r.doc_id for r in by.collect()} == want
