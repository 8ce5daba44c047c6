"""Buckets of a few suffixes, and a gram and a passage in very many contexts: boundaries lose no match."""

import random
from bisect import bisect_right
from collections import Counter

import pytest

from scrivel.llm import suffix_dedup

DOC = "doc_id long, text string"


def removed(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    out = []
    for (k, _), x in zip(rows, raw):
        m = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        out.append((k, len(x), sum(m)))
    return Counter(out)


@pytest.mark.parametrize("sort_rows", [2, 7, 40, 30_000])
def test_small_buckets_equal_brute_force(spark, sort_rows):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two, three = word(150), word(230), word(700)
    rows = [(k, word(rng.randint(0, 400)) + rng.choice([one, two, three, two[:205], three[100:450], one + two]) + word(rng.randint(0, 300))) for k in range(120)]
    rows += [(500, "ab" * 700), (501, "x" * 1200), (502, None), (503, three * 3)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, DOC), sort_rows).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got) == removed(rows)


def test_hot_gram_is_split(spark):
    """A passage shorter than a window in many unlike contexts, and a longer one: one gram each, many buckets."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    short, long = word(120), word(260)
    rows = [(k, word(210) + (short if k % 3 else long) + word(210)) for k in range(6_000)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, DOC).repartition(4), 500).collect()
    assert {(r.n_removed >= 260) == (r.doc_id % 3 == 0) for r in got} == {True}
    assert all(r.n_removed == 0 for r in got if r.doc_id % 3)


def test_splitters_part_the_suffixes(spark):
    rows = [(bytes([k % 251, k % 7, k % 13]) * 20, bytes([k % 5])) for k in range(5_000)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in rows], "suffix binary, ahead binary")
    parts = suffix_dedup.splitters(df, 500)
    assert parts == sorted(parts) and 5 <= len(parts) <= 10
    assert max(Counter(bisect_right(parts, r) for r in rows).values()) < 2_000
