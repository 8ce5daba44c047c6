"""Crowded buckets, recall at the threshold, and the texts that are fetched."""

import random
from collections import Counter

import pytest

from scrivel.llm import minhash

DOC = "doc_id long, text string"


def brute(rows, k):
    """component_id by comparing all texts that share a shingle."""
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, t in rows if (w := t.lower().split())}
    where, at = {}, {i: i for i, _ in rows}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                at[b] = a
    return {i: top(i) for i, _ in rows}


def family(rng, n, shared, own):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(shared)]
    return [" ".join(base + [word() for _ in range(own)]) for _ in range(n)]


@pytest.mark.parametrize("bucket", [1, 3, 128])
def test_crowded_buckets_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    rng = random.Random(4)
    texts = [t for shared, own in ((40, 9), (40, 4), (60, 30), (80, 10)) for t in family(rng, 40, shared, own)]
    texts += [" ".join(w if rng.random() > 0.04 else "zz" for w in t.split()) for t in texts[::3]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC), 2).collect()}
    assert got == brute(rows, 2)
    assert len(set(got.values())) > 20


def test_a_band_shared_by_very_many_unlike_texts(spark, monkeypatch):
    """All share half their words; prefixes give next to no pairs, where the buckets would give hundreds of thousands."""
    rng = random.Random(7)
    texts = family(rng, 4_000, 24, 12)
    seen = []
    plain = minhash.verified

    def counting(pairs, *rest):
        seen.append(pairs.distinct().count())
        return plain(pairs, *rest)

    monkeypatch.setattr(minhash, "verified", counting)
    rows = [*enumerate(texts), (9_000, texts[5] + " end"), (9_001, texts[7])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC), 2).collect()}
    assert {i: c for i, c in got.items() if i != c} == {9_000: 5, 9_001: 7}
    assert seen[0] < 33 * len(rows) and seen[1] < len(rows), seen


def test_recall_at_the_threshold(spark):
    rng = random.Random(9)
    rows, pairs = [], 0
    for i in range(0, 600, 2):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.randint(60, 200))]
        other, own = list(words), {tuple(words[j : j + 2]) for j in range(len(words) - 1)}
        for j in rng.sample(range(len(words)), len(words)):
            new = other[:j] + ["q%d" % j] + other[j + 1 :]
            s = {tuple(new[x : x + 2]) for x in range(len(new) - 1)}
            if 100 * len(own & s) < 80 * len(own | s):
                break
            other = new
        pairs += 1
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC), 2).collect()}
    assert sum(got[i + 1] == i for i in range(0, 600, 2)) == pairs


def test_one_row_of_each_group_stays(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (1, t), (None, t), (2, t + " x"), (None, "other words entirely here now"), (None, "other words entirely here now"), (None, None), (3, ""), (3, "")]
    kept = minhash.without_copies(spark.createDataFrame(rows, DOC), 2).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, t), (None, "other words entirely here now"), (None, None), (3, ""), (3, "")])
