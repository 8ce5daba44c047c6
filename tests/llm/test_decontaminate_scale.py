"""The automaton stays linear, and long items and clashing names change nothing."""

import random
import time

from pyspark.sql import functions as F

from scrivel.llm import decontaminate, quality_fm


def test_repetitive_items_build_in_linear_time():
    began = time.time()
    machine = decontaminate.Automaton([(1, [b"a"] * 100_000), (2, [b"a"] * 5), (3, ([b"a"] * 9 + [b"b"]) * 2_000)])
    ranges, found = machine.scan([b"x"] + [b"a"] * 20_000 + [b"c"] + [b"a"] * 4)
    assert time.time() - began < 20
    assert ranges == [(1, 20_001)] and found == {1, 2}


def test_scan_equals_brute_force_on_few_words():
    rng = random.Random(5)
    for _ in range(300):
        items = [(i, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))]) for i in range(5)]
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        hit, ids = set(), set()
        for i, x in items:
            n = min(4, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(words) - n + 1):
                    if words[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(i)
        ranges, found = decontaminate.Automaton(items, 4).scan(words)
        assert {j for s, e in ranges for j in range(s, e)} == hit and found == ids


def test_long_items_in_pieces_and_clashing_names(spark):
    rng = random.Random(6)
    long = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "three short words")], "item_id long, text string")
    rows = [(k, " ".join(["x"] * 5 + long[k * 40 : k * 40 + 10 + k] + ["y"] * 30), 5) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("_hits", "_ITEMS", "_n_words", "_fm_score")})
    blocks = list(decontaminate.item_blocks(bench, block_words=64))
    assert max(sum(len(w) for _, w in b) for b in blocks) <= 64 and len(blocks) > 10
    small = decontaminate.scan(docs, bench, block_words=64)
    assert {r.doc_id: r["_hits_"] for r in small.collect()} == {k: [5, 15 + k] for k in range(20)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and all(r.text.split() == ["x"] * 5 + ["y"] * 30 and r["_hits"] == "x" for r in kept.collect())
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    assert quality_fm.keep_good(docs, labels).columns == docs.columns


def test_training_rows_are_bounded_and_one_for_each_label(spark):
    docs = spark.createDataFrame([(k % 7, f"text number {k}", k) for k in range(70)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int")
    one, two = quality_fm.train(docs, labels), quality_fm.train(docs.repartition(5), labels)
    assert (one.w == two.w).all() and (one.v == two.v).all()
    idx, val = quality_fm.features(" ".join(f"word{i}" for i in range(20_000)), 5, {})
    few = quality_fm.strongest(idx, val)
    assert len(idx) > 4_096 == len(few[0]) and few[0][-1] == idx[-1]
