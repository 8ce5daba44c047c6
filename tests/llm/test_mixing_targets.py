"""What the mix takes against the targets, and the draw of its shards."""

from collections import Counter

import pytest

from scrivel.llm import mixing
from scrivel.llm.common import Workspace

DOC = "doc_id long, text string, source string"


@pytest.mark.parametrize("sizes", [{"a": [20], "b": [20], "c": [20]}, {"a": [1000, 7, 300], "b": [128] * 9, "c": [1, 1, 1], None: [129, 127, 5]}, {"a": [3000], "b": [2]}, {"x": [128, 128]}])
def test_every_source_meets_its_target(spark, sizes):
    rows, k = [], 0
    for source, docs in sizes.items():
        for n in docs:
            rows.append((k, " ".join(f"w{k}_{i}" for i in range(n)), source))
            k += 1
    docs = spark.createDataFrame(rows, DOC)
    source = {r[0]: r[2] for r in rows}
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes), (taken, target)
    # every word comes from its own source, as often as counted
    mixed = mixing.shards(docs).collect()
    words = Counter(source[int(w[1:].split("_")[0])] for r in mixed for w in r.text.split())
    assert words == taken


def test_shards_hold_what_was_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 6)
    docs = spark.createDataFrame([(i, "word " * (40 + i), "abc"[i % 3]) for i in range(60)], DOC)
    sources = Workspace(spark, "t").write(mixing.targets(mixing.counted(docs)), "sources")
    drawn = {(r.shard, r.source_no): r.slots for r in mixing.shard_counts(sources).collect()}
    assert Counter((r.shard, r.source_no) for r in mixing.shards(docs).collect()) == drawn
    assert len({s for s, _ in drawn}) > 3
    # another draw, another mix
    monkeypatch.setattr(mixing, "SEED", mixing.SEED + 40)
    assert {(r.shard, r.source_no): r.slots for r in mixing.shard_counts(sources).collect()} != drawn
