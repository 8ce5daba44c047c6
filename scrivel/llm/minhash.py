"""Near-duplicates: many hash minima with banding, signature verification, exact verification, connected components.

1. Each text gives its set of word shingles as 64-bit hashes, a 128-bit digest of the sorted set, PERMUTATIONS minima and
   BANDS band keys. Equal sets share a digest and are one class from there on, however many rows hold them.
2. Classes that share a band key are candidates. A bucket first links each member with the smallest one only. Pairs are
   verified on signatures (MIN_AGREE of the minima), and texts are fetched only for those that agree, to compare full sets.
3. Components of the verified links. Pairs inside a component are never needed, so a group of copies costs as many pairs
   as it has members. A bucket whose members are then still in several components is searched once more:
   a. one of at most BUCKET members gives the pairs between members of different components;
   b. members of larger ones, unlike texts with some words in common, are joined by prefix filtering, which is exact: two
      sets of similarity 0.8 share one of the rarest fifth of their shingles, rare among all such members, and in places
      that leave room for the rest. What all of them have in common is frequent, so it is in no prefix of a text that
      has a fifth of its own.
   These pairs are verified likewise, so that no link between components is lost.
4. A band key, a hub or a shingle with a good share of all rows is spread over tasks for the joins.

With 32 bands of 4, a pair of similarity 0.8 is missed with a probability of (1 - 0.8^4)^32, 5 in 10^8; agreement of 128
minima falls below 72 with less than 1 in 10^8.

Edge cases: null and empty texts have an empty set, n_shingles 0 and are linked with nothing, not even with each other;
rows with equal doc_id but different texts are different nodes that share an id; a null id never is a component's id
unless all its ids are null; repeated rows are all kept when their id is the component's; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, batch_of, freed, map_rows, spread_join, unused
from scrivel.llm.components import connected_components

PERMUTATIONS, BANDS = 128, 32
ROWS = PERMUTATIONS // BANDS
MIN_AGREE = 72
#: members of a bucket that are paired with each other; larger buckets are searched by prefixes
BUCKET = 128
#: row numbers that are broadcast at most, 8 bytes each
MOST_SENT = 1_000_000

_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], k: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    get, ids = known.get, []
    for w in words:
        h = get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    h = np.array(ids, np.uint64)
    n = max(len(h) - k + 1, 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = _mixed(out * _MIX + h[i : i + n])
    if len(words) < k:
        out = _mixed(out + np.uint64(len(words)))
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of the permutations (a x + b mod 2^32 over mixed hashes)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        part = x[at : at + 512, None] * _A
        part += _B
        np.minimum(low, part.min(0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        out = _mixed(out * _MIX + rows[:, i])
    return out.view(np.int64)


_FEATURES = "rid long, doc_id long, n long, c1 long, c2 long, sig binary, bands array<long>, packed binary"


def features(docs: DataFrame, k: int, rid: str | None = None) -> DataFrame:
    """A row for each document: set size, digest, signature, band keys and the packed text. rid tells rows apart."""
    known: dict[bytes, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column("text").to_pylist():
            s = shingle_set(words_of(text), k, known)
            d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            # sets of fewer than 4 shingles reach 0.8 only with an equal set, and those share a class
            sig = signature(s) if len(s) > 3 else None
            for c, v in zip(cols, (len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), sig if sig is None else sig.tobytes(), None if sig is None else band_keys(sig), None if sig is None else pack(text.encode("utf-8", "surrogatepass")))):
                c.append(v)
        return batch_of(_FEATURES, [batch.column("rid"), batch.column("doc_id"), *cols])

    return map_rows(docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), "doc_id", "text"), run, _FEATURES)


def verified(pairs: DataFrame, feats: DataFrame, space: Workspace, name: str, k: int, percent: int) -> DataFrame:
    """The distinct pairs (u, v) of class nodes whose signatures agree and whose full sets reach the similarity; written."""
    pairs = space.write(pairs.select("u", "v").distinct(), f"{name}-pairs")
    hubs = space.write(pairs.groupBy("v").agg(F.count("*").alias("k")).where("k > 1").hint("rebalance"), f"{name}-hubs")

    def with_sides(df: DataFrame, column: str) -> DataFrame:
        side = feats.select("rid", column)
        return spread_join(df.join(side.toDF("u", f"{column}_u"), "u"), side.toDF("v", f"{column}_v"), ["v"], hubs)

    def agree(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for c in ("sig_u", "sig_v"))
        return batch.select(["u", "v"]).filter(pa.array((one == two).sum(1) >= MIN_AGREE))

    known: dict[bytes, int] = {}

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        sets = lambda z: shingle_set(unpack(z).lower().split(), k, known)
        us, vs, last, two = [], [], None, None
        for u, v, tu, tv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "packed_u", "packed_v"))):
            if last != v:
                last, two = v, sets(tv)
            one = sets(tu)
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= percent * (len(one) + len(two) - both):
                us.append(u)
                vs.append(v)
        return batch_of("u long, v long", [us, vs])

    near = space.write(map_rows(with_sides(pairs, "sig"), agree, "u long, v long"), f"{name}-near")
    links = space.write(map_rows(with_sides(near, "packed"), compare, "u long, v long"), f"{name}-links")
    for part in ("pairs", "near", "hubs"):
        space.drop(f"{name}-{part}")
    return links


def _near_in_size(percent: int):
    return (F.col("nu") * percent <= F.col("nv") * 100) & (F.col("nv") * percent <= F.col("nu") * 100)


def _sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The rows (node, n, root, and more columns) twice, as u and as v."""
    return tuple(rows.select(*more, F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), *([F.col("place").alias(f"p{x}")] if "place" in rows.columns else [])) for x in "uv")


def prefix_pairs(nodes: DataFrame, feats: DataFrame, space: Workspace, k: int, percent: int) -> DataFrame:
    """Candidate pairs (u, v) of different components among nodes (node, n, root): all that can reach the similarity."""
    known: dict[bytes, int] = {}

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        sets = [shingle_set(unpack(z).lower().split(), k, known).view(np.int64) for z in batch.column("packed").to_pylist()]
        return batch_of("node long, all array<long>", [batch.column("node"), sets])

    texts = feats.select(F.col("rid").alias("node"), "packed").join(nodes.select("node"), "node", "left_semi")
    rows = space.write(map_rows(texts, shingles, "node long, all array<long>").select("node", F.explode("all").alias("shingle")), "shingles")
    often = space.write(rows.groupBy("shingle").agg(F.count("*").alias("k")), "often")
    # a shingle of one text only meets nothing, but it takes its place in that text's order
    ranked = spread_join(rows, often.where("k > 1"), ["shingle"], often, "left")
    item = F.struct(F.coalesce("k", F.lit(1)).alias("k"), "shingle")
    each = ranked.groupBy("node").agg(F.sort_array(F.collect_list(item)).alias("s")).join(nodes, "node")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    first = F.slice("s", F.lit(1), length)
    prefix = each.select("node", "n", "root", F.posexplode(first).alias("place", "x")).where("x.k > 1").select(F.col("x.shingle").alias("shingle"), "place", "node", "n", "root")
    prefix = space.write(prefix, "prefixes")
    for name in ("shingles", "often"):
        space.drop(name)
    one, two = _sides(prefix, "shingle")
    # what both can share at most, from this shingle on, and what similarity asks for
    most = 1 + F.least(F.col("nu") - F.col("pu") - 1, F.col("nv") - F.col("pv") - 1)
    # shingles ahead of this one may be shared as well
    room = (most + F.least("pu", "pv")) * (100 + percent) >= percent * (F.col("nu") + F.col("nv"))
    return one.join(two, "shingle").where((F.col("ru") > F.col("rv")) & _near_in_size(percent) & room).select("u", "v")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable) and kept (doc_id is that id)."""
    rows = grouped(docs, k, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, rid: str | None = None) -> DataFrame:
    """Per row: rid (a number that tells rows apart; the column named so, where given), doc_id, n_shingles, component_id and root, which names its group (null: none)."""
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    feats = space.write(features(docs, k, rid), "features")
    # one node for each class: the row id of one of its rows
    classes = space.write(
        feats.where("n > 0").groupBy("c1", "c2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count("*").alias("k")), "classes"
    )
    with freed(spark):
        keys = feats.where("n > 3").select("rid", "n", "bands").join(classes.select(F.col("node").alias("rid")), "rid", "left_semi")
        keys = keys.select(F.col("rid").alias("node"), "n", F.explode("bands").alias("key"))
        crowded = space.write(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("k")).where("k > 1").hint("rebalance"), "crowded")
        buckets = space.write(spread_join(keys, crowded, ["key"], crowded), "buckets")
        links = verified(buckets.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")), feats, space, "first", k, percent)
        roots = space.write(connected_components(links, space, "round"), "roots")
        # what is left: members of one bucket in different components
        placed = buckets.join(roots, "node", "left").select("key", "hub", "node", "n", F.coalesce("root", "node").alias("root"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k")).where("low < high").select("key", "k")
        placed = space.write(placed.join(mixed, "key"), "mixed")
        space.drop("buckets")
        one, two = _sides(placed.where(F.col("k") <= BUCKET), "key", "hub")
        rest = one.join(two.drop("hub"), "key").where((F.col("ru") > F.col("rv")) & _near_in_size(percent) & (F.col("u") != F.col("hub")) & (F.col("v") != F.col("hub"))).select("u", "v")
        large = space.write(placed.where(F.col("k") > BUCKET).select("node", "n", "root").distinct(), "large")
        if large.limit(1).count():
            rest = rest.union(prefix_pairs(large, feats, space, k, percent))
        more = verified(rest, feats, space, "second", k, percent)
        if more.limit(1).count():
            linked = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), space, "again")
            roots = space.write(linked, "roots2")
    whole = classes.join(roots, "node", "left").select("c1", "c2", "node", "least", F.coalesce("root", "node").alias("root"))
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = whole.join(ids, "root").select("c1", "c2", "component_id", "root")
    rows = feats.select("rid", "doc_id", F.col("n").alias("n_shingles"), "c1", "c2")
    # rows of a class of very many copies are spread
    out = spread_join(rows, named, ["c1", "c2"], classes.select("c1", "c2", "k"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("rid", "doc_id", "n_shingles", component.alias("component_id"), "root")


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, same columns, with one row of each group of near-duplicates: the one with the smallest doc_id (null last), of
    rows with that id the first. Rows without words are no copies of each other and all stay."""
    space = Workspace(docs.sparkSession, "without-copies")
    own, names = unused(docs.columns, "rid")[0], [f"`{c}`" for c in docs.columns]
    # written, as a row's number must be the same in both readings
    docs = space.write(docs.withColumn(own, F.monotonically_increasing_id()), "docs")
    rows = space.write(grouped(docs, k, percent, f"`{own}`").select("rid", "doc_id", "root"), "rows")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("f")).select("f.rid")
    drop = rows.where("root IS NOT NULL").join(first, "rid", "left_anti").select(F.col("rid").alias("_drop"))
    drop = space.write(drop, "drop")
    if drop.count() <= MOST_SENT:  # else texts are shuffled
        drop = F.broadcast(drop)
    return docs.join(drop, F.col(f"`{own}`") == F.col("_drop"), "left_anti").select(*names)


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: all pairs that share a shingle, compared on their whole sets, in DuckDB; for tables whose doc_id is unique
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW}, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
  ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM w),
each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * k >= 80 * (na + nb - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept
FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(shingles)
"""
