"""Removal of long repeated byte strings with a distributed suffix array over anchored suffixes.

Every window of WINDOW bytes that occurs twice is removed at all its places. Windows are addressed through anchors: the anchor
of a window is the place in it whose GRAM-byte string has the least hash (leftmost on a tie). It depends on nothing but the
window's bytes, so equal windows have equal anchors at equal offsets, and comparing suffixes at anchors loses no match,
at a hundredth of the suffixes. Consecutive windows with the same anchor form a stretch.

1. Each task finds the stretches of its texts: place, window count, the gram's hash, and a digest of the bytes.
2. Stretches whose gram occurs once in the corpus hold no repeated window. Of the others, equal ones are counted
   (pre-aggregated before the shuffle) and one of each is fetched, so thousands of copies weigh as one.
3. Their suffixes are range-partitioned by leading tokens: splitters are sampled suffixes, whole with the bytes to their
   left, so a gram of any number of suffixes is split over as many buckets as it needs. A bucket is read in order, in
   batches of at most SORT_ROWS suffixes, each sorted by multikey quicksort, eight bytes a step, to the right and to the
   left of the anchor. A window of d bytes before its anchor is repeated when another suffix, or another copy, shares
   200 - d bytes to the right and d to the left.
4. Comparison across boundaries: a suffix that shares 200 - d bytes with the splitter or suffix at an edge of its batch
   may have equals beyond it. Such windows, once for each group of a batch, go on by digest, are counted over all
   batches and buckets, and come back to the suffixes that had no equal in their own batch.
5. Repeated windows go back to all stretches with that digest, and texts drop the bytes they cover. Where one gram or
   one digest has a good share of all stretches, these are spread over tasks for the joins.

Edge cases: null and empty texts and texts shorter than a window lose nothing; equal texts, also in rows with equal
doc_id, are different places, so all of them lose their repeated windows; matches never cross documents; texts of any
length are cut in pieces that overlap by a window less one byte; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, batch_of, bounded, freed, map_rows, short, spread_join

WINDOW, GRAM = 200, 40
#: bytes that are hashed at once
PIECE = 1 << 19

_TABLE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (40) bytes at each place of raw, by doubling: 2, 4, 8, 16, 32, then 32 + 8."""
    h = _TABLE[raw]
    eight = h
    for k, size in enumerate((1, 2, 4, 8, 16)):
        h = h[:-size] * _MULT[k] + h[size:]
        h ^= h >> np.uint64(29)
        if size == 4:
            eight = h
    h = h[: len(raw) - GRAM + 1] * _MULT[5] + eight[32:]
    h ^= h >> np.uint64(32)
    h *= _MULT[0]
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


_PLACE_BITS = np.uint64(20)  # a piece has at most 2 ** 20 bytes
_PLACES = np.uint64((1 << 20) - 1)


def stretches(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, window count, anchor, gram hash) of the stretches of a piece; bounds: where its texts end."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = gram_hashes(raw)
    key = (h & ~_PLACES) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(key, WINDOW - GRAM + 1)
    anchor = (least & _PLACES).astype(np.int64)
    # windows that reach over the end of a text don't count
    ok = np.ones(n, bool)
    for b in bounds:
        ok[max(0, b - WINDOW + 1) : b] = False
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])) + 1
    first = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([first, [n]]))
    good = ok[first]
    first, count = first[good], count[good]
    anchor = anchor[first]
    return first, count, anchor, h[anchor]


_ROWS = "rid long, doc_id long, n_bytes long, whole_sha string, packed binary"


def packed_texts(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        return batch_of(_ROWS, [batch.column("rid"), batch.column("doc_id"), [len(x) for x in raw], [hashlib.sha256(x).hexdigest() for x in raw], [pack(x) for x in raw]])

    return map_rows(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), run, _ROWS)


_PLACED = "rid long, first long, windows int, lead int, gram long, d1 long, d2 long"


def placed_stretches(rows: DataFrame) -> DataFrame:
    """The stretches of all texts. lead: bytes from the first window to the anchor; d1, d2: digest of the bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        pieces: list[tuple[int, int, bytes]] = []  # (rid, offset, bytes)
        for rid, z in zip(batch.column("rid").to_pylist(), batch.column("packed").to_pylist()):
            raw = unpack(z)
            if len(raw) >= WINDOW:
                for at in range(0, len(raw) - WINDOW + 1, PIECE):
                    pieces.append((rid, at, raw[at : at + PIECE + WINDOW - 1]))
        cols: list[list] = [[] for _ in range(7)]
        group: list = []

        def flush() -> None:
            if not group:
                return
            joined = b"".join(p[2] for p in group)
            ends = np.cumsum([len(p[2]) for p in group])
            first, count, anchor, gram = stretches(np.frombuffer(joined, np.uint8), ends)
            which = np.searchsorted(ends, first, "right")
            starts = np.concatenate([[0], ends[:-1]])
            offset = np.array([p[1] for p in group]) - starts
            view, digest = memoryview(joined), xxhash.xxh3_128_digest
            both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + WINDOW - 1).tolist())]), ">i8").reshape(-1, 2)
            for c, v in zip(cols, (np.array([p[0] for p in group], np.int64)[which], first + offset[which], count, anchor - first, gram.view(np.int64), both[:, 0].astype(np.int64), both[:, 1].astype(np.int64))):
                c.append(v)
            group.clear()

        size = 0
        for p in pieces:
            if size + len(p[2]) > PIECE + WINDOW - 1:
                flush()
                size = 0
            group.append(p)
            size += len(p[2])
        flush()
        return batch_of(_PLACED, [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in cols])

    return map_rows(rows.where(F.col("n_bytes") >= WINDOW).select("rid", "packed"), run, _PLACED)


_FETCHED = "d1 long, d2 long, copies long, lead int, windows int, suffix binary, ahead binary"


def fetched(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of one stretch of each digest: the suffix at its anchor, and what is ahead of the anchor, backwards."""
    each = wanted.groupBy("rid").agg(F.collect_list(F.struct("first", "windows", "lead", "d1", "d2", "copies")).alias("parts"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        cols: list[list] = [[] for _ in range(7)]
        for z, parts in zip(batch.column("packed").to_pylist(), batch.column("parts").to_pylist()):
            raw = unpack(z)
            for p in parts:
                data = raw[p["first"] : p["first"] + p["windows"] + WINDOW - 1]
                for c, v in zip(cols, (p["d1"], p["d2"], p["copies"], p["lead"], p["windows"], data[p["lead"] :], data[: p["lead"]][::-1])):
                    c.append(v)
        return batch_of(_FETCHED, cols)

    return map_rows(rows.select("rid", "packed").join(each, "rid").select("packed", "parts"), run, _FETCHED)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of words, and for each but the first how many words it shares with the one before.

    Multikey quicksort, level by level: all runs of rows that are equal so far are split by their next word at once; rows
    that stand alone are done. Words are compared eight bytes at a time.
    """
    n, depth = words.shape
    order = np.arange(n)
    shared = np.full(max(n - 1, 0), depth)
    open_at = np.arange(n)  # positions in runs of two or more
    run = np.zeros(n, np.int64)  # the run of each of them
    for level in range(depth):
        if len(open_at) < 2:
            break
        rows = order[open_at]
        part = np.lexsort((words[rows, level], run))
        rows = rows[part]
        order[open_at] = rows
        value = words[rows, level]
        same = (run[1:] == run[:-1]) & (value[1:] == value[:-1])
        split = (run[1:] == run[:-1]) & ~same
        shared[open_at[1:][split] - 1] = level
        new = np.concatenate([[0], np.cumsum(~same)])
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        open_at, run = open_at[again], new[again]
    return order, shared


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, filled up with zeros; the true lengths limit what counts as shared."""
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def _neighbours(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows (width a multiple of 8), and the bytes that neighbours share."""
    words = np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)
    order, shared = multikey_sort(words)
    if len(order) < 2:
        return order, np.empty(0, np.int64)
    at = np.minimum(shared, words.shape[1] - 1)
    a, b = words[order[:-1], at], words[order[1:], at]
    diff = a ^ b
    # leading equal bytes of the first unequal word
    lead = np.zeros(len(diff), np.int64)
    for k in range(1, 8):
        lead += (diff >> np.uint64(64 - 8 * k)) == 0
    return order, np.where(shared == words.shape[1], matrix.shape[1], shared * 8 + lead)


REACH = WINDOW - GRAM  # most bytes of a window before its anchor


def shared_bytes(x: bytes, y: bytes) -> int:
    """How many leading bytes two strings share."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def repeated_windows(copies: np.ndarray, leads: np.ndarray, windows: np.ndarray, right: list[bytes], left: list[bytes], edges: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """For each stretch of a batch, the ranges (first, end) of its windows that occur twice in it, counted from its start,
    and the windows that may have equals beyond the edges: (stretch, window, copies), once for each group of equal ones.

    Suffixes are sorted to the right and to the left of the anchor. For each number d of bytes before the anchor, suffixes
    form runs that share WINDOW - d bytes rightwards and runs that share d leftwards; a pair of runs with two copies or
    more is a repeated window. Ids of runs come from the sorted neighbours, so the comparison is exact.
    """
    n = len(right)
    r_order, r_shared = _neighbours(_padded(right, WINDOW))
    l_order, l_shared = _neighbours(_padded(left, REACH))
    r_place, l_place = np.empty(n, np.int64), np.empty(n, np.int64)
    r_place[r_order], l_place[l_order] = np.arange(n), np.arange(n)
    # bytes that a suffix shares with the nearer edge; only those with its whole gram can have equals beyond
    over = np.zeros(n, np.int64)
    for edge in edges:
        gram = edge[:GRAM]
        for i, x in enumerate(right):
            if x.startswith(gram):
                over[i] = max(over[i], shared_bytes(x, edge))
    marks: list[list[int]] = [[] for _ in range(n)]
    beyond: list[tuple[int, int, int]] = []
    least = leads - windows + 1  # bytes before the anchor in the last window
    for d in range(REACH + 1):
        here = np.flatnonzero((least <= d) & (d <= leads))
        if not len(here):
            continue
        r_run = np.concatenate([[0], np.cumsum(r_shared < WINDOW - d)])[r_place[here]]
        l_run = np.concatenate([[0], np.cumsum(l_shared < d)])[l_place[here]]
        pair = r_run * n + l_run
        order = np.argsort(pair, kind="stable")
        head = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        group = np.cumsum(head) - 1
        total = np.bincount(group, copies[here][order])
        for i in here[order[total[group] >= 2]].tolist():
            marks[i].append(d)
        lone = here[order[head]]  # one of each group
        for i, k in zip(lone.tolist(), total.astype(np.int64).tolist()):
            if over[i] >= WINDOW - d:
                beyond.append((i, int(leads[i]) - d, k))
    out = []
    for i, ds in enumerate(marks):
        spans: list[tuple[int, int]] = []
        for d in reversed(ds):  # windows in order of their start
            w = int(leads[i]) - d
            if spans and spans[-1][1] == w:
                spans[-1] = (spans[-1][0], w + 1)
            else:
                spans.append((w, w + 1))
        out.append(spans)
    return out, beyond


#: suffixes that are sorted at once, and that a bucket has on average
SORT_ROWS = 10_000
#: splitters at most; a bucket of more suffixes is read in more batches
MAX_SPLITTERS = 8_192
_SAMPLES = 10  # sampled suffixes for each splitter
#: a range of repeated windows (lo to hi), or, where copies is set, window lo with the digest w1, w2
_FOUND = "d1 long, d2 long, lo int, hi int, w1 long, w2 long, copies long"


def splitters(suffixes: DataFrame, sort_rows: int) -> list[tuple[bytes, bytes]]:
    """Sampled (suffix, bytes ahead) that part the suffixes in buckets of about sort_rows."""
    n = suffixes.count()
    wanted = min(n // sort_rows, MAX_SPLITTERS)
    if not wanted:
        return []
    sample = suffixes.select("suffix", "ahead").sample(min(1.0, wanted * _SAMPLES / n), seed=5)
    found = sorted((bytes(r.suffix), bytes(r.ahead)) for r in sample.toLocalIterator())
    return sorted({found[len(found) * (i + 1) // (wanted + 1)] for i in range(wanted)} if found else ())


def repeated(suffixes: DataFrame, space: Workspace, sort_rows: int = SORT_ROWS) -> DataFrame:
    """(d1, d2, ranges): ranges of repeated windows, by digest."""
    spark = suffixes.sparkSession
    parts = splitters(suffixes, sort_rows)
    sent = spark.sparkContext.broadcast(parts)  # at most MAX_SPLITTERS of 360 bytes

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [bisect_right(sent.value, x) for x in zip(batch.column("suffix").to_pylist(), batch.column("ahead").to_pylist())]
        return batch_of("bucket int, " + _FETCHED, [at, *batch.columns])

    def solve(rows: pa.Table, edges: list[bytes]) -> pa.RecordBatch:
        get = lambda c: rows.column(c).to_numpy()
        d1, d2, right, left = get("d1"), get("d2"), rows.column("suffix").to_pylist(), rows.column("ahead").to_pylist()
        found, beyond = repeated_windows(get("copies"), get("lead").astype(np.int64), get("windows").astype(np.int64), right, left, edges)
        flat = [(i, lo, hi, None, None, None) for i, spans in enumerate(found) for lo, hi in spans]
        for i, w, k in beyond:
            data = left[i][::-1] + right[i]
            key = xxhash.xxh3_128_digest(data[w : w + WINDOW])
            flat.append((i, w, w + 1, int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), k))
        pick = np.array([f[0] for f in flat], np.int64)
        return batch_of(_FOUND, [d1[pick], d2[pick], *([f[c] for f in flat] for c in range(1, 6))])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of one bucket, fewer than sort_rows
        size, bucket, low = 0, None, None

        def edges(high: bytes | None) -> list[bytes]:
            return [x for x in (low, high) if x is not None]

        for batch in short(batches, sort_rows):
            column = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                piece, now = batch.slice(a, b - a), int(column[a])
                first = piece.column("suffix")[0].as_py()
                if held and (now != bucket or size + len(piece) > sort_rows):
                    rows = pa.Table.from_batches(held)
                    yield solve(rows, edges(first if now == bucket else sent.value[bucket][0]))
                    low = rows.column("suffix")[-1].as_py()
                    held, size = [], 0
                if now != bucket:
                    bucket, low = now, sent.value[now - 1][0] if now else None
                held.append(piece)
                size += len(piece)
        if held:
            yield solve(pa.Table.from_batches(held), edges(sent.value[bucket][0] if bucket < len(sent.value) else None))

    placed = map_rows(suffixes, place, "bucket int, " + _FETCHED, 4_000).repartition("bucket").sortWithinPartitions("bucket", "suffix", "ahead")
    with freed(spark):
        found = space.write(bounded(placed).mapInArrow(run, _FOUND), "found")
    often = found.where("copies > 0").groupBy("w1", "w2").agg(F.sum("copies").alias("k")).where("k > 1").select("w1", "w2")
    # at most one of a batch has no equal there, so these keys are never hot
    lone = found.where("copies = 1").join(often, ["w1", "w2"], "left_semi").select("d1", "d2", "lo", "hi")
    every = found.where("copies IS NULL").select("d1", "d2", "lo", "hi").union(lone)
    return every.groupBy("d1", "d2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_parts(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """What stays of a text, removed bytes, maximal removed runs; ranges are byte ranges in any order, overlapping or not."""
    out, at, spans = [], 0, 0
    end = -1
    for s, e in sorted(ranges):
        if s > end:
            out.append(raw[at:s])
            spans += 1
            end = e
        else:
            end = max(end, e)
        at = end
    out.append(raw[at:])
    return out, len(raw) - sum(map(len, out)), spans


def removals(docs: DataFrame, sort_rows: int = SORT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The packed texts with their rid, and the repeated byte ranges of each (rid, ranges)."""
    spark = docs.sparkSession
    space = Workspace(spark, "suffixes")
    rows = space.write(packed_texts(docs), "texts")
    places = space.write(placed_stretches(rows), "places")
    with freed(spark):
        often = space.write(places.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").hint("rebalance"), "often")
        close = space.write(spread_join(places, often.select("gram"), ["gram"], often).drop("gram"), "close")
        space.drop("places")
        space.drop("often")
        one = close.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.first("rid").alias("rid"), F.first("first").alias("first"), F.first("windows").alias("windows"), F.first("lead").alias("lead"))
        suffixes = space.write(fetched(one, rows), "suffixes")
        found = repeated(suffixes, space, sort_rows)
    hits = spread_join(close, found, ["d1", "d2"], suffixes.select("d1", "d2", F.col("copies").alias("k")))
    space.drop("suffixes")
    hits = hits.select("rid", "first", F.explode("ranges").alias("r"))
    hits = hits.select("rid", (F.col("first") + F.col("r.lo")).alias("s"), (F.col("first") + F.col("r.hi") + (WINDOW - 1)).alias("e"))
    return rows, hits.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))


def deduplicate(docs: DataFrame, sort_rows: int = SORT_ROWS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay."""
    rows, ranges = removals(docs, sort_rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        cols: list[list] = [[] for _ in range(3)]
        for z, found, sha in zip(batch.column("packed").to_pylist(), batch.column("ranges").to_pylist(), batch.column("whole_sha").to_pylist()):
            removed = spans = 0
            if found:
                out, removed, spans = kept_parts(unpack(z), [(r["s"], r["e"]) for r in found])
                sha = hashlib.sha256(b"".join(out)).hexdigest()
            for c, v in zip(cols, (removed, spans, sha)):
                c.append(v)
        return batch_of(_RESULT, [batch.column("doc_id"), batch.column("n_bytes"), *cols])

    return map_rows(rows.join(ranges, "rid", "left"), run, _RESULT)


#: windows by value in DuckDB: every place of every text, counted by its 200 bytes
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS raw, upper(hex(encode(coalesce(text, '')))) AS hx FROM documents),
p AS (SELECT rid, unnest(range(octet_length(raw) - {WINDOW - 1})) AS pos FROM d WHERE octet_length(raw) >= {WINDOW}),
w AS (SELECT p.rid, pos, md5_number(substring(hx, (2 * pos + 1)::BIGINT, {2 * WINDOW})) AS h FROM p JOIN d USING (rid)),
often AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM w SEMI JOIN often USING (h)),
runs AS (SELECT rid, pos, sum(CASE WHEN before IS NULL OR pos > before + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM hit),
spans AS (SELECT rid, run, min(pos) AS s, max(pos) + {WINDOW} AS e, coalesce(lag(max(pos) + {WINDOW}) OVER (PARTITION BY rid ORDER BY run), 0) AS from_ FROM runs GROUP BY rid, run),
cut AS (SELECT d.rid, string_agg(substring(hx, (2 * from_ + 1)::BIGINT, (2 * (s - from_))::BIGINT), '' ORDER BY s) || substring(any_value(hx), (2 * max(e) + 1)::BIGINT) AS kept, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans
  FROM spans JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""
