"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Training words are streamed through the automaton, which tracks the longest suffix of what was read that occurs in some
item. A word is hit when it lies inside an occurrence of a window: WINDOW consecutive item words, or a whole item that
has fewer (but not none).

Edge cases: null and empty texts have no words and no hits; null items and items without words have no window; equal
items each count by their item_id, null ids count as one item that is left out of the list; texts of any length are
streamed whole; repeated rows are judged one by one; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import uuid
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, bounded, short, unused

WINDOW = 10
#: words of one automaton; a larger benchmark is cut into several, applied one after another
BLOCK_WORDS = 400_000

#: byte table of the word rule: A-Z lower-cased, all other ASCII but 0-9 and a-z to a space, the rest as it is
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; states know which items hold their window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = array("l", [-1]), array("l", [0])
        #: state and length -> ids of the items with a window of that length there
        self.items: dict[tuple[int, int], set] = {}
        #: state -> lengths of whole short items that end there
        self.short: dict[int, set[int]] = {}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        by_length = sorted(range(1, len(self.len)), key=self.len.__getitem__)  # a link leads to a shorter state
        #: for each state the one on its chain of links whose lengths include the window, 0 for none
        self.wide = array("l", bytes(array("l").itemsize * len(self.len)))
        for state in by_length:
            if self.len[state] >= window:
                self.wide[state] = state if self.len[self.link[state]] < window else self.wide[self.link[state]]
        for item, words in items:
            if 0 < len(words) < window:
                state = self._walk(words)
                self.items.setdefault((state, len(words)), set()).add(item)
                self.short.setdefault(state, set()).add(len(words))
            elif words:
                state = n = 0
                for w in words:
                    state, n = self.step(state, n, w)
                    if n >= window:
                        self.items.setdefault((self.wide[state], window), set()).add(item)
        #: for each state the nearest one on its chain that ends a short item or is wide, 0 for none. Such states on one
        #: chain have different lengths of at most the window, so there are at most that many and they are walked in scan()
        self.stop = array("l", bytes(array("l").itemsize * len(self.len)))
        for state in by_length:
            own = state in self.short or self.wide[state] == state
            self.stop[state] = state if own else self.stop[self.link[state]]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def _walk(self, words: list[bytes]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def step(self, state: int, n: int, w: bytes) -> tuple[int, int]:
        """The state and length of the longest suffix after one more word."""
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            n = self.len[state]
        if w in nxt[state]:
            return nxt[state][w], n + 1
        return 0, 0

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal hit ranges of words (end exclusive, touching ones joined), and the ids of the items found."""
        ranges: list[tuple[int, int]] = []
        found: set = set()
        met: set = set()  # windows and short items whose ids are in found already
        nxt, link, length, stop, wide, short, items, window = self.next, self.link, self.len, self.stop, self.wide, self.short, self.items, self.window
        state = n = 0
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    n = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    n = 0
                    continue
            state, n = to, n + 1
            at = stop[state]
            if at:
                reach = 0
                while at:
                    for size in (*((window,) if wide[at] == at else ()), *short.get(at, ())):
                        if size <= n:
                            reach = max(reach, size)
                            if (at, size) not in met:
                                met.add((at, size))
                                found |= items.get((at, size), set())
                    at = stop[link[at]]
                if reach:
                    start = i + 1 - reach
                    while ranges and ranges[-1][1] >= start:
                        start = min(start, ranges.pop()[0])
                    ranges.append((start, i + 1))
        return ranges, found


def joined_ranges(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(one + two):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """The items in blocks of a bounded number of words. A longer item is cut in pieces that share window - 1 words, so
    each of its windows is in one of them."""
    most = max(block_words, window)
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        whole = words_of(row.text)
        for at in range(0, max(len(whole) - window, 0) + 1, most - window + 1):
            words = whole[at : at + most]
            if not words:
                continue
            if block and size + len(words) > most:
                yield block
                block, size = [], 0
            block.append((row.item_id, words))
            size += len(words)
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs and, as the last three columns, _n_words, _hits (start, end, start, ... of hit word ranges) and _items (ids as
    text, without null); where docs has such a name, a longer one is taken.

    Each block of items has its own automaton, of a bounded size, and its own pass, with a written table between passes.
    """
    spark = docs.sparkSession
    names = docs.columns
    new = unused(names, "_n_words", "_hits", "_items")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", `{}` bigint, `{}` array<int>, `{}` array<string>".format(*new)
    out, space = None, None
    for k, block in enumerate(item_blocks(benchmark, window, block_words) if benchmark is not None else ()):
        if out is not None:
            space = space or Workspace(spark, "decontaminate")
            out = space.write(out, f"pass{k}")
        out = _pass(docs if out is None else out, names, new, schema, spark.sparkContext.broadcast((block, window)), out is not None)
    if out is None:
        out = _pass(docs, names, new, schema, spark.sparkContext.broadcast(([], window)), False)
    return out


_KEPT: dict = {}


def _pass(docs: DataFrame, names: list[str], new: list[str], schema: str, sent, again: bool) -> DataFrame:
    token = uuid.uuid4().hex

    def run(batches):
        # built once in a Python worker, from at most BLOCK_WORDS words
        if token not in _KEPT:
            _KEPT.clear()
            _KEPT[token] = Automaton(*sent.value)
        machine = _KEPT[token]
        for batch in short(batches):
            n_words, hits, ids = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                ranges, found = machine.scan(words)
                found = {str(x) for x in found if x is not None}
                if again:
                    old = batch.column(new[1])[i].as_py()
                    ranges = joined_ranges(ranges, list(zip(old[::2], old[1::2])))
                    found |= set(batch.column(new[2])[i].as_py())
                n_words.append(len(words))
                hits.append([x for r in ranges for x in r])
                ids.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))],
                names=[*names, *new],
            )

    return bounded(docs).mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 (of the ids as text, sorted, comma-joined), contaminated."""
    # ends less starts: starts stand at even places, ends at odd ones
    signed = F.transform("_hits", lambda x, i: F.when(i % 2 == 1, x.cast("long")).otherwise(-x.cast("long")))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return scan(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("_hits") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: windows by value in DuckDB
ORACLE_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
sized AS (SELECT item_id, words, least({WINDOW}, len(words)) AS n FROM item WHERE len(words) > 0),
window_ AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(len(words) - n + 1), lambda i: array_to_string(words[i + 1 : i + n], ' '))) AS gram FROM sized),
doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sizes AS (SELECT DISTINCT n FROM window_),
place AS (SELECT doc_id, words, n, unnest(range(len(words) - n + 1)) AS i FROM doc, sizes WHERE len(words) >= n),
met AS (SELECT doc_id, i, p.n, item_id FROM place p JOIN window_ w ON w.n = p.n AND w.gram = array_to_string(words[i + 1 : i + p.n], ' ')),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT doc.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

#: a text is dropped when more than this share of its words is hit, else its hit ranges are cut out
MAX_COVERAGE = 0.8


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each hit range."""
    raw = text.encode("utf-8", "surrogatepass")
    clean = raw.translate(_TABLE)
    spots, at = [], 0
    for w in clean.split():
        at = clean.index(w, at)
        spots.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for s, e in ranges:
        out.append(raw[at : spots[s][0]])
        at = spots[e - 1][1]
    return (b"".join(out) + raw[at:]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs, same columns: documents hit beyond max_coverage of their words are dropped, hit ranges cut from the others.

    Hit ranges of short whole items are cut as well. n_chars follows the text.
    """
    names = docs.columns
    found = scan(docs, benchmark, window)
    schema = docs.schema
    counts, places = found.columns[-3:-1]

    def run(batches):
        for batch in short(batches):
            texts, keep = [], []
            for text, n, hits in zip(batch.column("text").to_pylist(), batch.column(counts).to_pylist(), batch.column(places).to_pylist()):
                ranges = list(zip(hits[::2], hits[1::2]))
                keep.append(not ranges or sum(e - s for s, e in ranges) <= max_coverage * n)
                texts.append(cut(text, ranges) if ranges else text)
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names).filter(pa.array(keep))

    return bounded(found).mapInArrow(run, schema)
