"""Positional inverted index as ordinary tables."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.functions import codec
from scrivel.functions.batches import map_pieces
from scrivel.functions.text import bigrams


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, token, n: occurrences in title and body. No positions are made, so one cheap pass."""
    tokens = F.concat(bigrams(F.col("title")), bigrams(F.col("body")))
    return docs.select("doc_id", F.explode(tokens).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def token_stats(docs: DataFrame) -> DataFrame:
    """token, document_count, positions_count; counted within documents first, so nothing is counted distinct."""
    return token_counts(docs).groupBy("token").agg(F.count("*").alias("document_count"), F.sum("n").alias("positions_count"))


def merge_stats(*parts: DataFrame) -> DataFrame:
    """Partial statistics of disjoint corpora to those of the whole."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("token").agg(F.sum("document_count").alias("document_count"), F.sum("positions_count").alias("positions_count"))


#: a block: what some documents that came together have of one token. Each document's id, then in varints how many positions
#: of title and body each has, and the positions as differences; documents and n (positions) are the block's counts
_VARINTS = ("title_sizes", "body_sizes", "titles", "bodies")
_BLOCK = {"token": "string", "doc_ids": "array<bigint>"} | dict.fromkeys(_VARINTS, "binary") | {"documents": "bigint", "n": "bigint"}
#: how blocks are written: small row groups, so that a token filter skips most, ids as packed differences (version 2 of the
#: format), no dictionaries but the tokens'
_WRITTEN = {"parquet.block.size": str(16 << 20), "parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_ids.list.element", *_VARINTS)}
#: bytes of text that postings are made of at once: what they take is small, and a token's block holds many documents
_PIECE = 1 << 20
#: bytes of written documents that a task makes postings of, so that it sorts them in memory and no task is the last by far
_SPLIT = 16 << 20
_LISTS = {"title_pos": "array<int>", "body_pos": "array<int>"}
#: a token is a number below PAIRS: two indexed characters, each ranked by code point (0: not indexed)
RANKS = 62 + 0x9FA5 - 0x4E00 + 2
PAIRS = RANKS * RANKS
_ASCII = np.zeros(256, dtype=np.int32)
_ASCII[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 63)


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, token number and code point offset of every bigram of some texts, by row and offset."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(ends[-1] - ends[0] + 2, dtype=np.uint8)
    if len(raw) > 2:
        raw[:-2] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    at = np.flatnonzero((raw[:-2] & 0xC0) != 0x80)  # where code points start
    lead = raw[at]
    rank = _ASCII[lead]
    wide = np.flatnonzero((lead >= 0xE4) & (lead <= 0xE9))  # the three bytes of the ideographs
    if len(wide):
        w = at[wide]
        code = (raw[w].astype(np.int32) & 15) << 12 | (raw[w + 1].astype(np.int32) & 63) << 6 | (raw[w + 2] & 63)
        rank[wide] = np.where((code >= 0x4E00) & (code <= 0x9FA5), code - 0x4E00 + 63, 0)
    first = np.searchsorted(at, ends - ends[0])  # each text's first code point
    follows = rank[1:] > 0
    inner = first[(first > 0) & (first < len(at))]
    follows[inner - 1] = False
    here = np.flatnonzero((rank[:-1] > 0) & follows)
    n = np.diff(np.searchsorted(here, first))  # of each text
    return np.repeat(np.arange(len(n)), n), rank[here].astype(np.int64) * RANKS + rank[here + 1], here - np.repeat(first[:-1], n)


#: the character of each rank
_CHARACTERS = [chr(c) for c in [0, *np.flatnonzero(_ASCII), *range(0x4E00, 0x9FA6)]]


def _posted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of some documents, by token and then as the documents come."""
    ids = batch.column(0)
    (r0, k0, p0), (r1, k1, p1) = _pairs(batch.column(1)), _pairs(batch.column(2))
    row, key, pos = np.concatenate([r0, r1]), np.concatenate([k0, k1]), np.concatenate([p0, p1]).astype(np.int32)
    # (token, row, place in the arrays) in one number, so that a plain sort keeps titles first and offsets in order
    bits = max(len(key).bit_length(), 1)
    order = np.sort((key * len(ids) + row) << bits | np.arange(len(key)))
    group, at = order >> bits, order & ((1 << bits) - 1)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    title = at < len(k0)
    before = np.concatenate([[0], np.cumsum(title)])
    bounds = np.append(starts, len(at))
    lists = []
    for mine, offsets in ((title, before[bounds]), (~title, bounds - before[bounds])):
        lists.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pos[at[mine]])))
    keys, row = np.divmod(group[starts], max(len(ids), 1))
    new = np.diff(keys, prepend=-1) != 0  # keys are in order
    distinct = [_CHARACTERS[k // RANKS] + _CHARACTERS[k % RANKS] for k in keys[new].tolist()]
    tokens = pa.array(distinct, pa.string()).take(pa.array(np.cumsum(new) - 1))
    return pa.RecordBatch.from_arrays([tokens, ids.take(pa.array(row)), *lists], names=["token", "doc_id", *_LISTS])


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks of some postings: one for each run of a token."""
    tokens, ids = batch.column(0), batch.column(1)
    starts = np.flatnonzero(np.diff(tokens.dictionary_encode().indices.to_numpy(), prepend=-1))
    bounds = np.append(starts, len(tokens))
    lists = lambda at, values: codec._put_all(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values)))
    sizes, places, n = [], [], np.zeros(len(starts), dtype=np.int64)
    for column in (batch.column(2), batch.column(3)):
        at = codec._bounds(column)
        pos = column.values.slice(at[0], at[-1] - at[0]).to_numpy()
        at = at - at[0]
        first = at[:-1][np.diff(at) > 0]  # each document's first position stays as it is
        steps = np.diff(pos, prepend=0)
        steps[first] = pos[first]
        sizes.append(lists(bounds, np.diff(at)))
        places.append(lists(at[bounds], steps))
        n += np.diff(at[bounds])
    ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), ids)
    return pa.RecordBatch.from_arrays([tokens.take(pa.array(starts)), ids, *sizes, *places, pa.array(np.diff(bounds)), pa.array(n)], names=list(_BLOCK))


def _unpacked(ids: Column, *varints: Column) -> Column:
    """The postings of a block, as an array of (doc_id, title_pos, body_pos)."""

    @F.arrow_udf("array<struct<doc_id: bigint, title_pos: array<int>, body_pos: array<int>>>")
    def run(ids: pa.Array, title_sizes: pa.Array, body_sizes: pa.Array, titles: pa.Array, bodies: pa.Array) -> pa.Array:
        lists = []
        for sizes, steps in ((title_sizes, titles), (body_sizes, bodies)):
            n, total = codec._get_all(sizes).flatten().to_numpy(), np.cumsum(codec._get_all(steps).flatten().to_numpy())
            at = np.concatenate([[0], np.cumsum(n)])
            pos = total - np.repeat(np.concatenate([[0], total])[at[:-1]], n)
            lists.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(pos.astype(np.int32))))
        at = codec._bounds(ids) if len(ids) else np.zeros(1)
        posts = pa.StructArray.from_arrays([ids.flatten(), *lists], names=["doc_id", *_LISTS])
        return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), posts)

    return run(ids, *varints)


def _made(docs: DataFrame, blocks: bool) -> DataFrame:
    """Postings, or blocks of them, made where the texts are; only those of documents that share an id are gathered."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = {"token": "string", "doc_id": kind} | _LISTS
    schema = lambda kinds: ", ".join(f"{c} {t}" for c, t in kinds.items())
    post = lambda d, fn, kinds: map_pieces(d.select("doc_id", "title", "body"), fn, schema(kinds), _PIECE)
    kinds = _BLOCK | {"doc_ids": f"array<{kind}>"}
    made = lambda d: post(d, lambda b: _packed(_posted(b)), kinds) if blocks else post(d, _posted, rows)
    shared = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if shared.isEmpty():
        return made(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    together = [F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in _LISTS]
    gathered = post(docs.join(shared, same, "left_semi"), _posted, rows).groupBy("token", "doc_id").agg(*together)
    if blocks:
        gathered = map_pieces(gathered.sortWithinPartitions("token", "doc_id"), _packed, schema(kinds), _PIECE)
    return made(docs.join(shared, same, "left_anti")).unionByName(gathered)


def postings(docs: DataFrame) -> DataFrame:
    """token, doc_id, title_pos, body_pos (sorted arrays): a posting for each token of a document.

    All tokens of a document are found where its text is, so nothing is shuffled. Only documents that share an id are
    gathered after it.
    """
    return _made(docs, blocks=False)


@dataclass
class Index:
    """Documents, a posting for each token of a document, and what is known of each token."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame

    def document_counts(self, tokens: list[str]) -> dict[str, int]:
        """In how many documents each of a query's tokens is: one row a token comes to the driver."""
        return {r.token: r.document_count for r in self.stats.where(F.col("token").isin(tokens)).select("token", "document_count").collect()}


def index_of(docs: DataFrame) -> Index:
    """An index that is made when it is read; for small corpora and tests."""
    return Index(docs, postings(docs), token_stats(docs))


def save_index(docs: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes documents in so many parts (None: as they are), blocks of each part's postings sorted by token so that a token filter
    skips most of it, and the tokens' statistics. Postings stay with their documents: a query reads its tokens from all parts alike."""
    (docs.repartition(parts, "doc_id") if parts else docs).write.mode("overwrite").parquet(f"{path}/docs")
    _post(docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/docs"), f"{path}/postings", f"{path}/stats/batch=-1")


def _post(docs: DataFrame, path: str, stats_path: str) -> None:
    spark, key = docs.sparkSession, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(_SPLIT))  # there is no such option of one read
    try:
        made = _made(docs, blocks=True).sortWithinPartitions("token")
        made.write.mode("overwrite").options(**_WRITTEN).parquet(path)
    finally:
        spark.conf.set(key, before)
    stats_of(docs.sparkSession.read.schema(made.schema).parquet(path)).write.mode("overwrite").parquet(stats_path)


def stats_of(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("token").agg(F.sum("documents").alias("document_count"), F.sum("n").alias("positions_count"))


def append_index(docs: DataFrame, path: str, batch: int = 0) -> None:
    """Adds documents under a batch number; the same batch again replaces itself, so a retried one counts once."""
    docs.write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")
    _post(docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/docs/batch={batch}"), f"{path}/postings/batch={batch}", f"{path}/stats/batch={batch}")


_DOCS = "doc_id bigint, url string, title string, body string"


def open_index(spark: SparkSession, path: str) -> Index:
    """A saved index, whatever was appended to it included."""
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")
    stats = merge_stats(read("stats", "token string, document_count bigint, positions_count bigint"))
    blocks = read("postings", ", ".join(f"{c} {t}" for c, t in _BLOCK.items()))
    return Index(read("docs", _DOCS), blocks.select("token", F.inline(_unpacked("doc_ids", *_VARINTS))), stats)


def lookup(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """The postings of some tokens; the filter is pushed down to the scan."""
    return open_index(spark, path).postings.where(F.col("token").isin(tokens))


def index_size(index: Index) -> DataFrame:
    """n_docs, n_tokens, n_postings and n_positions: what a monitor shows of an index."""
    size = index.stats.agg(F.count("*").alias("n_tokens"), F.sum("document_count").alias("n_postings"), F.sum("positions_count").alias("n_positions"))
    return index.docs.agg(F.count("*").alias("n_docs")).crossJoin(size)  # one row each
