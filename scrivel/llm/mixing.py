"""Mixing sources to target weights.

Each source's words form a stream, its documents in a pseudorandom order, packed into blocks of BLOCK_WORDS words. A
source gets as many slots as its target needs, and its last slot is cut to the words that are still wanted, so it gives
its target to the word, also where it is smaller than a block. Each slot draws its output shard uniformly: the counts of
a shard's sources are a multinomial draw given the sources' totals (shard_counts() returns them); shards drawn without
regard to the totals would miss the targets by chance. Slot number j of a source takes block perm(j mod blocks) of pass
j div blocks, where perm is a swap-or-not permutation keyed by source and pass. The permutation is run backwards from the
block to its slots, so blocks and slots meet by index without a table of slots. No block is taken more than three times.

shards() returns the mix itself, a row for each slot with the text of its block; mix() writes these rows and counts in them
what was taken of each document. Words keep the white space behind them (a document's first also what is ahead of it);
where a block goes on with another document there is a line feed more.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at MAX_REPEATS
times its source's size, and the excess goes to the others by weight. Everything is a built-in function. Running sums
are taken in buckets of bounded size first, then over buckets, so a hot source is no single task.

Edge cases: null texts and texts without a word have size 0 and are never taken; a null source is a source of its own;
rows with equal doc_id, and repeated rows, each have their own place in the stream; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, freed

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
#: rows of a bucket of running sums, on average at most
BUCKET_ROWS = 4_000
ROUNDS = 12
#: a word with the white space behind it, a text's first also with what is ahead
SPACED = r"(?:^[ \t-\r]+)?[^ \t-\r]+[ \t-\r]*"
SEED = 17


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_no, source_size, target: one row for each source. The only single task, over these rows."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    rows = by.withColumn("source_no", no.cast("long")).withColumn("w", weight.cast("long"))
    every = Window.partitionBy(F.lit(1))
    cap = F.col("source_size") * MAX_REPEATS
    # sources by how soon they reach their cap; each is capped if the share that is left then would exceed it
    ahead = Window.partitionBy(F.lit(1)).orderBy(F.col("source_size") * MAX_REPEATS / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "cap_before": F.coalesce(F.sum(cap).over(ahead), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(ahead), F.lit(0))})
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    capped = wide("source_size") * MAX_REPEATS * (wide("all_w") - wide("w_before")) <= wide("w") * (wide("total") - wide("cap_before"))
    rows = rows.withColumn("capped", capped)
    left = (F.col("total") - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(every)).cast("double")
    left_w = (F.col("all_w") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(every)).cast("double")
    rows = rows.withColumns({"left": left, "left_w": left_w})
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("w") * F.col("left") / F.col("left_w"))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def permuted(i: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """Where a keyed pseudorandom permutation of 0..n-1 sends i: swap-or-not, ROUNDS rounds. back: what it sends to i."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(F.lit(SEED), *key, r).cast("long") - x, n)
        high = F.greatest(x, partner)
        return F.when(F.xxhash64(F.lit(SEED + 1), *key, r, high).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, i.cast("long"), swap)


def counted(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, mark (tells rows with equal doc_id apart) and further columns of docs."""
    return docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("mark"), *more)


def packed(rows: DataFrame, sizes: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """The rows with source_no instead of source, and start: the first word of each document in its source's stream (null
    for size 0). sizes: the same rows, for the sums."""
    buckets = 1 << max(0, (n_rows // BUCKET_ROWS)).bit_length()

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(sources.select("source", "source_no"), df["source"].eqNullSafe(sources["source"])).drop("source")
        return df.withColumn("h", F.xxhash64("doc_id", "size")).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))

    sums = placed(sizes).groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_no", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    inner = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed(rows).withColumn("upto", F.sum("size").over(inner)).join(sums.hint("merge"), ["source_no", "bucket"])
    start = F.when(F.col("size") > 0, F.col("first") + F.col("upto") - F.col("size"))
    return rows.withColumn("start", start).drop("h", "bucket", "upto", "first", "mark")


def draws(sources: DataFrame) -> DataFrame:
    """source_no, source, blocks, slots, last_words, shards: what there is of each source, what it gets (last_words: the
    words of its last slot), and the shards of the mix.

    A source gives whole passes first. Of the next pass it gives so many slots as the words left need; all blocks have
    BLOCK_WORDS words but the stream's last, whose slot in that pass the permutation tells.
    """
    rows = sources.where("source_size > 0").withColumns({
        "blocks": F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long"), "want": F.round("target").cast("long"),
    })
    rows = rows.withColumn("passes", F.floor(F.col("want") / F.col("source_size")).cast("long"))
    rows = rows.withColumns({
        "left": F.col("want") - F.col("passes") * F.col("source_size"),
        "tail": F.col("source_size") - (F.col("blocks") - 1) * BLOCK_WORDS,
        "tail_at": permuted(F.col("blocks") - 1, F.col("blocks"), F.col("source_no"), F.col("passes"), back=True),
    })
    # words of the first k slots of the pass: k blocks, less what the tail lacks once it is among them
    short = F.lit(BLOCK_WORDS) - F.col("tail")
    plain = F.ceil(F.col("left") / BLOCK_WORDS).cast("long")
    more = F.when(plain <= F.col("tail_at"), plain).otherwise(F.ceil((F.col("left") + short) / BLOCK_WORDS).cast("long"))
    # with the tail as the last slot wanted, that slot has tail words only
    more = F.when((F.col("left") > F.col("tail_at") * BLOCK_WORDS) & (F.col("left") <= F.col("tail_at") * BLOCK_WORDS + F.col("tail")), F.col("tail_at") + 1).otherwise(more)
    rows = rows.withColumn("more", F.when(F.col("left") > 0, more).otherwise(0))
    before = (F.col("more") - 1) * BLOCK_WORDS - F.when(F.col("tail_at") < F.col("more") - 1, short).otherwise(0)
    rows = rows.withColumns({"slots": F.col("passes") * F.col("blocks") + F.col("more"), "last_words": F.when(F.col("left") > 0, F.col("left") - before).otherwise(BLOCK_WORDS)})
    shards = F.ceil(F.sum("slots").over(Window.partitionBy(F.lit(1))) / SHARD_SLOTS)
    return rows.select("source_no", "source", "blocks", "slots", F.col("last_words").cast("long").alias("last_words"), F.greatest(shards, F.lit(1)).cast("long").alias("shards"))


def shard_of() -> Column:
    """The shard that slot number slot of a source draws."""
    return F.pmod(F.xxhash64(F.lit(SEED + 2), "source_no", "slot"), F.col("shards")).cast("int")


def shard_counts(sources: DataFrame) -> DataFrame:
    """shard, source_no, slots: the draw, how many slots of each source each shard gets."""
    slots = draws(sources).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    return slots.select(shard_of().alias("shard"), "source_no").groupBy("shard", "source_no").agg(F.count("*").alias("slots"))


def assembled(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """shard, slot, source, source_no, block, text, parts (start and number of words of each document in the block)."""
    # the words twice in the next step, else the optimizer would move their search into the loop over blocks
    rows = rows.where("size > 0").select("source_no", "start", "size", F.regexp_extract_all("text", F.lit(SPACED), F.lit(0)).alias("list"))
    first = F.col("start") - F.pmod("start", F.lit(BLOCK_WORDS))
    ends = F.col("start") + F.size("list")

    def piece(at: Column) -> Column:
        low, high = F.greatest("start", at), F.least(ends, at + BLOCK_WORDS)
        cut = F.slice("list", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(F.floor(at / BLOCK_WORDS).alias("block"), (low - at).alias("ahead"), (high - low).alias("words"), cut.alias("cut"))

    pieces = F.transform(F.sequence(first, ends - 1, F.lit(BLOCK_WORDS).cast("long")), piece)
    rows = rows.select("source_no", "start", F.inline(pieces)).join(draws(sources), "source_no").where("slots > 0")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.col("blocks")))))
    slot = F.col("turn") * F.col("blocks") + permuted(F.col("block"), F.col("blocks"), F.col("source_no"), F.col("turn"), back=True)
    rows = rows.withColumn("slot", slot).where("slot < slots").withColumn("shard", shard_of())
    # the last slot of a source is cut to the words that are still wanted
    left = F.when(F.col("slot") == F.col("slots") - 1, F.greatest(F.col("last_words") - F.col("ahead"), F.lit(0))).otherwise(F.col("words"))
    rows = rows.withColumn("words", F.least("words", left)).where("words > 0")
    text = F.array_join(F.when(F.col("words") < F.size("cut"), F.slice("cut", F.lit(1), F.col("words").cast("int"))).otherwise(F.col("cut")), "")
    part = F.struct("start", "words", text.alias("text"))
    # shards are dealt to tasks in turn, one each or as many to each: by hash, several would meet in some
    most = (draws(sources).agg(F.max("shards")).first()[0] or 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = most[0] if most[0] <= 2 * most[1] else most[1]
    rows = rows.select("shard", "slot", "source", "source_no", "block", part.alias("part")).repartitionById(tasks, "shard")
    rows = rows.groupBy("shard", "source_no", "slot").agg(F.first("source").alias("source"), F.first("block").alias("block"), F.sort_array(F.collect_list("part")).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    parts = F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["words"].alias("words")))
    rows = rows.select("shard", "slot", "source", "source_no", "block", text.alias("text"), parts.alias("parts"))
    return rows.sortWithinPartitions("shard", F.xxhash64(F.lit(SEED + 3), "source_no", "slot"))


def _mixed(docs: DataFrame, path: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places of the documents, sources, and the mix, which is written to path, or to a folder of its own."""
    space = Workspace(docs.sparkSession, "mixing")
    sizes = space.write(counted(docs), "sizes")
    sources = space.write(targets(sizes), "sources")
    # texts are written in between, so that the shuffle files of one step are gone before the next
    n_rows = sizes.count()
    with freed(docs.sparkSession):
        rows = space.write(packed(counted(docs, "text"), sizes, sources, n_rows), "packed")
    space.free()
    mixed = assembled(rows, sources)
    if path:
        mixed.write.option("compression", "zstd").parquet(path)
        mixed = docs.sparkSession.read.schema(mixed.schema).parquet(path)
    else:
        mixed = space.write(mixed, "mixed")
    space.free()
    return rows, sources, mixed


def shards(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The mix: shard, slot, source, source_no, block, text, parts. A shard's rows are together, in pseudorandom order."""
    return _mixed(docs, path)[2]


def mix(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken (words of it in the written mix, repeats counted)."""
    rows, sources, mixed = _mixed(docs, path)
    taken = mixed.select("source_no", F.inline("parts")).groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    # neither side has a bounded size, so they are merged, never broadcast
    out = rows.join(taken.hint("merge"), ["source_no", "start"], "left").join(sources, "source_no")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
