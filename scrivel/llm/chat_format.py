"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once: that speaker's turns as the assistant's, those of
the others as named users', the system's as they are. Masks give the characters to train on: the speaker's text and the
end mark after it. A rendering longer than PART_CHARS is returned in several parts, cut between turns, so no row has to
hold a conversation of any length; part and masks count from the start of the part.

Offsets are running sums in blocks of BLOCK_TURNS turn numbers first, then over the blocks.

Edge cases: a null role is the speaker `unknown`, a null text is empty; turns are ordered by turn (null first), then
role and text; repeated turns are all rendered; each turn without a conv_id is a conversation of its own, as nothing says
what it belongs to; a conversation of system turns alone has
no participant and no rows; control marks in a text are broken up (`<|` to `< |`); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_CHARS = 65_536
BLOCK_TURNS = 64


def rotate(conversations: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, participant, part, n_turns, n_targets, text, masks (`start:end` of characters, comma-joined)."""
    name = F.coalesce("role", F.lit("unknown"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = conversations.select("conv_id", "turn", name.alias("name"), body.alias("body"))
    alone = turns.where("conv_id IS NULL AND name <> 'system'")
    turns = turns.where("conv_id IS NOT NULL")
    people = turns.where("name <> 'system'").select(F.col("conv_id").alias("of"), F.col("name").alias("participant")).distinct()
    rows = turns.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    target = F.col("name") == F.col("participant")
    head = F.when(F.col("name") == "system", "<|system|>\n").when(target, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user:"), "name", F.lit("|>\n")))
    rows = rows.withColumns({"target": target & (F.col("name") != "system"), "head": head, "block": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK_TURNS)})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit("<|end|>\n"))).withColumn("size", F.length("piece").cast("long"))
    sums = rows.groupBy("conv_id", "participant", "block").agg(F.sum("size").alias("chars"))
    before = F.sum("chars").over(Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("conv_id").alias("of"), F.col("participant").alias("by"), F.col("block").alias("in"), F.coalesce(before, F.lit(0)).alias("first"))
    inside = Window.partitionBy("conv_id", "participant", "block").orderBy(F.col("turn").asc_nulls_first(), "name", "body").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("participant") == F.col("by")) & (F.col("block") == F.col("in")))
    rows = rows.withColumn("start", F.col("first") + F.col("upto") - F.col("size"))
    rows = rows.withColumn("part", F.floor(F.col("start") / part_chars))
    item = F.struct("start", "piece", "target", (F.length("piece") - F.length("body") - 8).alias("lead"))
    parts = rows.groupBy("conv_id", "participant", "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    own = F.filter("items", lambda x: x["target"])
    base = F.get("items", F.lit(0))["start"]
    masks = F.transform(own, lambda x: F.concat((x["start"] - base + x["lead"]).cast("string"), F.lit(":"), (x["start"] - base + F.length(x["piece"]) - 1).cast("string")))
    parts = parts.select(
        "conv_id", "participant", "part", F.size("items").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_targets"),
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("text"), F.array_join(masks, ",").alias("masks"),
    )
    one = F.lit(1).cast("long")
    own, head = F.concat(F.lit("<|assistant|>\n"), "body", F.lit("<|end|>\n")), len("<|assistant|>\n")
    mask = F.concat(F.lit(f"{head}:"), (F.length("body") + head + len("<|end|>")).cast("string"))
    return parts.union(alone.select("conv_id", "name", F.lit(0).cast("long"), one, one, own, mask))


#: the same in DuckDB, with one running sum for each rendering
ORACLE_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, name AS participant FROM turns WHERE name <> 'system'),
pieces AS (SELECT t.conv_id, p.participant, t.turn, t.name, t.body, t.name = p.participant AS target,
  CASE WHEN t.name = 'system' THEN '<|system|>' || chr(10) WHEN t.name = p.participant THEN '<|assistant|>' || chr(10) ELSE '<|user:' || t.name || '|>' || chr(10) END AS head
  FROM turns t JOIN people p ON t.conv_id = p.conv_id),
sized AS (SELECT *, head || body || '<|end|>' || chr(10) AS piece, row_number() OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, name, body) AS no FROM pieces),
placed AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY conv_id, participant ORDER BY no) - length(piece))::BIGINT AS first FROM sized),
parts AS (SELECT *, first // {PART_CHARS} AS part FROM placed),
based AS (SELECT *, first - min(first) OVER (PARTITION BY conv_id, participant, part) AS skip FROM parts)
SELECT conv_id, participant, part, count(*) AS n_turns, count(*) FILTER (target) AS n_targets, string_agg(piece, '' ORDER BY no) AS text,
  coalesce(string_agg((skip + length(head))::BIGINT || ':' || (skip + length(piece) - 1)::BIGINT, ',' ORDER BY no) FILTER (target), '') AS masks
FROM based GROUP BY conv_id, participant, part
UNION ALL SELECT conv_id, name, 0, 1, 1, '<|assistant|>' || chr(10) || body || '<|end|>' || chr(10), '14:' || (14 + length(body) + 7) FROM turns WHERE conv_id IS NULL AND name <> 'system'
"""
