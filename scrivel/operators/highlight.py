"""Highlight intervals and abstracts of hits, over one document each."""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.functions.batches import short_batches
from scrivel.operators.search import query_tokens

OPEN, CLOSE, WIDTH = "<span style='color:red'>", "</span>", 100


def islands(keyword: str) -> re.Pattern | None:
    """A match for each run of a keyword's bigrams that lie at most one character apart; None for one without bigrams."""
    tokens = list(dict.fromkeys(t for t, _ in query_tokens(keyword)))
    hit = "(?:" + "|".join(f"{t[0]}(?={t[1]})" for t in tokens) + ")"
    return re.compile(f"(?s){hit}(?:.??{hit})*+.") if tokens else None


def _spans(text: str, pattern: re.Pattern) -> list[dict]:
    every = [{"s": m.start(), "e": m.end() - 1} for m in pattern.finditer(text)]
    best = max(every, key=lambda x: x["e"] - x["s"], default=None)
    return [best] if best and best["e"] - best["s"] + 1 <= WIDTH else every


def with_intervals(docs: DataFrame, keyword: str, column: str, name: str) -> DataFrame:
    """docs with name: the intervals (s, e; e inclusive) to highlight, merged over gaps of one character.

    The first longest interval alone, but all of them if it is longer than WIDTH. One pass over the text finds them.
    """
    pattern = islands(keyword)
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    short_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<s: int, e: int>>")
    def run(texts: pa.Array) -> pa.Array:
        found = (None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist())
        return pa.array([None if t is None else _spans(t, pattern) if pattern else [] for t in found], kind)

    return docs.withColumn(name, run(F.col(column)))


def marked(s: Column, spans: Column, start: Column, end: Column) -> Column:
    """s[start:end) with each interval in tags."""
    cut = lambda a, b: F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))
    pieces = F.transform(spans, lambda x, i: F.concat(
        cut(F.when(i == 0, start).otherwise(F.get(spans, i - 1)["e"] + 1), x["s"]), F.lit(OPEN), cut(x["s"], x["e"] + 1), F.lit(CLOSE)
    ))
    return F.concat(F.array_join(pieces, ""), cut(F.get(spans, F.size(spans) - 1)["e"] + 1, end))


def highlighted(docs: DataFrame, keyword: str) -> DataFrame:
    """docs with title_marked and abstract: about WIDTH characters around the marks, or the body's first WIDTH."""
    out = with_intervals(with_intervals(docs, keyword, "title", "title_spans"), keyword, "body", "body_spans")
    h, size = F.col("body_spans"), F.length("body")
    first, last = F.get(h, F.lit(0))["s"], F.get(h, F.size(h) - 1)["e"]
    room = WIDTH - (last - first + 1)
    out = out.withColumn("_pad", F.when(room >= 0, F.floor(room / 2)).otherwise(-F.floor(-room / 2)).cast("int"))
    out = out.withColumn("_start", F.greatest(first - F.col("_pad"), F.lit(0)))
    reach = F.when(F.col("_start") - F.col("_pad") >= 0, last + F.col("_pad")).otherwise(last + F.col("_pad") - F.col("_start"))
    # a span wider than the window would start before it and end behind it: the window is moved out to hold it
    out = out.withColumn("_end", F.greatest(F.least(size, reach), last + 1)).withColumn("_start", F.least("_start", first))
    abstract = F.when(F.size(h) > 0, marked(F.col("body"), h, F.col("_start"), F.col("_end"))).otherwise(F.substring("body", 1, WIDTH))
    t = F.col("title_spans")
    title = F.when(F.size(t) > 0, marked(F.col("title"), t, F.lit(0), F.length("title"))).otherwise(F.col("title"))
    return out.withColumns({"abstract": abstract, "title_marked": title}).drop("_pad", "_start", "_end")
