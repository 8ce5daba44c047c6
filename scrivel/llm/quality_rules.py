"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation estimates how often each rule
votes how on good and on bad documents, and the posterior probability of good replaces a filter that all must pass.

There is more than one way to be bad, and rules look for different ones: a text full of symbols repeats no more than a
good one does. So a document is good, or bad in the way that one of the rules looks for; that rule then votes bad on it,
and any rule may vote bad on a good document by mistake. Estimation starts at even odds for every accused document and
learns how often each rule is wrong, from what the other rules say of the same documents; no labels and no tables of
likelihoods are given. A rule's accusation holds unless the documents that it accuses look like the good ones otherwise
and are too many to be of a kind of their own.

Everything that touches a text is a built-in function. Votes are counted by pattern (at most 3^7 rows, whatever the
corpus), the estimation runs on these counts, and posteriors go back by pattern.

Edge cases: null and empty texts have no words and fail the base rule; words are `[^\\x20\\x09-\\x0D]+`; a text of any
length is read whole; repeated rows count and are returned as often as they stand there; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace

_SPACE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: rule -> (condition of a vote for bad, condition of a vote for good), over the columns of statistics()
RULES = {
    "length": ("n_words < 50", "n_words >= 100"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "capitals": ("10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    "marks": ("10 * n_marks > 3 * n_words", "20 * n_marks <= n_words"),
}


def _without(column: str, chars: str) -> Column:
    """How many characters of the column are among chars."""
    return (F.length(column) - F.length(F.translate(column, chars, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text. Three-word windows are compared by 64-bit hashes, within one text only."""
    n = F.size("words")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    out = out.withColumn("words", F.filter(F.split("t", r"[ \t-\r]+"), lambda w: w != ""))
    # (lines with a word) as they stand
    out = out.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.translate(x, _SPACE, "") != ""))
    out = out.select(
        "doc_id", n.cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.translate("t", _SPACE, "")).cast("long").alias("word_chars"),
        _without("t", "#*$%&|<>").alias("n_symbols"), _without("t", _UPPER).alias("n_upper"), _without("t", "!?").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    three = F.transform(F.sequence(F.lit(0), F.size("h") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)))
    out = out.withColumn("g", F.when(F.size("h") >= 3, three).otherwise(F.array().cast("array<bigint>"))).drop("h")
    # Windows found twice: sort (hash, place) as one number, the place in the low bits; equal hashes are neighbours then.
    # The place leads back to the whole hash, so the bits that the shift pushes out are compared as well.
    out = out.withColumn("bits", F.ceil(F.log2(F.size("g") + 2)).cast("int"))
    packed = F.expr("sort_array(transform(g, (x, i) -> shiftleft(x, bits) | cast(i AS BIGINT)))")
    again = F.size(F.array_distinct("g")) < F.size("g")
    out = out.withColumn("p", F.when(again, packed).otherwise(F.array().cast("array<bigint>")))
    at = "get(g, cast({} & (shiftleft(1L, bits) - 1) AS INT))"
    seen = F.expr(f"transform(p, x -> {at.format('x')})")
    out = out.withColumn("v", seen)
    places = F.expr(
        "filter(transform(p, (x, i) -> CASE WHEN get(v, i) = get(v, i - 1) OR get(v, i) = get(v, i + 1)"
        " THEN cast(x & (shiftleft(1L, bits) - 1) AS INT) END), x -> x IS NOT NULL)"
    )
    out = out.withColumn("q", F.sort_array(places))
    covered = F.expr("aggregate(transform(q, (x, i) -> least(3, coalesce(get(q, i + 1), x + 3) - x)), 0L, (a, x) -> a + x)")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_upper", "n_marks")


def votes(stats: DataFrame) -> DataFrame:
    """stats with a column vote_<rule> for each rule: 0 bad, 1 abstains, 2 good."""
    return stats.withColumns({f"vote_{r}": F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) for r, (bad, good) in RULES.items()})


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], list[list[list[float]]]]:
    """The posterior probability of good for each pattern of votes, and how often each rule votes bad, abstains and votes
    good, for good documents and then for each kind of bad ones. One pseudo-count for each kind, and one for each vote
    spread as the rule's votes are, keep estimates off zero."""
    k, total = len(RULES), sum(patterns.values())
    if not total:
        return {}, []
    kinds = range(k + 1)  # 0 is good, 1 + j bad in the way of rule j
    overall = [[sum(n for p, n in patterns.items() if p[j] == v) / total for v in range(3)] for j in range(k)]
    share = {}
    for p in patterns:
        accused = [1 + j for j, v in enumerate(p) if v == 0]
        share[p] = {0: 0.5, **dict.fromkeys(accused, 0.5 / len(accused))} if accused else {0: 1.0}
    table: list[list[list[float]]] = []
    for _ in range(rounds):
        mass = [sum(share[p].get(c, 0.0) * n for p, n in patterns.items()) for c in kinds]
        table = [[[overall[j][v] for v in range(3)] for j in range(k)] for _ in kinds]
        for p, n in patterns.items():
            for c, part in share[p].items():
                for j, v in enumerate(p):
                    table[c][j][v] += part * n
        table = [[[x / (mass[c] + 1) for x in votes_] for votes_ in table[c]] for c in kinds]
        prior = [log((m + 1) / (total + k + 1)) for m in mass]
        for p in patterns:
            logs = {c: prior[c] + sum(log(table[c][j][v]) for j, v in enumerate(p) if c != 1 + j) for c in share[p]}
            top = max(logs.values())
            whole = sum(exp(x - top) for x in logs.values())
            share[p] = {c: exp(x - top) / whole for c, x in logs.items()}
    return {p: share[p][0] for p in patterns}, table


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior."""
    spark = docs.sparkSession
    table = Workspace(spark, "rules").write(votes(statistics(docs)), "votes")
    columns = [f"vote_{r}" for r in RULES]
    counted = table.groupBy(*columns).count().collect()  # at most 3 ** len(RULES) rows
    posterior, _ = estimate({tuple(r[c] for c in columns): r["count"] for r in counted})
    known = spark.createDataFrame([(*p, x) for p, x in posterior.items()], ", ".join(f"{c} int" for c in columns) + ", posterior double")
    return table.join(F.broadcast(known), columns).select(*COUNTS, base_failed().alias("base_failed"), (~base_failed() & (F.col("posterior") >= threshold)).alias("kept"), "posterior")


COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def base_counts(docs: DataFrame) -> DataFrame:
    """What judge() returns without the verdict, which SQL can't express."""
    return statistics(docs).select(*COUNTS, base_failed().alias("base_failed"))


#: base_counts() in DuckDB
COUNTS_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM a),
c AS (SELECT *, list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS g FROM b),
n AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(g) AS x FROM c) GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT doc_id, unnest(range(len(g))) AS i, unnest(g) AS x FROM c),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT p.doc_id, unnest([i, i + 1, i + 2]) AS j FROM p JOIN n ON n.doc_id = p.doc_id AND n.x = p.x) GROUP BY doc_id),
e AS (SELECT c.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN hit USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM e
"""
