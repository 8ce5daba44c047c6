import random

from scrivel.operators import highlight
from scrivel.operators.search import query_tokens


def merged(text, keyword):
    tokens = {t for t, _ in query_tokens(keyword)}
    out = []
    for p in (i for i in range(len(text)) if text[i : i + 2] in tokens):
        if out and p - out[-1][1] <= 1:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    best = max(out, key=lambda s: s[1] - s[0], default=None)
    return [best] if best and best[1] - best[0] + 1 <= 100 else out


def test_intervals_are_found_in_one_pass(spark):
    rng = random.Random(8)
    texts = [None, "", *["".join(rng.choice("abat-\n中\U00020000") for _ in range(rng.randint(0, 40))) for _ in range(400)], "ab" * 20_000 + "-" * 9 + "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    for keyword in ("ab", "aaab", "bat", "a中a", "-", "x"):
        out = highlight.with_intervals(docs, keyword, "body", "h")
        for r in out.collect():
            want = None if r.body is None else merged(r.body, keyword)
            assert (None if r.h is None else [list(x) for x in r.h]) == want, (keyword, r.body)
        assert "regexp_extract_all" not in out._jdf.queryExecution().toString()  # an array of all characters was made
