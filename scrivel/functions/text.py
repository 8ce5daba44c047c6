"""Pages to documents, documents to character bigrams. Built-in functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE = r"(?is)<title.*?>(.*?)</title>"
#: comments, scripts, styles and titles with what is in them, and all other tags; a tag ends at its first >
MARKUP = r"(?is)<(?:!--.*?-->|script[^>]*>.*?</script>|style[^>]*>.*?</style>|title[^>]*>.*?</title>|.[^>]*>)"
BLANKS = r"[\t\n\f\r ]+"
#: white space that trimming takes off, Unicode's included
EDGE = r"\t-\r \x{85}\p{Z}"
INDEXED = "A-Za-z0-9一-龥"
BIGRAM = f"[{INDEXED}]{{2}}"


def trimmed(c: Column) -> Column:
    """The pattern goes through the whole text, so it is for those that still have an edge once plain blanks are off."""
    plain = F.trim(c)
    ends = F.concat(F.left(plain, F.lit(1)), F.right(plain, F.lit(1)))
    return F.when(ends.rlike(f"[{EDGE}]"), F.regexp_extract(plain, f"(?s)^[{EDGE}]*(.*[^{EDGE}])", 1)).otherwise(plain)


def title_of(html: Column) -> Column:
    return trimmed(F.regexp_extract(html, TITLE, 1))


def body_of(html: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(html, MARKUP, " "), BLANKS, " "))


def parse_documents(pages: DataFrame) -> DataFrame:
    """doc_id, url, title, body of the pages that have a title; the others are no documents."""
    html = F.col("html")
    return pages.where(html.rlike(TITLE)).select(F.col("page_id").alias("doc_id"), "url", title_of(html).alias("title"), body_of(html).alias("body"))


def bigrams(s: Column) -> Column:
    """The overlapping bigrams of indexed characters, in order. A lookahead finds them in one pass over the text."""
    return F.regexp_extract_all(s, F.lit(f"(?=({BIGRAM}))"), F.lit(1))


def bigram_positions(s: Column) -> Column:
    """array<struct<token, pos>>: bigrams with their code point offsets, linear in the text."""
    chars = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))

    def pairs(c: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0)))
        return F.transform(at, lambda i: F.struct(F.concat(F.get(c, i), F.coalesce(F.get(c, i + 1), F.lit(""))).alias("token"), i.alias("pos")))

    # one evaluation of the characters, bound by a lambda
    made = F.transform(F.array(chars), pairs)
    return F.filter(F.get(made, F.lit(0)), lambda x: x["token"].rlike(f"^{BIGRAM}$"))


def host_of(url: Column) -> Column:
    """Host without user info and port; empty for urls that have none."""
    raw = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(raw, "^.*@", ""), ":[^:]*$", "")
