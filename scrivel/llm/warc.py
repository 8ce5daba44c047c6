"""Content-addressed WARC archive.

1. Each row becomes a WARC record: a response, or a revisit of the response with an equal payload. Equal means equal
   SHA-256 and length; the header also gives the SHA-1 that the format asks for.
2. Payload bytes are stored once by SHA-256, as gzipped WARC files of resource records.
3. Record headers are stored apart from payloads, byte for byte as they would stand in an ordinary archive, in a table of
   uid, sha, size and header.
4. Reading streams the payload files, however large, and cuts records by Content-Length alone; every payload is verified
   against both of its digests and its length. Original records are rebuilt by joining headers with payloads by digest.

Urls are kept reversibly: one with a CR or LF has these and % percent-encoded, and the header says so (X-Target-Escaped);
a null url has no WARC-Target-URI.

Edge cases: a null html is an empty payload; page ids may repeat: of the rows with the smallest page_id and equal payload,
fully repeated ones included, exactly one is the response; a null page_id sorts last and refers_to is null for revisits of
it; an empty table gives an empty archive; other columns are ignored. A payload may hold anything, also lines like those
of a record. Copies of a payload are pre-aggregated before the shuffle, and a payload of a third of all rows is spread
over tasks where headers meet payloads.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivel.llm.common import Workspace, batch_of, bounded, freed, short, spread_join

#: payloads of so few bytes are never revisited
MIN_BYTES = 0
#: records of a payload file; reading doesn't depend on it, as files are streamed
FILE_RECORDS = 1_000
_DATE = "2024-01-01T00:00:00Z"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def base32_of_hex(digest: Column) -> Column:
    """The base32 of 160 bits in hex, 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *_DIGITS)


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, size, sha and sha1 of every row."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("sha"), F.sha1(raw).alias("sha1"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _header(judged: DataFrame) -> Column:
    """The header block of each record, up to the blank line."""
    odd = F.col("url").rlike("[\r\n]")
    escaped = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    none = F.lit("")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    refers = F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", F.concat(F.lit("<urn:scrivel:"), number("first_uid"), F.lit(">"))), _line("X-Refers-To-Page", number("first_page")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("kind")), _line("WARC-Record-ID", F.concat(F.lit("<urn:scrivel:"), number("uid"), F.lit(">"))), _line("WARC-Date", F.lit(_DATE)),
        F.when(F.col("url").isNull(), none).otherwise(_line("WARC-Target-URI", F.when(odd, escaped).otherwise(F.col("url")))), F.when(odd, "X-Target-Escaped: 1\r\n").otherwise(none),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), _line("X-Payload-SHA256", F.col("sha")), _line("X-Page-ID", number("page_id")),
        F.when(F.col("kind") == "revisit", refers).otherwise(none), _line("Content-Length", F.when(F.col("kind") == "revisit", "0").otherwise(F.col("size").cast("string"))), F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, space: Workspace, min_bytes: int = MIN_BYTES) -> tuple[str, str]:
    """Writes a record for each row; returns the folders of payload files and of headers."""
    # written once: ids that tell rows apart, whatever happens to executors; no payloads
    keyed = space.write(_keyed(pages).withColumn("uid", F.monotonically_increasing_id()), "keyed")
    first = keyed.groupBy("sha", "size").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")).alias("f"), F.count("*").alias("k"))
    first = space.write(first.select("sha", "size", "k", F.col("f.uid").alias("first_uid"), F.col("f.page_id").alias("first_page")), "first")
    judged = spread_join(keyed, first.drop("k"), ["sha", "size"], first.select("sha", "size", "k"))
    single = (F.col("uid") == F.col("first_uid")) | (F.col("size") < min_bytes)
    judged = judged.withColumns({"kind": F.when(single, "response").otherwise("revisit"), "digest": base32_of_hex(F.col("sha1"))})
    # exact bytes, so a binary column
    judged.select("uid", "sha", "size", _header(judged).cast("binary").alias("header")).write.option("compression", "zstd").parquet(space.path("headers"))
    space.drop("keyed")
    space.drop("first")
    # copies go before the shuffle
    body = F.coalesce("html", F.lit(""))
    bodies = pages.select(F.sha2(body.cast("binary"), 256).alias("sha"), body.alias("html")).groupBy("sha").agg(F.first("html").alias("html"))
    raw = F.col("html").cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"), _line("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), "sha", F.lit(">"))), _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1(raw)))), _line("X-Payload-SHA256", F.col("sha")), _line("Content-Length", F.octet_length(raw).cast("string")), F.lit("\r\n"),
    )
    # the text writer ends each record with the two line ends that the format asks for
    with freed(pages.sparkSession):
        bodies.select(F.concat(head, "html").alias("value")).write.options(lineSep="\r\n\r\n", maxRecordsPerFile=FILE_RECORDS, compression="gzip").text(space.path("payloads"))
    space.free()
    return space.path("payloads"), space.path("headers")


class Records:
    """Cuts a stream of bytes into (header block, payload); what is held is one record and the piece fed last."""

    def __init__(self):
        self.held, self.need = bytearray(), 0

    def feed(self, data: bytes):
        self.held += data
        at = 0
        while len(self.held) - at >= max(self.need, 1):
            stop = self.held.find(b"\r\n\r\n", at)
            if not self.held.startswith(b"WARC/"[: len(self.held) - at], at):
                raise ValueError("no record where one should begin")
            if stop < 0:
                break
            stop += 4
            length = int(bytes(self.held[at:stop]).rsplit(b"\r\nContent-Length: ", 1)[1].split(b"\r\n", 1)[0])
            end = stop + length + 4
            if len(self.held) < end:
                self.need = end - at
                break
            if self.held[end - 4 : end] != b"\r\n\r\n":
                raise ValueError("a record has another length than it says")
            yield bytes(self.held[at:stop]), bytes(self.held[stop : end - 4])
            at, self.need = end, 0
        del self.held[:at]

    def close(self) -> None:
        if self.held:
            raise ValueError("the archive ends within a record")


_STORED = "sha string, size long, digest string, payload string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha, size, digest and payload of each stored payload, verified. Gzipped files come whole and in order to one task,
    line by line, so no file has to fit in memory."""

    def run(batches):
        records = Records()
        for batch in short(batches, 2_000):
            cols: list[list] = [[] for _ in range(4)]
            for head, payload in records.feed(("\n".join(batch.column("value").to_pylist()) + "\n").encode("utf-8", "surrogatepass")):
                h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)
                sha, digest = h["X-Payload-SHA256"], h["WARC-Payload-Digest"][5:]
                if hashlib.sha256(payload).hexdigest() != sha or base32_sha1(payload) != digest:
                    raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match its digest")
                for c, v in zip(cols, (sha, len(payload), digest, payload.decode("utf-8", "surrogatepass"))):
                    c.append(v)
            if cols[0]:
                yield batch_of(_STORED, cols)
        records.close()

    return bounded(spark.read.option("lineSep", "\n").text(path)).mapInArrow(run, _STORED)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """uid, sha, size, header and what it says: page_id, url, kind, digest, refers_to."""
    rows = spark.read.schema("uid long, sha string, size long, header binary").parquet(path)
    # lines begin after a line end, which no value holds
    said = lambda name: F.regexp_extract("text", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    has = lambda name: F.contains("text", F.lit(f"\r\n{name}: "))
    rows = rows.withColumn("text", F.col("header").cast("string")).withColumn("uri", said("WARC-Target-URI"))
    plain = F.replace(F.replace(F.replace("uri", F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    url = F.when(has("WARC-Target-URI"), F.when(has("X-Target-Escaped"), plain).otherwise(F.col("uri")))
    return rows.select(
        "uid", "sha", "size", "header", said("X-Page-ID").try_cast("long").alias("page_id"), url.alias("url"), said("WARC-Type").alias("kind"),
        F.expr(r"substring(regexp_extract(text, '\r\nWARC-Payload-Digest: ([^\r\n]*)\r\n', 1), 6)").alias("digest"), said("X-Refers-To-Page").try_cast("long").alias("refers_to"),
    )


def reconstruct(spark: SparkSession, folders: tuple[str, str]) -> DataFrame:
    """Every original record: uid, page_id, url, kind, refers_to, digest, header and its full payload, joined by digest.

    A header whose payload is missing, or of another length or digest than it says, is an error.
    """
    heads = read_headers(spark, folders[1])
    stored = read_payloads(spark, folders[0]).select("sha", F.col("size").alias("stored_size"), F.col("digest").alias("stored_digest"), "payload")
    counts = Workspace(spark, "warc-counts").write(heads.groupBy("sha").agg(F.count("*").alias("k")), "counts")
    both = spread_join(heads, stored, ["sha"], counts, "left")
    same = F.coalesce((F.col("stored_size") == F.col("size")) & (F.col("stored_digest") == F.col("digest")), F.lit(False))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload for record "), F.col("uid").cast("string"))))
    return both.select("uid", "page_id", "url", "kind", "refers_to", "digest", "header", checked.alias("payload"))


def originals(spark: SparkSession, folders: tuple[str, str]) -> DataFrame:
    """uid and the bytes of each record as an ordinary archive would have them: header, payload of responses, two line ends."""
    block = F.when(F.col("kind") == "response", F.col("payload").cast("binary")).otherwise(F.lit(b""))
    return reconstruct(spark, folders).select("uid", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archive, reads it back and rebuilds the records: page_id, payload_bytes, payload_digest, record_type,
    refers_to; size and digest are taken of the rebuilt payloads."""
    spark = pages.sparkSession
    folders = write_archive(pages, Workspace(spark, "warc"), min_bytes)
    raw = F.col("payload").cast("binary")
    return reconstruct(spark, folders).select(
        "page_id", F.octet_length(raw).cast("long").alias("payload_bytes"), base32_of_hex(F.sha1(raw)).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"
    )


_CHARS = _DIGITS[1]
#: digests, sizes and who is the response, in DuckDB; base32 from hex, five bits a character. Pages whose page_id repeats
#: with an equal payload would need row ids; the given tables have none.
ORACLE_SQL = f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS size, sha1(html) AS hex, min(page_id) OVER (PARTITION BY sha256(html)) AS first FROM a),
c AS (SELECT *, list_transform(range(8), lambda i: ('0x' || hex[5 * i + 1 : 5 * i + 5])::INT) AS words FROM b)
SELECT page_id, size::BIGINT AS payload_bytes,
  list_aggregate(list_transform(words, lambda w: list_aggregate(list_transform([32768, 1024, 32, 1], lambda p: '{_CHARS}'[(w // p) % 32 + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM c
"""
