"""WARC as a content-addressed archive: payload bytes once by verified strong digest, exact record headers apart,
original records rebuilt by a join.

write_archive() leaves two tables in a folder: `payloads` (digest: SHA-256 in hex, n_bytes, payload) holds each
distinct payload once; `records` holds each record's exact header block (WARC and HTTP headers, as bytes) and the
digest of its payload. read_archive() checks every stored payload against its digest and parses the headers back;
rebuild() joins both into the bytes of the original record. All of it is native Spark.

Defined results: a null html is an empty payload; a null url becomes `urn:page:<page_id>`; line breaks in a url are
percent-encoded, so that a header stays one line; payloads of `min_bytes` or more that are equal share one response,
the record of the smallest page_id; rows that repeat a page_id give a record each, with a record id of its own. A stored
payload that fails its digest makes the read fail. A payload that very many pages share moves once: revisits are joined to
a digest and a length, the most frequent ones by a broadcast.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_hot, table

#: Fixed values of RFC 4648 and of the WARC format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
MIN_BYTES = 0


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are twenty bits, or four letters."""
    hexed = F.sha1(data)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*letters)


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))])


def describe(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, sha1, n_bytes."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), "\r", "%0D"), "\n", "%0A")
    rows = pages.select("page_id", url.alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    return rows.withColumns({"digest": F.sha2("payload", 256), "sha1": base32_sha1(F.col("payload")), "n_bytes": F.octet_length("payload").cast("long")})


def write_archive(pages: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """pages: page_id, url, html. Hot payloads are reduced before the shuffle, and only ids and digests are joined."""
    keyed = describe(pages)
    light = scratch.save(keyed.drop("payload").withColumn("row", F.monotonically_increasing_id()), "described")
    first = light.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("f"), F.count(F.lit(1)).alias("_n"))
    first = scratch.save(first.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.row").alias("first_row"), "_n"), "first")
    joined = join_hot(light, first, "digest", "inner")
    revisit = (F.col("n_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c, row: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.substring("digest", 1, 16), F.lit(":"), row.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("n_bytes").cast("string"))), F.lit("\r\n"))
    length = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    common = lambda kind, extra: F.concat(F.lit("WARC/1.1\r\n"), _lines(("WARC-Type", F.lit(kind)), ("WARC-Record-ID", name(F.col("page_id"), F.col("row"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), *extra, ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", length.cast("string"))), F.lit("\r\n"))
    head = F.when(revisit, common("revisit", [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", name(F.col("first_id"), F.col("first_row")))])).otherwise(common("response", []))
    records = joined.withColumn("http", http).select("page_id", "digest", F.encode(F.concat(head, F.col("http")), "UTF-8").alias("header"))
    scratch.save(records, "records")
    # One copy of each payload; copies of a task's own rows go before the shuffle.
    scratch.save(keyed.groupBy("digest", "n_bytes").agg(F.any_value("payload").alias("payload")), "payloads")


def read_archive(scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(records with the fields of their headers; payloads, each verified against its digest)."""
    verified = F.when((F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes")), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary"))
    payloads = scratch.load("payloads").withColumn("payload", verified)
    text = F.decode("header", "UTF-8")
    field = lambda n: F.regexp_extract(text, rf"\r\n{n}: ([^\r]*)\r\n", 1)
    refers = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:(-?\d+):", 1)
    records = scratch.load("records").withColumns({"record_type": field("WARC-Type"), "url": field("WARC-Target-URI"), "payload_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""), "refers_to": F.when(refers != "", refers.cast("long"))})
    return records, payloads


def rebuild(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """records with `record` (the exact WARC record: header, payload unless it's a revisit, two line ends) and `payload`, for revisits that of their response."""
    full = records.join(payloads.select("digest", "payload", "n_bytes"), "digest", "left")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    return full.withColumn("record", F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end)))


def proven(rebuilt: DataFrame) -> DataFrame:
    """Of response records as rebuild gives them, from the bytes of the record alone: payload_bytes, stored (the payload's SHA-1 in base32)."""
    head = F.octet_length("header")
    body = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    stated = F.regexp_extract(F.decode("header", "UTF-8"), r"Content-Length: (\d+)\r\n\r\n$", 1).cast("long")
    exact = (F.octet_length("record") == head + F.octet_length(body) + 4) & (F.octet_length(body) == stated)
    length = F.when(exact, F.octet_length(body).cast("long")).otherwise(F.raise_error(F.lit("a record is not as long as its headers say")).cast("long"))
    return rebuilt.select("digest", "page_id", "payload_digest", "record_type", "refers_to", length.alias("payload_bytes"), base32_sha1(body).alias("stored"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), scratch)
    records, payloads = read_archive(scratch)
    response = F.col("record_type") == "response"
    built = scratch.save(proven(rebuild(records.where(response), payloads)), "rebuilt")
    # Revisits have no payload of their own: length and digest are those of the rebuilt response.
    known = built.groupBy("digest").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("stored").alias("stored"))
    copies = records.where(~response).groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
    known = scratch.save(known.join(copies, "digest"), "known")
    again = join_hot(records.where(~response).select("digest", "page_id", "payload_digest", "record_type", "refers_to"), known, "digest")
    same = F.when(F.col("stored") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another digest than its payload has")))
    return built.unionByName(again).select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


_HEX = "sha1(coalesce(html, ''))"
_B32 = " || ".join(f"substr('{BASE32}', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {k}) & 31)::bigint, 1)" for i in range(8) for k in (15, 10, 5, 0))
OP6_SQL = f"""
with p as (select page_id, {_HEX} as h, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
f as (select d, min(page_id) as first_id from p group by d)
select page_id, n::bigint as payload_bytes, {_B32} as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from p join f using (d)
"""
