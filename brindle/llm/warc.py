"""Content-addressed web archive.

A payload is stored once under its SHA-256 digest; the exact headers of every
record are kept apart.  A record is rebuilt by joining its header with the
payload that its digest names.  Records whose payload another record already
holds are revisits.

Scale: payloads shuffle once, one copy for each task and digest at most (map
side), whatever the number of copies.  Headers and digests are narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import Workspace, join_by_key

# The alphabet of base32, and the line end of record headers.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_of_hex(hexadecimal: Column, digits: int = 40) -> Column:
    """Base32 of a digest given in hexadecimal; digits: a multiple of 5 (SHA-1 has 40)."""
    chars = []
    for at in range(0, digits, 5):
        value = F.conv(F.substring(hexadecimal, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*chars)


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for null.  Line ends in values are escaped."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archive(
    spark: SparkSession,
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Write a record for each row; returns the archive's folder.

    payloads: address (SHA-256, lower-case hex), payload, records (how many name it); each once.
    headers: page_id, address, head (the record's exact header bytes, as text).

    Of the records with equal payloads of ``min_bytes`` bytes at least, those
    with the smallest page id are responses and the others revisit it; smaller
    payloads are responses all.  ``date`` is written as every record's time,
    since the table has none.

    Null payloads are empty ones, null urls leave their line out.  A null page
    id comes after all others and is written as ``null``.  Repeated rows give a
    record each.  An empty table gives an archive without records.  Other
    columns are not read.  Different payloads of one address raise an error.
    """
    space = Workspace(spark, "archive")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), base32_of_hex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    groups = digests.groupBy("address").agg(
        F.count("*").alias("records"), F.min("page_id").alias("first_id"), F.min("sha1").alias("low"), F.max("sha1").alias("high"), F.min("bytes").alias("least"), F.max("bytes").alias("most")
    )
    sure = F.when((F.col("low") == F.col("high")) & (F.col("least") == F.col("most")), F.col("address")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads have the address "), F.col("address")))
    )
    space.save(rows.select(F.sha2("payload", 256).alias("address"), "payload").groupBy("address").agg(F.first("payload").alias("payload"), F.count("*").alias("records")), "payloads")
    own = join_by_key(digests, space.save(groups.select(sure.alias("address"), "first_id", "records"), "groups"), ["address"], "records")
    response = (F.col("bytes") < min_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    block_bytes = F.octet_length(http) + F.when(response, F.col("bytes")).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(response, F.lit("response")).otherwise("revisit")),
        _line("WARC-Record-ID", _record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(~response, _record_id(F.col("first_id")))),
        _line("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
        http,
    )
    space.save(own.select("page_id", "address", head.alias("head")), "headers")
    return space.path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the records: page_id, record_type, refers_to, payload_bytes, payload_digest, record.

    ``record`` holds the exact bytes of the original record: its header and, of
    a response, the payload, which a join brings; payload_bytes and
    payload_digest come from the stored bytes.  This raises where the SHA-256 of
    these isn't their address, or a header's digest or length isn't that of its
    payload.
    """
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what} "), F.col("address")))
    stored = spark.read.parquet(f"{path}/payloads")
    true = F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(wrong("payload differs from its address"))
    about = stored.select(true.alias("address"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "records")
    about = Workspace(spark, "payload_digests").save(about, "about")
    heads = spark.read.parquet(f"{path}/headers")
    said = lambda pattern: F.regexp_extract("head", pattern, 1)
    kind, refers = said(r"(?m)^WARC-Type: (\w+)$"), said(r"(?m)^WARC-Refers-To: <urn:page:(-?\d+)>$")
    parsed = heads.select(
        "page_id",
        "address",
        "head",
        kind.alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        said(r"(?m)^WARC-Payload-Digest: sha1:(\w+)$").alias("digest"),
        said(r"\nContent-Length: (\d+)\r\n\r\n").cast("long").alias("length"),
        F.octet_length(F.substring_index("head", CRLF + CRLF, -2)).alias("http"),
    )
    # a page may share its payload with any share of the others, but the payload itself comes to responses only
    known = join_by_key(parsed, about, ["address"], "records")
    is_response = F.col("record_type") == "response"
    length = F.col("http") + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    sure = F.when((F.col("digest") == F.col("payload_digest")) & (F.col("length") == length), F.col("head")).otherwise(wrong("a header differs from its payload"))
    fields = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    checked = known.select(*fields, "address", sure.alias("head"))
    responses = checked.filter(is_response).join(stored.select("address", "payload"), "address")
    revisits = checked.filter(~is_response).withColumn("payload", F.lit(""))
    return responses.unionByName(revisits).select(*fields, F.concat("head", "payload", F.lit(CRLF + CRLF)).cast("binary").alias("record"))
