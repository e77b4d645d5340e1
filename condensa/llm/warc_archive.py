"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder. ``headers`` has a row a record: the exact bytes of
its WARC header, those of its HTTP header, and the SHA-256 of its payload. ``payloads`` has each
payload once, by that digest. Original records come back by a join on the digest, and reading
hashes every payload again: one that doesn't fit its digest raises an error.

Of records with equal payloads the one with the smallest id is a ``response``; the others are
``revisit`` records that refer to it. Payloads under ``min_bytes`` bytes are always responses.

Scale: digests are grouped with map-side sums; only digests that occur more than once are joined
back (a hot one is a skewed join, which Spark splits). Payloads that occur once are written where
they are read; of the others one a task and digest is shuffled, since a rank-one window is limited
before its exchange.

Defined cases: a null payload is empty. A row with a null id is written like others; it is a
response only if no row with an id has its payload. Rows that repeat an id and payload are records
each, and responses alike if theirs is the smallest id. A null address leaves out its header line.
An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, work_dir

#: Digests that repeat are broadcast up to this many (64 MB); beyond it the join shuffles.
BROADCAST_DIGESTS = 1_000_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal: four groups of forty bits."""
    chars = []
    for group in range(4):
        bits = F.conv(F.substring(hexadecimal, 10 * group + 1, 10), 16, 10).cast("long")
        chars += [F.substring(F.lit(BASE32), F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*chars)


def _payload(column: str) -> Column:
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def write_archive(records: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    own = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("payload"))
    digests = own.select("record_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    repeated = cut(digests.groupBy("digest").agg(F.min("record_id").alias("first_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    joined = digests.join(repeated, "digest", "left")
    revisit = (F.col("bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:x-record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("record_id"))),
        F.coalesce(line("WARC-Target-URI", address), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first_id"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.lit(len(_HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    joined.select("record_id", "digest", F.encode(warc, "UTF-8").alias("warc_header"), F.encode(F.lit(_HTTP), "UTF-8").alias("http_header")).write.parquet(f"{out}/headers")
    # Only payloads that repeat are shuffled, as one a task and digest; the others are written where they are.
    repeated = repeated.select(F.col("digest").alias("_repeated"))
    stored = own.select(F.sha2("payload", 256).alias("digest"), "record_id", "payload").join(repeated, F.col("digest") == F.col("_repeated"), "left")
    once = F.row_number().over(Window.partitionBy("digest").orderBy("record_id"))
    alone = stored.filter("_repeated IS NULL").select("digest", "payload")
    first = stored.filter("_repeated IS NOT NULL").withColumn("_n", once).filter("_n = 1").select("digest", "payload")
    alone.unionByName(first).write.parquet(f"{out}/payloads")


def _verified(payloads: DataFrame) -> DataFrame:
    wrong = F.sha2("payload", 256) != F.col("digest")
    return payloads.withColumn("payload", F.when(wrong, F.raise_error(F.concat(F.lit("payload damaged: "), F.col("digest"))).cast("binary")).otherwise(F.col("payload")))


def _field(text: Column, key: str) -> Column:
    found = F.regexp_extract(text, rf"(?md)^{key}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, out: str) -> DataFrame:
    """(record_id, url, record_type, refers_to, header_digest, payload_bytes, payload_digest), the last two from the payloads as read."""
    payloads = _verified(spark.read.parquet(f"{out}/payloads"))
    facts = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    text = F.decode("warc_header", "UTF-8")
    number = lambda x: F.regexp_extract(F.coalesce(x, F.lit("")), r"^<urn:x-record:(-?\d+)>$", 1)
    refers = number(_field(text, "WARC-Refers-To"))
    headers = spark.read.parquet(f"{out}/headers").select(
        "record_id", "digest",
        _field(text, "WARC-Target-URI").alias("url"),
        _field(text, "WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        _field(text, "WARC-Payload-Digest").alias("header_digest"),
    )
    return headers.join(facts, "digest")


def reconstruct(spark: SparkSession, out: str) -> DataFrame:
    """(record_id, payload, record): every record's full payload and the exact bytes of its WARC record."""
    headers, payloads = spark.read.parquet(f"{out}/headers"), _verified(spark.read.parquet(f"{out}/payloads"))
    response = _field(F.decode("warc_header", "UTF-8"), "WARC-Type") == "response"
    body = F.when(response, F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return headers.join(payloads, "digest").select("record_id", "payload", F.concat("warc_header", "http_header", body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), out)
    return read_archive(spark, out).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, html, array_to_string(list_transform(range(32), lambda i:
    substr('{BASE32}', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + (i // 8) * 10 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
