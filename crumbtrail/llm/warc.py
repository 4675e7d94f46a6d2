"""Content-addressed web archive.

Each distinct payload is stored once under its SHA-256; each record keeps its own exact
WARC and HTTP header bytes in a second table; a join on the digest gives the original
records back. Both tables are Parquet, written by Spark's commit protocol, so a task that
is run again leaves no second copy.

Defined cases: a null body is an empty payload; payloads below ``min_bytes`` are never
revisits; rows that repeat an id with the same payload are all responses; a row with a
null id is a revisit when an equal payload has an id; a null url gives an empty target; an
empty table gives empty archives. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.llm.common import new_path, table

EOL = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """One header line; null (a line that concat_ws leaves out) if the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def _parsed(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    min_bytes: int = 100,
    date: str = "2026-01-01T00:00:00Z",
) -> None:
    """Writes ``path``/payloads (digest, payload) and ``path``/headers (digest, warc_header, http_header)."""
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # One payload per digest leaves each map task, so a payload that fills a third of the
    # table meets as a row per task. A second, independent digest and the length prove that
    # equal digests mean equal bytes.
    proof = F.concat_ws(":", F.md5("payload"), F.octet_length("payload").cast("string"))
    (
        rows.groupBy("digest")
        .agg(F.any_value("payload").alias("payload"), F.min(proof).alias("lo"), F.max(proof).alias("hi"))
        .select(
            "digest",
            F.when(F.col("lo") == F.col("hi"), F.col("payload"))
            .otherwise(F.raise_error(F.concat(F.lit("unequal payloads under digest "), F.col("digest"))))
            .alias("payload"),
        )
        .write.parquet(f"{path}/payloads")
    )
    records = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
    first = records.groupBy(F.col("digest").alias("first_digest")).agg(F.min("page_id").alias("first_id"))
    revisit = (F.col("size") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(EOL * 2),
    )
    length = F.octet_length("http_header") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))
    only = lambda c: F.when(F.col("revisit"), c)
    header = F.concat(
        F.concat_ws(
            EOL,
            F.lit("WARC/1.1"),
            _field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            _field("WARC-Record-ID", _record_urn(F.col("page_id"))),
            _field("WARC-Date", F.lit(date)),
            _field("WARC-Target-URI", F.translate(F.coalesce("url", F.lit("")), EOL, "")),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            _field("WARC-Refers-To", only(_record_urn(F.col("first_id")))),
            _field("WARC-Profile", only(F.lit(REVISIT_PROFILE))),
            _field("X-Page-Id", F.col("page_id").cast("string")),
            _field("X-Refers-To-Page-Id", only(F.col("first_id").cast("string"))),
            _field("Content-Type", F.lit("application/http; msgtype=response")),
            _field("Content-Length", length.cast("string")),
        ),
        F.lit(EOL * 2),
    )
    (
        records.join(first, F.col("digest") == F.col("first_digest"))
        .withColumn("revisit", revisit)
        .withColumn("http_header", http)
        .select("digest", header.alias("warc_header"), "http_header")
        .write.parquet(f"{path}/headers")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: warc_header, http_header, payload (of revisits too) and ``record``, the bytes as in a WARC file."""
    heads = spark.read.schema("digest string, warc_header string, http_header string").parquet(f"{path}/headers")
    bodies = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    body = F.when(_parsed(F.col("warc_header"), "WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return heads.join(bodies, "digest").select(
        "warc_header",
        "http_header",
        "payload",
        F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), body, F.lit(EOL * 2).cast("binary")).alias("record"),
    )


def digests(records: DataFrame) -> DataFrame:
    """What the headers say of each record, and the digest of the payload as read back."""
    h = F.col("warc_header")
    return records.select(
        _parsed(h, "X-Page-Id").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        _parsed(h, "WARC-Type").alias("record_type"),
        _parsed(h, "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return digests(read_archive(spark, path))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, octet_length(body) AS n, min(page_id) OVER (PARTITION BY d) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
