"""A content-addressed WARC archive.

The archive is two tables: ``payloads`` holds the bytes of every distinct payload once, under their
SHA-256, and ``headers`` the exact header bytes of every record with the digest of its payload. Records
are rebuilt by joining headers with payloads; a rebuilt payload whose SHA-256 is not its address is an
error. Revisit records carry the digest of the payload they refer to, so their full payload is found by
the same join.

All of it is column expressions. Large groups of equal payloads take part in ordinary joins on the
digest, which adaptive execution splits, and in pre-aggregated maxima.

Defined cases: a null payload is empty; payloads under ``revisit_from`` bytes are always responses, yet
stored once; a group of equal payloads without any non-null id is all responses; of rows that repeat
one id and payload all are responses if the id is their group's largest; an empty table gives an empty
archive; columns other than id, url and payload are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.common import materialize, table

CRLF = "\r\n"


def _header(fields: list[tuple[str, Column]], kind: str, extra: list[tuple[str, Column]]) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1" + CRLF + f"WARC-Type: {kind}" + CRLF)]
    for name, value in [*fields, *extra]:
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit("")))
    return F.encode(F.concat(*parts, F.lit(CRLF)), "UTF-8")


def write(pages: DataFrame, revisit_from: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Write the archive; (headers, payloads) as read back from the shared folder."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("id"), F.regexp_replace(F.col(url), "[\r\n]", " ").alias("url"), body.alias("payload"))
    digests = rows.select("id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    digests = materialize(digests, "warc-digests")
    owners = digests.groupBy("sha256").agg(F.max("id").alias("owner"))
    known = digests.join(owners, "sha256")
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = (F.col("bytes") >= revisit_from) & F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    shared = [("WARC-Record-ID", uri(F.col("id"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("sha256")))]
    response = _header(shared, "response", [("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes").cast("string"))])
    refer = _header(shared, "revisit", [("WARC-Refers-To", uri(F.col("owner"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Length", F.lit("0"))])
    headers = materialize(known.select("id", "sha256", F.when(revisit, refer).otherwise(response).alias("header")), "warc-headers")
    # Each payload comes from the rows of its owner alone; a payload of null ids only from any of its rows.
    chosen = owners.select(F.col("sha256").alias("address"), F.col("owner"))
    own = rows.withColumn("sha256", F.sha2("payload", 256)).join(chosen, (F.col("sha256") == F.col("address")) & F.col("id").eqNullSafe(F.col("owner")), "left_semi")
    own = own.select("sha256", "payload")
    if not digests.groupBy("sha256", "id").count().filter("count > 1").isEmpty():  # rows that repeat an id and a payload
        own = own.groupBy("sha256").agg(F.first("payload").alias("payload"))
    payloads = materialize(own, "warc-payloads")
    return headers, payloads


def read(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rebuild every record: id, header, record (bytes as in a WARC file), payload, and the parsed fields."""
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))))
    store = payloads.withColumnRenamed("sha256", "address").select("address", sound.alias("payload"))
    both = headers.join(store, F.col("sha256") == F.col("address"))
    text = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    both = both.withColumn("record_type", field("WARC-Type")).withColumn("payload_digest", F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1))
    both = both.withColumn("refers_to", F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1))
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("id", "header", "payload", "record_type", "payload_digest", "refers_to", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = read(*write(pages))
    kind = pages.schema["page_id"].dataType
    # The digest is taken from the payload that was read back, and must be the one in the header.
    digest = F.sha1("payload")
    same = F.when(digest == F.col("payload_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("digest of record "), F.col("id").cast("string"), F.lit(" differs"))))
    return records.select(F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), same.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) < 1000 OR page_id = max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) < 1000 OR page_id = max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN NULL ELSE max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
