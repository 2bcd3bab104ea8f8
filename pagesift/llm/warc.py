"""A content-addressed archive of WARC records.

``payloads`` holds each payload once, under its SHA-256; ``headers`` holds the
exact header of every record with the digest of its payload.  A record is put
together again by a join on the digest, that of a revisit too, and the stored
bytes are checked against it and against what the header says of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, hot_keys, join_hot, scratch_path, table, written

#: Payloads of at least so many bytes are stored for one record and revisited by others.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:pagesift:page:"
#: Bytes of frequent payloads that may be broadcast when records are put together.
BROADCAST_BYTES = 64 << 20
EOL = "\r\n"


def head(*fields: tuple[str, Column]) -> Column:
    """A record header; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)) for name, value in fields]
    return F.concat(F.lit(f"WARC/1.1{EOL}"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit(EOL))


def field(name: str) -> Column:
    """The value of a header field, or null."""
    return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def describe(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """``page_id``, ``url``, ``sha256``, ``sha1``, ``n``: what a record's header needs, without the payload."""
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))


def record_heads(facts: DataFrame, first: DataFrame, date: str) -> DataFrame:
    """``sha256`` and ``head`` of each record; ``first`` names the response of each payload.

    A record's id has the page's id and the number of its row, as pages may
    share an id or have none.
    """
    x = join_hot(facts, first, ["sha256"], "records")
    revisit = (F.col("n") >= REVISIT_BYTES) & (F.col("row") != F.col("keep.row"))
    name = lambda of: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(f"{of}page_id").cast("string"), F.lit("")), F.lit(":"), F.col(f"{of}row").cast("string"), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    made = head(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", name("")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", uri),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, name("keep."))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Payload-Length", F.col("n")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
    )
    return x.select("sha256", made.alias("head"))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row of ``pages`` under ``path``.

    Of equal payloads of at least 1000 bytes the row with the largest id is the
    response and the others revisit it; a shorter payload is a response each
    time, yet stored once too.  A null text is an empty payload, a null url
    gives no target field.  Rows that repeat an id and a payload are records of
    their own, one of them the response.  Other columns are ignored.
    """
    facts = written(describe(pages, id_col, url_col, text_col), "facts")
    first = facts.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("keep"), F.count(F.lit(1)).alias("records"))
    first = written(first, "first")
    record_heads(facts, first, date).write.parquet(f"{path}/headers")
    stored = first.select("keep.page_id").where("page_id IS NOT NULL")
    other = written(facts.select("page_id").join(stored, "page_id", "left_anti"), "other")
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    bodies = drop_ids(pages.select(F.col(id_col).alias("page_id"), payload.alias("payload")), other, "page_id").select(F.sha2("payload", 256).alias("sha256"), "payload")
    if facts.count() - other.where("page_id IS NOT NULL").count() != first.count():  # an id that isn't one row's alone
        bodies = bodies.dropDuplicates(["sha256"])
    bodies.write.parquet(f"{path}/payloads")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The headers, and the payloads with ``n`` and ``sha1``; a payload that doesn't have the digest it is stored under fails the read."""
    heads = spark.read.schema("sha256 string, head string").parquet(f"{path}/headers")
    bodies = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary"))
    bodies = bodies.select("sha256", sound.alias("payload"))
    return heads, bodies.select("sha256", "payload", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))


def checked(records: DataFrame) -> DataFrame:
    """Fails where a header doesn't say of its payload what the stored bytes are, or where these are lost."""
    told = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (field("WARC-Payload-Length") == F.col("n").cast("string"))
    return records.withColumn("n", F.when(F.coalesce(told, F.lit(False)), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("another payload than in the header: "), F.col("sha256"))).cast("long")))


def record_facts(spark: SparkSession, path: str) -> DataFrame:
    """All records with what their stored payloads are, ``n`` and ``sha1``, without these themselves: ``head``, ``n``, ``sha1``."""
    heads, bodies = stored(spark, path)
    facts = written(bodies.drop("payload").join(heads.groupBy("sha256").agg(F.count(F.lit(1)).alias("records")), "sha256", "right"), "payload-facts")
    return checked(join_hot(heads, facts, ["sha256"], "records")).select("head", "n", "sha1")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records again: ``head``, ``payload``, its ``n`` and ``sha1``, and ``record``, the record's exact bytes.

    A revisit has the payload of the record that it refers to; its own bytes
    have none.  Frequent payloads are broadcast as far as ``BROADCAST_BYTES``
    go; beyond, Spark splits the records of a frequent one.
    """
    heads, bodies = stored(spark, path)
    hot = hot_keys(written(heads.groupBy("sha256").agg(F.count(F.lit(1)).alias("records")), "records"), "records").select("sha256")
    frequent = written(bodies.join(F.broadcast(hot), "sha256", "left_semi"), "frequent")
    if (frequent.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_BYTES:
        rest = heads.join(F.broadcast(frequent.select("sha256")), "sha256", "left_anti").join(bodies, "sha256", "left")
        records = rest.unionByName(heads.join(F.broadcast(frequent), "sha256"))
    else:
        records = heads.join(bodies, "sha256", "left")
    own = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.encode(F.lit(EOL * 2), "UTF-8")
    return checked(records).select("head", "payload", "n", "sha1", F.concat(F.encode("head", "UTF-8"), own, end).alias("record"))


def read_back(records: DataFrame) -> DataFrame:
    """What the records say: id, payload length and digest (of the stored payload), type, and the page that a revisit refers to."""
    page = lambda name: F.regexp_extract(field(name), f"^<{URN}(-?\\d+):\\d+>$", 1)
    number = lambda c: F.nullif(c, F.lit("")).cast("long")
    return records.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
    )


def taken_apart(records: DataFrame) -> DataFrame:
    """``head``, ``n`` and ``sha1`` of records by their exact bytes; of a revisit, whose bytes have none, by its payload."""
    size = F.octet_length(F.encode("head", "UTF-8"))
    body = F.substring(F.col("record"), size + 1, F.octet_length("record") - size - 2 * len(EOL))
    payload = F.when(field("WARC-Type") == "revisit", F.col("payload")).otherwise(body)
    return records.select("head", F.octet_length(payload).cast("long").alias("n"), F.sha1(payload).alias("sha1"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_back(taken_apart(read_archive(spark, path)))


OP9_SQL = """
SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN long AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN long AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, t, octet_length(encode(t)) >= 1000 AS long, max(page_id) OVER (PARTITION BY t) AS last FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""
