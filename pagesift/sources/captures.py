"""Reading captures and jobs, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.plans.rules import rule_lines

PAGES = "page_id bigint, url string, html string"
STORED = "path string, content binary"
JOBS = "job_id bigint, url string, rules string, mode string"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType = PAGES) -> DataFrame:
    """Captures from Parquet or JSON with the columns of ``schema``, or from files of one page each (``kind`` text)."""
    if kind == "text":
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
        return files.select(F.xxhash64("url").alias("page_id"), "url", "html")
    return spark.read.schema(schema).format(kind).load(path)


def read_responses(spark: SparkSession, path: str, kind: str = "binaryFile") -> DataFrame:
    """Captures from files of one stored HTTP response each: ``file``, ``url``, ``html``, ``status`` and ``headers``.

    With another ``kind``, as ``parquet``, files hold many responses: rows of ``path``
    and ``content``, as Spark's ``binaryFile`` gives them.  Files of one each cost
    what making, listing and opening them takes, so many small ones are best kept so.

    A file has a status line, headers, an empty line and the body, as long as
    ``content-length`` says or to the end.  The url is that of the header
    ``x-url`` or ``content-location``.  Names of headers are in lower case, and
    of one that is repeated the last counts.  A file without a status line has
    neither status nor headers and is all body; an empty file is none at all.
    """
    head = F.decode(F.substring("content", 1, 1 << 16), "ISO-8859-1")
    raw = (spark.read if kind == "binaryFile" else spark.read.schema(STORED)).format(kind).load(path).where(F.length("content") > 0)
    files = raw.select(F.col("path").alias("file"), "content", F.regexp_extract(head, r"(?s)^(HTTP/\S+ \d{3}.*?\r?\n)(\r?\n)", 1).alias("head"), F.length(F.regexp_extract(head, r"(?s)^HTTP/\S+ \d{3}.*?\r?\n\r?\n", 0)).alias("n"))
    lines = F.filter(F.split("head", r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x))).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    headers = F.when(F.col("head") != "", F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))
    own = files.withColumn("headers", headers)
    size = F.coalesce(F.expr("try_cast(headers['content-length'] AS INT)"), F.length("content"))
    body = F.decode(F.substring(F.col("content"), F.col("n") + 1, size), "UTF-8")
    status = F.regexp_extract("head", r"^HTTP/\S+ (\d{3})", 1)
    return own.select("file", F.coalesce(F.col("headers")["x-url"], F.col("headers")["content-location"]).alias("url"), body.alias("html"), F.when(status != "", status.cast("int")).alias("status"), "headers")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs from JSON lines; ``rules`` may be a text block or an array, ``mode`` may be missing."""
    raw = spark.read.schema(JOBS).json(path)
    listed = F.from_json("rules", "array<string>")
    rules = F.coalesce(F.when(F.col("rules").startswith("["), F.array_join(listed, "\n")), F.col("rules"), F.lit(""))
    return raw.select("job_id", "url", rule_lines(rules).alias("rules"), F.coalesce("mode", F.lit("requests")).alias("mode"))


def write_json(wide: DataFrame, path: str) -> None:
    """One JSON object per page and line, as ``extract_wide`` makes them."""
    wide.select("result").write.text(path)


def write_csv(results: DataFrame, path: str) -> None:
    results.withColumn("values", F.array_join("values", "\n")).write.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_xml(results: DataFrame, path: str) -> None:
    results.write.format("xml").option("rowTag", "result").save(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("report").write.text(path)
