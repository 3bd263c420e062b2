"""Images, JSON documents, embedded data and content pins from files; sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgauge.functions.text import media_type, natural_key

DATASET = r"""(?is)<script\b(?=[^>]*\bid=["']dataset["'])(?=[^>]*\btype=["']application/json["'])[^>]*>(.*?)</script>"""


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, sort_key, media_type, sha256, size, content) of the images below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,webp,PNG,JPG,JPEG,WEBP}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), natural_key(name).alias("sort_key"), media_type(F.col("content")).alias("media_type"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def pins(files: DataFrame) -> DataFrame:
    """(path, sha256, byte_length) of binary files: what an artifact is pinned by."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("byte_length"))


def pin_mismatches(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected pins (path, sha256, byte_length) that no file fulfils, exactly."""
    return expected.join(actual, ["path", "sha256", "byte_length"], "left_anti")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a stated schema; anything unreadable is fatal."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def embedded_dataset(html: Column) -> Column:
    """JSON text of the ``dataset`` script of a page; null without one or where it isn't JSON."""
    body = F.trim(F.regexp_extract(html, DATASET, 1))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def title(html: Column) -> Column:
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t != "", t)


def write_once(df: DataFrame, path: str) -> None:
    """Write JSON lines to a new path; an existing one is an error."""
    df.write.mode("errorifexists").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log that is only ever added to."""
    df.write.mode("append").json(path)
