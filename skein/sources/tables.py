"""Input tables: stored pages, rendered pages, API payloads, look-up tables, image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "page_id bigint, url string, html string"
RENDERED = "url string, html string, status int"
DNS = "host string, ip string"
ENTITIES = "key string, avatar_url string, verified boolean"
REDIRECTS = "src string, dst string"
LISTED_DOMAINS = "domain string, wildcard boolean"
MODEL_ANSWERS = "bookmark_id string, json string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored API answers, one JSON object a line; rows that are no JSON come as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: path, length, content of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def request_url(body: Column, query: Column) -> Column:
    """SRC21: the link of a request, from its body or its query."""
    return F.coalesce(F.nullif(F.trim(body), F.lit("")), F.nullif(F.trim(query), F.lit("")))


def resolve_redirects(urls: DataFrame, redirects: DataFrame, url: str = "url", hops: int = 5) -> DataFrame:
    """UF5b: urls with `resolved`: where short links lead, at most `hops` steps; an unsafe target gives the link itself back.
    redirects: src, dst, safe, one row a src."""
    from skein.functions.url import is_shortlink

    d = urls.withColumn("resolved", F.col(url)).withColumn("_ok", F.lit(True))
    r = redirects.groupBy("src").agg(F.min_by(F.struct("dst", "safe"), "dst").alias("to"))
    for _ in range(hops):
        going = is_shortlink(F.col("resolved")) & F.col("_ok")
        d = d.join(r, F.when(going, F.col("resolved")) == F.col("src"), "left")
        d = d.withColumn("_ok", F.col("_ok") & F.coalesce(F.col("to.safe"), F.lit(True))).withColumn("resolved", F.coalesce("to.dst", "resolved")).drop("src", "to")
    return d.withColumn("resolved", F.when(F.col("_ok"), F.col("resolved")).otherwise(F.col(url))).drop("_ok")
