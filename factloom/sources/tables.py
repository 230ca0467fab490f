"""Readers. Schemas are explicit, so no reader scans a source to infer one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import urls
from factloom.operators.ordered import latest, row_numbers


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(position, org_number): one key per line, trimmed, blank lines dropped, file order kept."""
    lines = spark.read.text(path, wholetext=False).select(_place().alias("position"), F.trim("value").alias("org_number"))
    return lines.filter("org_number <> ''")


def universe(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The company list from JSON lines, plain or gzip; the last of duplicate keys wins. A gzip file is one
    task to read, hence the repartition right after it."""
    rows = spark.read.schema(schemas.UNIVERSE).json(path).select("*", _place().alias("_place"))
    spread = rows.repartition(partitions) if partitions else rows
    return latest(spread.filter("organisation_number IS NOT NULL"), ["organisation_number"], ["_place"]).drop("_place")


def _place() -> Column:
    """Where a line stands: files by name, then the place in the file, however the files were dealt to tasks."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored registry responses; the kind is a partition column."""
    return spark.read.schema(schemas.RESPONSE).parquet(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages with state, link origin and landing address."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def as_pages(raw: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Any table of pages in the working shape; the host stands in for the company."""
    return raw.select(
        urls.host(F.col(url)).alias("org_number"), F.col(key).cast("bigint").alias("page_ord"), F.col(url).alias("url"), F.col(html).alias("raw_html"),
        F.lit("2024-06-01 00:00:00").cast("timestamp").alias("fetched_at"), F.lit("available").alias("fetch_state"), F.lit(None).cast("string").alias("linked_from"),
        F.lit(None).cast("string").alias("final_url"), F.lit(False).alias("rendered"),
    )


def feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Change-feed items from JSON lines of feed pages: (page_no, item_no, id, url, status, employer). Pages are
    numbered from 0 in the order of file names and of lines in a file."""
    lines = spark.read.schema(schemas.FEED_PAGE).json(path).select("*", _place().alias("_place"))
    placed = lines.withColumn("_split", F.struct("_place.file_path", "_place.file_block_start"))
    rows = row_numbers(placed, [], ["_place"], "_split", "_number").withColumn("page_no", F.col("_number") - 1)
    items = rows.select("page_no", F.posexplode("items").alias("item_no", "_i"))
    return items.select(
        "page_no", "item_no", F.col("_i.id").alias("id"), F.col("_i.url").alias("url"), F.col("_i._feed_entry.status").alias("status"),
        F.col("_i._feed_entry.businessName").alias("employer"),
    ).filter("id <> ''")


def ads(spark: SparkSession, path: str) -> DataFrame:
    """Full job ads: (title, published, expires, number, homepage). Contact people are not read."""
    rows = spark.read.schema(schemas.AD_RECORD).json(path)
    return rows.select(
        "ad_content.title", F.left("ad_content.published", F.lit(10)).alias("published"), F.left("ad_content.expires", F.lit(10)).alias("expires"),
        F.col("ad_content.employer.orgnr").alias("number"), F.col("ad_content.employer.homepage").alias("homepage"),
    )


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made labels, one JSON file per entity."""
    return spark.read.schema(
        "org_number string, expected_legal_name string, expected_fields map<string,string>"
    ).option("multiLine", True).json(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Every claim of every snapshot, oldest first by run. Columns a snapshot was written without are NULL."""
    shape = ", ".join(f"{n} {t}" for n, t in schemas.CLAIM.items())
    return spark.read.schema(f"{shape}, run_timestamp timestamp, run_date date").parquet(path)


def envelopes(spark: SparkSession, path: str, schema) -> DataFrame:
    """A finished run, read back from its JSON lines."""
    return spark.read.schema(schema).json(path)
