"""Feeds in and out: JSON snapshots with an explicit schema, three posting dialects, a snapshot sink that keeps the last good one."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.functions.text import clean
from tidemill.session import discard, publish, published

LISTING = (
    "title string, company_name string, location string, description string, extensions array<string>, "
    "job_highlights array<struct<title:string,items:array<string>>>, detected_extensions struct<posted_at:string>, "
    "apply_options array<struct<title:string,link:string>>, via string"
)
LEVER = (
    "id string, text string, descriptionPlain string, description string, additionalPlain string, additional string, workplaceType string, applyUrl string, "
    "hostedUrl string, lists array<struct<text:string,content:string>>, categories struct<location:string,allLocations:array<string>>"
)
COMMON = ["posting_id", "title", "location", "description", "apply_url", "is_remote", "published"]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file or folder; a row that doesn't fit keeps its text in ``_corrupt_record``; a missing path gives an empty frame."""
    full = f"{schema}, _corrupt_record string"
    try:
        return spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt_record").option("mode", "PERMISSIVE").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], full)


def read_snapshot(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The last good snapshot below ``path``; a missing one is empty."""
    version = published(spark, f"{path}/CURRENT")
    return spark.read.schema(schema).parquet(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, path: str, succeeded: int) -> bool:
    """Replaces the snapshot, unless nothing succeeded: then the last good one stays.

    The rows are written beside the old ones and a pointer moves to them in one step, so a write that fails loses
    nothing; the snapshot before the last one is deleted.
    """
    if succeeded <= 0:
        return False
    spark, version = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    old = published(spark, f"{path}/CURRENT")
    publish(spark, f"{path}/CURRENT", version)
    older = published(spark, f"{path}/BEFORE")
    if old:
        publish(spark, f"{path}/BEFORE", old)
    if older:
        discard(spark, f"{path}/{older}")
    return True


def _places(first: Column, more: Column) -> Column:
    """Distinct places in order, joined by " / "."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(first), F.coalesce(more, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))), " / ")


def from_lever(df: DataFrame) -> DataFrame:
    lists = F.array_join(F.transform("lists", lambda x: F.concat_ws(" ", x["text"], x["content"])), " ")
    body = F.concat_ws(" ", F.coalesce("descriptionPlain", "description"), lists, F.coalesce("additionalPlain", "additional"))
    return df.select(
        F.col("id").alias("posting_id"), F.col("text").alias("title"), _places(F.col("categories.location"), F.col("categories.allLocations")).alias("location"),
        clean(body).alias("description"), F.coalesce("applyUrl", "hostedUrl").alias("apply_url"), (F.lower("workplaceType") == "remote").alias("is_remote"), F.lit(None).cast("string").alias("published"),
    )


def from_ashby(df: DataFrame, key: str = "posting_no") -> DataFrame:
    """Listed postings only."""
    return df.where(F.coalesce("isListed", F.lit(True))).select(
        F.col(key).cast("string").alias("posting_id"), "title", _places(F.col("location"), F.col("secondaryLocations.location")).alias("location"),
        clean(F.coalesce("descriptionPlain", "descriptionHtml")).alias("description"), F.coalesce("applyUrl", "jobUrl").alias("apply_url"),
        (F.coalesce("isRemote", F.lit(False)) | (F.lower(F.coalesce("workplaceType", F.lit(""))) == "remote")).alias("is_remote"), F.col("publishedAt").alias("published"),
    )


def from_greenhouse(df: DataFrame) -> DataFrame:
    """Rows delivered twice count once."""
    return df.select(
        F.col("id").cast("string").alias("posting_id"), "title", F.coalesce("location.name", F.lit("")).alias("location"), clean(F.col("content"), escaped_markup=True).alias("description"),
        F.col("absolute_url").alias("apply_url"), F.lower(F.coalesce("location.name", F.lit(""))).contains("remote").alias("is_remote"), F.col("updated_at").alias("published"),
    ).distinct()


def common(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One table of all dialects with the ``origin`` of each row."""
    out = None
    for origin, df in parts:
        part = df.select(F.lit(origin).alias("origin"), *COMMON)
        out = part if out is None else out.unionByName(part)
    return out
