"""Readers and writers: driver tables, canonical JSON lines, page trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines under a declared schema; malformed lines fail the job or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_pages(spark: SparkSession, path: str, extensions: str = "wikitext") -> DataFrame:
    """Whole files of a tree as ``path, stem, page_id, text``, redirects left out.

    The id is the first fifteen hex digits of the path's MD5, 60 bits.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extensions}").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    out = files.select(name.alias("path"), F.regexp_replace(F.element_at(F.split(name, "/"), -1), "\\.[^.]*$", "").alias("stem"), F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("page_id"), F.col("value").alias("text"))
    return out.where(~F.regexp_like(F.lower(F.trim("text")), F.lit("^# ?redirect")))


def with_sidecars(pages: DataFrame, spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Pages left-joined to their ``STEM.meta.json`` files."""
    meta = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(path)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "\\.meta\\.json$", "")
    return pages.join(meta.withColumn("stem", stem), "stem", "left")


def quarantine(df: DataFrame, status: str, path: str) -> DataFrame:
    """Write the rows with status QUARANTINED as JSON and return the others."""
    df.where(F.col(status) == "QUARANTINED").write.mode("overwrite").json(path)
    return df.where(F.col(status) != "QUARANTINED")
