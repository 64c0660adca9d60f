"""JSON files, one document or a list of documents each, over several lines; files that aren't JSON are told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged


def read(spark: SparkSession, path: str, schema: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and the files that couldn't be read as file and raw. Both have the file's name. Files are parsed once, and the result is written down."""
    whole = spark.read.schema(f"{schema}, _corrupt_record string").options(multiLine="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", recursiveFileLookup="true", **options).json(path)
    told = staged(whole.withColumn("file", F.col("_metadata.file_path")))
    return told.filter("_corrupt_record is null").drop("_corrupt_record"), told.filter("_corrupt_record is not null").select("file", F.col("_corrupt_record").alias("raw"))
