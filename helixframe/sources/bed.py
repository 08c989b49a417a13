"""BED files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (contig, start, stop, name, rest, idx) of lines that do not begin with ``#``; idx follows the file."""
    rows = spark.read.text(path).withColumn("idx", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    return rows.select(
        f[0].alias("contig"), f[1].cast("bigint").alias("start"), f[2].cast("bigint").alias("stop"), f[3].alias("name"),
        F.when(F.size(f) > 4, F.str_to_map(f[4], F.lit(";"), F.lit("="))).alias("rest"), "idx",
    )


def as_mapping(bed: DataFrame) -> DataFrame:
    """A remap file: the fourth column names the old contig."""
    return bed.select(F.col("name").alias("old_contig"), "contig", "start")
