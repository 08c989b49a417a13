"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.scratch import cut, drop, scratch_path, shared_dir

__all__ = ["components", "cut", "drop", "open_store", "scratch_path", "shared_dir", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def open_store(path: str):
    """Arrow's file system for a path in the shared folder, and the name there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Smallest reachable id of every vertex of the undirected ``edges(a, b)``.

    Minimum labels travel along edges, then each label is replaced by its own label
    (pointer jumping), so rounds grow with the logarithm of a component's diameter.
    Every round is cut, every join has two fresh exchanges, and minima are partial
    aggregates, so a hub of any degree is split.  Returns ``(v, component)``.
    """
    both = cut(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .distinct(),
        label + "-edges",
    )
    labels = cut(both.groupBy("v").agg(F.least("v", F.min("u")).alias("component")), label)
    while True:
        sent = both.join(labels.withColumnRenamed("v", "u"), "u").select("v", "component")
        least = cut(
            labels.select("v", "component", F.col("component").alias("old"))
            .unionByName(sent.withColumn("old", F.lit(None).cast("long")))
            .groupBy("v")
            .agg(F.min("component").alias("component"), F.max("old").alias("old")),
            label,
        )
        up = least.select(F.col("v").alias("component"), F.col("component").alias("root"))
        after = cut(
            least.join(up, "component").select("v", F.col("root").alias("component"), "old"), label
        )
        moved = after.where("component <> old").limit(1).count()
        for past in (labels, least):
            drop(past)
        labels = after.select("v", "component")
        if not moved:
            return labels
