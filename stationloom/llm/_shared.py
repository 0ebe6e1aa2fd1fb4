"""Tables kept in the shared folder, and connected components over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.result import shared_dir, stored

__all__ = ["components", "new_path", "remove", "shared_dir", "stored"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for frame in frames:
        for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): the smallest node reachable.

    Alternating large-star and small-star steps; each is an aggregate and a
    join on the node, so that a hub's edges are split over tasks, and each
    round's edges go to the shared folder.  Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # edges point from the larger to the smaller node, as a small-star step wants them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        last, now = now, stored(small.where("u <> v").distinct(), "edges")
        remove(spark, last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
