"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts that split on ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, whose executors are the driver, may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "/tmp/textmill-checkpoints"
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet to the shared folder and read it back.

    Unlike checkpoint(), which runs the plan for its count and again for its files, this runs it once. The files go
    with the application, or before by drop_staged.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table of stage_table that nothing will read again."""
    files, at = _file_system(df.sparkSession, df._staged_at)
    files.delete(at, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; in a lambda an expression is computed for each element that it is used for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a bigint, b bigint): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds until nothing changes, each written to the shared folder. A round
    replaces each edge by one towards the smallest neighbour, so the number of rows never grows and the number of
    rounds is about the logarithm of the longest path. Nodes without an edge don't appear. Nulls are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stage_table(e, "cc")
    now, last = None, ()
    while now != last:
        last = now
        both = e.select(F.col("u").alias("n"), F.col("v").alias("w")).union(e.select(F.col("v").alias("n"), F.col("u").alias("w")))
        least = both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("w > n").join(least, "n").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        before, after = e, linked.select("u", F.col("m").alias("v")).union(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = stage_table(after, "cc")
        drop_staged(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.col("u").cast("decimal(38,0)")).alias("t")).first()
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
