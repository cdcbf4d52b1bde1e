"""Tables written once and read several times, and checked broadcasts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Without that setting only a session in one process (``local``, ``local[...]``) gets a
    folder of its own; anywhere else executors could not see what others have written.
    """
    conf = spark.sparkContext.getConf()
    configured = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = f"file:/tmp/seamline-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, name: str, *sort_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Everything after it starts from files: a lost executor repeats its own tasks
    only, and each reader scans just its columns.  Each task writes one file;
    sorted by ``sort_by``, its page statistics let readers skip the other rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list, into: str) -> DataFrame:
    """``df`` with the place, from 0, of each row among those of its ``keys``, by ``order``.

    Rows are sorted into ranges that can cut a key's rows, so that no task holds a key.
    A row's number in its part of the sorted table, what lies before its key there, and
    the rows of the key in earlier parts give its place.  Only the counts per key and part
    are added up, and joined back; most keys lie in one part.  Equal rows follow each
    other in any order.
    """
    part, at = F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")
    by = [*[F.col(key) for key in keys], *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", part, at)
    placed = stage(placed, f"numbered-{into}")
    counts = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__offset")
    joined_by = [*keys, "__part"]
    offsets = counts.select(*[F.col(key).alias(f"__of{k}") for k, key in enumerate(joined_by)], offset)
    same = [F.col(key).eqNullSafe(F.col(f"__of{k}")) for k, key in enumerate(joined_by)]
    joined = placed.join(small(offsets), reduce(lambda a, b: a & b, same))
    return joined.select(*df.columns, (F.col("__at") + F.col("__offset")).alias(into))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it is small.

    Above the limit it stays as it is and Spark joins by shuffling.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def large(df: DataFrame) -> DataFrame:
    """Mark ``df`` as too large to be broadcast, whatever Spark takes its size to be.

    Of a staged table that is the share of a few columns in the compressed files, mostly of
    others that hold nothing; of millions of rows it can be less than Spark broadcasts.
    """
    return df.hint("merge")
