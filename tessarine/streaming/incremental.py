"""Incremental maintenance of a snapshot (path, mtime, size, hash, ...).

``classify`` joins a scan with the last snapshot; ``upsert`` makes the next one;
``follow`` does both for each micro-batch of a stream of scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(scan: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, status): fast_hit, hash_hit, miss, or pruned for paths no longer there."""
    s = snapshot.select("path", F.col("mtime").alias("m"), F.col("size").alias("z"), F.col("hash").alias("h"), F.lit(1).alias("old"))
    j = scan.select("path", "mtime", "size", "hash", F.lit(1).alias("new")).join(s, "path", "full")
    status = (
        F.when(F.col("new").isNull(), "pruned")
        .when(F.col("old").isNull(), "miss")
        .when(F.col("mtime").eqNullSafe(F.col("m")) & F.col("size").eqNullSafe(F.col("z")), "fast_hit")
        .when(F.col("hash").eqNullSafe(F.col("h")), "hash_hit")
        .otherwise("miss")
    )
    return j.select("path", status.alias("status"))


def upsert(snapshot: DataFrame, scan: DataFrame, key: str = "path") -> DataFrame:
    """The scan's rows, and the snapshot's for paths that the scan lacks."""
    return scan.unionByName(snapshot.join(scan.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def prune(snapshot: DataFrame, scan: DataFrame, key: str = "path") -> DataFrame:
    return snapshot.join(scan.select(key).distinct(), key, "left_semi")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def follow(stream: DataFrame, folder: str, checkpoint: str, key: str = "path", order: str = "mtime"):
    """Start a query that keeps numbered snapshots of a stream of scans under ``folder``.

    Snapshot n is written from n - 1 and the batch, so a batch that is run
    again writes the same table.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = latest(df, key, order)
        if n > 0:
            new = upsert(spark.read.parquet(f"{folder}/{n - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{folder}/{n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
