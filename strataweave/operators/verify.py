"""Checks of a result: inventories, file sets, identity of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path_key and state of every file that is missing, extra, changed or duplicate.

    Both sides: path_key, size, sha256.
    """
    side = lambda df, name: df.groupBy("path_key").agg(F.count("*").alias(f"{name}_n"), F.min("size").alias(f"{name}_size"), F.min("sha256").alias(f"{name}_sha256"))
    both = side(expected, "old").join(side(found, "new"), "path_key", "full_outer")
    changed = (F.col("old_size") != F.col("new_size")) | (F.col("old_sha256") != F.col("new_sha256"))
    state = F.when(F.col("new_n").isNull(), "missing").when(F.col("old_n").isNull(), "extra").when(F.col("new_n") > 1, "duplicate").when(changed, "changed")
    return both.select("path_key", state.alias("state")).where("state is not null")


def changed_inputs(analysed: DataFrame, present: DataFrame) -> DataFrame:
    """Inputs that aren't as they were when analysed (input_id, size, sha256)."""
    now = present.select("input_id", F.col("size").alias("now_size"), F.col("sha256").alias("now_sha256"))
    same = F.col("size").eqNullSafe(F.col("now_size")) & F.col("sha256").eqNullSafe(F.col("now_sha256"))
    return analysed.join(now, "input_id", "left").where(~same)


def same_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths that only one of two readers lists; empty if they agree."""
    left, right = a.select("path"), b.select("path")
    return left.exceptAll(right).withColumn("side", F.lit("first")).union(right.exceptAll(left).withColumn("side", F.lit("second")))
