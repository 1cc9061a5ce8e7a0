"""Mounts of several archives under their common prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.paths import mount_parts


def rebased(mounts: DataFrame) -> DataFrame:
    """Mounts (input_index, mount; 64 at most) with their longest common prefix and what is left of each.

    Parts are compared without regard to case; the base input's spelling is kept.
    """
    parts = mounts.withColumn("parts", mount_parts(F.col("mount")))
    lowered = F.transform("parts", F.lower)
    gathered = parts.agg(F.collect_list(lowered).alias("every"), F.min_by("parts", "input_index").alias("base"))
    shared = lambda i: F.forall("every", lambda p: F.coalesce(F.get(p, i) == F.lower(F.get("base", i)), F.lit(False)))
    differing = F.filter(F.transform("base", lambda _, i: F.when(~shared(i), i)), lambda x: x.isNotNull())
    size = F.coalesce(F.array_min(differing), F.size("base"))
    common = gathered.select(size.alias("n"), F.array_join(F.slice("base", F.lit(1), size), "/").alias("common"))
    rest = F.slice("parts", F.col("n") + 1, F.size("parts"))
    # one row, of at most 64 mounts
    return parts.join(F.broadcast(common)).select("input_index", "mount", "common", F.array_join(rest, "/").alias("rest"))
