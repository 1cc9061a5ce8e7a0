"""Alignment of N inputs on one key: one union and one grouping, never N - 1 joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_INPUTS = 64


def tagged(inputs: Sequence[DataFrame]) -> DataFrame:
    """The rows of all inputs with ``input_index``; input 0 is the base. Absent columns are null."""
    if not 1 <= len(inputs) <= MOST_INPUTS:
        raise ValueError(f"1 to {MOST_INPUTS} inputs, not {len(inputs)}")
    out = inputs[0].withColumn("input_index", F.lit(0))
    for n, rows in enumerate(inputs[1:], 1):
        out = out.unionByName(rows.withColumn("input_index", F.lit(n)), allowMissingColumns=True)
    return out


def holders(rows: DataFrame, key: str) -> DataFrame:
    """key, holders (input numbers in order), n_holders."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set("input_index")).alias("holders")).withColumn("n_holders", F.size("holders"))


def partial_rows(rows: DataFrame, key: str, n_inputs: int) -> DataFrame:
    """Rows that only some inputs hold. Absence never deletes: they are counted and kept."""
    return holders(rows, key).where(F.col("n_holders") < n_inputs)


def donor_only(rows: DataFrame, key: str) -> DataFrame:
    """Keys the base lacks, with the first input that holds them."""
    return rows.groupBy(key).agg(F.min("input_index").alias("first_input")).where("first_input > 0")


def first_holder(rows: DataFrame, key: str) -> DataFrame:
    """Each key's row from the first input that holds it (the union that keeps all)."""
    rest = [c for c in rows.columns if c not in (key, "input_index")]
    first = rows.groupBy(key).agg(F.min(F.struct("input_index", *rest)).alias("first"))
    return first.select(key, "first.*")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
