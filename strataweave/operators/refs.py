"""References between tables: integer keys, array leaves and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.paths import asset_path
from strataweave.functions.values import refers

EXAMPLES = 32
BY_NUMBER, BY_NAME = "messagepack", "tables by name"
MOST_SUFFIXES = 10_000


def missing(references: DataFrame, targets: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """References (rule, source_row, target_id) above zero without a target (rule, target_id), exempt pairs aside."""
    out = references.where("target_id > 0").join(targets.select("rule", "target_id"), ["rule", "target_id"], "left_anti")
    if exempt is not None:
        out = out.join(exempt.select("rule", "source_row", "target_id"), ["rule", "source_row", "target_id"], "left_anti")
    return out


def missing_names(references: DataFrame, targets: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """References by name (rule, source_row, target) that can mean a row, without a target (rule, target), exempt pairs aside.

    Names are compared exactly, case included.
    """
    out = references.where(refers(F.col("target"))).join(targets.select("rule", "target"), ["rule", "target"], "left_anti")
    if exempt is not None:
        out = out.join(exempt.select("rule", "source_row", "target"), ["rule", "source_row", "target"], "left_anti")
    return out


def broken(form: str, references: DataFrame, targets: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """rule, source_row, target (text) of references that break, by the form of the tables; another form is an error.

    References and targets hold ``target_id`` where rows have numbers, ``target`` where they have names.
    """
    if form == BY_NUMBER:
        return missing(references, targets, exempt).select("rule", "source_row", F.col("target_id").cast("string").alias("target"))
    if form == BY_NAME:
        return missing_names(references, targets, exempt).select("rule", "source_row", "target")
    raise ValueError(f"no references are known for {form!r}")


def resolved_tables(paths: DataFrame, tables: DataFrame) -> DataFrame:
    """path, table: the first of the declared tables (position, table, suffix) whose suffix ends the path's normal form.

    Declared tables come from profiles and are few; more than ``MOST_SUFFIXES`` are an error.
    """
    if tables.limit(MOST_SUFFIXES + 1).count() > MOST_SUFFIXES:
        raise ValueError(f"over {MOST_SUFFIXES} declared tables")
    normal = paths.select("path", asset_path(F.col("path")).alias("asset_path"))
    met = normal.join(F.broadcast(tables), F.col("asset_path").endswith(F.col("suffix")))
    return met.groupBy("path").agg(F.min_by("table", "position").alias("table"))


def repeated_tables(resolved: DataFrame) -> DataFrame:
    """Declared tables that more than one path resolves to, which no reference check can decide: table, n_paths."""
    return resolved.groupBy("table").agg(F.count("*").alias("n_paths")).where("n_paths > 1")


def summary(breaks: DataFrame) -> DataFrame:
    """Per rule: how many references break, and the least and greatest missing id."""
    return breaks.groupBy("rule").agg(F.count("*").alias("n_missing"), F.min("target_id").alias("min_missing"), F.max("target_id").alias("max_missing"))


def examples(breaks: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The first breaks of each rule in scan order; tasks keep only their first ones before the shuffle."""
    order = Window.partitionBy("rule").orderBy("scan_order")
    return breaks.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def skipped(rules: DataFrame, tables: DataFrame) -> DataFrame:
    """Rules whose target table isn't there: noted, not failed."""
    return rules.join(tables.select(F.col("table").alias("target")), "target", "left_anti")


def leaves(rows: DataFrame, row: str, rule: str, values: str) -> DataFrame:
    """A reference for each integer above zero in an array."""
    return rows.select(F.lit(rule).alias("rule"), F.col(row).alias("source_row"), F.explode(values).alias("target_id")).where("target_id > 0")
