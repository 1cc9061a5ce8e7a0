"""Merge plans: what happens to each asset, conflicts with identifiers, totals, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.ids import CONFLICT, GROUP, PLAN, VARIANT, framed, stable_id, stable_id_of
from strataweave.functions.paths import component, package_stem, path_key

COPY, DEDUPLICATE, MERGE, SELECT_OPAQUE = "copy", "deduplicate", "merge_database", "select_opaque"
MOST_CONFLICTS = 50_000
PLAN_SCHEMA = (
    "schema_version int, plan_id string, base_input string, profile_status string, profile string, inputs array<string>, drift long, warnings array<string>, "
    "conflicts array<struct<conflict_id:string,asset:string,row:string,unit:string,kind:string,variants:array<struct<input_id:string,variant_id:string>>>>"
)


def packages(entries: DataFrame) -> DataFrame:
    """Entries (input_index, path, sha256, ...) grouped into packages and loose files.

    input_index, group_key, loose, complete, components (suffixes in order), digest.
    """
    stem = F.when(component(F.col("path")).isNull(), F.col("path")).otherwise(package_stem(F.col("path")))
    kind = F.coalesce(component(F.col("path")), F.lit("file"))
    placed = entries.select("input_index", path_key(stem).alias("group_key"), kind.alias("component"), path_key(F.col("path")).alias("key"), "sha256")
    grouped = placed.groupBy("input_index", "group_key").agg(F.sort_array(F.collect_list(F.struct("component", "key", "sha256"))).alias("parts"))
    parts = F.transform("parts", lambda p: F.hex(F.concat(framed(p.component), framed(p.key), framed(p.sha256))))
    names = F.transform("parts", lambda p: p.component)
    data = F.concat(F.lit(GROUP).cast("binary"), F.unhex(F.array_join(parts, "")))
    return grouped.select(
        "input_index",
        "group_key",
        F.array_contains(names, "file").alias("loose"),
        F.array_contains(names, ".uasset").alias("complete"),
        names.alias("components"),
        F.sha2(data, 256).alias("digest"),
    )


def asset_actions(groups: DataFrame) -> DataFrame:
    """group_key, n_providers, action: one provider copies, equal ones deduplicate, tables of two components merge, the rest is chosen."""
    table = F.col("complete") & (F.array_join("components", ",") == ".uasset,.uexp")
    seen = groups.groupBy("group_key").agg(F.count("*").alias("n_providers"), (F.min("digest") == F.max("digest")).alias("same"), F.bool_and(table).alias("tables"))
    action = F.when(F.col("n_providers") == 1, COPY).when(F.col("same"), DEDUPLICATE).when(F.col("tables"), MERGE).otherwise(SELECT_OPAQUE)
    return seen.select("group_key", "n_providers", action.alias("action"))


def with_ids(variants: DataFrame, asset: str, key: str, input_ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Variants (key, input_index, unit_id, kind, raw_hash) with variant_id, and conflicts with conflict_id and their variants in (input, variant) order."""
    name = F.element_at(F.array(*[F.lit(x) for x in input_ids]), F.col("input_index") + 1)
    row = F.col(key).cast("string")
    made = variants.withColumn("input_id", name).withColumn("variant_id", stable_id("var", VARIANT, F.lit(asset), row, F.col("unit_id"), F.col("input_id"), F.upper("raw_hash")))
    listed = F.sort_array(F.collect_list(F.struct("input_id", "variant_id", "input_index")))
    grouped = made.groupBy(key, "unit_id", "kind").agg(listed.alias("variants"))
    parts = F.concat(F.array(F.lit(asset), row, F.col("unit_id")), F.transform("variants", lambda v: v.variant_id))
    return made, grouped.withColumn("conflict_id", stable_id_of("conf", CONFLICT, parts))


def offered(conflicts: DataFrame, key: str) -> DataFrame:
    """key, unit_id, kind, conflict_id, input_id, variant_id, input_index: the variants of each conflict, from its own list."""
    return conflicts.select(key, "unit_id", "kind", "conflict_id", F.inline("variants"))


def conflict_chunks(conflicts: DataFrame) -> DataFrame:
    """Digests of the sorted conflict ids by their first two hexadecimal digits: 256 rows, however many conflicts.

    Ids are hashes, so 65,536 groups by four digits hold a few each, and 256 of their digests make a row.
    """
    part, chunk = F.substring("conflict_id", 6, 4).alias("part"), F.substring("part", 1, 2).alias("chunk")
    parts = conflicts.groupBy(part).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("conflict_id")).alias("ids"))
    digests = parts.select("part", "n", F.sha2(F.array_join("ids", ","), 256).alias("digest"))
    grouped = digests.groupBy(chunk).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "digest"))).alias("parts"))
    return grouped.select("chunk", "n", F.sha2(F.array_join("parts.digest", ","), 256).alias("digest"))


def summary(conflicts: DataFrame, differences_drift: DataFrame, input_ids: Sequence[str], base: str, profile: str) -> DataFrame:
    """One row: n_conflicts, n_drift, plan_id over inputs, base, profile and conflict ids."""
    chunks = conflict_chunks(conflicts).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("chunk", "digest"))).alias("chunks"))
    drift = differences_drift.agg(F.count("*").alias("n_drift"))
    status = "selected" if profile != "generic" else "generic"
    fixed = F.array(*[F.lit(x) for x in (*input_ids, base, status, profile)])
    parts = F.concat(fixed, F.transform("chunks", lambda c: c.digest))
    return chunks.join(drift, how="cross").select(F.coalesce("n", F.lit(0)).alias("n_conflicts"), "n_drift", stable_id_of("plan", PLAN, parts).alias("plan_id"))


def write_plan(plan: DataFrame, path: str) -> None:
    """A plan as JSON; an existing one is an error."""
    plan.write.mode("errorifexists").json(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan from JSON, refused unless it has the known schema and version."""
    plan = spark.read.schema(PLAN_SCHEMA).option("mode", "FAILFAST").json(path)
    sound = F.coalesce(F.col("schema_version"), F.lit(0)) == 1
    return plan.withColumn("schema_version", F.when(sound, F.col("schema_version")).otherwise(F.raise_error(F.lit("schema_version must be 1")).cast("int")))
