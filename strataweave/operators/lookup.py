"""Lookups and guards around a merge: providers, name tables, imports, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.align import MOST_INPUTS
from strataweave.plans.plan import MOST_CONFLICTS

MOST_INPUT_BYTES = 128 << 30


def provider_of(providers: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Each group's provider (group_key, input_id, ...): the chosen input's copy, else the first by input id."""
    order = Window.partitionBy("group_key").orderBy(F.col("chosen").desc(), "input_id")
    if chosen is None:
        marked = providers.withColumn("chosen", F.lit(False))
    else:
        wanted = chosen.select("group_key", "input_id", F.lit(True).alias("chosen"))
        marked = providers.join(wanted, ["group_key", "input_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    return marked.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "chosen")


def chosen_inputs(conflicts: DataFrame, choices: DataFrame, variants: DataFrame) -> DataFrame:
    """Conflicts with the input whose variant was chosen."""
    offered = variants.select("conflict_id", "variant_id", "input_id")
    return conflicts.join(choices, "conflict_id").join(offered, ["conflict_id", "variant_id"])


def name_indexes(base_names: DataFrame, donor_names: DataFrame) -> DataFrame:
    """Each donor name (pos, name) with its index in the base's table; new names follow in order.

    Of a repeated base name the first occurrence counts.
    """
    first = base_names.groupBy("name").agg(F.min("pos").alias("base_pos"))
    size = base_names.agg(F.count("*").alias("base_n"))
    wanted = donor_names.groupBy("name").agg(F.min("pos").alias("pos")).join(first, "name", "left")
    # names of one package: a table of a few thousand rows
    added = wanted.where("base_pos is null").withColumn("n", F.row_number().over(Window.orderBy("pos")) - 1).join(F.broadcast(size))
    known = wanted.where("base_pos is not null").select("name", F.col("base_pos").alias("index"), F.lit(False).alias("added"))
    return known.union(added.select("name", (F.col("base_n") + F.col("n")).alias("index"), F.lit(True).alias("added")))


def import_matches(base: DataFrame, donor: DataFrame) -> DataFrame:
    """Donor imports with the base import of the same package, class and object (null-safe); null if there is none."""
    keys = ("class_package", "class_name", "object_name")
    left = base.groupBy(*keys).agg(F.min("pos").alias("base_pos"))
    same = [donor[k].eqNullSafe(left[k]) for k in keys]
    return donor.join(left, same, "left").select(donor["pos"], *[donor[k] for k in keys], "base_pos")


def stale_hashes(entries: DataFrame) -> DataFrame:
    """Entries whose stored hash is wrong, and whether that is tolerated.

    Only in version 3, for a ``.uexp`` that is a sound table (``is_table``) and whose
    header of the same stem is sound.
    """
    stem = F.regexp_replace(F.lower("path"), r"(?s)\.[^./]*\z", "")
    marked = entries.withColumn("stem", stem)
    headers = marked.where("sha1_ok and lower(path) like '%.uasset'").select("archive", "stem", F.lit(True).alias("header_ok")).distinct()
    wrong = marked.where("not sha1_ok").join(headers, ["archive", "stem"], "left")
    tolerated = (F.col("version") == 3) & F.lower("path").endswith(".uexp") & F.col("is_table") & F.coalesce("header_ok", F.lit(False))
    return wrong.select("archive", "path", tolerated.alias("tolerated"))


def compression_conforms(entries: DataFrame, method: str) -> DataFrame:
    """One row: whether no entry is compressed (``None``), or every non-empty one is by the one method."""
    full = F.col("logical") > 0
    odd = F.count_if(full & (F.col("method") != method))
    return entries.agg(F.count("*").alias("n"), odd.alias("n_odd")).withColumn("conforms", F.col("n_odd") == 0)


def placement_assets(paths: DataFrame, folder: str, prefix: str) -> DataFrame:
    """Paths below a folder whose file name starts with a prefix, in any case."""
    lowered = F.lower("path")
    return paths.where(lowered.contains(folder) & F.element_at(F.split(lowered, "/"), -1).startswith(prefix))


def input_errors(inputs: DataFrame, base_id: str) -> DataFrame:
    """What speaks against a set of inputs (input_id, path, size, sha256); empty if nothing does."""
    total = inputs.agg(
        F.count("*").alias("n"),
        F.sum("size").alias("bytes"),
        F.count_distinct("sha256").alias("hashes"),
        F.count_distinct(F.lower("path")).alias("paths"),
        F.count_if(F.col("input_id") == base_id).alias("bases"),
        F.count_if(~F.lower("path").endswith(".pak")).alias("others"),
    )
    checks: list[tuple[Column, str]] = [
        ((F.col("n") < 1) | (F.col("n") > MOST_INPUTS), "number of inputs"),
        (F.col("bytes") > MOST_INPUT_BYTES, "total size"),
        (F.col("hashes") < F.col("n"), "equal inputs"),
        (F.col("paths") < F.col("n"), "repeated path"),
        (F.col("bases") != 1, "base isn't listed"),
        (F.col("others") > 0, "not an archive name"),
    ]
    return total.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(why)) for c, why in checks]))).alias("error"))


def too_many_conflicts(conflicts: DataFrame, most: int = MOST_CONFLICTS) -> bool:
    """Whether a plan has more conflicts than it may; counts one more than the limit at most."""
    return conflicts.limit(most + 1).count() > most


def duplicate_outputs(paths: DataFrame) -> DataFrame:
    """Output paths that differ in case only."""
    return paths.groupBy(F.lower("path").alias("path_key")).agg(F.count("*").alias("copies")).where("copies > 1")
