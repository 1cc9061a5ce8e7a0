"""Differences between a base and its donors, by unit and by row.

One grouping decides everything: among the holders of a row that the base has,
some donor differs from the base exactly if not all values are equal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.ids import distinct_text
from strataweave.operators.units import Unit, hash_of_parts, semantic, unit_hash, unit_part

FIELD_VALUE, ATOMIC_GROUP, ROW_ID_COLLISION = "FIELD_VALUE", "ATOMIC_GROUP", "ROW_ID_COLLISION"
STRUCTURE_MISMATCH, ENCODING_DRIFT, OPAQUE_PACKAGE = "STRUCTURE_MISMATCH", "ENCODING_DRIFT", "OPAQUE_PACKAGE"
PLACEMENT = "POTENTIAL_PLACEMENT_COLLISION"
#: Kinds that inform and can't be chosen.
INFORMATIONAL = (ENCODING_DRIFT, PLACEMENT)
WHOLE_ROW, ADDED_ROW = "__whole_row__", "$row"
DRIFT_SAMPLES = 64


def differs(c: str) -> Column:
    return F.min(c) != F.max(c)


def unit_differences(long: DataFrame, key: str) -> DataFrame:
    """key, unit_id, unit_pos, kind, n_variants of each unit that differs from the base, drift included."""
    seen = long.groupBy(key, "unit_id", "unit_pos", "atomic").agg(
        F.min("input_index").alias("first"), F.count("*").alias("n_variants"), differs("sem_hash").alias("meaning"), differs("raw_hash").alias("bytes")
    )
    kind = F.when(F.col("meaning"), F.when(F.col("atomic"), ATOMIC_GROUP).otherwise(FIELD_VALUE)).otherwise(ENCODING_DRIFT)
    return seen.where("first = 0 and n_variants > 1 and (meaning or bytes)").select(key, "unit_id", "unit_pos", kind.alias("kind"), "n_variants")


def _compared(units: Sequence[Unit], kinds: Mapping[str, str]) -> tuple[dict[str, Column], list[Column], list[Column]]:
    """Texts of each unit by name; whether units differ in bytes, and as what, from ``differs`` of the texts (named bytes0, meaning0, ...)."""
    texts, kind_of = {}, []
    for n, u in enumerate(units):
        plain = all(kinds[f] not in ("integer", "float", "boolean") for f in u.fields)  # meaning and bytes are one
        texts[f"bytes{n}"] = distinct_text([F.col(f).cast("string") for f in u.fields])
        meaning = F.col(f"bytes{n}")
        if not plain:
            texts[f"meaning{n}"] = distinct_text([semantic(kinds, f) for f in u.fields])
            meaning = F.col(f"meaning{n}")
        kind_of.append(F.when(meaning, F.lit(ATOMIC_GROUP if u.atomic else FIELD_VALUE)).otherwise(F.lit(ENCODING_DRIFT)))
    return texts, [F.col(f"bytes{n}") for n in range(len(units))], kind_of


def row_differences(rows: DataFrame, key: str, units: Sequence[Unit], kinds: Mapping[str, str]) -> DataFrame:
    """What ``unit_differences`` finds, from whole rows: one grouping, and only units that differ become rows."""
    texts, changed, kind_of = _compared(units, kinds)
    grouped = rows.select(key, "input_index", *[t.alias(c) for c, t in texts.items()]).groupBy(key)
    seen = grouped.agg(F.min("input_index").alias("first"), F.count("*").alias("n_variants"), *[differs(c).alias(c) for c in texts])
    found = [F.when(changed[n], F.struct(F.lit(u.id).alias("unit_id"), F.lit(n).alias("unit_pos"), kind_of[n].alias("kind"))) for n, u in enumerate(units)]
    return seen.where("first = 0 and n_variants > 1").select(key, "n_variants", F.inline(F.array_compact(F.array(*found)))).select(key, "unit_id", "unit_pos", "kind", "n_variants")


def row_variants(rows: DataFrame, key: str, units: Sequence[Unit], kinds: Mapping[str, str]) -> DataFrame:
    """key, input_index, unit_id, kind, raw_hash: every holder's version of each unit that differs.

    Rows of one key meet once, in a window, and tell there which of their units
    differ: nothing is joined back, so nothing is broadcast either.
    """
    texts, changed, kind_of = _compared(units, kinds)
    held = Window.partitionBy(key)
    fields = [f for u in units for f in u.fields]
    parts = {f: f"part{n}" for n, f in enumerate(fields)}
    met = rows.where(F.col(key).isNotNull()).select(key, "input_index", *fields).repartition(key)  # whole rows move, their texts don't
    texted = met.withColumns({f"{c}_text": t for c, t in texts.items()})
    over = {c: F.min(f"{c}_text").over(held) != F.max(f"{c}_text").over(held) for c in texts}
    seen = texted.withColumns({"first": F.min("input_index").over(held), "n_held": F.count("*").over(held), **over}).where("first = 0 and n_held > 1")
    hashed = seen.withColumns({parts[f]: unit_part(F.col(f).cast("string")) for f in fields})
    found = [
        F.when(changed[n], F.struct(F.lit(u.id).alias("unit_id"), kind_of[n].alias("kind"), hash_of_parts(u.fields, [F.col(parts[f]) for f in u.fields]).alias("raw_hash")))
        for n, u in enumerate(units)
    ]
    return hashed.select(key, "input_index", F.inline(F.array_compact(F.array(*found))))


def shape_mismatches(rows: DataFrame, key: str, shape: str) -> DataFrame:
    """Rows whose holders have different field lists: one choice for the whole row."""
    seen = rows.groupBy(key).agg(F.min("input_index").alias("first"), F.count("*").alias("n_variants"), differs(shape).alias("differs"))
    return seen.where("first = 0 and differs").select(key, F.lit(WHOLE_ROW).alias("unit_id"), F.lit(STRUCTURE_MISMATCH).alias("kind"), "n_variants")


def with_row_texts(rows: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The rows with texts in place of the hashes, for where they are only compared."""
    return rows.withColumn("raw_hash", distinct_text([F.col(f).cast("string") for f in kinds])).withColumn("sem_hash", distinct_text([semantic(kinds, f) for f in kinds]))


def with_row_hashes(rows: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The rows with raw_hash and sem_hash over all their fields."""
    raw = unit_hash(list(kinds), [F.col(f).cast("string") for f in kinds])
    return rows.withColumn("raw_hash", raw).withColumn("sem_hash", unit_hash(list(kinds), [semantic(kinds, f) for f in kinds]))


def added_rows(hashed: DataFrame, key: str) -> DataFrame:
    """Rows the base lacks: first_input, n_variants, and whether holders disagree in meaning or only in bytes."""
    seen = hashed.groupBy(key).agg(
        F.min("input_index").alias("first_input"), F.count("*").alias("n_variants"), differs("sem_hash").alias("collides"), differs("raw_hash").alias("bytes")
    )
    return seen.where("first_input > 0").withColumn("drifts", F.col("bytes") & ~F.col("collides")).drop("bytes")


def conflicts(differences: DataFrame, mismatches: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """key, unit_id, kind, n_variants: units of rows of one shape, whole rows, collisions of added rows."""
    units = differences.join(mismatches.select(key), key, "left_anti").select(key, "unit_id", "kind", "n_variants")
    rows = added.where("collides").select(key, F.lit(ADDED_ROW).alias("unit_id"), F.lit(ROW_ID_COLLISION).alias("kind"), "n_variants")
    return units.unionByName(mismatches).unionByName(rows)


def drift_samples(differences: DataFrame, key: str, most: int = DRIFT_SAMPLES) -> DataFrame:
    """The first drifting units by row and position; a distributed top-k."""
    return differences.where(F.col("kind") == ENCODING_DRIFT).orderBy(key, "unit_pos").limit(most)


def placement_collisions(rows: DataFrame, *, row: str, map_id: str, appear: str, label: str, owner: str, talk: str) -> DataFrame:
    """Places that rows of several inputs may want for different owners; informs only.

    Key: map and appear label where both are given, else the label. Kept are keys
    with two rows, two (owner, talk) bindings, two inputs, and two different sets
    of (row, binding) by input.
    """
    text = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    place = F.when((F.col(map_id) > 0) & text(appear).isNotNull(), F.concat(F.col(map_id), F.lit("|"), text(appear))).otherwise(text(label))
    bound = F.struct(F.col(row).alias("row"), F.col(owner).alias("owner"), F.col(talk).alias("talk"))
    placed = rows.where((F.col(owner) > 0) & (F.col(talk) > 0)).select("input_index", place.alias("place"), bound.alias("bound")).where("place is not null")
    facts = placed.distinct()  # map-side; what follows sees each fact once
    per_input = facts.groupBy("place", "input_index").agg(F.sort_array(F.collect_set("bound")).alias("facts"))
    sides = per_input.groupBy("place").agg(F.count("*").alias("n_inputs"), F.count_distinct("facts").alias("n_sets"))
    counted = facts.groupBy("place").agg(F.count_distinct("bound.row").alias("n_rows"), F.count_distinct(F.struct("bound.owner", "bound.talk")).alias("n_bindings"))
    return counted.join(sides, "place").where("n_rows > 1 and n_bindings > 1 and n_inputs > 1 and n_sets > 1").select("place", "n_rows", "n_bindings", "n_inputs")
