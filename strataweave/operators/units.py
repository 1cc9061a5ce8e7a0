"""Atomic units of a row: groups of linked fields, array positions, single fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.ids import UNIT, framed
from strataweave.functions.values import canonical

WHOLE_FIELDS, PARALLEL_ITEMS = "whole_fields", "parallel_array_items"


@dataclass(frozen=True)
class Unit:
    """What is chosen as a whole: its name and the fields it covers."""

    id: str
    fields: tuple[str, ...]
    compound: bool = False

    @property
    def atomic(self) -> bool:
        return self.compound or len(self.fields) > 1


def plan_units(kinds: Mapping[str, str], groups: Sequence[tuple[str, Sequence[str], bool]], key: str, *, strict: bool = True) -> list[Unit]:
    """Units of a row with fields of these kinds: the groups first, then a unit per field left.

    A group of which the row has some fields but not all is an error where
    ``strict``, and so are overlapping groups and groups with the key.
    """
    units, used = [], set()
    for name, fields, compound in groups:
        present = [f for f in fields if f in kinds]
        if key in fields or used & set(present):
            raise ValueError(f"group {name} has the key or a field of another group")
        if not present:
            continue
        if len(present) < len(fields):
            if strict:
                raise ValueError(f"group {name} lacks {sorted(set(fields) - set(present))}")
            continue
        used |= set(present)
        units.append(Unit(f"group:{name}", tuple(fields), compound or any(kinds[f] in ("array", "map") for f in fields)))
    units += [Unit(f"field:{f}", (f,), kinds[f] in ("array", "map")) for f in kinds if f != key and f not in used]
    return units


def unit_part(value: Column) -> Column:
    """A value as its unit's hash takes it; null differs from empty."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def hash_of_parts(names: Sequence[str], parts: Sequence[Column]) -> Column:
    """SHA-256 over the framed names and parts of a unit. Frames use a part several times, so parts are best columns."""
    framed_parts = [framed(x) for n, p in zip(names, parts, strict=True) for x in (F.lit(n), p)]
    return F.sha2(F.concat(F.lit(UNIT).cast("binary"), *framed_parts), 256)


def unit_hash(names: Sequence[str], values: Sequence[Column]) -> Column:
    """SHA-256 over the framed names and values of a unit; a null value differs from an empty one."""
    return hash_of_parts(names, [unit_part(v) for v in values])


def semantic(kinds: Mapping[str, str], field: str) -> Column:
    return canonical(F.col(field).cast("string"), kinds[field])


def long_form(rows: DataFrame, key: str, units: Sequence[Unit], kinds: Mapping[str, str]) -> DataFrame:
    """key, input_index, unit_id, unit_pos, atomic, raw_hash, sem_hash: a row for each unit of each row."""
    fields = [f for u in units for f in u.fields]
    raw = {f: f"raw_{n}" for n, f in enumerate(fields)}
    sem = {f: f"sem_{n}" for n, f in enumerate(fields)}
    parts = [unit_part(F.col(f).cast("string")).alias(raw[f]) for f in fields] + [unit_part(semantic(kinds, f)).alias(sem[f]) for f in fields]
    made = [
        F.struct(
            F.lit(u.id).alias("unit_id"),
            F.lit(n).alias("unit_pos"),
            F.lit(u.atomic).alias("atomic"),
            hash_of_parts(u.fields, [F.col(raw[f]) for f in u.fields]).alias("raw_hash"),
            hash_of_parts(u.fields, [F.col(sem[f]) for f in u.fields]).alias("sem_hash"),
        )
        for n, u in enumerate(units)
    ]
    return rows.select(key, "input_index", *parts).select(key, "input_index", F.inline(F.array(*made)))


def array_units(rows: DataFrame, key: str, group: str, fields: Sequence[str]) -> DataFrame:
    """One unit per position of parallel arrays of one length; ``length`` is null where lengths differ or are 0."""
    sizes = [F.size(f) for f in fields]
    length = F.when((F.greatest(*sizes) == F.least(*sizes)) & (sizes[0] > 0), sizes[0]) if len(sizes) > 1 else F.nullif(sizes[0], F.lit(0))
    flat = rows.select(key, "input_index", length.alias("length"), *fields)
    items = F.posexplode(F.arrays_zip(*[F.col(f) for f in fields]))
    placed = flat.where("length is not null").select(key, "input_index", "length", items.alias("position", "item"))
    unit = F.concat(F.lit(f"group:{group}["), F.col("position"), F.lit("]"))
    return placed.select(key, "input_index", "length", "position", unit.alias("unit_id"), *[F.col(f"item.{f}").alias(f) for f in fields])
