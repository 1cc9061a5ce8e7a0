"""Applying choices: merged rows, their order, counters and the audit ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.ids import distinct_text
from strataweave.operators.diff import ADDED_ROW, WHOLE_ROW
from strataweave.operators.units import Unit

LEDGER_ROWS = 1024


def _by_key(rows: DataFrame, key: str, fields: Sequence[str], choices: DataFrame) -> DataFrame:
    """Each key with its holders' rows (a map by input), its choices (a map by unit) and its base."""
    held = rows.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("input_index", F.struct(*fields)))).alias("held"),
        F.min("input_index").alias("base"),
        F.min(F.when(F.col("input_index") == 0, F.col("row_pos"))).alias("base_pos"),
    )
    chosen = choices.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "input_index"))).alias("chosen"))
    joined = held.join(chosen, key, "left").withColumn("chosen", F.coalesce("chosen", F.create_map().cast("map<string,int>")))
    whole = F.coalesce(F.try_element_at("chosen", F.lit(WHOLE_ROW)), F.try_element_at("chosen", F.lit(ADDED_ROW)))
    return joined.withColumn("whole", whole).withColumn("is_added", F.col("base") > 0)


def merged(rows: DataFrame, key: str, units: Sequence[Unit], choices: DataFrame) -> DataFrame:
    """key, fields, is_added, base_pos of the merged table.

    A whole-row choice takes the chosen holder's entire row; else each unit comes
    from its chosen input, or from the base (of added rows the first holder).
    """
    fields = [f for u in units for f in u.fields]
    joined = _by_key(rows, key, fields, choices)
    out = []
    for u in units:
        source = F.coalesce(F.col("whole"), F.try_element_at("chosen", F.lit(u.id)), F.col("base"))
        out += [F.try_element_at("held", source)[f].alias(f) for f in u.fields]
    return joined.select(key, *out, "is_added", "base_pos")


def ordered(table: DataFrame, key: str) -> DataFrame:
    """Base rows in base order, then added rows by ascending key."""
    return table.orderBy("is_added", "base_pos", key)


def change_counts(rows: DataFrame, key: str, units: Sequence[Unit], choices: DataFrame) -> DataFrame:
    """One row: rows, preserved and replaced units of the merged table."""
    fields = [f for u in units for f in u.fields]
    joined = _by_key(rows, key, fields, choices)
    replaced = F.lit(0)
    for u in units:
        source = F.try_element_at("chosen", F.lit(u.id))
        replaced = replaced + F.when(source.isNotNull() & (source != F.col("base")), len(u.fields)).otherwise(0)
    counted = joined.withColumn("touched", replaced).withColumn("kept_whole", F.col("whole") == F.col("base"))
    preserved = F.when(F.col("is_added"), 0).when(F.col("whole").isNotNull(), F.col("kept_whole").cast("int")).when(F.col("touched") == 0, 1).otherwise(len(fields) - F.col("touched"))
    changed = F.when(F.col("is_added"), 1).when(F.col("whole").isNotNull(), 1 - F.col("kept_whole").cast("int")).otherwise(F.col("touched"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return counted.agg(F.count("*").alias("n_rows"), total(preserved, "preserved"), total(changed, "replaced"))


def apply_array_choice(base: DataFrame, donors: DataFrame, choices: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Base arrays with single positions taken from chosen donors.

    ``choices``: key, position, input_index. Arrays keep their length; a donor of
    another length is never taken from.
    """
    wanted = choices.join(donors.withColumnRenamed("input_index", "donor"), key).where(F.col("donor") == F.col("input_index"))
    taken = wanted.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("position", F.struct(F.size(fields[0]).alias("n"), *[F.get(f, F.col("position")).alias(f) for f in fields])))).alias("taken")
    )

    def patched(f):
        def item(x, i):
            got = F.try_element_at("taken", i)
            return F.when(got.n == F.size(f), got[f]).otherwise(x)

        return F.when(F.col("taken").isNull(), F.col(f)).otherwise(F.transform(f, item)).alias(f)

    return base.join(taken, key, "left").select(key, *[patched(f) for f in fields])


def ledger(table: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Hashes of stretches of output rows in order: section, stretch, n_rows, digest.

    A stretch has at most LEDGER_ROWS base positions (or keys of added rows), so
    that no task gathers more, and stretches are hashed where they are.
    """
    place = F.coalesce("base_pos", key)
    text = distinct_text([F.col(f).cast("string") for f in (key, *fields)])
    rows = table.select(F.when(F.col("is_added"), "added").otherwise("base").alias("section"), F.floor(place / LEDGER_ROWS).alias("stretch"), place.alias("place"), F.sha2(text, 256).alias("row_hash"))
    grouped = rows.groupBy("section", "stretch").agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list(F.struct("place", "row_hash"))).alias("hashes"))
    joined = F.array_join(F.transform("hashes", lambda x: x.row_hash), "")
    return grouped.select("section", "stretch", "n_rows", F.sha2(joined, 256).alias("digest"))


def rising(rows: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Per group: rows, and neighbours by position that fall or repeat."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(position))
    seen = rows.select(group, F.col(value).alias("v"), before.alias("before"))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return seen.groupBy(group).agg(F.count("*").alias("n"), count(F.col("v") < F.col("before"), "falls"), count(F.col("v") == F.col("before"), "repeats"))


def running_total(rows: DataFrame, group: str, order: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """The rows with the sum of ``value`` over their group up to their (integer) order, equal ones included.

    Windows are over ``width`` orders of a group; totals of the stretches before come from a window over those alone,
    so that a group of a third of all rows is spread.
    """
    parted = rows.withColumn("__part", F.floor(F.col(order) / width))
    sums = parted.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__at")).agg(F.sum(value).alias("total"))
    before = F.sum("total").over(Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    totals = sums.select("__group", "__at", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = parted.join(totals, F.col(group).eqNullSafe(F.col("__group")) & F.col("__part").eqNullSafe(F.col("__at")))
    within = F.sum(value).over(Window.partitionBy(group, "__part").orderBy(order))
    return joined.withColumn(name, within + F.col("__before")).drop("__part", "__group", "__at", "__before")


def overlaps(ranges: DataFrame, group: str, start: str, end: str, width: int = 1 << 24) -> DataFrame:
    """Ranges that begin before an earlier one of their group ends; those without a start or an end take no part.

    Windows are over starts within ``width``; what reaches in from before is the greatest end of the stretches before.
    """
    parted = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__part", F.floor(F.col(start) / width))
    ends = parted.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__at")).agg(F.max(end).alias("end"))
    before = F.max("end").over(Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    joined = parted.join(ends.select("__group", "__at", before.alias("__before")), F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    within = F.max(end).over(Window.partitionBy(group, "__part").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(within, F.col("__before"))
    return joined.withColumn("reach", reach).where(F.col(start) < F.col("reach")).drop("__part", "__group", "__at", "__before")
