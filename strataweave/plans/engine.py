"""The whole way from overlays to a verified merge: analyze, choose, execute, verify."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import align, apply, diff
from strataweave.operators.lookup import too_many_conflicts
from strataweave.operators.units import Unit, plan_units
from strataweave.plans import plan as plans
from strataweave.plans import resolve
from strataweave.sources.folders import written


class MergeError(ValueError):
    """Choices that don't fit the plan, or a result that doesn't fit the report."""


@dataclass(frozen=True)
class Session:
    """An analysed table: its overlays and its conflicts with their variants, written once and read by what follows."""

    asset: str
    key: str
    units: tuple[Unit, ...]
    rows: DataFrame
    conflicts: DataFrame
    variants: DataFrame
    drift: DataFrame
    partial: DataFrame
    plan_id: str


def analyze(
    inputs: Sequence[DataFrame], asset: str, key: str, kinds: Mapping[str, str], groups: Sequence[tuple[str, Sequence[str], bool]] = (), input_ids: Sequence[str] | None = None, most_conflicts: int | None = None
) -> Session:
    """Compares donors with the base (the first input) and names every conflict.

    Inputs have the key, ``row_pos`` and the fields of ``kinds``; one that has a
    key twice is refused, and so are more than ``most_conflicts`` conflicts, if
    that is given. A pure function of its inputs: the plan id is the same
    whenever they are.
    """
    ids = tuple(input_ids or (f"in-{n}" for n in range(len(inputs))))
    units = plan_units({key: "integer", **kinds}, groups, key)
    rows = written(align.tagged(inputs), "overlays")
    repeated = align.duplicate_keys(rows, "input_index", key).limit(1).collect()
    if repeated:
        raise MergeError(f"{ids[repeated[0].input_index]} has the key {repeated[0][key]} {repeated[0].copies} times")
    added = diff.added_rows(diff.with_row_texts(rows, kinds), key).where("collides")
    whole = rows.join(added.select(key), key, "left_semi")
    collisions = diff.with_row_hashes(whole, kinds).select(key, "input_index", F.lit(diff.ADDED_ROW).alias("unit_id"), "raw_hash", F.lit(diff.ROW_ID_COLLISION).alias("kind"))
    own = diff.row_variants(rows, key, units, kinds).select(key, "input_index", "unit_id", "raw_hash", "kind")
    _, found = plans.with_ids(own.union(collisions), asset, key, ids)
    conflicts = written(found, "conflicts")
    if most_conflicts is not None and too_many_conflicts(conflicts.where(resolve.blocking(F.col("kind"))), most_conflicts):
        raise MergeError(f"over {most_conflicts} conflicts in {asset}")
    variants = plans.offered(conflicts, key)
    drift = conflicts.where(F.col("kind") == diff.ENCODING_DRIFT)
    plan_id = plans.summary(conflicts.where(resolve.blocking(F.col("kind"))), drift, ids, ids[0], "generic").first().plan_id
    return Session(asset, key, tuple(units), rows, conflicts, variants, drift, align.partial_rows(rows, key, len(inputs)), plan_id)


def check_choices(session: Session, choices: DataFrame, plan_id: str = "") -> None:
    """Raises MergeError unless the choices are of this plan, known, selectable and complete."""
    if plan_id not in ("", session.plan_id):
        raise MergeError("the choices are of another plan")
    wrong = resolve.invalid(choices, session.conflicts, session.variants).limit(1).collect()
    if wrong:
        raise MergeError(f"{wrong[0].reason}: {wrong[0].conflict_id}")
    open_ = resolve.unresolved(session.conflicts, choices).limit(1).collect()
    if open_:
        raise MergeError(f"without a choice: {open_[0].conflict_id}")


@dataclass(frozen=True)
class Result:
    table: DataFrame
    report: DataFrame
    counts: DataFrame
    ledger: DataFrame


def execute(session: Session, choices: DataFrame, plan_id: str = "") -> Result:
    """The merged table in order, the report of what was chosen, counters and audit ledger."""
    check_choices(session, choices, plan_id)
    by_unit = session.variants.join(choices.select("conflict_id", "variant_id"), ["conflict_id", "variant_id"]).select(session.key, "unit_id", "input_index")
    by_unit = written(by_unit, "choices")
    fields = [f for u in session.units for f in u.fields]
    table = written(apply.merged(session.rows, session.key, session.units, by_unit), "merged")
    return Result(
        apply.ordered(table, session.key),
        resolve.report(session.conflicts, session.variants, choices),
        apply.change_counts(session.rows, session.key, session.units, by_unit),
        apply.ledger(table, session.key, fields),
    )


def verify(session: Session, result: Result, table: DataFrame) -> None:
    """Raises MergeError unless a table, read from wherever, has the ledger of the result."""
    fields = [f for u in session.units for f in u.fields]
    found = apply.ledger(table, session.key, fields)
    if found.exceptAll(result.ledger).union(result.ledger.exceptAll(found)).limit(1).collect():
        raise MergeError("the table differs from the audit ledger")
