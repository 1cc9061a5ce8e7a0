"""Choices: what is missing, what is wrong, choosing in bulk, and the report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.diff import ENCODING_DRIFT, INFORMATIONAL, PLACEMENT


def blocking(kind: Column) -> Column:
    return ~kind.isin(*INFORMATIONAL)


def unresolved(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """Blocking conflicts without a choice."""
    return conflicts.where(blocking(F.col("kind"))).join(choices.select("conflict_id"), "conflict_id", "left_anti")


def invalid(choices: DataFrame, conflicts: DataFrame, variants: DataFrame) -> DataFrame:
    """Choices with why they can't be: unknown conflict, informational kind or unknown variant."""
    known = conflicts.select("conflict_id", "kind")
    offered = variants.select("conflict_id", "variant_id", F.lit(True).alias("offered"))
    seen = choices.join(known, "conflict_id", "left").join(offered, ["conflict_id", "variant_id"], "left")
    why = F.when(F.col("kind").isNull(), "unknown conflict").when(~blocking(F.col("kind")), "informational").when(F.col("offered").isNull(), "unknown variant")
    return seen.select("conflict_id", "variant_id", why.alias("reason")).where("reason is not null")


def matches_text(needle: str, *columns: str) -> Column:
    """Whether the lower-cased texts have a needle in lower case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle))


def bulk_choose(conflicts: DataFrame, variants: DataFrame, choices: DataFrame, input_id: str, condition: Column | None = None) -> DataFrame:
    """Choices of one input's variant for all selectable conflicts without one; made choices stay."""
    open_ = unresolved(conflicts if condition is None else conflicts.where(condition), choices)
    return open_.select("conflict_id").join(variants.where(F.col("input_id") == input_id).select("conflict_id", "variant_id"), "conflict_id")


def inline_choices(pairs: Iterable[str]) -> dict[str, str]:
    """``conflict=variant`` pairs; a contradiction is an error."""
    out: dict[str, str] = {}
    for pair in pairs:
        conflict, found, variant = pair.partition("=")
        if not found or not conflict or not variant:
            raise ValueError(f"not conflict=variant: {pair!r}")
        if out.setdefault(conflict, variant) != variant:
            raise ValueError(f"two choices for {conflict}")
    return out


def report(conflicts: DataFrame, variants: DataFrame, choices: DataFrame) -> DataFrame:
    """conflict_id, kind, variant_id, automatic: what was chosen, or taken by itself.

    Drift without a choice takes the base's variant, else that of the first
    input; placement notes have none.
    """
    own = variants.groupBy("conflict_id").agg(F.min_by("variant_id", "input_index").alias("first"))
    seen = conflicts.join(choices.select("conflict_id", "variant_id"), "conflict_id", "left").join(own, "conflict_id", "left")
    drift = (F.col("kind") == ENCODING_DRIFT) & F.col("variant_id").isNull()
    taken = F.when(F.col("kind") == PLACEMENT, F.lit(None)).when(drift, F.col("first")).otherwise(F.col("variant_id"))
    return seen.select("conflict_id", "kind", taken.alias("variant_id"), drift.alias("automatic"))
