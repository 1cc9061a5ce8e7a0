"""Incremental planning: every new batch of donor rows is compared with the base.

A plan is a pure function of base and donors, so the stream keeps no state: each
micro-batch is diffed on its own and written under its batch id, which makes a
repeated batch overwrite itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strataweave.operators import align, diff
from strataweave.operators.units import Unit


def watch_donors(base: DataFrame, donors: DataFrame, key: str, units: Sequence[Unit], kinds: Mapping[str, str], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes each batch's differences from the base to ``<out>/batch=<id>``."""

    def compare(batch: DataFrame, number: int) -> None:
        held = base.join(batch.select(key).distinct(), key, "left_semi")
        rows = align.tagged([held, batch])
        found = diff.row_differences(rows, key, units, kinds)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return donors.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
