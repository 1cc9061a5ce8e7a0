"""Versions of differing units: without a join, and equal to the plain way."""

from pyspark.sql import functions as F

from strataweave import queries
from strataweave.operators import diff, units

SF = "/root/testdata/sf0.001"
KINDS = {"a": "integer", "b": "text", "c": "float"}
UNITS = units.plan_units({"k": "integer", **KINDS}, [("ab", ("a", "b"), True)], "k")


def test_nothing_is_joined_back(spark):
    """A join's small side was estimated by its Parquet file, and broadcasting it took the driver's memory at 60 times sf0.1."""
    for name in ("variants", "conflict_ids"):
        assert "Join" not in queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_equals_long_form_joined_with_differences(spark, rows):
    made = [
        (0, 1, "1", "x", "1.0"), (1, 1, "01", "x", "1"), (2, 1, "2", "x", None), (0, 2, None, "", "3"), (1, 2, "", None, "3"), (0, 3, "5", "y", "0"), (1, 3, "5", "y", "-0.0"),
        (1, 4, "1", "x", "1"), (2, 4, "2", "x", "1"), (0, 5, "1", "z", "1"), (0, None, "1", "z", "1"), (1, None, "2", "z", "1"),
    ]
    df = spark.createDataFrame(made, "input_index int, k long, a string, b string, c string")
    long = units.long_form(df, "k", UNITS, KINDS)
    want = long.join(diff.unit_differences(long, "k").select("k", "unit_id", "kind"), ["k", "unit_id"])
    names = ("k", "input_index", "unit_id", "kind", "raw_hash")
    found = rows(diff.row_variants(df, "k", UNITS, KINDS), *names)
    assert found == rows(want, *names)
    assert {r[0] for r in found} == {1, 2, 3}


def test_frames_keep_their_form(spark):
    """Lengths of 0, one byte, over 127 and over 255 bytes, with characters of several bytes."""
    from strataweave.functions.ids import framed

    texts = ["", "a", "é" * 63 + "x", "é" * 64, "x" * 127, "x" * 128, "€" * 85, "😀" * 100, None, "\0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", framed(F.col("t")).alias("f"))
    for r in df.collect():
        data = (r.t or "").encode()
        assert bytes(r.f) == len(data).to_bytes(8, "big") + data


def test_choices_read_their_conflicts_alone(spark):
    """Variants come from each conflict's own list: only choices are joined."""
    for name, joins in (("unresolved_conflicts", 1), ("invalid_choices", 2), ("bulk_choose", 2), ("report_records", 2)):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") <= joins, name
