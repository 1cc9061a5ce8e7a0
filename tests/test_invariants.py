"""Properties of diff and apply on small tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.functions import ids, paths, values
from strataweave.operators import align, apply, diff, refs, units, verify

KINDS = {"a": "integer", "b": "text", "c": "float"}
UNITS = units.plan_units({"k": "integer", **KINDS}, [("ab", ("a", "b"), False)], "k")
SCHEMA = "k long, row_pos long, a string, b string, c string"
MOST = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
row = st.tuples(st.integers(0, 6), st.sampled_from(["1", "01", "2", None]), st.sampled_from(["x", "X", ""]), st.sampled_from(["1.0", "1", "nan", "-0.0", "0"]))
table = st.lists(row, max_size=6, unique_by=lambda r: r[0])


def overlay(spark, tables):
    return align.tagged([spark.createDataFrame([(k, k, a, b, c) for k, a, b, c in t], SCHEMA) for t in tables])


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@MOST
@given(base=table)
def test_an_input_does_not_differ_from_itself(spark, base):
    rows = overlay(spark, [base, base])
    assert found(diff.unit_differences(units.long_form(rows, "k", UNITS, KINDS), "k")) == []
    merged = apply.merged(rows, "k", UNITS, spark.createDataFrame([], "k long, unit_id string, input_index int"))
    assert sorted(r.k for r in merged.collect()) == sorted(k for k, *_ in base)


@MOST
@given(base=table, one=table, two=table)
def test_order_of_donors_changes_no_difference_and_rows_are_never_lost(spark, base, one, two):
    made = [diff.unit_differences(units.long_form(overlay(spark, t), "k", UNITS, KINDS), "k") for t in ([base, one, two], [base, two, one])]
    assert found(made[0]) == found(made[1])
    rows = overlay(spark, [base, one, two])
    merged = apply.merged(rows, "k", UNITS, spark.createDataFrame([], "k long, unit_id string, input_index int")).collect()
    assert sorted(r.k for r in merged) == sorted({k for t in (base, one, two) for k, *_ in t})
    by_key = {k: (a, b, c) for k, a, b, c in base}
    for r in merged:
        if not r.is_added:
            assert (r.a, r.b, r.c) == by_key[r.k]


def test_meaning_and_encoding_are_told_apart(spark):
    rows = overlay(spark, [[(1, "1", "x", "1.0"), (2, "1", "x", "0")], [(1, "01", "x", "1"), (2, "2", "x", "-0.0")]])
    kinds = {(r.k, r.unit_id): r.kind for r in diff.unit_differences(units.long_form(rows, "k", UNITS, KINDS), "k").collect()}
    assert kinds == {(1, "group:ab"): "ENCODING_DRIFT", (1, "field:c"): "ENCODING_DRIFT", (2, "group:ab"): "ATOMIC_GROUP", (2, "field:c"): "ENCODING_DRIFT"}


def test_whole_row_choices_take_the_entire_row(spark):
    rows = overlay(spark, [[(1, "1", "x", "1")], [(1, "2", "y", "2")], [(9, "5", "z", "3")]])
    choices = spark.createDataFrame([(1, diff.WHOLE_ROW, 1)], "k long, unit_id string, input_index int")
    out = apply.ordered(apply.merged(rows, "k", UNITS, choices), "k").collect()
    assert [(r.k, r.a, r.b, r.c, r.is_added) for r in out] == [(1, "2", "y", "2", False), (9, "5", "z", "3", True)]
    assert found(apply.change_counts(rows, "k", UNITS, choices)) == [(2, 0, 2)]


def test_plan_units_refuses_partial_and_overlapping_groups():
    with pytest.raises(ValueError, match="lacks"):
        units.plan_units({"k": "integer", "a": "text"}, [("g", ("a", "z"), False)], "k")
    with pytest.raises(ValueError, match="another group"):
        units.plan_units({"k": "integer", "a": "text", "b": "text"}, [("g", ("a", "b"), False), ("h", ("b",), False)], "k")
    with pytest.raises(ValueError, match="key"):
        units.plan_units({"k": "integer", "a": "text"}, [("g", ("k", "a"), False)], "k")
    assert [u.id for u in units.plan_units({"k": "integer", "a": "text"}, [("g", ("y", "z"), False)], "k")] == ["field:a"]


def test_number_of_inputs_is_bounded(spark):
    with pytest.raises(ValueError):
        align.tagged([])
    with pytest.raises(ValueError):
        align.tagged([spark.range(1)] * 65)


def test_exact_numbers(spark):
    text = spark.createDataFrame([("9007199254740993",), ("9007199254740992",), ("nan",), ("-0.0",), ("1e3",), (None,)], "v string")
    got = [r[0] for r in text.select(values.canonical(F.col("v"), "float")).collect()]
    assert got[2:] == ["f:nan", "i:0", "i:1000", None]
    ints = [r[0] for r in text.limit(2).select(values.canonical(F.col("v"), "integer")).collect()]
    assert ints == ["i:9007199254740993", "i:9007199254740992"]


def test_framing_keeps_parts_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert len({r[0] for r in df.select(ids.stable_id("t", "tag", F.col("x"), F.col("y"))).collect()}) == 2


def test_mounts_and_matchers(spark):
    df = spark.createDataFrame([("../../Game/x",), ("Game/../x",), ("/abs",), ("a//b",), ("C:/x",), ("a/b/",)], "m string")
    got = [r[0] for r in df.select(paths.mount_error(F.col("m"))).collect()]
    assert got == [None, "dots", "absolute", "empty part", "colon", None]
    hit = spark.createDataFrame([("/../../game/a",), ("/x/game/a",)], "p string").select(paths.matches(F.col("p"), F.lit("prefix"), F.lit("/game/")))
    assert [r[0] for r in hit.collect()] == [True, False]


def test_references_skip_exempt_pairs_and_zero(spark):
    uses = spark.createDataFrame([("r", 1, 5, 1), ("r", 2, 0, 2), ("r", 3, 7, 3), ("r", 4, 9, 4)], "rule string, source_row long, target_id long, scan_order long")
    targets = spark.createDataFrame([("r", 5)], "rule string, target_id long")
    exempt = spark.createDataFrame([("r", 3, 7)], "rule string, source_row long, target_id long")
    assert found(refs.summary(refs.missing(uses, targets, exempt))) == [("r", 1, 9, 9)]


def test_inventory_states(spark):
    schema = "path_key string, size long, sha256 string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], schema)
    new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("d", 1, "x"), ("d", 1, "x"), ("e", 1, "z")], schema)
    assert found(verify.inventory_diff(old, new)) == [("b", "changed"), ("c", "missing"), ("d", "duplicate"), ("e", "extra")]
    assert found(verify.same_files(old.select(F.col("path_key").alias("path")), new.select(F.col("path_key").alias("path"))).select("path", "side")) == [("c", "first"), ("d", "second"), ("e", "second")]
