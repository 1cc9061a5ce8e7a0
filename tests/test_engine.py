import pytest
from pyspark.sql import functions as F

from strataweave.operators import apply, lookup
from strataweave.plans import engine, resolve

KINDS = {"a": "integer", "b": "text"}
SCHEMA = "k long, row_pos long, a string, b string"


def inputs(spark):
    return [
        spark.createDataFrame([(1, 0, "1", "x"), (2, 1, "2", "y"), (3, 2, "3", "z")], SCHEMA),
        spark.createDataFrame([(1, 0, "9", "x"), (2, 1, "02", "y"), (8, 2, "1", "n")], SCHEMA),
        spark.createDataFrame([(2, 0, "2", "q"), (8, 1, "2", "n"), (7, 2, "7", "m")], SCHEMA),
    ]


def test_from_overlays_to_a_verified_table(spark):
    session = engine.analyze(inputs(spark), "t", "k", KINDS)
    kinds = {(r.k, r.unit_id): r.kind for r in session.conflicts.collect()}
    assert kinds == {(1, "field:a"): "FIELD_VALUE", (2, "field:a"): "ENCODING_DRIFT", (2, "field:b"): "FIELD_VALUE", (8, "$row"): "ROW_ID_COLLISION"}
    assert engine.analyze(inputs(spark), "t", "k", KINDS).plan_id == session.plan_id
    none = spark.createDataFrame([], "conflict_id string, variant_id string")
    with pytest.raises(engine.MergeError, match="without a choice"):
        engine.execute(session, none)
    choices = resolve.bulk_choose(session.conflicts, session.variants, none, "in-2")
    choices = choices.union(resolve.bulk_choose(session.conflicts, session.variants, choices, "in-1"))
    with pytest.raises(engine.MergeError, match="another plan"):
        engine.execute(session, choices, "plan-x")
    result = engine.execute(session, choices, session.plan_id)
    assert [tuple(r)[:3] for r in result.table.collect()] == [(1, "9", "x"), (2, "2", "q"), (3, "3", "z"), (7, "7", "m"), (8, "2", "n")]
    report = {(r.kind, r.automatic) for r in result.report.collect()}
    assert report == {("FIELD_VALUE", False), ("ROW_ID_COLLISION", False), ("ENCODING_DRIFT", True)}
    assert tuple(result.counts.first()) == (5, 1 + 1 + 1, 2 + 2)
    engine.verify(session, result, result.table)
    with pytest.raises(engine.MergeError, match="ledger"):
        engine.verify(session, result, result.table.withColumn("b", F.upper("b")))


def test_unknown_choices_are_refused(spark):
    session = engine.analyze(inputs(spark), "t", "k", KINDS)
    for conflict, variant, why in (("conf-x", "var-x", "unknown conflict"), (session.drift.first().conflict_id, "v", "informational")):
        with pytest.raises(engine.MergeError, match=why):
            engine.check_choices(session, spark.createDataFrame([(conflict, variant)], "conflict_id string, variant_id string"))


def test_lookups(spark, rows):
    providers = spark.createDataFrame([("g", "in-1", "x"), ("g", "in-0", "y"), ("h", "in-2", "z")], "group_key string, input_id string, sha256 string")
    assert rows(lookup.provider_of(providers), "group_key", "input_id") == [("g", "in-0"), ("h", "in-2")]
    chosen = spark.createDataFrame([("g", "in-1")], "group_key string, input_id string")
    assert rows(lookup.provider_of(providers, chosen), "group_key", "input_id") == [("g", "in-1"), ("h", "in-2")]
    base = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos long, name string")
    donor = spark.createDataFrame([(0, "z"), (1, "b"), (2, "y"), (3, "z"), (4, "a")], "pos long, name string")
    assert rows(lookup.name_indexes(base, donor), "name", "index", "added") == [("a", 0, False), ("b", 1, False), ("y", 4, True), ("z", 3, True)]
    schema = "pos long, class_package string, class_name string, object_name string"
    imports = lookup.import_matches(spark.createDataFrame([(5, "p", None, "o")], schema), spark.createDataFrame([(1, "p", None, "o"), (2, "p", "c", "o")], schema))
    assert rows(imports, "pos", "base_pos") == [(1, 5), (2, None)]


def test_guards(spark, rows):
    good = spark.createDataFrame([("in-0", "a.pak", 5, "x"), ("in-1", "b.pak", 5, "y")], "input_id string, path string, size long, sha256 string")
    assert rows(lookup.input_errors(good, "in-0"), "error") == []
    bad = good.union(spark.createDataFrame([("in-2", "A.PAK", 5, "x"), ("in-3", "z.zip", 200 << 30, "w")], good.schema))
    assert rows(lookup.input_errors(bad, "in-9"), "error") == [("base isn't listed",), ("equal inputs",), ("not an archive name",), ("repeated path",), ("total size",)]
    entries = spark.createDataFrame([("p", 3, "A.uexp", False, True), ("p", 3, "a.uasset", True, False), ("p", 3, "b.uexp", False, True), ("q", 4, "a.uexp", False, True)], "archive string, version int, path string, sha1_ok boolean, is_table boolean")
    assert rows(lookup.stale_hashes(entries), "archive", "path", "tolerated") == [("p", "A.uexp", True), ("p", "b.uexp", False), ("q", "a.uexp", False)]
    sizes = spark.createDataFrame([("None", 3), ("Zlib", 0)], "method string, logical long")
    assert lookup.compression_conforms(sizes, "None").first().conforms
    assert not lookup.compression_conforms(sizes, "Oodle").first().conforms
    files = spark.createDataFrame([("x/Local/Npc/SetListA.uexp",), ("X/LOCAL/npc/other",), ("x/local/npc/SETLIST",)], "path string")
    assert lookup.placement_assets(files, "local/npc/", "setlist").count() == 2
    assert rows(lookup.duplicate_outputs(spark.createDataFrame([("A",), ("a",), ("b",)], "path string")), "path_key") == [("a",)]


def test_a_key_twice_in_one_input_is_refused(spark):
    base = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 2, "c")], "k long, row_pos long, v string")
    with pytest.raises(engine.MergeError, match="in-0 has the key 1 2 times"):
        engine.analyze([base, base.where("k = 2")], "t", "k", {"v": "text"})


def test_a_ledger_tells_where_fields_end_and_nulls_from_empty_texts(spark):
    rows = [("x|y", "z"), ("x", "y|z"), (None, "z"), ("", "z")]
    digests = set()
    for a, b in rows:
        table = spark.createDataFrame([(1, a, b, False, 0)], "k long, a string, b string, is_added boolean, base_pos long")
        digests.add(apply.ledger(table, "k", ["a", "b"]).first().digest)
    assert len(digests) == 4
