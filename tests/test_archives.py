import os

import pytest
from pyspark.sql import functions as F

from strataweave import queries
from strataweave.plans import archives, rules
from strataweave.plans.engine import MergeError
from strataweave.sources import folders
from strataweave.sources import msgpack_rows as m
from strataweave.sources import tagged_rows as t


def table(*rows, like=None):
    return m.build_table([m.pack_value(r) for r in rows], like)


BASE = [{"m_id": 1, "x": 1, "y": [1, 2]}, {"m_id": 2, "x": 5, "y": [3]}, {"m_id": 3, "x": 7}]
ONE = [{"m_id": 1, "x": 9, "y": [1, 2]}, {"m_id": 2, "x": 5.0, "y": [4]}, {"m_id": 9, "x": 1}]
TWO = [{"m_id": 3, "z": 7}, {"m_id": 9, "x": 2}, {"m_id": 8, "x": 0}]
HEAD = b"header"


def inputs():
    t = "Game/Db/T"
    return [
        {f"{t}.uasset": HEAD, f"{t}.uexp": table(*BASE), "same.txt": b"s", "base.txt": b"b", "differs.bin": b"0"},
        {f"{t}.uasset": HEAD, "game/db/t.uexp": table(*ONE), "same.txt": b"s", "differs.bin": b"1", "Bad.uasset": b"h", "Bad.uexp": b"no table"},
        {f"{t}.uasset": HEAD, f"{t}.uexp": table(*TWO), "Bad.uasset": b"h", "Bad.uexp": b"nor this", "new.txt": b"n"},
    ]


def test_archives_are_planned_and_merged(spark, tmp_path):
    made = archives.analyze_archives(spark, archives.demo_archives(spark, inputs()))
    actions = {r.group_key: r.action for r in made.actions.collect()}
    assert actions == {"game/db/t": "merge_database", "same.txt": "deduplicate", "base.txt": "copy", "new.txt": "copy", "differs.bin": "select_opaque", "bad": "select_opaque"}
    kinds = {(r.group_key, r.row, r.unit_id): r.kind for r in made.conflicts.collect()}
    assert kinds == {
        ("game/db/t", "1", "field:x"): "FIELD_VALUE",
        ("game/db/t", "2", "field:x"): "ENCODING_DRIFT",
        ("game/db/t", "2", "field:y"): "ATOMIC_GROUP",
        ("game/db/t", "3", "__whole_row__"): "STRUCTURE_MISMATCH",
        ("game/db/t", "9", "$row"): "ROW_ID_COLLISION",
        ("differs.bin", "", ""): "OPAQUE_PACKAGE",
        ("bad", "", ""): "OPAQUE_PACKAGE",
    }
    assert made.warnings.count() == 1
    last = made.conflicts.where("kind <> 'ENCODING_DRIFT'").join(made.variants.groupBy("conflict_id").agg({"input": "max"}), "conflict_id")
    picks = last.join(made.variants, "conflict_id").where("input = `max(input)`").select("conflict_id", "variant_id")
    with pytest.raises(MergeError, match="without a choice"):
        archives.merge_archives(made, picks.limit(2), f"file://{tmp_path}/none")
    back = archives.merge_archives(made, picks, f"file://{tmp_path}/out", plan_id=made.plan_id)
    files = {r.path: bytes(r.content) for r in back.collect()}
    assert {p: c for p, c in files.items() if not p.startswith("Game")} == {"same.txt": b"s", "base.txt": b"b", "new.txt": b"n", "differs.bin": b"1", "Bad.uasset": b"h", "Bad.uexp": b"nor this"}
    expected = table({"m_id": 1, "x": 9, "y": [1, 2]}, {"m_id": 2, "x": 5, "y": [4]}, {"m_id": 3, "z": 7}, {"m_id": 8, "x": 0}, {"m_id": 9, "x": 2}, like=table(*BASE))
    assert files["Game/Db/T.uexp"] == expected and files["Game/Db/T.uasset"] == HEAD


def test_tables_that_differ_around_their_rows_are_chosen_whole(spark):
    a = table({"m_id": 1})
    files = [{"t.uasset": b"h", "t.uexp": a}, {"t.uasset": b"h", "t.uexp": b"XXXXXX" + table({"m_id": 2})[6:]}]
    made = archives.analyze_archives(spark, archives.demo_archives(spark, files))
    assert [(r.kind, r.row) for r in made.conflicts.collect()] == [("STRUCTURE_MISMATCH", "")]


def profile(*fields):
    group = rules.FieldGroup("pair", fields)
    return rules.Profile("demo", "Demo", "table", 1, (rules.Matcher("contains", "/t"),), (), (rules.AssetRule("t", (rules.Matcher("suffix", "/t"),), 0, (group,)),))


def test_linked_fields_are_one_choice(spark, tmp_path):
    files = [{"t.uasset": b"h", "t.uexp": table({"m_id": 1, "a": 1, "b": 2, "c": 3})}, {"t.uasset": b"h", "t.uexp": table({"m_id": 1, "a": 1, "b": 5, "c": 4})}]
    made = archives.analyze_archives(spark, archives.demo_archives(spark, files), [profile("a", "b")])
    assert {(r.unit_id, r.kind) for r in made.conflicts.collect()} == {("group:pair", "ATOMIC_GROUP"), ("field:c", "FIELD_VALUE")}
    last = made.variants.where("input = if(unit_id = 'group:pair', 1, 0)").select("conflict_id", "variant_id")
    back = archives.merge_archives(made, last, f"file://{tmp_path}/out").where("path = 't.uexp'").first()
    assert bytes(back.content) == table({"m_id": 1, "a": 1, "b": 5, "c": 3}, like=files[0]["t.uexp"])


def test_linked_fields_in_part_make_the_asset_one_choice(spark):
    files = [{"t.uasset": b"h", "t.uexp": table({"m_id": 1, "a": 1})}, {"t.uasset": b"h", "t.uexp": table({"m_id": 1, "a": 2})}]
    made = archives.analyze_archives(spark, archives.demo_archives(spark, files), [profile("a", "b")])
    assert [r.kind for r in made.conflicts.collect()] == ["OPAQUE_PACKAGE"]
    assert "in part" in made.warnings.first().warning


def test_equal_inputs_are_refused(spark):
    with pytest.raises(MergeError, match="equal"):
        archives.analyze_archives(spark, archives.demo_archives(spark, [{"a": b"1"}, {"a": b"1"}]))


def test_leaves_and_shells():
    assert m.integer_leaves(m.pack_value({"a": [1, -2, {"5": 3}], "b": 0, "c": 2.0})) == [1, 3]
    assert m.shell_digest(table({"m_id": 1})) == m.shell_digest(table({"m_id": 2}, {"m_id": 3}))


def named(rows, first=()):
    """A package of rows {name: {field: (kind, value)}}; ``first``: names that its name table starts with."""
    header, payload = t.empty_table("Items", "Item")
    header = t.Package(header).extended(header, first, len(payload))
    made = [(t.portable_name(n), *(t.portable_field(f, *v) for f, v in fields.items())) for n, fields in rows.items()]
    header, payload = t.build_table(header, payload, made)
    return {"Game/Items.uasset": header, "Game/Items.uexp": payload + t.TAG.to_bytes(4, "little")}


def number(x):
    return "IntProperty", str(x)


def word(x):
    return "NameProperty", x


NAMED = [
    {"Sword": {"Cost": number(5), "Kind": word("Blade")}, "Shield": {"Cost": number(7)}, "Bow": {"Cost": number(1), "Kind": word("Wood")}},
    {"Sword": {"Cost": number(6), "Kind": word("Blade")}, "Shield": {"Cost": number(7), "Kind": word("Round")}, "Zither": {"Cost": number(2)}, "Axe": {"Cost": number(3)}},
    {"Sword": {"Cost": number(5), "Kind": word("Fresh")}, "Bow": {"Cost": number(1), "Kind": word("Wood")}, "sword": {"Cost": number(9)}, "Axe": {"Cost": number(4)}},
]


def read_named(files):
    header, content = files["Game/Items.uasset"], files["Game/Items.uexp"]
    return {n: {f["name"]: f["value"] for f in fields} for _, n, _, fields in t.table_rows(header, t.payload_of(header, content))}


def test_tables_by_name_are_merged_by_row_and_field(spark, tmp_path):
    files = [named(rows, first) for rows, first in zip(NAMED, ((), ("Wood", "unused"), ("Axe",)), strict=True)]
    made = archives.analyze_archives(spark, archives.demo_archives(spark, files))
    assert {(r.row, r.unit_id): r.kind for r in made.conflicts.collect()} == {
        ("Sword", "field:Cost"): "FIELD_VALUE", ("Sword", "field:Kind"): "FIELD_VALUE", ("Shield", "__whole_row__"): "STRUCTURE_MISMATCH", ("Axe", "__whole_row__"): "ATOMIC_GROUP",
    }
    wanted = {("Sword", "field:Cost"): 1, ("Sword", "field:Kind"): 2, ("Shield", "__whole_row__"): 1, ("Axe", "__whole_row__"): 2}
    picks = spark.createDataFrame([(*k, v) for k, v in wanted.items()], "row string, unit_id string, input int")
    choices = made.variants.join(picks, ["row", "unit_id", "input"]).select("conflict_id", "variant_id")
    back = archives.merge_archives(made, choices, f"file://{tmp_path}/named", plan_id=made.plan_id)
    out = {r.path: bytes(r.content) for r in back.collect()}
    found = read_named(out)
    assert found == {
        "Sword": {"Cost": "6", "Kind": "Fresh"}, "Shield": {"Cost": "7", "Kind": "Round"}, "Bow": {"Cost": "1", "Kind": "Wood"},
        "Zither": {"Cost": "2"}, "Axe": {"Cost": "4"}, "sword": {"Cost": "9"},
    }
    assert list(found) == ["Sword", "Shield", "Bow", "Zither", "Axe", "sword"]  # base order, then as first held
    assert {"Fresh", "Round", "Zither", "Axe", "sword"} <= set(t.Package(out["Game/Items.uasset"]).names)


def test_an_order_of_names_is_no_difference(spark):
    files = [named(NAMED[0]), named(NAMED[0], ("Wood", "Cost"))]
    made = archives.analyze_archives(spark, archives.demo_archives(spark, files))
    assert made.conflicts.count() == 0


def test_linked_fields_in_part_choose_the_named_table_whole(spark):
    files = [named(NAMED[0]), named(NAMED[1])]
    group = rules.FieldGroup("both", ("Cost", "Kind"))
    asset = rules.AssetRule("items", (rules.Matcher("suffix", "/items"),), 0, (group,))
    made = archives.analyze_archives(spark, archives.demo_archives(spark, files), [rules.Profile("p", "p", "", 1, (rules.Matcher("suffix", "/items"),), (), (asset,))])
    assert [r.kind for r in made.conflicts.collect()] == ["OPAQUE_PACKAGE"] and made.warnings.count() == 1


def named_rows(spark):
    """Four inputs of three groups of rows by name: equal, differing, of other shapes, without a base, held once."""
    kinds = {"a": "Int64Property", "b": "NameProperty", "c": "StrProperty", "d": "Int64Property"}
    held = {
        ("0", "same"): ["a1 bX cs", "a1 bX cs", "a1 bX cs"], ("0", "unit"): ["a1 bX cs d4", "a1 bX ct d4", None, "a1 bX cs d5"], ("0", "linked"): ["a1 bX cs", "a2 bX cs", "a1 bY cs"],
        ("0", "part"): ["a1 cs", "a2 ct"], ("0", "shape"): ["a1 bX", None, "a1 bX cs"], ("0", "order"): ["a1 bX", "bX a1"], ("0", "one"): ["a1"], ("1", "unit"): [None, "a1", "a1"],
        ("1", "added"): [None, "a1 bX", None, "a1 bY"], ("1", "grown"): [None, None, "a1", "a1 cs"], ("1", "late"): [None, None, None, "a1"], ("1", "base"): ["c", "c"], ("1", "none"): ["", "c"], ("2", "same"): ["a1", "a1"],
    }
    fields = lambda texts: [(x[0], kinds[x[0]], x[1:]) for x in texts.split()]
    rows = [(g, n, f"{n}-{g}", place, name, fields(x)) for place, ((g, name), found) in enumerate(held.items()) for n, x in enumerate(found) if x is not None]
    return spark.createDataFrame(rows, "group_key string, input_index int, asset string, row_pos long, row_name string, fields array<struct<name:string,type:string,value:string>>")


def test_rows_beside_their_holders_give_the_same_conflicts(spark, rows):
    linked = F.array(F.struct(F.lit("g").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("fields"))).alias("groups")
    row = F.struct("group_key", F.lit(0).alias("row_id"), "row_name").alias("row")
    for groups in (linked, F.array().cast("array<struct<id:string,fields:array<string>>>").alias("groups")):
        back = t.read_tables(t.write_tables(named_rows(spark))).withColumns({"input_index": F.split("asset", "-")[0].cast("int"), "group_key": F.split("asset", "-")[1]})
        back = back.select(row, "input_index", "fields", groups)
        want = archives.row_conflicts(archives.with_hashes(back), archives.field_units(back))
        got = archives.held_conflicts(t.differing_rows(named_rows(spark)).select(row, "held", groups))
        names = ("row", "unit_id", "kind", "n_variants")
        assert rows(got, *names) == rows(want, *names) and got.dtypes == want.dtypes
        assert {r.kind for r in got.collect()} == {"ATOMIC_GROUP", "FIELD_VALUE", "STRUCTURE_MISMATCH"}


def test_tables_of_a_group_meet_in_one_task(spark):
    """Rows move once, before fields are made of them, and nothing is written: all rows as Parquet and five exchanges of them before."""
    shared = folders.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    found = queries.name_table_merge(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and set(os.listdir(shared)) == before
    assert plan.count("Exchange") == 1 and "array(" not in plan[plan.index("Exchange") :]
