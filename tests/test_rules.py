import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataweave.plans import plan, resolve, rules

GOOD = {
    "schemaVersion": 1,
    "id": "demo",
    "displayName": "Demo",
    "format": "table",
    "detection": {"minimumMatches": 1, "pathMatchers": [{"kind": "contains", "value": "/db/"}]},
    "assets": [{"id": "items", "pathMatchers": [{"kind": "suffix", "value": "/items"}], "priority": 2, "fieldGroups": [{"id": "g", "fields": ["x", "y"], "mode": "parallel_array_items"}]}],
}


def changed(**kw):
    return json.dumps({**GOOD, **kw})


def test_profiles_parse_and_resolve(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD))
    (profile,) = rules.read_profiles(spark, str(tmp_path))
    assert profile.assets[0].groups[0].mode == "parallel_array_items"
    files = spark.createDataFrame([("Game/db/items.uasset",), ("Game/db/other.uexp",)], "path string")
    assert sorted(map(tuple, rules.resolve_rules(files, rules.rule_table(spark, [profile])).collect())) == [("Game/db/items.uasset", "items"), ("Game/db/other.uexp", "generic")]
    assert rules.selected_profile(rules.detect(files, rules.signature_table(spark, [profile]))) == "demo"
    assert rules.selected_profile(rules.detect(files.limit(0), rules.signature_table(spark, [profile]))) == "generic"


NEW_SESSION = """
from pyspark.sql import SparkSession
from strataweave import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", len(queries.queries()["rule_priority"](spark, "/root/testdata/sf0.001").collect()))
"""


def test_rules_resolve_in_a_new_session():
    """With the numbers that columns have at a session's start Spark once looked for the path among the rules."""
    done = subprocess.run([sys.executable, "-c", NEW_SESSION], capture_output=True, text=True, timeout=240, cwd=Path(__file__).parents[1])
    assert "rows 67" in done.stdout, done.stderr[-2000:]


def test_a_path_given_twice_has_its_rule(spark):
    files = spark.createDataFrame([("Game/db/items.uasset",), ("Game/db/items.uasset",), (None,)], "path string")
    table = rules.rule_table(spark, [rules.parse_profile(json.dumps(GOOD))])
    assert sorted(map(tuple, rules.resolve_rules(files, table).collect()), key=repr) == [("Game/db/items.uasset", "items"), (None, "generic")]


@pytest.mark.parametrize(
    "text",
    [
        changed(schemaVersion=2),
        changed(extra=1),
        changed(id="no spaces"),
        changed(detection={"minimumMatches": 3, "pathMatchers": [{"kind": "contains", "value": "/db/"}]}),
        changed(detection={"pathMatchers": [{"kind": "regex", "value": "x"}]}),
        changed(assets=GOOD["assets"] * 2),
        changed(assets=[{**GOOD["assets"][0], "pathMatchers": []}]),
        changed(assets=[{**GOOD["assets"][0], "fieldGroups": [{"id": "g", "fields": ["x"]}, {"id": "h", "fields": ["x"]}]}]),
        changed(assets=[{**GOOD["assets"][0], "fieldGroups": [{"id": "g", "fields": ["x"], "mode": "other"}]}]),
    ],
)
def test_profiles_that_break_a_rule_are_refused(text):
    with pytest.raises(rules.ProfileError):
        rules.parse_profile(text)


def test_key_may_not_be_in_a_group():
    with pytest.raises(rules.ProfileError):
        rules.validate(rules.parse_profile(json.dumps(GOOD)), key="x")


def test_inline_choices():
    assert resolve.inline_choices(["a=1", "b=2", "a=1"]) == {"a": "1", "b": "2"}
    for bad in (["a=1", "a=2"], ["a"], ["=1"]):
        with pytest.raises(ValueError):
            resolve.inline_choices(bad)


def test_plans_are_written_once_and_read_strictly(spark, tmp_path):
    path = str(tmp_path / "plan")
    row = spark.createDataFrame([(1, "plan-x", "in-0", "generic", "generic", ["in-0"], 0, [], [])], plan.PLAN_SCHEMA)
    plan.write_plan(row, path)
    assert plan.read_plan(spark, path).first().plan_id == "plan-x"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        plan.write_plan(row, path)
    other = str(tmp_path / "other")
    plan.write_plan(row.withColumn("schema_version", F.lit(2)), other)
    with pytest.raises(Exception, match="schema_version"):
        plan.read_plan(spark, other).collect()


def test_packages_group_by_stem(spark):
    entries = spark.createDataFrame(
        [(0, "A/x.uasset", "1"), (0, "a/X.uexp", "2"), (1, "a/x.uasset", "1"), (1, "a/x.uexp", "3"), (0, "t.txt", "5"), (1, "t.txt", "5"), (1, "only.bin", "6")],
        "input_index int, path string, sha256 string",
    )
    found = {r.group_key: (r.n_providers, r.action) for r in plan.asset_actions(plan.packages(entries)).collect()}
    assert found == {"a/x": (2, "merge_database"), "t.txt": (2, "deduplicate"), "only.bin": (1, "copy")}
