"""Merging whole archives: from files to a plan, and from choices to a new archive.

Entries are aligned by package and path; packages of a header and a table that
several inputs hold and that differ are compared row by row and field by field,
everything else is copied, deduplicated or chosen as a whole. Rows have numbers
(MessagePack tables) or names (tables of tagged properties), by the header's
class. A table that can't be parsed, or whose providers differ outside their
rows, is chosen as a whole too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.ids import CONFLICT, VARIANT, stable_id, stable_id_of
from strataweave.functions.paths import component, package_stem, path_key
from strataweave.operators import diff
from strataweave.operators.align import MOST_INPUTS
from strataweave.plans import plan as plans
from strataweave.plans.engine import MergeError
from strataweave.plans.resolve import invalid, unresolved
from strataweave.plans.rules import Profile, resolve_rules, rule_table
from strataweave.sources import archive, msgpack_rows, tagged_rows
from strataweave.sources.folders import new_folder, written

#: Rows of tables by name have the number 0, others the empty name; a named row's first field, without a name, is its label.
_TABLES = "group_key string, input_index int, shell string, error string, rows array<struct<row_pos:long,row_id:long,row_name:string,fields:array<struct<name:string,type:string,value:string,raw:binary>>>>"


@dataclass(frozen=True)
class ArchivePlan:
    """entries, actions, conflicts, variants, warnings and the parsed rows, all written once."""

    input_ids: tuple[str, ...]
    entries: DataFrame
    actions: DataFrame
    rows: DataFrame
    conflicts: DataFrame
    variants: DataFrame
    warnings: DataFrame
    plan_id: str


def read_archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Entries of all inputs in order, with input_index, group_key and component."""
    if not 1 <= len(paths) <= MOST_INPUTS:
        raise MergeError(f"1 to {MOST_INPUTS} inputs, not {len(paths)}")
    archive.register(spark)
    out = None
    for n, path in enumerate(paths):
        one = spark.read.format("overlay_archive").load(path).select(F.lit(n).alias("input_index"), "mount", "path", "sha256", "logical", "content")
        out = one if out is None else out.union(one)
    stem = F.when(component(F.col("path")).isNull(), F.col("path")).otherwise(package_stem(F.col("path")))
    return out.withColumns({"group_key": path_key(stem), "component": F.coalesce(component(F.col("path")), F.lit("file"))})


def _table(header: bytes | None, content: bytes) -> tuple[list[dict], str]:
    """Rows and shell of a table of either form."""
    if header is None or not tagged_rows.is_table_package(header):
        return [{"row_pos": p, "row_id": i, "row_name": "", "fields": f} for p, i, _, f in msgpack_rows.table_rows(content)], msgpack_rows.shell_digest(content)
    payload = tagged_rows.payload_of(header, content)
    rows = []
    for position, name, label, fields in tagged_rows.table_rows(header, payload):
        rows.append({"row_pos": position, "row_id": 0, "row_name": name, "fields": [{"name": "", "type": "NameProperty", "value": name, "raw": label}, *fields]})
    return rows, tagged_rows.shell_digest(header, payload)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for group, index, header, content in zip(*(batch.column(n).to_pylist() for n in ("group_key", "input_index", "header", "content")), strict=True):
            row = {"group_key": group, "input_index": index, "shell": None, "error": None, "rows": []}
            try:
                row["rows"], row["shell"] = _table(header, content)
            except (msgpack_rows.TableError, tagged_rows.TaggedError, UnicodeDecodeError) as e:
                row["error"] = str(e)
            out.append(row)
        field = pa.struct([("name", pa.string()), ("type", pa.string()), ("value", pa.string()), ("raw", pa.binary())])
        rows = pa.list_(pa.struct([("row_pos", pa.int64()), ("row_id", pa.int64()), ("row_name", pa.string()), ("fields", pa.list_(field))]))
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("group_key", pa.string()), ("input_index", pa.int32()), ("shell", pa.string()), ("error", pa.string()), ("rows", rows)]))


_GROUPS = "array<struct<id:string,fields:array<string>>>"


def group_table(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """rule, groups: the linked fields that each asset rule declares."""
    rows = [(a.id, [(g.id, list(g.fields)) for g in a.groups]) for p in profiles for a in p.assets if a.groups]
    return spark.createDataFrame(rows, f"rule string, groups {_GROUPS}")


def _named(fields: Column, name: Column) -> Column:
    return F.get(F.filter(fields, lambda x: x["name"] == name), F.lit(0))


def _present(groups: Column, fields: Column, count) -> Column:
    """Groups by how many of their fields a row has."""
    names = F.transform(fields, lambda x: x["name"])
    return F.filter(groups, lambda g: count(F.size(F.array_intersect(g["fields"], names)), F.size(g["fields"])))


def _meaning(x: Column) -> Column:
    """What a field stands for; tagged properties have one encoding alone, their portable bytes."""
    text = F.concat_ws(":", F.when(x["type"].isin("integer", "float"), "number").otherwise(x["type"]), x["value"])
    return F.when(x["type"].endswith("Property"), F.hex(x["raw"])).otherwise(text)


def _sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def _units(fields: Column, groups: Column, digest=_sha256) -> Column:
    """Units of a row of any shape: linked fields first, then one per field left but the key; with raw and canonical hashes."""
    whole = _present(groups, fields, lambda n, size: n == size)
    grouped = F.flatten(F.transform(whole, lambda g: g["fields"]))
    joined = lambda g, of: digest(F.to_json(F.transform(g["fields"], lambda n: of(_named(fields, n)))))
    linked = F.transform(whole, lambda g: F.struct(F.concat(F.lit("group:"), g["id"]).alias("unit_id"), F.lit(True).alias("atomic"), joined(g, lambda f: F.hex(f["raw"])).alias("raw_hash"), joined(g, _meaning).alias("sem_hash")))
    left = F.filter(fields, lambda x: ~x["name"].isin("", msgpack_rows.ID_KEY) & ~F.array_contains(grouped, x["name"]))
    single = F.transform(
        left, lambda x: F.struct(F.concat(F.lit("field:"), x["name"]).alias("unit_id"), x["type"].isin("array", "map").alias("atomic"), digest(x["raw"]).alias("raw_hash"), digest(_meaning(x)).alias("sem_hash"))
    )
    return F.concat(linked, single)


def field_units(rows: DataFrame) -> DataFrame:
    """The units of each row (row, input_index, fields, groups) with their places."""
    placed = rows.select("row", "input_index", F.posexplode(_units(F.col("fields"), F.col("groups"))).alias("unit_pos", "u"))
    return placed.select("row", "input_index", "unit_pos", "u.*")


def row_text(row: Column) -> Column:
    """A row's name or number, as conflicts give it."""
    return F.when(row["row_name"] != "", row["row_name"]).otherwise(row["row_id"].cast("string"))


def _shape(fields: Column) -> Column:
    return F.transform(fields, lambda x: x["name"])


def _row_meaning(fields: Column) -> Column:
    return F.transform(fields, lambda x: F.struct(x["name"].alias("n"), _meaning(x).alias("v")))


def with_hashes(rows: DataFrame) -> DataFrame:
    """Rows (row, input_index, fields, groups) with their shape, raw_hash and sem_hash."""
    raw = F.to_json(F.transform("fields", lambda x: F.struct(x["name"], x["type"], x["raw"])))
    return rows.withColumns({"shape": F.to_json(_shape(F.col("fields"))), "raw_hash": F.sha2(raw, 256), "sem_hash": F.sha2(F.to_json(_row_meaning(F.col("fields"))), 256)})


def row_conflicts(hashed: DataFrame, units: DataFrame) -> DataFrame:
    """row, unit_id, kind, n_variants: differing units, rows of different shapes, and added rows that differ.

    An added row with a name that differs is a group of all its fields.
    """
    found = diff.conflicts(diff.unit_differences(units, "row"), diff.shape_mismatches(hashed, "row", "shape"), diff.added_rows(hashed, "row"), "row")
    named = (F.col("row.row_name") != "") & (F.col("unit_id") == diff.ADDED_ROW)
    kind = F.when(named, diff.ATOMIC_GROUP).otherwise(F.col("kind"))
    return found.select("row", F.when(named, diff.WHOLE_ROW).otherwise(F.col("unit_id")).alias("unit_id"), kind.alias("kind"), "n_variants")


def held_conflicts(rows: DataFrame) -> DataFrame:
    """What ``row_conflicts`` finds, for rows by name that have their holders beside them (row, groups, held of input_index and fields).

    Nothing is grouped, so that nothing is shuffled or written either, and
    values are compared as they are. Holders of one shape have the same units in
    the same places.
    """
    texts = lambda h: F.struct(h["input_index"].alias("input"), _shape(h["fields"]).alias("shape"), _row_meaning(h["fields"]).alias("meaning"), _units(h["fields"], F.col("groups"), lambda x: x.cast("binary")).alias("units"))
    seen = rows.where(F.size("held") > 1).select("row", F.transform("held", texts).alias("held"))
    differ = lambda of: F.size(F.array_distinct(F.transform("held", of))) > 1
    in_base = F.array_min(F.transform("held", lambda h: h["input"])) == 0
    whole = lambda kind: F.array(F.struct(F.lit(diff.WHOLE_ROW).alias("unit_id"), F.lit(kind).alias("kind")))

    def unit(u, n):
        at = lambda of: differ(lambda h: F.get(h["units"], n)[of])
        kind = F.when(at("sem_hash"), F.when(u["atomic"], diff.ATOMIC_GROUP).otherwise(diff.FIELD_VALUE)).when(at("raw_hash"), diff.ENCODING_DRIFT)
        return F.struct(u["unit_id"].alias("unit_id"), kind.alias("kind"))

    units = F.filter(F.transform(F.get("held", F.lit(0))["units"], unit), lambda u: u["kind"].isNotNull())
    found = F.when(~in_base, F.when(differ(lambda h: h["meaning"]), whole(diff.ATOMIC_GROUP)))
    found = found.when(differ(lambda h: h["shape"]), whole(diff.STRUCTURE_MISMATCH)).otherwise(units)
    return seen.select("row", F.size("held").cast("long").alias("n_variants"), F.inline(found)).select("row", "unit_id", "kind", "n_variants")


def analyze_archives(spark: SparkSession, paths: Sequence[str], profiles: Sequence[Profile] = ()) -> ArchivePlan:
    """A plan for inputs in order; the first is the base.

    Profiles declare linked fields. An asset of which some row has a declared
    group in part is chosen as a whole, with a warning.
    """
    entries = written(read_archives(spark, paths), "entries")
    hashes = entries.groupBy("input_index").agg(F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("files"))
    named = hashes.select("input_index", F.sha2(F.to_json("files"), 256).alias("h")).orderBy("input_index").collect()  # 64 rows at most
    input_ids = tuple(f"in-{r.h[:16]}" for r in named)
    if len(set(input_ids)) < len(paths):
        raise MergeError("two inputs are equal, or one is empty")
    groups = plans.packages(entries)
    actions = plans.asset_actions(groups)
    tables = entries.where("component = '.uexp'").join(actions.where(F.col("action") == plans.MERGE), "group_key")
    headers = entries.where("component = '.uasset'").select("group_key", "input_index", F.col("content").alias("header"))
    tables = tables.join(headers, ["group_key", "input_index"], "left")
    parsed = written(tables.select("group_key", "input_index", "header", "content").mapInArrow(_parsed, _TABLES), "parsed")
    whole = parsed.groupBy("group_key").agg(F.max("error").alias("error"), diff.differs("shell").alias("shells"))
    asset = parsed.select(F.concat("group_key", F.lit(".uexp")).alias("path")).distinct()
    rules = resolve_rules(asset, rule_table(spark, profiles)).join(F.broadcast(group_table(spark, profiles)), "rule")
    groups_of = rules.select(F.regexp_replace("path", r"\.uexp\z", "").alias("group_key"), "groups")
    parsed = parsed.join(groups_of, "group_key", "left").withColumn("groups", F.coalesce("groups", F.array().cast(_GROUPS)))
    partly = F.exists("rows", lambda r: F.size(_present(F.col("groups"), r["fields"], lambda n, size: (n > 0) & (n < size))) > 0)
    parts = parsed.groupBy("group_key").agg(F.bool_or(partly).alias("partly"))
    whole = whole.join(parts, "group_key").withColumn("error", F.coalesce("error", F.when(F.col("partly"), "a row has linked fields in part")))
    failed = whole.where("error is not null or shells").select("group_key", F.coalesce("error", F.lit("the tables differ outside their rows")).alias("why"), F.col("error").isNull().alias("structure"))
    actions = written(actions.join(failed, "group_key", "left").withColumn("action", F.when(F.col("why").isNotNull(), plans.SELECT_OPAQUE).otherwise(F.col("action"))), "actions")

    exploded = parsed.join(failed, "group_key", "left_anti").select("group_key", "input_index", "groups", F.inline("rows"))
    base = parsed.groupBy("group_key").agg(F.min("input_index").alias("base"))
    # the base of an asset is its first provider; rows count inputs from there
    rows = exploded.join(base, "group_key").withColumn("row", F.struct("group_key", "row_id", "row_name"))
    placed = rows.withColumns({"input": F.col("input_index"), "input_index": F.col("input_index") - F.col("base")})
    rows = written(placed.select("row", "group_key", "row_id", "row_name", "row_pos", "fields", "groups", "input_index", "input"), "rows")

    units = field_units(rows)
    hashed = with_hashes(rows)
    found = written(row_conflicts(hashed, units), "found")
    of_units = units.join(found, ["row", "unit_id"]).select("row", "unit_id", "kind", "input_index", "raw_hash")
    of_rows = hashed.join(found.where(F.col("unit_id").isin(diff.WHOLE_ROW, diff.ADDED_ROW)), "row").select("row", "unit_id", "kind", "input_index", "raw_hash")
    inputs = rows.select("row", "input_index", "input")
    of_rows = of_units.union(of_rows).join(inputs, ["row", "input_index"]).select(F.col("row.group_key"), row_text(F.col("row")).alias("row"), "unit_id", "kind", "input", "raw_hash")
    opaque = groups.join(actions.where(F.col("action") == plans.SELECT_OPAQUE), "group_key")
    kind = F.when(F.coalesce("structure", F.lit(False)), diff.STRUCTURE_MISMATCH).otherwise(diff.OPAQUE_PACKAGE)
    of_files = opaque.select("group_key", F.lit("").alias("row"), F.lit("").alias("unit_id"), kind.alias("kind"), F.col("input_index").alias("input"), F.col("digest").alias("raw_hash"))

    input_id = F.element_at(F.array(*[F.lit(x) for x in input_ids]), F.col("input") + 1)
    made = of_rows.union(of_files).withColumn("input_id", input_id)
    made = made.withColumn("variant_id", stable_id("var", VARIANT, F.col("group_key"), F.col("row"), F.col("unit_id"), F.col("input_id"), F.col("raw_hash")))
    listed = made.groupBy("group_key", "row", "unit_id", "kind").agg(F.sort_array(F.collect_list(F.struct("input_id", "variant_id"))).alias("variants"))
    parts = F.concat(F.array("group_key", "row", "unit_id"), F.transform("variants", lambda v: v["variant_id"]))
    conflicts = written(listed.withColumn("conflict_id", stable_id_of("conf", CONFLICT, parts)), "conflicts")
    variants = written(made.join(conflicts.select("group_key", "row", "unit_id", "conflict_id"), ["group_key", "row", "unit_id"]), "variants")
    warnings = actions.where("why is not null").select(F.concat("group_key", F.lit(": "), "why").alias("warning")).distinct()
    drift = conflicts.where(F.col("kind") == diff.ENCODING_DRIFT)
    plan_id = plans.summary(conflicts.where(F.col("kind") != diff.ENCODING_DRIFT), drift, input_ids, input_ids[0], "generic").first().plan_id
    return ArchivePlan(input_ids, entries, actions, rows, conflicts, variants, warnings, plan_id)


def _tables_of(made: ArchivePlan, chosen: DataFrame) -> DataFrame:
    """group_key, content and header of every merged table: base rows in base order, then added rows by id, or named ones as first held.

    The header is null where it stays as it is.
    """
    rows = made.rows
    held = rows.groupBy("group_key", "row_id", "row_name").agg(
        F.map_from_entries(F.collect_list(F.struct("input", "fields"))).alias("held"),
        F.min("input").alias("first"),
        F.first("groups").alias("groups"),
        F.min("input_index").alias("index"),
        F.min(F.when(F.col("input_index") == 0, F.col("row_pos"))).alias("base_pos"),
        F.min(F.struct("input", "row_pos")).alias("at"),
    ).withColumn("row", row_text(F.struct("row_id", "row_name")))
    picks = chosen.where("row <> ''").groupBy("group_key", "row").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "input"))).alias("picks"))
    joined = held.join(picks, ["group_key", "row"], "left").withColumn("picks", F.coalesce("picks", F.create_map().cast("map<string,int>")))
    whole = F.coalesce(F.try_element_at("picks", F.lit(diff.WHOLE_ROW)), F.try_element_at("picks", F.lit(diff.ADDED_ROW)), F.col("first"))

    def taken(f):
        group = F.get(F.filter("groups", lambda g: F.array_contains(g["fields"], f["name"])), F.lit(0))
        unit = F.coalesce(F.concat(F.lit("group:"), group["id"]), F.concat(F.lit("field:"), f["name"]))
        return F.coalesce(_named(F.try_element_at("held", F.try_element_at("picks", unit)), f["name"]), f)

    fields = F.transform(F.try_element_at("held", whole), taken)
    placed = joined.select("group_key", (F.col("index") > 0).alias("is_added"), F.coalesce("base_pos", "row_id").alias("place"), "at.input", "at.row_pos", fields.alias("fields"))
    like = made.entries.where(F.col("component").isin(".uexp", ".uasset")).join(made.actions.where(F.col("action") == plans.MERGE), "group_key")
    first = lambda kind: F.min_by(F.when(F.col("component") == kind, F.col("content")), F.when(F.col("component") == kind, F.col("input_index")))
    like = like.groupBy("group_key").agg(first(".uexp").alias("like"), first(".uasset").alias("header"))

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("group_key", pa.string()), ("content", pa.binary()), ("header", pa.binary())])
        if not right.num_rows:
            return schema.empty_table()
        ordered = left.sort_by([(c, "ascending") for c in ("is_added", "place", "input", "row_pos")])
        like, header = right.column("like")[0].as_py(), right.column("header")[0].as_py()
        rows = ordered.column("fields").to_pylist()
        if header is not None and tagged_rows.is_table_package(header):
            header, payload = tagged_rows.build_table(header, tagged_rows.payload_of(header, like), [[f["raw"] for f in fields] for fields in rows])
            content = payload + like[-4:]
        else:
            header, content = None, msgpack_rows.build_table([msgpack_rows.rebuild_row(f) for f in rows], like)
        return pa.Table.from_pylist([{"group_key": right.column("group_key")[0].as_py(), "content": content, "header": header}], schema=schema)

    return placed.groupBy("group_key").cogroup(like.groupBy("group_key")).applyInArrow(build, "group_key string, content binary, header binary")


def merge_archives(made: ArchivePlan, choices: DataFrame, folder: str, name: str = "merged_P.pak", *, plan_id: str = "") -> DataFrame:
    """Writes the merged archive after checking the choices, and returns its entries as read back.

    Copied and deduplicated packages come from their first provider, chosen ones
    from the chosen input.
    """
    spark = choices.sparkSession
    if plan_id not in ("", made.plan_id):
        raise MergeError("the choices are of another plan")
    for wrong in invalid(choices, made.conflicts, made.variants).limit(1).collect():
        raise MergeError(f"{wrong.reason}: {wrong.conflict_id}")
    for left in unresolved(made.conflicts, choices).limit(1).collect():
        raise MergeError(f"without a choice: {left.conflict_id}")
    chosen = written(made.variants.join(choices.select("conflict_id", "variant_id"), ["conflict_id", "variant_id"]).select("group_key", "row", "unit_id", "input"), "chosen")

    files = chosen.where("row = ''").select("group_key", F.col("input").alias("wanted"))
    first = made.entries.groupBy("group_key").agg(F.min("input_index").alias("first"))
    source = made.actions.select("group_key", "action").join(first, "group_key").join(files, "group_key", "left")
    source = source.select("group_key", "action", F.coalesce("wanted", "first").alias("input_index"))
    taken = made.entries.join(source, ["group_key", "input_index"])
    merged = _tables_of(made, chosen).withColumnsRenamed({"content": "merged", "header": "merged_header"})
    out = taken.join(merged, "group_key", "left")
    table = (F.col("action") == plans.MERGE) & (F.col("component") == ".uexp")
    header = (F.col("action") == plans.MERGE) & (F.col("component") == ".uasset")
    content = F.when(table, F.col("merged")).when(header, F.coalesce("merged_header", "content")).otherwise(F.col("content"))
    out = written(out.select("path", content.alias("content")), "output")
    mount = made.entries.where("input_index = 0").select("mount").first()
    sink = out.orderBy(F.lower("path")).coalesce(1).write.format("overlay_archive").mode("append").option("name", name)
    sink.option("mount", mount.mount if mount else "../../../").save(folder)
    back = spark.read.format("overlay_archive").load(f"{folder}/{name}")
    expected = out.select("path", F.sha2("content", 256).alias("sha256"))
    if back.select("path", "sha256").exceptAll(expected).union(expected.exceptAll(back.select("path", "sha256"))).limit(1).collect():
        raise MergeError("the archive differs from what was written")
    return back


def demo_archives(spark: SparkSession, inputs: Sequence[dict[str, bytes]]) -> list[str]:
    """Archives of the given files in the shared folder, for tests and trials."""
    archive.register(spark)
    paths = []
    for files in inputs:
        paths.append(new_folder(spark, "demo"))
        rows = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
        rows.orderBy(F.lower("path")).coalesce(1).write.format("overlay_archive").mode("append").save(paths[-1])
    return paths

