"""The library's operators as queries over the driver's tables, with DuckDB SQL for the same rows.

P is three overlays of ``orders`` (base 0, donors 1 and 2), AR the same with
parallel arrays, DOC ``documents`` as loose files, PG and PATHS paths, EV
placements from ``events``, LI references from ``lineitem`` to ``part``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import ids, paths, values
from strataweave.operators import align, apply, diff, refs, units, verify
from strataweave.plans import plan, resolve, rules
from strataweave.sources.folders import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KINDS = {"custkey": "integer", "status": "text", "priority": "text", "day": "text", "cents": "integer"}
GROUPS = [("status_priority", ("status", "priority"), True)]
UNITS = units.plan_units({"row_id": "integer", **KINDS}, GROUPS, "row_id")
INPUT_IDS = ("in-0", "in-1", "in-2")
ASSET = "orders"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# overlays of orders


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("string").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.col("o_orderkey").alias("row_pos"),
    )


def overlays(spark, sf_dir) -> DataFrame:
    r = F.col("row_id")
    base = _orders(spark, sf_dir)
    first = base.where(r % 10 != 8).withColumns(
        {
            "priority": F.when(r % 7 == 0, "1-URGENT").otherwise(F.col("priority")),
            "cents": F.when(r % 11 == 0, F.col("cents") + 100).otherwise(F.col("cents")),
            "custkey": F.when(r % 5 == 0, F.lpad("custkey", 12, "0")).otherwise(F.col("custkey")),
        }
    )
    second = base.where(r % 10 != 7).withColumns(
        {"status": F.when((r % 13 == 0) | (r % 20 == 9), "X").otherwise(F.col("status")), "cents": F.when(r % 11 == 0, F.col("cents") + 100).otherwise(F.col("cents"))}
    )
    return align.tagged([base.where(r % 10 != 9), first, second])


P_SQL = """
o as (
  select o_orderkey as row_id, o_custkey::varchar as custkey, o_orderstatus as status, o_orderpriority as priority,
    cast(cast(o_orderdate as date) as varchar) as day, cast(round(o_totalprice * 100) as bigint) as cents
  from orders
), p as (
  select 0 as input_index, * from o where row_id % 10 <> 9
  union all
  select 1, row_id, case when row_id % 5 = 0 then lpad(custkey, 12, '0') else custkey end, status,
    case when row_id % 7 = 0 then '1-URGENT' else priority end, day, case when row_id % 11 = 0 then cents + 100 else cents end
  from o where row_id % 10 <> 8
  union all
  select 2, row_id, custkey, case when row_id % 13 = 0 or row_id % 20 = 9 then 'X' else status end, priority, day,
    case when row_id % 11 = 0 then cents + 100 else cents end
  from o where row_id % 10 <> 7
)"""

#: Each unit of each row as raw and canonical text.
LONG_SQL = (
    P_SQL
    + """, long as (
  select input_index, row_id, 'group:status_priority' as unit_id, 0 as unit_pos, true as atomic, status || '|' || priority as raw, status || '|' || priority as sem from p
  union all select input_index, row_id, 'field:custkey', 1, false, custkey, custkey::hugeint::varchar from p
  union all select input_index, row_id, 'field:day', 2, false, day, day from p
  union all select input_index, row_id, 'field:cents', 3, false, cents::varchar, cents::varchar from p
), d as (
  select row_id, unit_id, unit_pos, count(*) as n_variants,
    case when min(sem) <> max(sem) then case when bool_or(atomic) then 'ATOMIC_GROUP' else 'FIELD_VALUE' end else 'ENCODING_DRIFT' end as kind
  from long group by row_id, unit_id, unit_pos
  having min(input_index) = 0 and count(*) > 1 and (min(sem) <> max(sem) or min(raw) <> max(raw))
)"""
)
ADDED_SQL = (
    P_SQL
    + """, a as (
  select row_id, min(input_index) as first_input, count(*) as n_variants,
    min(concat_ws('|', custkey::hugeint, status, priority, day, cents)) <> max(concat_ws('|', custkey::hugeint, status, priority, day, cents)) as collides,
    min(concat_ws('|', custkey, status, priority, day, cents)) <> max(concat_ws('|', custkey, status, priority, day, cents)) as bytes
  from p group by row_id having min(input_index) > 0
)"""
)


def _long(spark, sf_dir):
    return units.long_form(overlays(spark, sf_dir), "row_id", UNITS, KINDS)


def _differences(spark, sf_dir):
    return diff.row_differences(overlays(spark, sf_dir), "row_id", UNITS, KINDS)


def _added(spark, sf_dir):
    return diff.added_rows(diff.with_row_texts(overlays(spark, sf_dir), KINDS), "row_id")


@query(f"with {P_SQL} select row_id, list(input_index order by input_index)::varchar as holders, count(*)::int as n_holders from p group by row_id")
def provider_alignment(spark, sf_dir):
    found = align.holders(overlays(spark, sf_dir), "row_id")
    return found.select("row_id", F.concat(F.lit("["), F.concat_ws(", ", "holders"), F.lit("]")).alias("holders"), "n_holders")


@query(f"with {P_SQL} select row_id, count(*)::int as n_holders from p group by row_id having count(*) < 3")
def partial_rows(spark, sf_dir):
    return align.partial_rows(overlays(spark, sf_dir), "row_id", 3).select("row_id", "n_holders")


@query(f"with {P_SQL} select distinct row_id from p")
def all_row_ids(spark, sf_dir):
    return overlays(spark, sf_dir).select("row_id").distinct()


@query(f"with {P_SQL} select row_id, input_index, custkey, status, priority, day, cents from p qualify row_number() over (partition by row_id order by input_index) = 1")
def row_union(spark, sf_dir):
    return align.first_holder(overlays(spark, sf_dir), "row_id").select("row_id", "input_index", *KINDS)


@query(f"with {P_SQL} select row_id, min(input_index) as first_input from p group by row_id having min(input_index) > 0")
def donor_only_rows(spark, sf_dir):
    return align.donor_only(overlays(spark, sf_dir), "row_id")


@query(f"with {ADDED_SQL} select row_id, n_variants from a where collides")
def added_row_collisions(spark, sf_dir):
    return _added(spark, sf_dir).where("collides").select("row_id", "n_variants")


@query(f"with {ADDED_SQL} select row_id, first_input, bytes and not collides as drifts from a where not collides")
def added_rows_agreed(spark, sf_dir):
    return _added(spark, sf_dir).where("not collides").select("row_id", "first_input", "drifts")


@query(f"with {P_SQL} select row_id, min(input_index) as input_index, arg_min(cents, input_index) as cents from p group by row_id having min(input_index) > 0")
def first_holder_pick(spark, sf_dir):
    return align.first_holder(overlays(spark, sf_dir), "row_id").where("input_index > 0").select("row_id", "input_index", "cents")


def _sql_frame(x: str) -> str:
    return f"unhex(format('{{:016x}}', octet_length(encode({x})))) || encode({x})"


def _sql_unit_hash(*pairs: tuple[str, str]) -> str:
    framed = " || ".join(f"{_sql_frame(repr(n))} || {_sql_frame(chr(39) + '=' + chr(39) + ' || ' + v)}" for n, v in pairs)
    return f"sha256(encode('{ids.UNIT}') || {framed})"


@query(
    f"""with {P_SQL}
  select input_index, row_id, 'group:status_priority' as unit_id, 0 as unit_pos, true as atomic,
    {_sql_unit_hash(("status", "status"), ("priority", "priority"))} as raw_hash, {_sql_unit_hash(("status", "'s:' || status"), ("priority", "'s:' || priority"))} as sem_hash from p
  union all select input_index, row_id, 'field:custkey', 1, false, {_sql_unit_hash(("custkey", "custkey"))}, {_sql_unit_hash(("custkey", "'i:' || custkey::hugeint::varchar"))} from p
  union all select input_index, row_id, 'field:day', 2, false, {_sql_unit_hash(("day", "day"))}, {_sql_unit_hash(("day", "'s:' || day"))} from p
  union all select input_index, row_id, 'field:cents', 3, false, {_sql_unit_hash(("cents", "cents::varchar"))}, {_sql_unit_hash(("cents", "'i:' || cents::varchar"))} from p"""
)
def unit_long_form(spark, sf_dir):
    return _long(spark, sf_dir)


@query(f"with {LONG_SQL} select row_id, unit_id, kind, n_variants from d")
def unit_diff(spark, sf_dir):
    return _differences(spark, sf_dir).select("row_id", "unit_id", "kind", "n_variants")


@query(f"with {LONG_SQL} select row_id, unit_id, n_variants from d where kind = 'FIELD_VALUE'")
def field_conflicts(spark, sf_dir):
    return _differences(spark, sf_dir).where(F.col("kind") == diff.FIELD_VALUE).select("row_id", "unit_id", "n_variants")


@query(f"with {LONG_SQL} select row_id, unit_id, n_variants from d where kind = 'ATOMIC_GROUP'")
def group_conflicts(spark, sf_dir):
    return _differences(spark, sf_dir).where(F.col("kind") == diff.ATOMIC_GROUP).select("row_id", "unit_id", "n_variants")


@query(f"with {LONG_SQL} select unit_id, count(*) as n_drift from d where kind = 'ENCODING_DRIFT' group by unit_id")
def encoding_drift(spark, sf_dir):
    return _differences(spark, sf_dir).where(F.col("kind") == diff.ENCODING_DRIFT).groupBy("unit_id").agg(F.count("*").alias("n_drift"))


@query(f"with {LONG_SQL} select row_id, unit_id from d where kind = 'ENCODING_DRIFT' order by row_id, unit_pos limit 64")
def drift_samples(spark, sf_dir):
    return diff.drift_samples(_differences(spark, sf_dir), "row_id").select("row_id", "unit_id")


def _shaped(spark, sf_dir):
    """The overlays, where donor 1 lacks ``day`` in every seventeenth row."""
    names = F.lit(",".join(KINDS))
    short = F.lit(",".join(k for k in KINDS if k != "day"))
    return overlays(spark, sf_dir).withColumn("shape", F.when((F.col("input_index") == 1) & (F.col("row_id") % 17 == 0), short).otherwise(names))


SHAPE_SQL = """, s as (
  select row_id, count(*) as n_variants from p group by row_id
  having min(input_index) = 0 and count(*) > 1 and bool_or(input_index = 1) and row_id % 17 = 0
)"""


@query(f"with {P_SQL}{SHAPE_SQL} select row_id, '__whole_row__' as unit_id, 'STRUCTURE_MISMATCH' as kind, n_variants from s")
def shape_mismatch(spark, sf_dir):
    return diff.shape_mismatches(_shaped(spark, sf_dir), "row_id", "shape")


def _conflicts(spark, sf_dir):
    return diff.conflicts(_differences(spark, sf_dir), diff.shape_mismatches(_shaped(spark, sf_dir), "row_id", "shape"), _added(spark, sf_dir), "row_id")


ALL_SQL = (
    LONG_SQL
    + SHAPE_SQL
    + ADDED_SQL.replace(P_SQL, "", 1)
    + """, c as (
  select row_id, unit_id, kind, n_variants from d where row_id not in (select row_id from s)
  union all select row_id, '__whole_row__', 'STRUCTURE_MISMATCH', n_variants from s
  union all select row_id, '$row', 'ROW_ID_COLLISION', n_variants from a where collides
)"""
)


@query(f"with {ALL_SQL} select row_id, unit_id, kind, n_variants from c")
def conflicts(spark, sf_dir):
    return _conflicts(spark, sf_dir)


# identifiers, plan, choices: of the units' conflicts


def _identified(spark, sf_dir):
    made = diff.row_variants(overlays(spark, sf_dir), "row_id", UNITS, KINDS)
    return plan.with_ids(made, ASSET, "row_id", INPUT_IDS)


def _sql_id(prefix: str, tag: str, *parts: str) -> str:
    framed = " || ".join(_sql_frame(p) for p in parts)
    return f"'{prefix}-' || sha256(encode('{tag}') || {framed})"


VARIANT_SQL = (
    LONG_SQL
    + f""", h as (
  select input_index, row_id, unit_id, case unit_id
      when 'group:status_priority' then {_sql_unit_hash(("status", "status"), ("priority", "priority"))}
      when 'field:custkey' then {_sql_unit_hash(("custkey", "custkey"))}
      when 'field:day' then {_sql_unit_hash(("day", "day"))}
      else {_sql_unit_hash(("cents", "cents::varchar"))} end as raw_hash
  from p cross join (values ('group:status_priority'), ('field:custkey'), ('field:day'), ('field:cents')) u(unit_id)
), v as (
  select h.row_id, h.unit_id, d.kind, h.input_index, 'in-' || h.input_index as input_id,
    {_sql_id("var", ids.VARIANT, repr(ASSET), "h.row_id::varchar", "h.unit_id", "'in-' || h.input_index", "upper(h.raw_hash)")} as variant_id
  from h join d on h.row_id = d.row_id and h.unit_id = d.unit_id
), ci as (
  select row_id, unit_id, kind, count(*) as n_variants,
    'conf-' || sha256(encode('{ids.CONFLICT}') || {_sql_frame(repr(ASSET))} || {_sql_frame("row_id::varchar")} || {_sql_frame("unit_id")}
      || unhex(string_agg(hex({_sql_frame("variant_id")}), '' order by input_id, variant_id))) as conflict_id
  from v group by row_id, unit_id, kind
)"""
)


@query(f"with {VARIANT_SQL} select row_id, unit_id, input_id, variant_id from v")
def variants(spark, sf_dir):
    return _identified(spark, sf_dir)[0].select("row_id", "unit_id", "input_id", "variant_id")


@query(f"with {VARIANT_SQL} select row_id, unit_id, kind, conflict_id from ci")
def conflict_ids(spark, sf_dir):
    return _identified(spark, sf_dir)[1].select("row_id", "unit_id", "kind", "conflict_id")


@query(
    f"""with {VARIANT_SQL}, k as (
  select substr(part, 1, 2) as chunk, sum(n)::bigint as n, sha256(string_agg(digest, ',' order by part)) as digest from (
    select substr(conflict_id, 6, 4) as part, count(*) as n, sha256(string_agg(conflict_id, ',' order by conflict_id)) as digest from ci where kind <> 'ENCODING_DRIFT' group by 1
  ) group by 1
)
select sum(n)::bigint as n_conflicts, (select count(*) from d where kind = 'ENCODING_DRIFT') as n_drift,
  'plan-' || sha256(encode('{ids.PLAN}') || {" || ".join(_sql_frame(repr(x)) for x in (*INPUT_IDS, "in-0", "generic", "generic"))}
    || unhex(string_agg(hex({_sql_frame("digest")}), '' order by chunk))) as plan_id
from k"""
)
def plan_summary(spark, sf_dir):
    found = _identified(spark, sf_dir)[1]
    drift = found.where(F.col("kind") == diff.ENCODING_DRIFT)
    return plan.summary(found.where(F.col("kind") != diff.ENCODING_DRIFT), drift, INPUT_IDS, "in-0", rules.GENERIC)


def _choices(spark, sf_dir):
    """Two of three blocking conflicts choose; by row, one of their variants."""
    found = written(_identified(spark, sf_dir)[1], "conflicts")
    open_ = found.where(resolve.blocking(F.col("kind")) & (F.col("row_id") % 3 != 0))
    chosen = open_.select("conflict_id", "row_id", "unit_id", F.get("variants", (F.col("row_id") % F.size("variants")).cast("int")).alias("v"))
    return found, chosen.select("conflict_id", "row_id", "unit_id", F.col("v.variant_id").alias("variant_id"), F.col("v.input_id").alias("input_id"))


CHOICE_SQL = (
    VARIANT_SQL
    + """, n as (
  select v.*, ci.conflict_id, ci.n_variants, row_number() over (partition by v.row_id, v.unit_id order by v.input_id, v.variant_id) - 1 as place
  from v join ci on v.row_id = ci.row_id and v.unit_id = ci.unit_id
), ch as (
  select conflict_id, row_id, unit_id, variant_id, input_id, input_index from n
  where kind <> 'ENCODING_DRIFT' and row_id % 3 <> 0 and place = row_id % n_variants
)"""
)


@query(f"with {CHOICE_SQL} select conflict_id, row_id, unit_id from ci where kind <> 'ENCODING_DRIFT' and conflict_id not in (select conflict_id from ch)")
def unresolved_conflicts(spark, sf_dir):
    found, chosen = _choices(spark, sf_dir)
    return resolve.unresolved(found, chosen).select("conflict_id", "row_id", "unit_id")


@query(
    f"""with {CHOICE_SQL}
select conflict_id || 'x' as conflict_id, variant_id, 'unknown conflict' as reason from ch where row_id % 7 = 1
union all select conflict_id, variant_id || 'x', 'unknown variant' from ch where row_id % 7 = 2
union all select conflict_id, 'any', 'informational' from ci where kind = 'ENCODING_DRIFT' and row_id % 7 = 3"""
)
def invalid_choices(spark, sf_dir):
    found, chosen = _choices(spark, sf_dir)
    r = F.col("row_id") % 7
    broken = chosen.select(
        F.when(r == 1, F.concat("conflict_id", F.lit("x"))).otherwise(F.col("conflict_id")).alias("conflict_id"),
        F.when(r == 2, F.concat("variant_id", F.lit("x"))).otherwise(F.col("variant_id")).alias("variant_id"),
    )
    drift = found.where((F.col("kind") == diff.ENCODING_DRIFT) & (r == 3)).select("conflict_id", F.lit("any").alias("variant_id"))
    return resolve.invalid(broken.union(drift), found, plan.offered(found, "row_id"))


@query(f"with {CHOICE_SQL} select n.conflict_id, n.variant_id from n where n.input_id = 'in-2' and n.kind <> 'ENCODING_DRIFT' and n.conflict_id not in (select conflict_id from ch)")
def bulk_choose(spark, sf_dir):
    found, chosen = _choices(spark, sf_dir)
    return resolve.bulk_choose(found, plan.offered(found, "row_id"), chosen, "in-2")


@query(
    f"""with {CHOICE_SQL}, f as (select conflict_id, arg_min(variant_id, input_index) as first from n group by conflict_id)
select ci.conflict_id, ci.kind, case when ci.kind = 'ENCODING_DRIFT' then f.first else ch.variant_id end as variant_id, ci.kind = 'ENCODING_DRIFT' as automatic
from ci join f on ci.conflict_id = f.conflict_id left join ch on ci.conflict_id = ch.conflict_id"""
)
def report_records(spark, sf_dir):
    found, chosen = _choices(spark, sf_dir)
    return resolve.report(found.select("conflict_id", "kind"), plan.offered(found, "row_id"), chosen)


@query(f"with {LONG_SQL} select row_id, unit_id, kind from d where kind <> 'ENCODING_DRIFT' and contains(lower('orders ' || row_id || ' ' || unit_id), 's 12')")
def conflict_filter(spark, sf_dir):
    found = _differences(spark, sf_dir).withColumn("asset", F.lit(ASSET)).withColumn("row", F.col("row_id").cast("string"))
    return found.where(resolve.blocking(F.col("kind")) & resolve.matches_text("s 12", "asset", "row", "unit_id")).select("row_id", "unit_id", "kind")


# apply


def _applied(spark, sf_dir):
    """Choices by unit, all conflicts decided: by row, one of the holders; collisions take the last holder."""
    rows = overlays(spark, sf_dir)
    held = align.holders(rows, "row_id").select("row_id", "holders")
    found = _differences(spark, sf_dir).where(resolve.blocking(F.col("kind"))).select("row_id", "unit_id")
    added = _added(spark, sf_dir).where("collides").select("row_id", F.lit(diff.ADDED_ROW).alias("unit_id"))
    every = found.union(added).join(held, "row_id")
    last = F.element_at("holders", -1)
    pick = F.get("holders", (F.col("row_id") % F.size("holders")).cast("int"))
    return rows, every.select("row_id", "unit_id", F.when(F.col("unit_id") == diff.ADDED_ROW, last).otherwise(pick).alias("input_index"))


APPLY_SQL = (
    LONG_SQL
    + ADDED_SQL.replace(P_SQL, "", 1)
    + """, hs as (
  select row_id, list(input_index order by input_index) as holders, min(input_index) as base from p group by row_id
), pick as (
  select d.row_id, d.unit_id, holders[d.row_id % len(holders) + 1] as input_index from d join hs on d.row_id = hs.row_id where kind <> 'ENCODING_DRIFT'
  union all select a.row_id, '$row', holders[-1] from a join hs on a.row_id = hs.row_id where collides
), w as (
  select hs.row_id, base, max(input_index) filter (unit_id = '$row') as whole,
    max(input_index) filter (unit_id = 'group:status_priority') as g, max(input_index) filter (unit_id = 'field:custkey') as k,
    max(input_index) filter (unit_id = 'field:day') as dy, max(input_index) filter (unit_id = 'field:cents') as c
  from hs left join pick on hs.row_id = pick.row_id group by hs.row_id, base
), m as (
  select w.row_id, g.status, g.priority, k.custkey, y.day, c.cents, w.base > 0 as is_added, case when w.base = 0 then w.row_id end as base_pos
  from w
  join p g on g.row_id = w.row_id and g.input_index = coalesce(w.whole, w.g, w.base)
  join p k on k.row_id = w.row_id and k.input_index = coalesce(w.whole, w.k, w.base)
  join p y on y.row_id = w.row_id and y.input_index = coalesce(w.whole, w.dy, w.base)
  join p c on c.row_id = w.row_id and c.input_index = coalesce(w.whole, w.c, w.base)
)"""
)


@query(f"with {APPLY_SQL} select row_id, status, priority, custkey, day, cents, is_added from m")
def merged_table(spark, sf_dir):
    rows, choices = _applied(spark, sf_dir)
    return apply.merged(rows, "row_id", UNITS, choices).drop("base_pos")


@query(f"with {APPLY_SQL} select row_id, is_added, base_pos from m order by is_added, base_pos, row_id")
def merged_order(spark, sf_dir):
    rows, choices = _applied(spark, sf_dir)
    return apply.ordered(apply.merged(rows, "row_id", UNITS, choices), "row_id").select("row_id", "is_added", "base_pos")


@query(
    f"""with {APPLY_SQL}, t as (
  select *, (case when g <> base then 2 else 0 end) + (case when k <> base then 1 else 0 end) + (case when dy <> base then 1 else 0 end) + (case when c <> base then 1 else 0 end) as touched from w
)
select count(*) as n_rows, sum(case when base > 0 then 0 when touched = 0 then 1 else 5 - touched end)::bigint as preserved, sum(case when base > 0 then 1 else touched end)::bigint as replaced from t"""
)
def preserved_replaced_counts(spark, sf_dir):
    rows, choices = _applied(spark, sf_dir)
    return apply.change_counts(rows, "row_id", UNITS, choices)


@query(
    f"""with {APPLY_SQL}, l as (
  select case when is_added then 'added' else 'base' end as section, coalesce(base_pos, row_id) as place,
    sha256({" || ".join(f"coalesce('=' || length({c}::varchar) || ':' || {c}, '-')" for c in ("row_id", "status", "priority", "custkey", "day", "cents"))}) as row_hash
  from m
)
select section, place // 1024 as stretch, count(*) as n_rows, sha256(string_agg(row_hash, '' order by place)) as digest from l group by 1, 2"""
)
def audit_ledger(spark, sf_dir):
    rows, choices = _applied(spark, sf_dir)
    return apply.ledger(apply.merged(rows, "row_id", UNITS, choices), "row_id", [f for u in UNITS for f in u.fields])


# parallel arrays


def _arrays(spark, sf_dir):
    c, k = F.col("cents"), F.col("custkey").cast("long")
    base = _orders(spark, sf_dir).select("row_id", F.array(c % 4, c % 5, c % 6).alias("types"), F.array(k % 10, k % 11, k % 12).alias("vals"))
    r = F.col("row_id")
    changed = lambda f: F.when(r % 3 == 0, F.transform(f, lambda x, i: F.when(i == 1, x + 1).otherwise(x))).otherwise(F.col(f))
    cut = lambda f: F.when(r % 29 == 0, F.slice(f, 1, 2)).otherwise(F.col(f))
    donor = base.withColumns({"types": changed("types"), "vals": changed("vals")}).withColumns({"types": cut("types"), "vals": cut("vals")})
    return base, donor


AR_SQL = """
b as (
  select o_orderkey as row_id, cast(round(o_totalprice * 100) as bigint) as cents, o_custkey as k from orders
), ar as (
  select row_id, [cents % 4, cents % 5, cents % 6] as types, [k % 10, k % 11, k % 12] as vals from b
), e as (
  select row_id, case when row_id % 3 = 0 then [types[1], types[2] + 1, types[3]] else types end as types,
    case when row_id % 3 = 0 then [vals[1], vals[2] + 1, vals[3]] else vals end as vals from ar
), dn as (
  select row_id, case when row_id % 29 = 0 then types[1:2] else types end as types, case when row_id % 29 = 0 then vals[1:2] else vals end as vals from e
)"""


@query(
    f"""with {AR_SQL}, x as (
  select 0 as input_index, * from ar union all select 1, * from dn
)
select input_index, row_id, len(types)::int as length, (i - 1)::int as position, 'group:pairs[' || (i - 1) || ']' as unit_id, types[i] as types, vals[i] as vals
from x, range(1, 4) t(i) where i <= len(types)"""
)
def array_units(spark, sf_dir):
    return units.array_units(align.tagged(list(_arrays(spark, sf_dir))), "row_id", "pairs", ["types", "vals"])


@query("select o_orderkey as row_id from orders where o_orderkey % 29 = 0")
def array_length_mismatch(spark, sf_dir):
    rows = align.tagged(list(_arrays(spark, sf_dir))).withColumn("shape", F.size("types").cast("string"))
    return diff.shape_mismatches(rows, "row_id", "shape").select("row_id")


@query(
    f"""with {AR_SQL}
select ar.row_id, list_transform([1, 2, 3], lambda i: case when i = 2 and ar.row_id % 2 = 0 and len(dn.types) = 3 then dn.types[i] else ar.types[i] end)::varchar as types,
  list_transform([1, 2, 3], lambda i: case when i = 2 and ar.row_id % 2 = 0 and len(dn.types) = 3 then dn.vals[i] else ar.vals[i] end)::varchar as vals
from ar join dn on ar.row_id = dn.row_id"""
)
def apply_array_choice(spark, sf_dir):
    base, donor = _arrays(spark, sf_dir)
    choices = base.where(F.col("row_id") % 2 == 0).select("row_id", F.lit(1).alias("position"), F.lit(1).alias("input_index"))
    out = apply.apply_array_choice(base, donor.withColumn("input_index", F.lit(1)), choices, "row_id", ["types", "vals"])
    shown = lambda c: F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))), F.lit("]")).alias(c)
    return out.select("row_id", shown("types"), shown("vals"))


# loose files: documents as two inputs


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    first = docs.select("path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    second = docs.where(F.col("doc_id") % 6 != 0).select("path", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size"))
    return first, second


DOC_SQL = """
f as (
  select 0 as input_index, doc_id, source || '/' || lang || '/' || doc_id || '.txt' as path, text from documents
  union all
  select 1, doc_id, source || '/' || lang || '/' || doc_id || '.txt', case when doc_id % 4 = 0 then text || '!' else text end from documents where doc_id % 6 <> 0
), g as (
  select input_index, path, sha256(text) as sha256, octet_length(encode(text)) as size from f
)"""


@query(
    f"""with {DOC_SQL}
select lower(path) as group_key, count(*) as n_providers,
  case when count(*) = 1 then 'copy' when min(sha256) = max(sha256) then 'deduplicate' else 'select_opaque' end as action
from g group by path"""
)
def asset_actions(spark, sf_dir):
    return plan.asset_actions(plan.packages(align.tagged(list(_files(spark, sf_dir)))))


@query(
    f"""with {DOC_SQL}
select input_index, lower(path) as group_key, sha256(encode('{ids.GROUP}') || {_sql_frame("'file'")} || {_sql_frame("lower(path)")} || {_sql_frame("sha256")}) as digest from g"""
)
def group_digest(spark, sf_dir):
    return plan.packages(align.tagged(list(_files(spark, sf_dir)))).select("input_index", "group_key", "digest")


@query(f"with {DOC_SQL} select path, count(*) as n_providers from g group by path having count(*) > 1 and min(sha256) = max(sha256)")
def loose_dedupe(spark, sf_dir):
    seen = align.tagged(list(_files(spark, sf_dir))).groupBy("path").agg(F.count("*").alias("n_providers"), diff.differs("sha256").alias("differs"))
    return seen.where("n_providers > 1 and not differs").select("path", "n_providers")


@query(f"with {DOC_SQL} select path, 'OPAQUE_PACKAGE' as kind, count(*) as n_variants from g group by path having min(sha256) <> max(sha256)")
def loose_conflicts(spark, sf_dir):
    seen = align.tagged(list(_files(spark, sf_dir))).groupBy("path").agg(F.count("*").alias("n_variants"), diff.differs("sha256").alias("differs"))
    return seen.where("differs").select("path", F.lit(diff.OPAQUE_PACKAGE).alias("kind"), "n_variants")


@query(
    f"""with {DOC_SQL}
select a.path as path_key, case when b.path is null then 'missing' else 'changed' end as state
from (select * from g where input_index = 0) a left join (select * from g where input_index = 1) b on a.path = b.path
where b.path is null or a.sha256 <> b.sha256"""
)
def inventory_diff(spark, sf_dir):
    first, second = _files(spark, sf_dir)
    return verify.inventory_diff(first.withColumnRenamed("path", "path_key"), second.withColumnRenamed("path", "path_key"))


@query("select sha256(text) as sha256, count(*) as copies from documents group by 1 having count(*) > 1")
def duplicate_inputs(spark, sf_dir):
    return align.duplicate_keys(_files(spark, sf_dir)[0], "sha256")


@query("select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return align.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    """with l as (
  select l_suppkey, l_orderkey as v, lag(l_orderkey) over (partition by l_suppkey order by l_orderkey, l_linenumber) as before from lineitem
)
select l_suppkey, count(*) as n, count(*) filter (v < before) as falls, count(*) filter (v = before) as repeats from l group by l_suppkey"""
)
def monotone_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("place"))
    return apply.rising(rows, "l_suppkey", "place", "l_orderkey")


RANGES_SQL = """r as (
  select source, doc_id, sum(n_chars) over (partition by source order by doc_id) - n_chars as start, n_chars + case when doc_id % 50 = 0 then 7 else 0 end as size from documents
)"""


@query(
    f"""with {RANGES_SQL}, x as (
  select *, max(start + size) over (partition by source order by start, start + size rows between unbounded preceding and 1 preceding) as reach from r
)
select source, doc_id from x where start < reach"""
)
def disjoint_ranges(spark, sf_dir):
    size = F.col("n_chars") + F.when(F.col("doc_id") % 50 == 0, 7).otherwise(0)
    docs = apply.running_total(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", "so_far")
    start = F.col("so_far") - F.col("n_chars")
    ranges = docs.select("source", "doc_id", start.alias("start"), (start + size).alias("end"))
    return apply.overlaps(ranges, "source", "start", "end").select("source", "doc_id")


# references


def _references(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem.part").alias("rule"), F.col("l_orderkey").alias("source_row"), F.col("l_partkey").alias("target_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("scan_order")
    )
    parts = table(spark, sf_dir, "part").where(F.col("p_partkey") % 50 != 0).select(F.lit("lineitem.part").alias("rule"), F.col("p_partkey").alias("target_id"))
    exempt = lines.where(F.col("source_row") % 97 == 0).select("rule", "source_row", "target_id").distinct()
    return lines, parts, exempt


BREAK_SQL = "x as (select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey > 0 and l_partkey not in (select p_partkey from part where p_partkey % 50 <> 0))"


@query(f"with {BREAK_SQL} select 'lineitem.part' as rule, count(*) as n_missing, min(l_partkey) as min_missing, max(l_partkey) as max_missing from x where l_orderkey % 97 <> 0 having count(*) > 0")
def reference_breaks(spark, sf_dir):
    lines, parts, exempt = _references(spark, sf_dir)
    return refs.summary(refs.missing(lines, parts, exempt))


@query(f"with {BREAK_SQL} select l_orderkey as source_row, l_partkey as target_id from x where l_orderkey % 97 = 0")
def reference_exempt(spark, sf_dir):
    lines, parts, exempt = _references(spark, sf_dir)
    return refs.missing(lines, parts).join(exempt, ["rule", "source_row", "target_id"], "left_semi").select("source_row", "target_id")


@query(f"with {BREAK_SQL} select l_orderkey as source_row, l_partkey as target_id from x where l_orderkey % 97 <> 0 order by l_orderkey, l_linenumber, l_partkey limit 32")
def reference_examples(spark, sf_dir):
    lines, parts, exempt = _references(spark, sf_dir)
    return refs.examples(refs.missing(lines, parts, exempt)).select("source_row", "target_id")


@query("select 'orders.clerk' as rule, 'clerk' as target")
def reference_skipped(spark, sf_dir):
    declared = spark.createDataFrame([("lineitem.part", "part"), ("orders.clerk", "clerk")], "rule string, target string")
    present = spark.createDataFrame([("part",), ("orders",)], "table string")
    return refs.skipped(declared, present).select("rule", "target")


@query("select o_orderkey as source_row, o_orderkey + 7 as target_id from orders where o_orderkey + 7 not in (select o_orderkey from orders)")
def self_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("orders.next").alias("rule"), F.col("o_orderkey").alias("source_row"))
    targets = rows.select("rule", F.col("source_row").alias("target_id"))
    return refs.missing(rows.withColumn("target_id", F.col("source_row") + 7), targets).select("source_row", "target_id")


@query(f"with {AR_SQL}, l as (select row_id, unnest(vals) as target_id from ar) select row_id as source_row, target_id from l where target_id > 0 and target_id % 4 = 3")
def reference_array_breaks(spark, sf_dir):
    base, _ = _arrays(spark, sf_dir)
    targets = spark.range(1, 12).where("id % 4 <> 3").select(F.lit("orders.vals").alias("rule"), F.col("id").alias("target_id"))
    return refs.missing(refs.leaves(base, "row_id", "orders.vals", "vals"), targets).select("source_row", "target_id")


@query(
    """with n as (
  select event_id, unnest([event_type, 'None', '', 'A::' || event_type, '/x/' || event_type, event_type || '_' || (event_id % 3)]) as name from events
)
select event_id, name from n where name not in ('', 'None') and not contains(name, '::') and not starts_with(name, '/') and name not in (select distinct event_type from events)"""
)
def name_references(spark, sf_dir):
    e = F.col("event_type")
    names = F.array(e, F.lit("None"), F.lit(""), F.concat(F.lit("A::"), e), F.concat(F.lit("/x/"), e), F.concat(e, F.lit("_"), (F.col("event_id") % 3).cast("string")))
    events = table(spark, sf_dir, "events")
    used = events.select(F.lit("events.type").alias("rule"), F.col("event_id").alias("source_row"), F.explode(names).alias("target"))
    known = events.select(F.lit("events.type").alias("rule"), e.alias("target")).distinct()
    return refs.missing_names(used, known).select(F.col("source_row").alias("event_id"), F.col("target").alias("name"))


@query(
    f"""with {BREAK_SQL}, s as (select l_orderkey, l_partkey::varchar as target from lineitem where l_orderkey % 97 <> 0)
select 'by number' as form, l_orderkey as source_row, l_partkey::varchar as target from x where l_orderkey % 97 <> 0
union all select 'by name', l_orderkey, 'p' || target from s where target::bigint % 50 = 0 or target::bigint not in (select p_partkey from part)"""
)
def reference_dispatch(spark, sf_dir):
    """The same references by number and, as names, by name."""
    lines, parts, exempt = _references(spark, sf_dir)
    name = F.concat(F.lit("p"), F.col("target_id").cast("string")).alias("target")
    by_number = refs.broken(refs.BY_NUMBER, lines, parts, exempt)
    by_name = refs.broken(refs.BY_NAME, lines.select("rule", "source_row", name), parts.select("rule", name), exempt.select("rule", "source_row", name))
    out = by_number.withColumn("form", F.lit("by number")).unionByName(by_name.withColumn("form", F.lit("by name")))
    return out.select("form", "source_row", "target")


@query(
    """with e as (
  select event_id % 2 as input_index, event_id as row, user_id % 20 as map_id, event_type as label, event_id % 3 as owner, cast(floor(value) as bigint) % 4 as talk from events
), f as (
  select distinct input_index, row, owner, talk, map_id || '|' || lower(trim(label)) as place from e where map_id > 0 and owner > 0 and talk > 0
), s as (
  select place, input_index, list((row, owner, talk) order by row, owner, talk)::varchar as facts from f group by place, input_index
), g as (
  select place, count(*) as n_inputs, count(distinct facts) as n_sets from s group by place
), c as (
  select place, count(distinct row) as n_rows, count(distinct (owner, talk)) as n_bindings from f group by place
)
select c.place, n_rows, n_bindings, n_inputs from c join g on c.place = g.place where n_rows > 1 and n_bindings > 1 and n_inputs > 1 and n_sets > 1"""
)
def placement_collisions(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "events")
        .select(
            (F.col("event_id") % 2).alias("input_index"),
            F.col("event_id").alias("row"),
            (F.col("user_id") % 20).alias("map_id"),
            F.col("event_type").alias("label"),
            (F.col("event_id") % 3).alias("owner"),
            (F.floor("value") % 4).alias("talk"),
        )
        .where("map_id > 0")
    )
    return diff.placement_collisions(rows, row="row", map_id="map_id", appear="label", label="label", owner="owner", talk="talk")


# paths and rules

#: A few paths in every form that the path functions tell apart.
PATHS = [
    "Game/Local/Database/Item.uasset", "Game/Local/Database/Item.uexp", "game/local/database/ITEM.ubulk", "Game/Local/Npc/NpcSetListA.uasset", "/abs/path", "back\\slash", "a//b",
    "a/./b", "a/../b", "c:/x", "", "plain.txt", "Game/Text/EN.uptnl", "../../Game/Local/Database/Shop.uasset", "Game//Twice//Item.UASSET", "x/.uasset", "a/b.uexp.txt", "end/",
]
MOUNTS = ["../../../Game/Content/Local", "../../../Game/Content/", "../../../game/content/Text/EN/", "../../../Game/Content/Local/Npc"]


def _paths(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    listed = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return urls.union(listed).distinct()


PATHS_SQL = (
    "pg as (select distinct path from (select regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages union all select * from (values "
    + ", ".join("('" + p + "')" for p in PATHS)
    + ")))"
)
STRIP_SQL = r"regexp_replace(regexp_replace(lower(replace(path, '\', '/')), '/{2,}', '/', 'g'), '\.(uasset|uexp|ubulk|uptnl)$', '')"
NORMAL_SQL = f"case when starts_with({STRIP_SQL}, '/') then {STRIP_SQL} else '/' || {STRIP_SQL} end"


@query(rf"with {PATHS_SQL} select path, lower(replace(path, '\', '/')) as path_key, coalesce(string_split(path, '/')[-1], '') as leaf from pg")
def path_key(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", paths.path_key(F.col("path")).alias("path_key"), paths.leaf(F.col("path")).alias("leaf"))


@query(f"with {PATHS_SQL} select path, {NORMAL_SQL} as asset_path from pg")
def asset_path_norm(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", paths.asset_path(F.col("path")).alias("asset_path"))


#: Tables that a profile declares, in order.
DECLARED = [("Items", "/database/item"), ("Shops", "/shop"), ("Items twice", "/item"), ("Everything local", "/npcsetlista"), ("Pages", "1")]


@query(
    f"with {PATHS_SQL}, n as (select path, {NORMAL_SQL} as asset_path from pg), t as (select * from (values "
    + ", ".join(f"({n}, '{name}', '{suffix}')" for n, (name, suffix) in enumerate(DECLARED))
    + ') t(position, "table", suffix)) select path, arg_min("table", position) as "table" from n join t on ends_with(asset_path, suffix) group by path'
)
def reference_tables(spark, sf_dir):
    declared = spark.createDataFrame([(n, *x) for n, x in enumerate(DECLARED)], "position int, table string, suffix string")
    return refs.resolved_tables(_paths(spark, sf_dir), declared)


@query(
    rf"""with {PATHS_SQL}
select path, case when path = '' then 'empty' when starts_with(path, '/') or starts_with(path, '\') then 'absolute' when contains(path, '\') then 'backslash'
  when contains(path, ':') then 'colon' when list_contains(string_split(path, '/'), '') then 'empty part'
  when list_contains(string_split(path, '/'), '.') or list_contains(string_split(path, '/'), '..') then 'dots' end as error
from pg"""
)
def path_validation(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", paths.entry_path_error(F.col("path")).alias("error"))


@query(
    rf"""with {PATHS_SQL}, k as (
  select path, nullif(regexp_extract(lower(path), '[^/](\.(?:uasset|uexp|ubulk|uptnl))$', 1), '') as component from pg
), s as (
  select *, lower(replace(case when component is null then path else left(path, length(path) - length(component)) end, '\', '/')) as group_key from k
)
select group_key, bool_or(component is null) as loose, bool_or(coalesce(component, '') = '.uasset') as complete, string_agg(coalesce(component, 'file'), ',' order by coalesce(component, 'file')) as components
from s group by group_key"""
)
def package_grouping(spark, sf_dir):
    entries = _paths(spark, sf_dir).select(F.lit(0).alias("input_index"), "path", F.lit("").alias("sha256"))
    return plan.packages(entries).select("group_key", "loose", "complete", F.concat_ws(",", "components").alias("components"))


@query(
    "select * from (values "
    + ", ".join(f"('{m}', '../../../Game/Content', '{r}')" for m, r in zip(MOUNTS, ("Local", "", "Text/EN", "Local/Npc"), strict=True))
    + ") t(mount, common, rest)"
)
def mount_prefix(spark, sf_dir):
    from strataweave.operators.mounts import rebased

    mounts = spark.createDataFrame(list(enumerate(MOUNTS)), "input_index int, mount string")
    return rebased(mounts).select("mount", "common", "rest")


RULES = [
    rules.Profile(
        "shop-demo",
        "Shop demo",
        "table",
        2,
        (rules.Matcher("prefix", "/game/local/database/"), rules.Matcher("contains", "/npc/"), rules.Matcher("suffix", "/never")),
        (),
        (
            rules.AssetRule("database", (rules.Matcher("prefix", "/game/local/database/"),), 1),
            rules.AssetRule("item", (rules.Matcher("prefix", "/game/local/database/"), rules.Matcher("suffix", "/item")), 5),
            rules.AssetRule("text-a", (rules.Matcher("contains", "/text/"),), 3),
            rules.AssetRule("text-b", (rules.Matcher("suffix", "/en"),), 3),
        ),
    ),
    rules.Profile("other-demo", "Other demo", "table", 1, (rules.Matcher("exact", "/nothing/here"),)),
]
NORMALS_SQL = f"{PATHS_SQL}, nm as (select path, {NORMAL_SQL} as a from pg), ins as (select *, regexp_replace(a, '^/(\\.\\./)+', '/') as i from nm)"
DB_SQL = "(starts_with(a, '/game/local/database/') or (i <> a and starts_with(i, '/game/local/database/')))"


@query(
    f"""with {NORMALS_SQL}
select path, 'shop-demo' as profile, 0 as signature from ins where {DB_SQL}
union all select path, 'shop-demo', 1 from ins where contains(a, '/npc/')
union all select path, 'shop-demo', 2 from ins where ends_with(a, '/never')
union all select path, 'other-demo', 0 from ins where a = '/nothing/here'"""
)
def matcher_eval(spark, sf_dir):
    return rules.matcher_hits(_paths(spark, sf_dir), rules.signature_table(spark, RULES)).select("path", "profile", "signature")


@query(
    f"""with {NORMALS_SQL}
select path, case when {DB_SQL} and ends_with(a, '/item') then 'item' when contains(a, '/text/') and ends_with(a, '/en') then 'generic'
  when contains(a, '/text/') then 'text-a' when ends_with(a, '/en') then 'text-b' when {DB_SQL} then 'database' else 'generic' end as rule
from ins"""
)
def rule_priority(spark, sf_dir):
    return rules.resolve_rules(_paths(spark, sf_dir), rules.rule_table(spark, RULES))


@query(
    f"""with {NORMALS_SQL}, h as (
  select max({DB_SQL}::int) + max(contains(a, '/npc/')::int) + max(ends_with(a, '/never')::int) as m from ins
)
select 'shop-demo' as profile, m::bigint as matched, 2 as minimum, m >= 2 as qualifies from h
union all select 'other-demo', 0, 1, false"""
)
def profile_detect(spark, sf_dir):
    return rules.detect(_paths(spark, sf_dir), rules.signature_table(spark, RULES))


@query(
    """select 'pair' as group_id, count(*) filter (o_orderkey % 17 <> 0) as complete, count(*) filter (o_orderkey % 17 = 0) as partial from orders
union all select 'never', 0, count(*) filter (o_orderkey % 5 = 0) from orders"""
)
def strict_group_observation(spark, sf_dir):
    groups = [rules.FieldGroup("pair", ("day", "cents")), rules.FieldGroup("never", ("status", "ghost"))]
    r = F.col("row_id")
    present = {"day": r % 17 != 0, "cents": F.lit(True), "status": r % 5 == 0, "ghost": F.lit(False)}
    return rules.observe_groups(_orders(spark, sf_dir), groups, present)


# values


@query("select doc_id, case when length(text) > 160 then left(text, 159) || '…' else text end as preview from documents")
def preview_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", values.preview(F.col("text")).alias("preview"))


@query(
    "select event_id, event_type || case when event_id % 2 = 0 then '' when event_id % 3 = 0 then '_x' else '_' || md5(event_type) end as name from events"
)
def demangle_name(spark, sf_dir):
    e, n = F.col("event_type"), F.col("event_id")
    mangled = F.concat(e, F.lit("_"), n.cast("string"), F.lit("_"), F.md5(e))
    name = F.when(n % 2 == 0, mangled).when(n % 3 == 0, F.concat(e, F.lit("_x"))).otherwise(F.concat(e, F.lit("_"), F.md5(e)))
    return table(spark, sf_dir, "events").select("event_id", values.demangled(name).alias("name"))


@query("select event_id, case when value = floor(value) then cast(value as hugeint)::varchar end as whole, case when value * 100 = floor(value * 100) then cast(value * 100 as bigint) end as row_id from events")
def exact_int_float(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", values.exact_integer(v).cast("string").alias("whole"), values.row_id_of_float(v * 100).alias("row_id"))


@query(
    """select * from (values (0, 9007199254740991::bigint, null::bigint), (1, null, null), (2, 0, 0), (3, null, null),
  (4, 16777215, 16777215), (5, 16777216, null), (6, -3, -3)) t(n, wide, narrow)"""
)
def row_id_from_float(spark, sf_dir):
    rows = [(0, 9007199254740991.0), (1, 9007199254740992.0), (2, -0.0), (3, 1.5), (4, 16777215.0), (5, 16777216.0), (6, -3.0)]
    v = F.col("value")
    return spark.createDataFrame(rows, "n int, value double").select("n", values.row_id_of_float(v).alias("wide"), values.row_id_of_float(v, single=True).alias("narrow"))


@query(
    """select * from (values (0, '9300000000000000000'), (1, '10000000000000000000'), (2, null), (3, '9223372036854775808'), (4, '-9223372036854775808'), (5, null),
  (6, null), (7, '0'), (8, '18446744073709549568'), (9, '9007199254740993'::varchar), (10, null), (11, null)) t(n, whole) where n <> 9
  union all select 9, '9007199254740992'"""
)
def exact_int_wide(spark, sf_dir):
    """Doubles at the ends of the signed and unsigned 64-bit range."""
    rows = [9.3e18, 1e19, 2.0**64, 2.0**63, -(2.0**63), -1e19, 1.5, -0.0, 2.0**64 - 2048, 2.0**53 + 1, float("nan"), float("inf")]
    made = spark.createDataFrame(list(enumerate(rows)), "n int, value double")
    return made.select("n", values.exact_integer(F.col("value")).cast("string").alias("whole"))


#: Kind, raw text, what it stands for.
EDGE_VALUES = [
    ("integer", "007", "i:7"), ("integer", "+7", "i:7"), ("integer", "-0", "i:0"), ("integer", "abc", "s:abc"), ("integer", "xyz", "s:xyz"), ("integer", "1.4", "s:1.4"), ("integer", "", "s:"),
    ("integer", " 1", "s: 1"), ("integer", None, None), ("float", "1", "i:1"), ("float", "1.0", "i:1"), ("float", "1e3", "i:1000"), ("float", "-0.0", "i:0"), ("float", "1.5", "f:1.5"),
    ("float", "NaN", "f:nan"), ("float", "abc", "s:abc"), ("float", "1d", "s:1d"), ("float", None, None), ("boolean", "TRUE", "b:true"), ("boolean", "false", "b:false"), ("boolean", "yes", "s:yes"),
    ("boolean", "1", "s:1"), ("text", "007", "s:007"), ("text", "", "s:"), ("text", None, None),
]


@query(
    "select * from (values "
    + ", ".join(f"('{k}', {'null' if r is None else repr(r)}, {'null' if c is None else repr(c)})" for k, r, c in EDGE_VALUES)
    + ") t(kind, raw, canonical)"
)
def canonical_edge_values(spark, sf_dir):
    made = spark.createDataFrame([(k, r) for k, r, _ in EDGE_VALUES], "kind string, raw string")
    kind, raw = F.col("kind"), F.col("raw")
    by_kind = F.when(kind == "integer", values.canonical(raw, "integer")).when(kind == "float", values.canonical(raw, "float"))
    by_kind = by_kind.when(kind == "boolean", values.canonical(raw, "boolean")).otherwise(values.canonical(raw, "text"))
    return made.select("kind", "raw", by_kind.alias("canonical"))


@query(
    f"with {P_SQL}, twice as (select * from p union all select * from p where input_index = 1 and row_id % 1000 = 0) "
    "select input_index, row_id, count(*) as copies from twice group by 1, 2 having count(*) > 1"
)
def duplicate_key_guard(spark, sf_dir):
    """What an analysis refuses: keys that one input has more than once."""
    rows = overlays(spark, sf_dir)
    twice = rows.unionByName(rows.where((F.col("input_index") == 1) & (F.col("row_id") % 1000 == 0)))
    return align.duplicate_keys(twice, "input_index", "row_id")


# sources and sinks: what was written, read again


@query()
def msgpack_roundtrip(spark, sf_dir):
    from strataweave.sources import msgpack_rows

    rows = _orders(spark, sf_dir).select(F.concat(F.lit("part-"), F.floor(F.col("row_id") / 50000).cast("string")).alias("asset"), F.col("row_id").alias("row_pos"), "row_id", "cents", "status")
    packed = rows.mapInArrow(_pack_orders, "asset string, row_pos long, raw binary")
    files = msgpack_rows.write_tables(packed)
    back = msgpack_rows.read_tables(files)
    value = lambda name: F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))["value"]
    return back.select("asset", "row_id", value("cents").cast("long").alias("cents"), value("status").alias("status"))


@query(f"with {P_SQL} select 'part-' || (row_id // 50000) as asset, row_number() over (partition by row_id // 50000 order by row_id) - 1 as row_pos, 'r' || row_id as row_name, cents, status, priority from o")
def ue_table_roundtrip(spark, sf_dir):
    """Orders written as packages of tagged properties, of 50,000 rows at most, and read again."""
    from strataweave.sources import tagged_rows

    files = tagged_rows.write_tables(_named_orders(_orders(spark, sf_dir), F.floor(F.col("row_id") / 50000).cast("string")))
    back = tagged_rows.read_tables(files)
    return back.select("asset", "row_pos", "row_name", _tagged("cents").cast("long").alias("cents"), _tagged("status").alias("status"), _tagged("priority").alias("priority"))


def _tagged(name):
    return F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))["value"]


def _named_orders(rows, part, *kept):
    field = lambda name, kind: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.col(name).cast("string").alias("value"))
    fields = F.array(field("cents", "Int64Property"), field("status", "NameProperty"), field("priority", "StrProperty"))
    return rows.select(*kept, F.concat(F.lit("part-"), part).alias("asset"), "row_pos", F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("row_name"), fields.alias("fields"))


@query(
    f"""with {P_SQL}, n as (
  select input_index, 'r' || row_id as row_name, unnest([('field:cents', cents::varchar), ('field:status', status), ('field:priority', priority)]) as u from p
), d as (
  select row_name, u[1] as unit_id, count(*) as n_variants, min(input_index) as first, min(u[2]) <> max(u[2]) as differs from n group by 1, 2
), w as (
  select 'r' || row_id as row_name, count(*) as n_variants, min(input_index) as first, min(concat_ws('|', cents, status, priority)) <> max(concat_ws('|', cents, status, priority)) as differs from p group by 1
)
select row_name, unit_id, 'FIELD_VALUE' as kind, n_variants from d where first = 0 and differs
union all select row_name, '__whole_row__', 'ATOMIC_GROUP', n_variants from w where first > 0 and differs"""
)
def name_table_merge(spark, sf_dir):
    """Conflicts of three tables by row name, each written as packages and read again.

    Plain rows move once, to the task that writes the packages of their group,
    reads them and compares them; fields are made after that.
    """
    from strataweave.plans import archives
    from strataweave.sources import tagged_rows

    group = F.floor(F.col("row_id") / 50000).cast("string")
    plain = overlays(spark, sf_dir).select("input_index", "row_id", "cents", "status", "priority", group.alias("group_key"))
    met = plain.repartition("group_key").sortWithinPartitions("group_key").withColumn("row_pos", F.col("row_id"))
    part = F.concat(F.col("input_index").cast("string"), F.lit("-"), F.col("group_key"))
    found = tagged_rows.differing_rows(_named_orders(met, part, "group_key", "input_index"))
    row = F.struct("group_key", F.lit(0).alias("row_id"), "row_name").alias("row")
    rows = found.select(row, "held", F.array().cast("array<struct<id:string,fields:array<string>>>").alias("groups"))
    return archives.held_conflicts(rows).select("row.row_name", "unit_id", "kind", "n_variants")


def _pack_orders(batches):
    import pyarrow as pa

    from strataweave.sources.msgpack_rows import pack_value

    for batch in batches:
        rows = batch.to_pylist()
        raw = [pack_value({"m_id": r["row_id"], "cents": r["cents"], "status": r["status"]}) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("asset"), batch.column("row_pos"), pa.array(raw, pa.binary())], ["asset", "row_pos", "raw"])


SQL["msgpack_roundtrip"] = (
    f"with {P_SQL} select 'part-' || (row_id // 50000) as asset, row_id, cents, status from o"
)


@query(f"with {DOC_SQL} select path, size, sha256 from g where input_index = 0")
def archive_roundtrip(spark, sf_dir):
    from strataweave.sources import archive
    from strataweave.sources.folders import new_folder

    archive.register(spark)
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    folder = new_folder(spark, "archive")
    rows = docs.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    archive.split(rows).write.format("overlay_archive").option("parts", "true").mode("append").save(folder)
    return spark.read.format("overlay_archive").load(folder).select("path", F.col("logical").alias("size"), "sha256")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
