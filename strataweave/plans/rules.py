"""Merge rules: profiles declared in JSON, their validation, detection and resolution."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions.paths import asset_path, matches
from strataweave.operators.units import PARALLEL_ITEMS, WHOLE_FIELDS

SCHEMA_VERSION = 1
#: What a profile may hold at most.
MOST = {"profiles": 64, "matchers": 32, "assets": 512, "groups": 128, "fields": 64}
KINDS = ("exact", "prefix", "suffix", "contains")
GENERIC = "generic"
_PROFILE_KEYS = {"schemaVersion", "id", "displayName", "format", "detection", "assets"}
_DETECTION_KEYS = {"minimumMatches", "pathMatchers", "rootScopeMatchers"}
_ASSET_KEYS = {"id", "pathMatchers", "priority", "fieldGroups"}
_GROUP_KEYS = {"id", "fields", "mode"}
_MATCHER_KEYS = {"kind", "value"}


class ProfileError(ValueError):
    """A profile that breaks a rule of its format."""


@dataclass(frozen=True)
class Matcher:
    kind: str
    value: str


@dataclass(frozen=True)
class FieldGroup:
    id: str
    fields: tuple[str, ...]
    mode: str = WHOLE_FIELDS


@dataclass(frozen=True)
class AssetRule:
    id: str
    matchers: tuple[Matcher, ...]
    priority: int = 0
    groups: tuple[FieldGroup, ...] = ()


@dataclass(frozen=True)
class Profile:
    id: str
    name: str
    format: str
    minimum: int
    signatures: tuple[Matcher, ...]
    scopes: tuple[Matcher, ...] = ()
    assets: tuple[AssetRule, ...] = field(default_factory=tuple)


def _known(value: Mapping, keys: set[str], where: str) -> Mapping:
    if not isinstance(value, Mapping):
        raise ProfileError(f"{where} must be an object")
    if unknown := set(value) - keys:
        raise ProfileError(f"{where} has unknown keys {sorted(unknown)}")
    return value


def _matchers(values, where: str) -> tuple[Matcher, ...]:
    found = tuple(Matcher(v["kind"], v["value"]) for v in (_known(x, _MATCHER_KEYS, where) for x in values))
    if len(found) > MOST["matchers"]:
        raise ProfileError(f"{where} has over {MOST['matchers']} matchers")
    for m in found:
        if m.kind not in KINDS or not m.value:
            raise ProfileError(f"{where} has the unknown or empty matcher {m}")
    return found


def parse_profile(text: str) -> Profile:
    """A profile from its JSON; unknown keys and versions are refused."""
    raw = _known(json.loads(text), _PROFILE_KEYS, "profile")
    if raw.get("schemaVersion") != SCHEMA_VERSION:
        raise ProfileError(f"schemaVersion must be {SCHEMA_VERSION}")
    detection = _known(raw.get("detection", {}), _DETECTION_KEYS, "detection")
    assets = []
    for a in raw.get("assets", []):
        _known(a, _ASSET_KEYS, "asset")
        groups = tuple(FieldGroup(g["id"], tuple(g["fields"]), g.get("mode", WHOLE_FIELDS)) for g in (_known(x, _GROUP_KEYS, "group") for x in a.get("fieldGroups", [])))
        assets.append(AssetRule(a["id"], _matchers(a.get("pathMatchers", []), a["id"]), a.get("priority", 0), groups))
    profile = Profile(
        raw["id"],
        raw.get("displayName", raw["id"]),
        raw.get("format", ""),
        detection.get("minimumMatches", 1),
        _matchers(detection.get("pathMatchers", []), "detection"),
        _matchers(detection.get("rootScopeMatchers", []), "scope"),
        tuple(assets),
    )
    validate(profile)
    return profile


def validate(profile: Profile, key: str | None = None) -> None:
    """Raises ProfileError for repeated ids, too many parts, overlapping groups or a group with the key."""
    if not profile.id or not all(c.isalnum() or c in "-_." for c in profile.id):
        raise ProfileError(f"profile id {profile.id!r}")
    if len(profile.assets) > MOST["assets"]:
        raise ProfileError(f"over {MOST['assets']} asset rules")
    if not 1 <= profile.minimum <= max(1, len(profile.signatures)):
        raise ProfileError("minimumMatches must be between 1 and the number of matchers")
    if len({a.id for a in profile.assets}) < len(profile.assets):
        raise ProfileError("asset ids repeat")
    if len({frozenset(a.matchers) for a in profile.assets}) < len(profile.assets):
        raise ProfileError("two asset rules have the same matchers")
    for a in profile.assets:
        if not a.matchers:
            raise ProfileError(f"{a.id} has no matcher")
        if len(a.groups) > MOST["groups"]:
            raise ProfileError(f"{a.id} has over {MOST['groups']} groups")
        used: set[str] = set()
        for g in a.groups:
            if not 1 <= len(g.fields) <= MOST["fields"] or len(set(g.fields)) < len(g.fields):
                raise ProfileError(f"{a.id}/{g.id} has no, repeated or too many fields")
            if g.mode not in (WHOLE_FIELDS, PARALLEL_ITEMS):
                raise ProfileError(f"{a.id}/{g.id} has the unknown mode {g.mode}")
            if used & set(g.fields) or key in g.fields:
                raise ProfileError(f"{a.id}/{g.id} has the key or a field of another group")
            used |= set(g.fields)
        if len({g.id for g in a.groups}) < len(a.groups):
            raise ProfileError(f"group ids of {a.id} repeat")


def read_profiles(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> list[Profile]:
    """Profiles of JSON files; a registry holds 64 at most, each of at most ``most_bytes``. More, or larger ones, raise ProfileError."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    large = files.where(F.col("length") > most_bytes).select("path").limit(1).collect()
    if large:
        raise ProfileError(f"over {most_bytes} bytes: {large[0].path}")
    rows = files.where(F.col("length") <= most_bytes).limit(MOST["profiles"] + 1).collect()
    if len(rows) > MOST["profiles"]:
        raise ProfileError(f"over {MOST['profiles']} profiles")
    found = [parse_profile(bytes(r.content).decode()) for r in sorted(rows, key=lambda r: r.path)]
    if len({p.id for p in found}) < len(found):
        raise ProfileError("profile ids repeat")
    return found


def rule_table(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """profile, rule, priority, matchers: at most 64 x 512 rows."""
    rows = [(p.id, a.id, a.priority, [(m.kind, m.value) for m in a.matchers]) for p in profiles for a in p.assets]
    return spark.createDataFrame(rows, "profile string, rule string, priority int, matchers array<struct<kind:string,value:string>>")


def signature_table(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    rows = [(p.id, p.minimum, n, m.kind, m.value) for p in profiles for n, m in enumerate(p.signatures)]
    return spark.createDataFrame(rows, "profile string, minimum int, signature int, kind string, value string")


def matcher_hits(paths: DataFrame, matchers: DataFrame) -> DataFrame:
    """Paths (path) with each matcher (kind, value, ...) that they meet. Matchers are few: at most 64 x 544 rows."""
    normal = paths.select("path", asset_path(F.col("path")).alias("asset_path"))
    return normal.join(F.broadcast(matchers), matches(F.col("asset_path"), F.col("kind"), F.col("value")))


def all_match(path: Column, matchers: Column) -> Column:
    return (F.size(matchers) > 0) & F.forall(matchers, lambda m: matches(path, m.kind, m.value))


def resolve_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, rule: the rule of the highest priority of which all matchers hold; none or a tie gives ``generic``.

    The rules are an array beside each path, not a join condition: in a new session Spark takes a condition with
    a function over ``matchers`` for one of the rules alone and filters them without the path.
    """
    normal = paths.select("path").distinct().select("path", asset_path(F.col("path")).alias("asset_path"))
    every = rules.agg(F.collect_list(F.struct("priority", "rule", "matchers")).alias("rules"))  # one row, of at most 64 x 512 rules
    met = normal.crossJoin(F.broadcast(every)).select("path", F.filter("rules", lambda r: all_match(F.col("asset_path"), r.matchers)).alias("met"))
    leaders = F.filter("met", lambda r: r.priority == F.array_max("met.priority"))
    return met.select("path", F.when(F.size(leaders) == 1, F.get(leaders, F.lit(0)).rule).otherwise(GENERIC).alias("rule"))


def detect(paths: DataFrame, signatures: DataFrame) -> DataFrame:
    """profile, matched, minimum, qualifies: distinct signatures that some path meets."""
    hits = matcher_hits(paths, signatures).groupBy("profile").agg(F.count_distinct("signature").alias("matched"))
    every = signatures.groupBy("profile").agg(F.max("minimum").alias("minimum"))
    out = every.join(hits, "profile", "left").select("profile", F.coalesce("matched", F.lit(0)).alias("matched"), "minimum")
    return out.withColumn("qualifies", F.col("matched") >= F.col("minimum"))


def selected_profile(detected: DataFrame) -> str:
    """The one profile that qualifies; none or several give ``generic``."""
    found = [r.profile for r in detected.where("qualifies").limit(2).collect()]
    return found[0] if len(found) == 1 else GENERIC


def observe_groups(rows: DataFrame, groups: Sequence[FieldGroup], present: Mapping[str, Column]) -> DataFrame:
    """group_id, complete, partial: rows with all, and with some but not all, fields of each group.

    A partial group is an error at once, one that is never complete at the end.
    """
    made = []
    for g in groups:
        count = sum((present[f].cast("int") for f in g.fields), F.lit(0))
        made.append(F.struct(F.lit(g.id).alias("group_id"), (count == len(g.fields)).alias("all"), ((count > 0) & (count < len(g.fields))).alias("some")))
    return rows.select(F.inline(F.array(*made))).groupBy("group_id").agg(F.count_if("all").alias("complete"), F.count_if("some").alias("partial"))


def top_by_priority(met: DataFrame, key: str) -> DataFrame:
    """Rows of the highest priority of each key, with how many there are."""
    rank = F.rank().over(Window.partitionBy(key).orderBy(F.col("priority").desc()))
    return met.withColumn("rank", rank).where("rank = 1").drop("rank")
