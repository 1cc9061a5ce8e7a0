"""Path expressions: keys, normal forms, validation, package components, matchers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four components of a package.
COMPONENTS = (".uasset", ".uexp", ".ubulk", ".uptnl")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def path_key(path: Column) -> Column:
    """The key that aligns inputs: forward slashes, lower case."""
    return F.lower(F.translate(path, "\\", "/"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def asset_path(path: Column) -> Column:
    """The form that matchers see: rooted, ASCII lower case, without component suffix."""
    plain = F.regexp_replace(ascii_lower(F.translate(path, "\\", "/")), "/{2,}", "/")
    plain = F.regexp_replace(plain, r"(?s)\.(uasset|uexp|ubulk|uptnl)\z", "")
    return F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))


def entry_path_error(path: Column) -> Column:
    """Why an entry path is refused; null if it is sound."""
    parts = F.split(path, "/", -1)
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(path.rlike(r"\A[/\\]"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike(r"\p{Cntrl}"), "control")
        .when(path.contains(":"), "colon")
        .when(F.exists(parts, lambda p: p == ""), "empty part")
        .when(F.exists(parts, lambda p: p.isin(".", "..")), "dots")
    )


def mount_error(mount: Column) -> Column:
    """Why a mount is refused; ``..`` may come before the first named part only."""
    parts = F.filter(F.split(mount, "/", -1), lambda p: p != "")
    named = F.aggregate(
        parts,
        F.struct(F.lit(False).alias("named"), F.lit(False).alias("bad")),
        lambda s, p: F.struct((s.named | (p != "..")).alias("named"), (s.bad | (s.named & (p == "..")) | (p == ".")).alias("bad")),
    )
    return (
        F.when(F.coalesce(mount, F.lit("")) == "", "empty")
        .when(mount.rlike(r"\A[/\\]"), "absolute")
        .when(mount.contains("\\") | mount.rlike(r"\p{Cntrl}"), "control")
        .when(F.substring_index(mount, "/", 1).contains(":"), "colon")
        .when(mount.contains("//"), "empty part")
        .when(named.bad, "dots")
    )


def mount_path(mount: Column) -> Column:
    return F.when(mount.endswith("/"), mount).otherwise(F.concat(mount, F.lit("/")))


def mount_parts(mount: Column) -> Column:
    return F.filter(F.split(mount, "/", -1), lambda p: p != "")


def component(path: Column) -> Column:
    """The component suffix of a path in lower case; null for a loose file."""
    return F.nullif(F.regexp_extract(F.lower(path), r"(?s)[^/](\.(?:uasset|uexp|ubulk|uptnl))\z", 1), F.lit(""))


def package_stem(path: Column) -> Column:
    """A path without its component suffix."""
    suffix = component(path)
    return F.when(suffix.isNull(), path).otherwise(F.substring(path, F.lit(1), F.length(path) - F.length(suffix)))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def matches(path: Column, kind: Column, value: Column) -> Column:
    """Whether a normal asset path meets a matcher; prefixes also hold after leading ``../``."""
    inner = F.regexp_replace(path, r"\A/(?:\.\./)+", "/")
    return (
        F.when(kind == "exact", path == value)
        .when(kind == "prefix", path.startswith(value) | ((inner != path) & value.startswith("/") & inner.startswith(value)))
        .when(kind == "suffix", path.endswith(value))
        .when(kind == "contains", path.contains(value))
        .otherwise(F.lit(False))
    )
