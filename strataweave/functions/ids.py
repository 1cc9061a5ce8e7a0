"""Identifiers and digests over length-framed parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own domain tags.
CONFLICT, VARIANT, PLAN, GROUP, UNIT = "sw/conflict/1", "sw/variant/1", "sw/plan/1", "sw/group/1", "sw/unit/1"


def framed(text: Column) -> Column:
    """A part with its length in eight bytes before it, so that parts can't run into each other."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    # a length below 128 is one ASCII character after seven zero bytes; hexadecimal digits cost several times that
    wide = F.unhex(F.lpad(F.hex(size.cast("long")), 16, "0"))
    return F.concat(F.when(size < 128, F.concat(F.lit(bytes(7)), F.char(size).cast("binary"))).otherwise(wide), data)


def distinct_text(values: Sequence[Column]) -> Column:
    """One text of several, different for different values; nulls differ from empty texts."""
    return F.concat(*[F.coalesce(F.concat(F.lit("="), F.length(v), F.lit(":"), v), F.lit("-")) for v in values])


def framed_array(texts: Column) -> Column:
    """The framed parts of an array, one after the other, as hexadecimal text."""
    return F.array_join(F.transform(texts, lambda t: F.hex(framed(t))), "")


def stable_id(prefix: str, tag: str, *parts: Column) -> Column:
    """``prefix-`` and a SHA-256 over the tag and the parts."""
    data = F.concat(F.lit(tag).cast("binary"), *[framed(p) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.sha2(data, 256))


def stable_id_of(prefix: str, tag: str, texts: Column) -> Column:
    """The same over an array of parts."""
    data = F.concat(F.lit(tag).cast("binary"), F.unhex(framed_array(texts)))
    return F.concat(F.lit(prefix + "-"), F.sha2(data, 256))


def raw_hash(data: Column) -> Column:
    """SHA-256 of exact bytes in upper case (identifiers are lower case)."""
    return F.upper(F.sha2(data.cast("binary"), 256))
