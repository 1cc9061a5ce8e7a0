"""Canonical values: what two spellings of one value share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS = 160
ELLIPSIS = "…"


def exact_integer(x: Column) -> Column:
    """The integer that a double is exactly, within the signed and unsigned 64-bit range; else null."""
    # floor gives a long, and a cast to decimal goes by the shortest digits: both halves are exact instead
    half = F.lit(4294967296.0)
    whole = (x == F.rint(x)) & (x >= F.lit(-9223372036854775808.0)) & (x < F.lit(18446744073709551616.0))
    high = F.floor(x / half)
    low = (x - high * half).cast("long")
    exact = high.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    return F.when(whole & ~F.isnan(x), exact.cast("decimal(38,0)"))


def row_id_of_float(x: Column, *, single: bool = False) -> Column:
    """A row id held as a float: only while every integer of that size is exact; -0.0 is 0."""
    most = float(2**24 - 1 if single else 2**53 - 1)
    return F.when((F.abs(x) <= most) & (x == F.floor(x)), x.cast("long"))


_INTEGER = r"\A[+-]?[0-9]{1,38}\z"
_FLOAT = r"(?i)\A[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?\z|\A[+-]?(nan|inf|infinity)\z"
_BOOLEAN = r"(?i)\A(true|false)\z"


def canonical(raw: Column, kind: str) -> Column:
    """Canonical text of a raw text: integers and integral floats share one, NaN and zero have one each.

    A text that isn't of its kind stands for itself alone, as text; null stays null.
    """
    text = F.concat(F.lit("s:"), raw)
    if kind == "integer":
        # most are canonical already: a long that prints as it reads needs neither pattern nor decimal
        short = raw.try_cast("long").cast("string") == raw
        return F.when(short, F.concat(F.lit("i:"), raw)).when(raw.rlike(_INTEGER), F.concat(F.lit("i:"), raw.try_cast("decimal(38,0)").cast("string"))).otherwise(text)
    if kind == "float":
        x = raw.try_cast("double")
        whole = exact_integer(x)
        value = (
            F.when(F.isnan(x), F.lit("f:nan"))
            .when(whole.isNotNull(), F.concat(F.lit("i:"), whole.cast("string")))
            .otherwise(F.concat(F.lit("f:"), x.cast("string")))
        )
        return F.when(raw.rlike(_FLOAT), value).otherwise(text)
    if kind == "boolean":
        return F.when(raw.rlike(_BOOLEAN), F.concat(F.lit("b:"), F.lower(raw))).otherwise(text)
    return text


def preview(text: Column, most: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit(ELLIPSIS))).otherwise(text)


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cntrl}", " ")


def demangled(name: Column) -> Column:
    """A property name without a trailing ``_<number>_<32 hexadecimal digits>``."""
    return F.regexp_replace(name, r"(?s)_[0-9]+_[0-9A-Fa-f]{32}\z", "")


def refers(name: Column) -> Column:
    """Whether a name can refer to a row: it isn't empty, ``None``, a qualified name or a path."""
    return (name != "") & (name != "None") & ~name.contains("::") & ~name.startswith("/")


def name_references(names: Column) -> Column:
    """Names that can refer to a row."""
    return F.filter(names, refers)


def positive(values: Column) -> Column:
    """The integers above zero of a (nested) array of integers."""
    return F.filter(values, lambda x: x > 0)
