"""Row tables of tagged properties: a package header and its payload to rows.

The header lists names and imports; the payload is one block with the row
structure, a zero, the number of rows, and each row as its name and a block of
tagged properties. Values are decoded to canonical text as they are walked,
names and imports resolved, so that rows compare by meaning whatever the order
of a package's tables.

A field's ``raw`` is its portable form: the places of name and import indexes
with what they name, then its bytes with zeros there. It is equal exactly if
the fields mean the same, and ``build_table`` puts it into any package that has
the imports, adding names as needed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache, lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed values of the format.
TAG, LEGACY_VERSION, EDITOR_ONLY_FILTERED = 0x9E2A83C1, -7, 0x80000000
NAME_CRC = 0x04C11DB7  # polynomial of the older of a name's two hashes
IMPORT_BYTES, EXPORT_BYTES = 28, 104
SIZE_AT, OFFSET_AT = 28, 36  # of the one export's payload, in its record
MOST_ROWS, MOST_DEPTH = 4_000_000, 32
NUMBERS = {
    "Int8Property": "b", "Int16Property": "h", "UInt16Property": "H", "IntProperty": "i", "UInt32Property": "I",
    "FloatProperty": "f", "Int64Property": "q", "UInt64Property": "Q", "DoubleProperty": "d",
}
PLAIN_STRUCTS = {
    "Vector": 12, "Rotator": 12, "IntVector": 12, "Vector2D": 8, "IntPoint": 8, "Vector4": 16, "Quat": 16, "LinearColor": 16,
    "Plane": 16, "IntRect": 16, "Color": 4, "FrameNumber": 4, "Guid": 16, "Timespan": 8, "DateTime": 8, "Box2D": 17, "Box": 25,
    "TwoVectors": 24, "Matrix": 64,
}
PATH_STRUCTS = ("SoftObjectPath", "SoftClassPath", "StringAssetReference", "StringClassReference")

ROWS = "asset string, row_pos long, row_name string, fields array<struct<name:string,type:string,value:string,refs:array<string>,raw:binary>>"
_FIELD = pa.struct([("name", pa.string()), ("type", pa.string()), ("value", pa.string()), ("refs", pa.list_(pa.string())), ("raw", pa.binary())])
_ARROW = pa.schema([("asset", pa.string()), ("row_pos", pa.int64()), ("row_name", pa.string()), ("fields", pa.list_(_FIELD))])


class TaggedError(ValueError):
    """Bytes that aren't such a table, or use what isn't read."""


_NAME, _IMPORT = 0, 1
_SITE = struct.Struct("<IBI")
_FORMS = {form: struct.Struct("<" + form) for form in "bBhHiIfqQd"}
_INT, _COUNT, _FLAG, _PAIR, _NO_INDEX = _FORMS["i"], _FORMS["I"], _FORMS["B"], struct.Struct("<ii"), bytes(4)


@lru_cache(maxsize=4096)
def _site(at: int, kind: int, what: str) -> bytes:
    text = what.encode()
    return _SITE.pack(at, kind, len(text)) + text


class _Walk:
    """A position in bytes, with what every value is made of."""

    def __init__(self, data: bytes, at: int = 0, names: list[str] | None = None) -> None:
        self.data, self.at, self.names = data, at, names or []
        self.refs: list[str] = []
        self.sites: list[tuple[int, int, str]] = []  # place, _NAME or _IMPORT, what it names

    def bytes(self, n: int) -> bytes:
        at = self.at
        if n < 0 or at + n > len(self.data):
            raise TaggedError("the data ends inside a value")
        self.at = at + n
        return self.data[at : at + n]

    def unpack(self, form: struct.Struct) -> tuple:
        at = self.at
        if at + form.size > len(self.data):
            raise TaggedError("the data ends inside a value")
        self.at = at + form.size
        return form.unpack_from(self.data, at)

    def number(self, form: str):
        return self.unpack(_FORMS[form])[0]

    def text(self) -> str:
        n = self.unpack(_INT)[0]
        return (self.bytes(-2 * n).decode("utf-16-le") if n < 0 else self.bytes(n).decode("latin-1")).removesuffix("\0")

    def name(self) -> str:
        index, instance = self.unpack(_PAIR)
        if not 0 <= index < len(self.names):
            raise TaggedError(f"there is no name {index}")
        name = self.names[index]
        self.sites.append((self.at - 8, _NAME, name))
        return f"{name}_{instance - 1}" if instance else name

    def reference(self) -> str:
        self.refs.append(self.name())
        return self.refs[-1]

    def target(self, p: Package) -> str:
        index = self.number("i")
        if index < 0:
            self.sites.append((self.at - 4, _IMPORT, p.target(index)))
        return p.target(index)

    def portable(self, begin: int, first_site: int) -> bytes:
        """What was read since ``begin``, whatever the order of the package's names and imports."""
        data, places = bytearray(self.data[begin : self.at]), [_COUNT.pack(len(self.sites) - first_site)]
        for at, kind, what in self.sites[first_site:]:
            at -= begin
            data[at : at + 4] = _NO_INDEX
            places.append(_site(at, kind, what))
        return b"".join([*places, data])


class Package:
    """Names, imports, the payload's size and the offsets of a header with one export."""

    def __init__(self, data: bytes) -> None:
        w = _Walk(data)
        if w.number("I") != TAG or w.number("i") != LEGACY_VERSION or w.bytes(16) != b"\0" * 16:
            raise TaggedError("not an unversioned package")
        if w.number("I") != len(data):
            raise TaggedError("the header's size is wrong")
        self.folder = w.text()
        flags, self.n_names_at, n_names, names_at = w.number("I"), w.at, w.number("i"), w.number("i")
        if not flags & EDITOR_ONLY_FILTERED:
            w.text()
        w.bytes(4)
        self.offsets = [w.at]  # of the fields that hold places after the names
        w.bytes(4)
        n_exports = w.number("i")
        self.offsets.append(w.at)
        exports_at, n_imports = w.number("i"), w.number("i")
        self.offsets.append(w.at)
        imports_at, self.rest_at = w.number("i"), w.at
        if n_exports != 1 or not 0 <= exports_at <= len(data) - EXPORT_BYTES:
            raise TaggedError("a package needs one export")
        w.at = names_at
        self.names = []
        for _ in range(n_names):
            self.names.append(w.text())
            w.bytes(4)  # hashes
        self.names_end, self.exports_at = w.at, exports_at
        w = _Walk(data, imports_at, self.names)
        found = []
        for _ in range(n_imports):
            package, kind, outer, name = w.name(), w.name(), w.number("i"), w.name()
            found.append((outer, f"{package}/{kind}/{name}"))
        self.imports = [_within(found, n) for n in range(n_imports)]
        w.at = exports_at
        self.export_class = self.target(w.number("i"))
        w.at = exports_at + 16
        self.export_name = w.name()
        self.payload_size = struct.unpack_from("<q", data, exports_at + SIZE_AT)[0]
        self.payload_offset = struct.unpack_from("<q", data, exports_at + OFFSET_AT)[0]

    def target(self, index: int) -> str:
        """What a package index names: an import by its identity, the export, or nothing."""
        if index < 0:
            if -index > len(self.imports):
                raise TaggedError(f"there is no import {index}")
            return self.imports[-index - 1]
        return "export" if index else "none"

    def extended(self, data: bytes, names: Sequence[str], payload_size: int) -> bytes:
        """The header with further names, all places after them moved, for a payload of another size."""
        w = _Walk(data, self.rest_at)
        offsets = [*self.offsets, w.at]
        w.bytes(8)
        offsets += [w.at, w.at + 4, w.at + 8]
        w.bytes(12 + 16)
        w.bytes(8 * w.number("i"))  # generations
        for _ in range(2):  # engine versions
            w.bytes(10)
            w.text()
        if w.number("I") or w.number("i"):
            raise TaggedError("compressed packages aren't written")
        w.bytes(4)
        if w.number("i"):
            raise TaggedError("packages to cook aren't written")
        bulk_at = w.at + 4
        offsets += [w.at, bulk_at + 8]
        w.at = bulk_at + 12
        w.bytes(4 * w.number("i"))
        w.bytes(4)
        offsets.append(w.at)
        w.bytes(4)
        if w.at > self.names_end or self.exports_at < self.names_end:
            raise TaggedError("the names aren't between summary and tables")
        added = b"".join(_name_entry(n) for n in names)
        out = bytearray(data[: self.names_end] + added + data[self.names_end :])
        for at in offsets:
            value = struct.unpack_from("<i", out, at)[0]
            if value >= self.names_end:
                struct.pack_into("<i", out, at, value + len(added))
        struct.pack_into("<I", out, _TOTAL_AT, len(out))
        struct.pack_into("<i", out, self.n_names_at, len(self.names) + len(names))
        struct.pack_into("<qq", out, self.exports_at + len(added) + SIZE_AT, payload_size, len(out))
        struct.pack_into("<q", out, bulk_at, len(out) + payload_size)
        return bytes(out)


_TOTAL_AT = 24  # of the header's size


def _within(imports: list[tuple[int, str]], n: int) -> str:
    """An import's identity: its class and name, and those of what it lies in."""
    parts: list[str] = []
    while len(parts) <= len(imports):
        outer, own = imports[n]
        parts.append(own)
        if outer >= 0:
            return " in ".join(parts)
        if -outer > len(imports):
            break
        n = -outer - 1
    raise TaggedError("an import lies in none or in itself")


@cache
def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        value = n << 24
        for _ in range(8):
            value = (value << 1 ^ (NAME_CRC if value >> 31 else 0)) & 0xFFFFFFFF
        table.append(value)
    return table


def _string(text: str) -> bytes:
    if text.isascii():
        return struct.pack("<i", len(text) + 1) + text.encode() + b"\0"
    wide = text.encode("utf-16-le") + b"\0\0"
    return struct.pack("<i", -len(wide) // 2) + wide


def _name_entry(text: str) -> bytes:
    """A name and its two hashes: an old checksum of the upper case, and CRC-32 of the code points."""
    table, older = _crc_table(), 0
    upper = text.upper()
    for byte in upper.encode() if text.isascii() else upper.encode("utf-16-le"):
        older = older >> 8 ^ table[(older ^ byte) & 255]
    return _string(text) + struct.pack("<HH", older & 0xFFFF, zlib.crc32(text.encode("utf-32-le")) & 0xFFFF)


def _text(w: _Walk) -> str:
    w.bytes(4)
    history = w.number("b")
    if history == -1:
        return w.text() if w.number("i") else ""
    if history == 0:
        return "|".join((w.text(), w.text(), w.text()))
    raise TaggedError(f"text history {history} isn't read")


def _number(form: str) -> Callable:
    one = _FORMS[form]

    def whole(w: _Walk, p: Package) -> str:
        return repr(w.unpack(one)[0])

    def real(w: _Walk, p: Package) -> str:
        value = w.unpack(one)[0]
        return str(int(value)) if value == value and abs(value) < 2**63 and value == int(value) else repr(value)

    return real if form in "fd" else whole


#: Values that are read alike in tags and in containers.
_VALUES: dict[str, Callable[[_Walk, Package], str]] = {
    **{kind: _number(form) for kind, form in NUMBERS.items()},
    **dict.fromkeys(("NameProperty", "EnumProperty"), lambda w, p: w.reference()),
    "StrProperty": lambda w, p: w.text(),
    "TextProperty": lambda w, p: _text(w),
    **dict.fromkeys(("SoftObjectProperty", "SoftClassProperty", "AssetObjectProperty"), lambda w, p: f"{w.reference()}:{w.text()}"),
    **dict.fromkeys(("ObjectProperty", "ClassProperty", "InterfaceProperty", "LazyObjectProperty"), lambda w, p: w.target(p)),
}


def _structure(w: _Walk, p: Package, name: str, depth: int) -> str:
    if name in PLAIN_STRUCTS:
        return w.bytes(PLAIN_STRUCTS[name]).hex()
    if name in PATH_STRUCTS:
        return f"{w.reference()}:{w.text()}"
    return "{" + ",".join(f"{f['name']}={f['value']}" for f in _block(w, p, depth + 1)) + "}"


def _item(w: _Walk, p: Package, kind: str, depth: int) -> str:
    """A value inside a container, which has no tag of its own."""
    if kind == "BoolProperty":
        return str(bool(w.number("B"))).lower()
    if kind == "ByteProperty":
        return str(w.number("B"))
    if kind == "StructProperty":
        return "{" + ",".join(f"{f['name']}={f['value']}" for f in _block(w, p, depth + 1)) + "}"
    if kind not in _VALUES:
        raise TaggedError(f"{kind} isn't read in containers")
    return _VALUES[kind](w, p)


def _list(w: _Walk, p: Package, kind: str, depth: int) -> str:
    count, name = w.number("i"), ""
    if not 0 <= count <= len(w.data):
        raise TaggedError("a container's size is wrong")
    if kind == "StructProperty":  # one tag tells the structure of all items
        w.name(), w.name(), w.bytes(8)
        name = w.name()
        w.bytes(16)
        if w.number("B"):
            w.bytes(16)
    one = (lambda: _structure(w, p, name, depth)) if name else (lambda: _item(w, p, kind, depth))
    return "[" + ",".join(one() for _ in range(count)) + "]"


def _block(w: _Walk, p: Package, depth: int = 0) -> list[dict]:
    """The tagged properties up to ``None``; every value must be as long as its tag says."""
    if depth > MOST_DEPTH:
        raise TaggedError("nested too deeply")
    fields: list[dict] = []
    while (field := _field(w, p, depth)) is not None:
        fields.append(field)
    return fields


def _field(w: _Walk, p: Package, depth: int) -> dict | None:
    """The tagged property here; None after the last one."""
    begin, first_site = w.at, len(w.sites)
    if (name := w.name()) == "None":
        return None
    kind = w.name()
    size = w.unpack(_PAIR)[0]
    inner: tuple = ()
    if kind in _VALUES and kind != "EnumProperty":  # nothing more in the tag
        pass
    elif kind == "StructProperty":
        inner = (w.name(),)
        w.bytes(16)
    elif kind == "BoolProperty":
        inner = (w.number("B"),)
    elif kind in ("ByteProperty", "EnumProperty", "ArrayProperty", "SetProperty"):
        inner = (w.name(),)
    elif kind == "MapProperty":
        inner = (w.name(), w.name())
    if w.unpack(_FLAG)[0]:
        w.bytes(16)
    start, outer, w.refs = w.at, w.refs, []
    value = _tagged(w, p, kind, inner, size, depth)
    if w.at - start != size:
        raise TaggedError(f"{name} is {w.at - start} bytes long, not {size}")
    field = {"name": name, "type": kind, "value": value, "refs": w.refs, "raw": b"" if depth else w.portable(begin, first_site)}
    w.refs = outer + w.refs
    return field


def _row_fields(w: _Walk, p: Package, heads: dict[bytes, tuple], end: bytes | None) -> list[dict]:
    """A row's tagged properties; numbers, strings and names whose tags have neither flag nor instances at once.

    ``heads`` gets what the first 16 bytes of such tags say; ``end`` is what closes a row.
    """
    fields: list[dict] = []
    while True:
        begin = w.at
        if end is not None and w.data.startswith(end, begin):
            w.at += len(end)
            return fields
        head = w.data[begin : begin + 16]
        known = heads.get(head)
        if known is None and (known := _plain_head(head, w.names)) is not None:
            heads[head] = known
        if known is None or begin + 25 > len(w.data) or w.data[begin + 24]:
            if (field := _field(w, p, 0)) is None:
                return fields
            fields.append(field)
            continue
        name, kind, places = known
        w.at, w.refs = begin + 25, []
        value, at = _VALUES[kind](w, p), w.at
        size = _INT.unpack_from(w.data, begin + 16)[0]
        if at - begin - 25 != size:
            raise TaggedError(f"{name} is {at - begin - 25} bytes long, not {size}")
        if kind == "NameProperty":
            raw = (_THREE, places, _site(25, _NAME, w.sites[-1][2]), _NO_HEAD, w.data[begin + 16 : begin + 25], _NO_INDEX, w.data[begin + 29 : at])
        else:
            raw = (_TWO, places, _NO_HEAD, w.data[begin + 16 : at])
        fields.append({"name": name, "type": kind, "value": value, "refs": w.refs, "raw": b"".join(raw)})


def _plain_head(head: bytes, names: list[str]) -> tuple[str, str, bytes] | None:
    """Name, kind and the places of both in portable bytes; None where the whole tag must be read."""
    if len(head) < 16:
        return None
    name, instance, kind, other = struct.unpack("<iiii", head)
    if instance or other or not 0 <= name < len(names) or not 0 <= kind < len(names):
        return None
    name, kind = names[name], names[kind]
    if name == "None" or (kind not in NUMBERS and kind not in ("StrProperty", "NameProperty")):
        return None
    return name, kind, _site(0, _NAME, name) + _site(8, _NAME, kind)


_TWO, _THREE, _NO_HEAD = _COUNT.pack(2), _COUNT.pack(3), struct.pack("<iiii", 0, 0, 0, 0)


def _tagged(w: _Walk, p: Package, kind: str, inner: tuple, size: int, depth: int) -> str:
    if kind in _VALUES:
        return _VALUES[kind](w, p)
    if kind == "BoolProperty":
        return str(bool(inner[0])).lower()
    if kind == "ByteProperty":
        return w.reference() if size == 8 else str(w.number("B"))
    if kind == "StructProperty":
        return _structure(w, p, inner[0], depth)
    if kind == "ArrayProperty":
        return _list(w, p, inner[0], depth)
    if kind in ("SetProperty", "MapProperty"):
        if w.number("i"):
            raise TaggedError("removed container items aren't read")
        if kind == "SetProperty":
            return _list(w, p, inner[0] if inner[0] != "StructProperty" else "", depth)
        pairs = w.number("i")
        return "{" + ",".join(f"{_item(w, p, inner[0], depth)}={_item(w, p, inner[1], depth)}" for _ in range(pairs)) + "}"
    raise TaggedError(f"{kind} isn't read")


def _object(header: bytes, payload: bytes) -> tuple[Package, _Walk]:
    """The package, and a walk that stands at the number of rows."""
    p = Package(header)
    w = _Walk(payload, 0, p.names)
    if [f["name"] for f in _block(w, p)] != ["RowStruct"] or w.number("i"):
        raise TaggedError("not a table object")
    return p, w


def table_rows(header: bytes, payload: bytes) -> Iterator[tuple[int, str, bytes, list[dict]]]:
    """Position, name, portable name and fields of each row; names and a row's fields may not repeat."""
    p, w = _object(header, payload)
    count, seen, heads = w.number("i"), set(), {}
    end = _PAIR.pack(w.names.index("None"), 0) if "None" in w.names else None
    if not 0 <= count <= MOST_ROWS:
        raise TaggedError("the number of rows is wrong")
    for position in range(count):
        w.refs, w.sites = [], []
        name = w.name()
        label = w.portable(w.at - 8, 0)
        fields = _row_fields(w, p, heads, end)
        if not name or name in seen or len({f["name"] for f in fields}) < len(fields):
            raise TaggedError(f"the row {name} or one of its fields has no name or repeats")
        seen.add(name)
        yield position, name, label, fields
    if w.at != len(payload):
        raise TaggedError("bytes after the last row")


def is_table_package(header: bytes) -> bool:
    """Whether a header is of a table by names, as its export's class says."""
    try:
        return Package(header).export_class.split(" in ")[0].endswith("/DataTable")
    except (TaggedError, UnicodeDecodeError):
        return False


def shell_digest(header: bytes, payload: bytes) -> str:
    """SHA-256 over what tables must share to be merged by rows: folder, class, name and the table object."""
    p, w = _object(header, payload)
    parts = [p.folder.encode(), p.export_class.encode(), p.export_name.encode(), w.portable(0, 0)]
    return sha256(b"".join(struct.pack("<I", len(x)) + x for x in parts)).hexdigest()


def payload_of(header: bytes, content: bytes) -> bytes:
    """The payload in a file of it and the closing tag."""
    size = Package(header).payload_size
    if content[size:] != struct.pack("<I", TAG) or size < 0:
        raise TaggedError("the payload's size or the closing tag is wrong")
    return content[:size]


def _placed(raw: bytes, names: dict[str, int], imports: dict[str, int]) -> bytes:
    """Portable bytes with the indexes of a package; new names are added to it."""
    count, at = struct.unpack_from("<I", raw)[0], 4
    sites = []
    for _ in range(count):
        place, kind, size = _SITE.unpack_from(raw, at)
        at += _SITE.size + size
        what = raw[at - size : at].decode()
        if kind == _IMPORT and what not in imports:
            raise TaggedError(f"the package doesn't import {what}")
        sites.append((place, -1 - imports[what] if kind == _IMPORT else names.setdefault(what, len(names))))
    out = bytearray(raw[at:])
    for place, index in sites:
        struct.pack_into("<i", out, place, index)
    return bytes(out)


def build_table(header: bytes, payload: bytes, rows: Iterator[Sequence[bytes]] | Sequence[Sequence[bytes]]) -> tuple[bytes, bytes]:
    """Header and payload of a table like the given one with these rows: portable name, portable fields.

    Names that the package lacks are added to it; an import that it lacks raises TaggedError.
    """
    return _filled(header, payload, lambda names, imports: (b"".join([_placed(part, names, imports) for part in row]) for row in rows))


def _filled(header: bytes, payload: bytes, rows: Callable[[dict[str, int], dict[str, int]], Iterator[bytes]]) -> tuple[bytes, bytes]:
    """Header and payload with rows as ``rows`` gives them for the package's names, to which it may add, and imports."""
    p, w = _object(header, payload)
    names: dict[str, int] = {}
    for n, text in enumerate(p.names):
        names.setdefault(text, n)
    if len(names) < len(p.names):
        raise TaggedError("the package's names repeat")
    imports = {what: n for n, what in reversed(list(enumerate(p.imports)))}
    known, body = len(names), []
    for row in rows(names, imports):
        body.append(row + _PAIR.pack(names.setdefault("None", len(names)), 0))
    built = payload[: w.at] + struct.pack("<i", len(body)) + b"".join(body)
    return p.extended(header, list(names)[known:], len(built)), built


#: How values of plain kinds are written.
_WRITTEN: dict[str, Callable[[str], bytes]] = {
    **{kind: (lambda value, form=form: struct.pack("<" + form, float(value) if form in "fd" else int(value))) for kind, form in NUMBERS.items()},
    "StrProperty": _string,
}


def portable_name(text: str) -> bytes:
    """A name's portable form."""
    return struct.pack("<I", 1) + _SITE.pack(0, _NAME, len(text.encode())) + text.encode() + bytes(8)


def portable_field(name: str, kind: str, value: str) -> bytes:
    """The portable form of a number, string or name property."""
    data, sites = bytes(8), [(0, name), (8, kind)]
    if kind != "NameProperty":
        if kind not in _WRITTEN:
            raise TaggedError(f"{kind} isn't written")
        data = _WRITTEN[kind](value)
    else:
        sites.append((25, value))
    places = b"".join(_SITE.pack(at, _NAME, len(x.encode())) + x.encode() for at, x in sites)
    return struct.pack("<I", len(sites)) + places + bytes(16) + struct.pack("<ii", len(data), 0) + b"\0" + data


def empty_table(name: str, row_struct: str) -> tuple[bytes, bytes]:
    """A package of a table without rows, whose rows have the given structure."""
    names = ["None", "RowStruct", "ObjectProperty", "/Script/CoreUObject", "/Script/Engine", "Class", "ScriptStruct", "DataTable", row_struct, name]
    names = list(dict.fromkeys(names))
    index = lambda *texts: b"".join(struct.pack("<ii", names.index(x), 0) for x in texts)
    imports = index("/Script/CoreUObject", "Class") + struct.pack("<i", 0) + index("DataTable") + index("/Script/CoreUObject", "ScriptStruct") + struct.pack("<i", 0) + index(row_struct)
    payload = index("RowStruct", "ObjectProperty") + struct.pack("<ii", 4, 0) + b"\0" + struct.pack("<i", -2) + index("None") + struct.pack("<ii", 0, 0)
    export = (struct.pack("<iiii", -1, 0, 0, 0) + index(name)).ljust(EXPORT_BYTES, b"\0")
    entries = b"".join(_name_entry(n) for n in names)
    front = struct.pack("<Ii", TAG, LEGACY_VERSION) + bytes(20) + _string("None") + struct.pack("<I", EDITOR_ONLY_FILTERED)
    rest = 112  # all zero: no thumbnails, generations, chunks or preloads
    names_at = len(front) + 8 + 8 + 16 + rest
    tables_at = names_at + len(entries)
    places = struct.pack("<iiiiiiii", len(names), names_at, 0, 0, 1, tables_at + len(imports), len(imports) // IMPORT_BYTES, tables_at)
    # summaries end in engine versions whose branch is an empty string, a zero length
    header = bytearray(front + places + bytes(rest) + entries + imports + export)
    struct.pack_into("<I", header, _TOTAL_AT, len(header))
    return Package(bytes(header)).extended(bytes(header), [], len(payload)), payload


_TAG_HEAD, _NAME_TAIL, _SIZE = struct.Struct("<iiii"), struct.Struct("<iiBii"), struct.Struct("<iiB")


def _plain_rows(batch: pa.RecordBatch, names: dict[str, int]) -> Iterator[bytes]:
    """Each row's name and properties of plain kinds, with indexes of ``names``, which gets new ones."""
    fields = batch.column("fields")
    flat = fields.flatten()
    columns = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    parts = zip(*[columns[n].to_pylist() for n in ("name", "type", "value")], strict=True)
    place, heads = (lambda text: names.setdefault(text, len(names))), {}
    for row_name, count in zip(batch.column("row_name").to_pylist(), pc.list_value_length(fields).to_pylist(), strict=True):
        out = [_PAIR.pack(place(row_name), 0)]
        for name, kind, value in islice(parts, count):
            head = heads.get((name, kind))
            if head is None:
                head = heads[name, kind] = _TAG_HEAD.pack(place(name), 0, place(kind), 0)
            if kind == "NameProperty":
                out += (head, _NAME_TAIL.pack(8, 0, 0, place(value), 0))
            else:
                if kind not in _WRITTEN:
                    raise TaggedError(f"{kind} isn't written")
                data = _WRITTEN[kind](value)
                out += (head, _SIZE.pack(len(data), 0, 0), data)
        yield b"".join(out)


def _written(asset: str, table: pa.Table) -> tuple[bytes, bytes]:
    """Header and payload of the table with these rows, in order of row_pos."""
    # as Python objects, a stretch of rows at a time
    ordered = table.select(["row_pos", "row_name", "fields"]).sort_by("row_pos").to_batches(max_chunksize=1000)
    return _filled(*empty_table(asset, "RowStructure"), lambda names, _: (row for b in ordered for row in _plain_rows(b, names)))


def write_tables(rows: DataFrame) -> DataFrame:
    """asset, header, payload of the tables with these rows (asset, row_pos, row_name, fields of name, type and value), in order of row_pos."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        asset = key[0].as_py()
        header, payload = _written(asset, table)
        return pa.table({"asset": [asset], "header": pa.array([header], pa.binary()), "payload": pa.array([payload], pa.binary())})

    return rows.groupBy("asset").applyInArrow(build, "asset string, header binary, payload binary")


def _arrow_rows(asset: str, rows: list[tuple[int, str, bytes, list[dict]]]) -> pa.RecordBatch:
    fields = [f for *_, found in rows for f in found]
    refs = pa.ListArray.from_arrays(pa.array(_offsets([f["refs"] for f in fields])), pa.array([r for f in fields for r in f["refs"]], pa.string()))
    columns = [refs if f.name == "refs" else pa.array([x[f.name] for x in fields], f.type) for f in _FIELD]
    held = pa.ListArray.from_arrays(pa.array(_offsets([found for *_, found in rows])), pa.StructArray.from_arrays(columns, fields=list(_FIELD)))
    head = [pa.array([asset] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays([*head, held], schema=_ARROW)


def _offsets(parts: list[list]) -> np.ndarray:
    return np.cumsum([0, *map(len, parts)], dtype=np.int32)


def read_tables(files: DataFrame) -> DataFrame:
    """Rows (ROWS) of table packages (asset, header, payload); a package is read by one task, a row at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("asset", "header", "payload")]
            for asset, header, payload in zip(*columns, strict=True):  # a batch has many packages: one at a time as Python bytes
                rows = table_rows(header.as_py(), payload.as_py())
                while held := list(islice(rows, 1000)):
                    yield _arrow_rows(asset.as_py(), held)

    return files.select("asset", "header", "payload").mapInArrow(read, ROWS)


HELD = "group_key string, row_name string, held array<struct<input_index:int,fields:array<struct<name:string,type:string,value:string,raw:binary>>>>"
_HELD_FIELD = pa.struct([("name", pa.string()), ("type", pa.string()), ("value", pa.string()), ("raw", pa.binary())])
_HELD = pa.schema([("group_key", pa.string()), ("row_name", pa.string()), ("held", pa.list_(pa.struct([("input_index", pa.int32()), ("fields", pa.list_(_HELD_FIELD))])))])


def _differing(tables: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[str, list[tuple[int, tuple]]]]:
    """Name and holders of each row that some tables hold in different bytes; equal fields are kept once."""
    held: dict[str, list[tuple[int, tuple]]] = {}
    known: dict[bytes, tuple] = {}  # a field's portable bytes tell its name, type and value too
    for index, header, payload in tables:
        for _, name, _, fields in table_rows(header, payload):
            found = tuple([known.get(f["raw"]) or known.setdefault(f["raw"], (f["name"], f["type"], f["value"], f["raw"])) for f in fields])
            held.setdefault(name, []).append((index, found))
    for name, holders in held.items():
        first = holders[0][1]
        if any(fields != first for _, fields in holders):
            yield name, holders


def _held_rows(group: str, rows: list[tuple[str, list[tuple[int, tuple]]]]) -> pa.RecordBatch:
    holders = [h for _, held in rows for h in held]
    fields = [f for _, found in holders for f in found]
    columns = [pa.array([f[n] for f in fields], kind.type) for n, kind in enumerate(_HELD_FIELD)]
    found = pa.ListArray.from_arrays(pa.array(_offsets([x for _, x in holders])), pa.StructArray.from_arrays(columns, fields=list(_HELD_FIELD)))
    one = _HELD.field("held").type.value_type
    each = pa.StructArray.from_arrays([pa.array([n for n, _ in holders], pa.int32()), found], fields=list(one))
    held = pa.ListArray.from_arrays(pa.array(_offsets([x for _, x in rows])), each)
    return pa.RecordBatch.from_arrays([pa.array([group] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.string()), held], schema=_HELD)


def differing_rows(rows: DataFrame) -> DataFrame:
    """Rows (HELD) by name that inputs hold in different bytes, with all their holders; each input's table is written and read again.

    Takes what ``write_tables`` does, with group_key and input_index. One task
    has the tables of a group, one at a time as a package, so that packages
    never move; nor do rows that all holders have alike.
    """

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        def tables():
            for index in sorted(pc.unique(table.column("input_index")).to_pylist()):
                own = table.filter(pc.equal(table.column("input_index"), index))
                yield index, *_written(own.column("asset")[0].as_py(), own)

        found, out = _differing(tables()), []
        while some := list(islice(found, 1000)):
            out.append(_held_rows(key[0].as_py(), some))
        return pa.Table.from_batches(out, schema=_HELD)

    return rows.groupBy("group_key").applyInArrow(compare, HELD)
