"""Row tables in MessagePack envelopes: bytes to rows and back.

A table is ten bytes of prefix (the payload's length at 6), a MessagePack map
with the list ``m_DataList`` of maps keyed by the integer ``m_id``, four bytes of
footer and a four-byte tag. Rows come out long, with their fields in order, so
that the operators see them like any columnar table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the envelope.
PREFIX, FOOTER, TAG = 10, 4, bytes.fromhex("C1832A9E")
LIST_KEY, ID_KEY = "m_DataList", "m_id"
MOST_DEPTH = 128

ROWS = "asset string, row_pos long, row_id long, raw binary, fields array<struct<name:string,type:string,value:string,raw:binary>>"
_FIELD = pa.struct([("name", pa.string()), ("type", pa.string()), ("value", pa.string()), ("raw", pa.binary())])
_ARROW = pa.schema([("asset", pa.string()), ("row_pos", pa.int64()), ("row_id", pa.int64()), ("raw", pa.binary()), ("fields", pa.list_(_FIELD))])


class TableError(ValueError):
    """Bytes that aren't a table: cut off, trailing, repeated or missing keys."""


#: Markers with the struct format of what follows.
_SCALARS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: ("binary", ">B"), 0xC5: ("binary", ">H"), 0xC6: ("binary", ">I"), 0xD9: ("string", ">B"), 0xDA: ("string", ">H"), 0xDB: ("string", ">I")}
_LISTS = {0xDC: ("array", ">H"), 0xDD: ("array", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}
_EXTENSIONS = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}
_SIZED_EXTENSIONS = {0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}


class _Reader:
    def __init__(self, data: bytes, at: int, end: int) -> None:
        self.data, self.at, self.end = data, at, end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise TableError("the table ends inside a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def head(self) -> tuple[str, object]:
        """The type of the next value, with its scalar value or its number of items."""
        m = self.number(">B")
        if m < 0x80 or m >= 0xE0:
            return "integer", m if m < 0x80 else m - 256
        if m < 0xA0:
            return ("map", m & 15) if m < 0x90 else ("array", m & 15)
        if m < 0xC0:
            return "string", self.take(m & 31).decode()
        if m == 0xC0:
            return "nil", None
        if m in (0xC2, 0xC3):
            return "boolean", m == 0xC3
        if m in _SCALARS:
            return ("float" if m < 0xCC else "integer"), self.number(_SCALARS[m])
        if m in _SIZED:
            kind, form = _SIZED[m]
            data = self.take(self.number(form))
            return kind, data.decode() if kind == "string" else data
        if m in _LISTS:
            kind, form = _LISTS[m]
            return kind, self.number(form)
        if m in _EXTENSIONS or m in _SIZED_EXTENSIONS:
            size = _EXTENSIONS.get(m) or self.number(_SIZED_EXTENSIONS[m])
            return "extension", (self.number(">b"), self.take(size))
        raise TableError(f"unknown marker {m:#x}")

    def canonical(self, depth: int = 0) -> tuple[str, str]:
        """Type and canonical text of the next value: integral floats are integers, maps keep their order."""
        if depth > MOST_DEPTH:
            raise TableError("nested too deeply")
        kind, value = self.head()
        if kind == "array":
            return kind, "[" + ",".join(self.typed(depth) for _ in range(value)) + "]"
        if kind == "map":
            return kind, "{" + ",".join(self.typed(depth) + "=" + self.typed(depth) for _ in range(value)) + "}"
        return kind, scalar_text(kind, value)

    def typed(self, depth: int) -> str:
        kind, text = self.canonical(depth + 1)
        if kind in ("integer", "float"):
            return ("f:" if text in ("nan", "inf", "-inf") or "." in text or "e" in text else "i:") + text
        if kind in ("string", "binary", "extension"):
            return f"{kind[0]}{len(text)}:{text}"
        return f"{kind[0]}:{text}"


def scalar_text(kind: str, value) -> str:
    if kind == "float":
        if value != value:
            return "nan"
        if value == int(value) if abs(value) < 2**64 else False:
            return str(int(value))
        return repr(value)
    if kind == "binary":
        return value.hex()
    if kind == "extension":
        return f"{value[0]}:{value[1].hex()}"
    return {None: "", True: "true", False: "false"}.get(value, str(value)) if kind in ("nil", "boolean") else str(value)


def _body(data: bytes) -> tuple[int, int]:
    if len(data) < PREFIX + FOOTER + len(TAG) or data[-len(TAG) :] != TAG:
        raise TableError("not a table envelope")
    (size,) = struct.unpack_from("<I", data, 6)
    if PREFIX + size + FOOTER + len(TAG) != len(data):
        raise TableError("the payload's length is wrong")
    return PREFIX, PREFIX + size


def is_table(data: bytes) -> bool:
    """Whether bytes are a sound table; nothing of it is kept."""
    try:
        for _ in table_rows(data):
            pass
    except (TableError, UnicodeDecodeError):
        return False
    return True


def table_rows(data: bytes) -> Iterator[tuple[int, int, bytes, list[dict]]]:
    """Position, id, exact bytes and fields of every row, one row at a time."""
    reader = _Reader(data, *_body(data))
    kind, size = reader.head()
    seen: set[int] = set()
    listed = False
    for _ in range(size if kind == "map" else 0):
        key_kind, key = reader.head()
        if key_kind != "string" or key != LIST_KEY:
            reader.canonical()
            continue
        listed = True
        list_kind, count = reader.head()
        if list_kind != "array":
            raise TableError(f"{LIST_KEY} isn't a list")
        for position in range(count):
            start = reader.at
            fields, row_id = _fields(reader)
            if row_id in seen:
                raise TableError(f"row id {row_id} repeats")
            seen.add(row_id)
            yield position, row_id, data[start : reader.at], fields
    if not listed or reader.at != reader.end:
        raise TableError(f"no {LIST_KEY}, or bytes after the payload")


def _fields(reader: _Reader) -> tuple[list[dict], int]:
    kind, size = reader.head()
    if kind != "map":
        raise TableError("a row isn't a map")
    fields, names, row_id = [], set(), None
    for _ in range(size):
        key_kind, name = reader.head()
        if key_kind != "string" or name in names:
            raise TableError(f"the field {name!r} repeats or isn't text")
        names.add(name)
        start = reader.at
        value_kind, text = reader.canonical()
        fields.append({"name": name, "type": value_kind, "value": text, "raw": reader.data[start : reader.at]})
        if name == ID_KEY:
            row_id = row_key(value_kind, text, reader.data[start])
    if row_id is None:
        raise TableError(f"a row has no {ID_KEY}")
    return fields, row_id


def row_key(kind: str, text: str, marker: int) -> int:
    """A row id; floats only where every integer of their size is exact."""
    most = 2**24 - 1 if marker == 0xCA else 2**53 - 1
    try:
        value = int(text)
    except ValueError:
        raise TableError(f"the row id {text} isn't an integer") from None
    if kind not in ("integer", "float") or (kind == "float" and abs(value) > most) or not -(2**63) <= value < 2**63:
        raise TableError(f"the row id {text} isn't an integer")
    return value


def _listed(size: int, least: bytes) -> bytes:
    """A list header of the marker family of ``least``, or of the next one that holds the size."""
    if size < 16 and least[0] & 0xF0 == 0x90:
        return bytes([0x90 | size])
    if size < 1 << 16 and least[0] != 0xDD:
        return b"\xdc" + struct.pack(">H", size)
    return b"\xdd" + struct.pack(">I", size)


def build_table(rows: list[bytes], like: bytes | None = None) -> bytes:
    """A table of exact row bytes; with ``like``, everything around its row list stays as it is there."""
    head, tail, prefix, footer, family = b"\x81\xaa" + LIST_KEY.encode(), b"", b"\0" * 6, b"\0" * FOOTER, b"\x90"
    if like is not None:
        start, end = _body(like)
        prefix, footer = like[:6], like[end : end + FOOTER]
        reader = _Reader(like, start, end)
        _, size = reader.head()
        for _ in range(size):
            _, key = reader.head()
            if key == LIST_KEY:
                head, family = like[start : reader.at], like[reader.at : reader.at + 1]
                _, count = reader.head()
                for _ in range(count):
                    reader.canonical()
                tail = like[reader.at : end]
                break
            reader.canonical()
    body = head + _listed(len(rows), family) + b"".join(rows) + tail
    return prefix + struct.pack("<I", len(body)) + body + footer + TAG


def read_tables(files: DataFrame) -> DataFrame:
    """Rows (ROWS) of table files (asset, content); a file is read by one task, a row at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asset, content in zip(batch.column("asset").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held = []
                for position, row_id, raw, fields in table_rows(content):
                    held.append({"asset": asset, "row_pos": position, "row_id": row_id, "raw": raw, "fields": fields})
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return files.select("asset", "content").mapInArrow(read, ROWS)


def write_tables(rows: DataFrame) -> DataFrame:
    """asset, content: a table file per asset from rows (asset, row_pos, raw), in order of position."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by("row_pos")
        return pa.table({"asset": [key[0].as_py()], "content": pa.array([build_table(ordered.column("raw").to_pylist())], pa.binary())})

    return rows.select("asset", "row_pos", "raw").groupBy("asset").applyInArrow(build, "asset string, content binary")


def pack_value(value) -> bytes:
    """MessagePack bytes of None, booleans, integers, floats, text, bytes, lists and dicts, as short as they go."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack(">b", value)
        for marker in (0xCC, 0xCD, 0xCE, 0xCF) if value >= 0 else (0xD0, 0xD1, 0xD2, 0xD3):
            try:
                return bytes([marker]) + struct.pack(_SCALARS[marker], value)
            except struct.error:
                continue
        raise TableError(f"{value} has more than 64 bits")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        return (bytes([0xA0 | len(data)]) if len(data) < 32 else b"\xdb" + struct.pack(">I", len(data))) + data
    if isinstance(value, bytes):
        return b"\xc6" + struct.pack(">I", len(value)) + value
    if isinstance(value, list):
        return _listed(len(value), b"\x90") + b"".join(map(pack_value, value))
    size = bytes([0x80 | len(value)]) if len(value) < 16 else b"\xdf" + struct.pack(">I", len(value))
    return size + b"".join(pack_value(k) + pack_value(v) for k, v in value.items())


def shell_digest(data: bytes) -> str:
    """A digest of everything outside the row list; tables of one asset must share it to be merged."""
    import hashlib

    empty = build_table([], data)
    return hashlib.sha256(empty).hexdigest()


def integer_leaves(raw: bytes) -> list[int]:
    """The integers above zero in a packed value; lists and the values of maps are entered, keys aren't."""
    reader, found = _Reader(raw, 0, len(raw)), []

    def walk(depth: int) -> None:
        if depth > MOST_DEPTH:
            raise TableError("nested too deeply")
        kind, value = reader.head()
        if kind == "integer" and value > 0:
            found.append(value)
        for _ in range(value if kind in ("array", "map") else 0):
            if kind == "map":
                reader.canonical(depth + 1)
            walk(depth + 1)

    walk(0)
    return found


def rebuild_row(fields: list[dict]) -> bytes:
    """A row of exact field bytes, in their order."""
    size = bytes([0x80 | len(fields)]) if len(fields) < 16 else b"\xde" + struct.pack(">H", len(fields))
    return size + b"".join(pack_value(f["name"]) + f["raw"] for f in fields)
