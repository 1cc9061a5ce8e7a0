import cProfile
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.sources import tagged_rows as t


def text(s):
    return struct.pack("<i", len(s) + 1) + s.encode() + b"\0"


class Maker:
    """Writes a package and its payload from the layout, with names in order of use."""

    def __init__(self, first=()):
        self.names = list(first)
        self.imports = [("/Script/Engine", "Class", "DataTable")]

    def name(self, s, instance=0):
        if s not in self.names:
            self.names.append(s)
        return struct.pack("<ii", self.names.index(s), instance)

    def tag(self, name, kind, value, extra=b""):
        return self.name(name) + self.name(kind) + struct.pack("<ii", len(value), 0) + extra + b"\0" + value

    def payload(self, rows):
        out = self.tag("RowStruct", "ObjectProperty", struct.pack("<i", -1)) + self.name("None") + struct.pack("<ii", 0, len(rows))
        for name, fields in rows:
            out += self.name(name) + b"".join(fields) + self.name("None")
        return out

    def header(self, size):
        imports = b"".join(self.name(p) + self.name(c) + struct.pack("<i", 0) + self.name(o) for p, c, o in self.imports)
        export = struct.pack("<iiii", -1, 0, 0, 0) + self.name("Table") + struct.pack("<I", 0) + struct.pack("<qq", size, 0)
        export = export.ljust(t.EXPORT_BYTES, b"\0")
        names = b"".join(text(n) + b"\0" * 4 for n in self.names)
        head = lambda total, names_at, exports_at, imports_at: (
            struct.pack("<Ii", 0x9E2A83C1, -7) + b"\0" * 16 + struct.pack("<I", total) + text("None")
            + struct.pack("<Iii", t.EDITOR_ONLY_FILTERED, len(self.names), names_at) + struct.pack("<ii", 0, 0)
            + struct.pack("<iiii", 1, exports_at, len(self.imports), imports_at) + b"\0" * 120
        )
        size = len(head(0, 0, 0, 0))
        places = size, size + len(names) + len(imports), size + len(names)
        return head(size + len(names) + len(imports) + len(export), *places) + names + imports + export


def made(m):
    vector = struct.pack("<fff", 1, 2, 3)
    nested = m.tag("X", "IntProperty", struct.pack("<i", 7)) + m.name("None")
    rows = [
        (
            "First",
            [
                m.tag("Amount", "IntProperty", struct.pack("<i", -5)),
                m.tag("Rate", "FloatProperty", struct.pack("<f", 2.0)),
                m.tag("Label", "NameProperty", m.name("Sword", 3)),
                m.tag("On", "BoolProperty", b"", b"\1"),
                m.tag("Note", "StrProperty", text("hi")),
                m.tag("Where", "StructProperty", vector, m.name("Vector") + b"\0" * 16),
                m.tag("Inner", "StructProperty", nested, m.name("Custom") + b"\0" * 16),
                m.tag("List", "ArrayProperty", struct.pack("<iii", 2, 4, 9), m.name("IntProperty")),
                m.tag("Map", "MapProperty", struct.pack("<ii", 0, 1) + m.name("Key") + struct.pack("<i", 8), m.name("NameProperty") + m.name("IntProperty")),
                m.tag("Says", "TextProperty", struct.pack("<Ib", 0, 0) + text("ns") + text("k") + text("hello")),
                m.tag("Ref", "ObjectProperty", struct.pack("<i", -1)),
            ],
        ),
        ("Second", [m.tag("Amount", "IntProperty", struct.pack("<i", 1))]),
    ]
    payload = m.payload(rows)
    m.header(0)
    return m.header(len(payload)), payload


def test_rows_by_name_with_resolved_values(spark):
    header, payload = made(Maker())
    files = spark.createDataFrame([("a", bytearray(header), bytearray(payload))], "asset string, header binary, payload binary")
    first, second = sorted(t.read_tables(files).collect(), key=lambda r: r.row_pos)
    assert (first.row_name, second.row_name) == ("First", "Second")
    assert {f.name: f.value for f in first.fields} == {
        "Amount": "-5", "Rate": "2", "Label": "Sword_2", "On": "true", "Note": "hi", "Where": struct.pack("<fff", 1, 2, 3).hex(), "Inner": "{X=7}",
        "List": "[4,9]", "Map": "{Key=8}", "Says": "ns|k|hello", "Ref": "/Script/Engine/Class/DataTable",
    }
    assert {f.name: f.refs for f in first.fields if f.refs} == {"Label": ["Sword_2"], "Map": ["Key"]}


def test_order_of_names_does_not_matter():
    one, two = (list(t.table_rows(*made(Maker(first)))) for first in ((), ("zzz", "Second", "Sword", "Vector")))
    assert one == two


def test_unsound_tables_are_refused():
    header, payload = made(Maker())
    for h, p in ((header[:-1], payload), (header, payload[:-1]), (header, payload + b"\0"), (b"\0" * 40, payload), (header, b"")):
        with pytest.raises(t.TaggedError):
            list(t.table_rows(h, p))
    m = Maker()
    wrong = m.payload([("A", []), ("A", [])])
    m.header(0)
    with pytest.raises(t.TaggedError):
        list(t.table_rows(m.header(len(wrong)), wrong))


def parts(header, payload):
    return [(label, *(f["raw"] for f in fields)) for _, _, label, fields in t.table_rows(header, payload)]


def test_portable_rows_fit_any_package_with_the_imports():
    header, payload = made(Maker())
    assert t.build_table(header, payload, parts(header, payload)) == (t.Package(header).extended(header, [], len(payload)), payload)
    other = made(Maker(("zzz", "Vector", "Sword")))
    assert parts(*other) == parts(header, payload)
    assert t.build_table(*other, parts(header, payload))[1] == other[1]


def test_new_names_move_everything_after_them():
    header, payload = made(Maker())
    rows = [(t.portable_name("Größe"), t.portable_field("New", "NameProperty", "Other")), *parts(header, payload)]
    grown, body = t.build_table(header, payload, rows)
    p = t.Package(grown)
    assert p.names[-3:] == ["Größe", "New", "Other"] and p.imports == t.Package(header).imports
    assert (p.payload_size, p.payload_offset) == (len(body), len(grown))
    assert [r[1] for r in t.table_rows(grown, body)] == ["Größe", "First", "Second"]
    assert parts(grown, body) == rows and t.shell_digest(grown, body) == t.shell_digest(header, payload)


def test_a_missing_import_is_refused():
    header, payload = made(Maker())
    with pytest.raises(t.TaggedError, match="import"):
        t.build_table(*t.empty_table("T", "R"), parts(header, payload))


def test_written_tables_read_back(spark):
    rows = spark.createDataFrame([("a", 1, "r", [("N", "IntProperty", "-4"), ("S", "StrProperty", "é")]), ("a", 0, "q", []), ("b", 0, "r", [("W", "NameProperty", "None2")])], "asset string, row_pos long, row_name string, fields array<struct<name:string,type:string,value:string>>")
    back = sorted((r.asset, r.row_pos, r.row_name, [(f.name, f.type, f.value) for f in r.fields]) for r in t.read_tables(t.write_tables(rows)).collect())
    assert back == sorted((r.asset, r.row_pos, r.row_name, [tuple(f) for f in r.fields]) for r in rows.collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.binary(min_size=1, max_size=6))
def test_damage_never_crashes(at, noise):
    header, payload = made(Maker())
    at %= len(payload)
    try:
        list(t.table_rows(header, payload[:at] + noise + payload[at + len(noise) :]))
    except (t.TaggedError, UnicodeDecodeError):
        pass


KINDS = [("a", "Int64Property", "-5"), ("b", "NameProperty", "Rot"), ("c", "StrProperty", "ΣΑΣ"), ("None", "DoubleProperty", "2.5"), ("Rot", "NameProperty", "a"), ("d", "StrProperty", "")]


def batch(rows):
    fields = [[dict(zip(("name", "type", "value"), f, strict=True)) for f in found] for _, found in rows]
    kind = pa.list_(pa.struct([("value", pa.string()), ("type", pa.string()), ("name", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows]), pa.array(fields, kind)], ["row_name", "fields"])


def test_plain_rows_are_those_of_their_portable_forms():
    rows = [(f"r{n}", [*KINDS[:3], *KINDS[4:]][: n % 6]) for n in range(20)]
    portable = [(t.portable_name(name), *(t.portable_field(*f) for f in fields)) for name, fields in rows]
    empty = t.empty_table("part", "RowStructure")
    header, payload = t._filled(*empty, lambda names, _: t._plain_rows(batch(rows)[:7], names))
    assert (header, payload) == t.build_table(*empty, portable[:7])
    header, payload = t._filled(*empty, lambda names, _: t._plain_rows(batch(rows)[7:], names))
    assert (header, payload) == t.build_table(*empty, portable[7:])
    back = [(name, label, [f["raw"] for f in fields]) for _, name, label, fields in t.table_rows(header, payload)]
    assert back == [(name, p[0], list(p[1:])) for (name, _), p in zip(rows[7:], portable[7:], strict=True)]
    with pytest.raises(t.TaggedError, match="isn't written"):
        list(t._plain_rows(batch([("r", [("a", "MapProperty", "")])]), {}))


def test_rows_read_at_once_are_those_read_tag_by_tag(monkeypatch):
    m = Maker()
    flag = m.name("F") + m.name("IntProperty") + struct.pack("<ii", 4, 0) + b"\1" + bytes(16) + struct.pack("<i", 9)
    rows = [("A", [m.tag("I", "IntProperty", struct.pack("<i", 1)), flag]), ("B", [m.tag("N", "NameProperty", m.name("X", 4)), m.name("I", 2) + m.tag("I", "IntProperty", struct.pack("<i", 3))[8:]])]
    payload = m.payload(rows)
    header = m.header(len(payload))
    found = list(t.table_rows(header, payload))
    monkeypatch.setattr(t, "_plain_head", lambda head, names: None)
    assert found == list(t.table_rows(header, payload))
    assert [f["value"] for f in found[1][3]] == ["X_3", "3"]
    short = payload.replace(struct.pack("<ii", 4, 0) + b"\0" + struct.pack("<i", 1), struct.pack("<ii", 5, 0) + b"\0" + struct.pack("<i", 1))
    monkeypatch.undo()
    with pytest.raises(t.TaggedError, match="I is 4 bytes long, not 5"):
        list(t.table_rows(header, short))


def test_rows_take_few_calls():
    """Python calls, which took most of the time of writing and reading plain rows: 425 a row before."""
    write, read = [], []

    class Frame:
        def groupBy(self, *_):
            return self

        select = groupBy

        def applyInArrow(self, f, _):
            write.append(f)

        def mapInArrow(self, f, _):
            read.append(f)

    t.write_tables(Frame())
    t.read_tables(Frame())
    rows = batch([(f"r{n}", KINDS[:3]) for n in range(2000)])
    table = pa.table({"row_pos": range(2000), **dict(zip(rows.schema.names, rows.columns, strict=True))})
    profile = cProfile.Profile()
    profile.enable()
    found = list(read[0](iter(write[0]((pa.scalar("part"),), table).to_batches())))
    profile.disable()
    assert sum(map(len, found)) == 2000
    assert sum(e.callcount for e in profile.getstats()) < 200 * 2000
