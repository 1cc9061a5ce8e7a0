import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.sources import msgpack_rows as m

ROWS = [{"m_id": 1, "x": 2, "name": "a" * 40}, {"m_id": 300, "list": [1, -5, 2**40, [1.5]], "b": b"\x00\xff", "n": None, "t": True}, {"m_id": -7, "map": {"k": 1, "j": 2.0}}]


def table(rows):
    return m.build_table([m.pack_value(r) for r in rows])


def test_round_trip_of_files(spark):
    files = spark.createDataFrame([("a", bytearray(table(ROWS))), ("empty", bytearray(table([])))], "asset string, content binary")
    rows = m.read_tables(files)
    found = {r.row_id: {f.name: (f.type, f.value) for f in r.fields} for r in rows.collect()}
    assert sorted(found) == [-7, 1, 300]
    assert found[300]["list"] == ("array", "[i:1,i:-5,i:1099511627776,a:[f:1.5]]")
    assert found[-7]["map"] == ("map", "{s1:k=i:1,s1:j=i:2}")
    assert found[300]["b"] == ("binary", "00ff")
    built = {r.asset: bytes(r.content) for r in m.write_tables(rows).collect()}
    assert built == {"a": table(ROWS)}


def test_integral_floats_mean_integers_but_bytes_differ():
    (a,), (b,) = (list(m.table_rows(table([{"m_id": 1, "x": v}]))) for v in (2, 2.0))
    assert a[3][1]["value"] == b[3][1]["value"] == "2"
    assert a[3][1]["raw"] != b[3][1]["raw"]


def test_everything_around_the_rows_stays(spark):
    rows = [m.pack_value({"m_id": n}) for n in range(20)]
    body = m.pack_value({"first": "kept"})[1:]
    whole = b"\x83" + body + m.pack_value("m_DataList") + m._listed(3, b"\x90") + b"".join(rows[:3]) + m.pack_value("last") + m.pack_value([1])
    like = b"ABCDEF" + len(whole).to_bytes(4, "little") + whole + b"wxyz" + m.TAG
    assert m.build_table(rows[:3], like) == like
    longer = m.build_table(rows, like)
    assert longer[:6] == b"ABCDEF" and longer[-8:-4] == b"wxyz"
    assert [r[1] for r in m.table_rows(longer)] == list(range(20))


@pytest.mark.parametrize("rows", [[{"m_id": 1}, {"m_id": 1}], [{"x": 1}], [{"m_id": "1"}], [{"m_id": 1.5}], [{"m_id": float(2**53)}], [{1: 2, "m_id": 1}]])
def test_unsound_rows_are_refused(rows):
    assert not m.is_table(table(rows))


def test_cut_and_trailing_bytes_are_refused():
    good = table(ROWS)
    assert m.is_table(good)
    for bad in (good[:-1], good[:20], good + b"x", b"", good[:6] + b"\0\0\0\0" + good[10:]):
        assert not m.is_table(bad)


value = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=8), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), value, max_size=4), max_size=5))
def test_any_rows_come_back(rows):
    rows = [{**r, "m_id": n} for n, r in enumerate(rows)]
    found = list(m.table_rows(table(rows)))
    assert [r[1] for r in found] == list(range(len(rows)))
    assert m.build_table([r[2] for r in found]) == table(rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_never_crash(data):
    m.is_table(data)
    m.is_table(b"\0" * 6 + len(data).to_bytes(4, "little") + data + b"\0" * 4 + m.TAG)
