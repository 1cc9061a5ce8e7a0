import hashlib
import io
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.sources import archive as a

FILES = [("Game/A.uasset", b"one"), ("Game/B/c.txt", b""), ("Game/Ünï.bin", bytes(range(256)) * 40), ("root.txt", b"r")]


def made(files=FILES, mount="../../../"):
    out = io.BytesIO()
    a.write_archive(out, mount, iter(sorted(files, key=lambda f: f[0].lower())))
    return out.getvalue()


def entries(data):
    footer, mount, found = a.read_index(io.BytesIO(data), len(data))
    return footer, mount, {e.path: a.read_entry(io.BytesIO(data), footer, e)[0] for e in found}


def old(version, files, *, compress=False, block=100):
    """An archive of an older version, written here from its layout."""
    small, guid = version == "8a", version in ("8a", 7, 8, 9)
    v = 8 if small else version
    footer = a.Footer(v, 0, 0, b"", a.OLD_METHODS, small)
    out, listed = b"", []

    def record(offset, content):
        pieces = [zlib.compress(content[i : i + block]) for i in range(0, len(content), block)] if compress else [content]
        stored = b"".join(pieces)
        method = int(compress)
        data = struct.pack("<QQQ", offset, len(stored), len(content)) + struct.pack("<B" if small else "<I", method) + (b"\0" * 8 if v == 1 else b"") + hashlib.sha1(stored).digest()
        if v >= 3:
            if compress:
                at = a.header_size(footer, 1, len(pieces)) + (0 if v >= 5 else where)
                data += struct.pack("<I", len(pieces))
                for p in pieces:
                    data += struct.pack("<QQ", at, at + len(p))
                    at += len(p)
            data += struct.pack("<BI", 0, block if compress else 0)
        return data, stored

    for path, content in files:
        where = len(out)
        head, stored = record(0, content)
        listed.append((path, record(where, content)[0]))
        out += head + stored
    index = a.fstring("../../../") + struct.pack("<I", len(listed)) + b"".join(a.fstring(p) + r for p, r in listed)
    tail = (b"\0" * 16 if guid else b"") + (b"\0" if v >= 4 else b"") + struct.pack("<IIQQ", a.MAGIC, v, len(out), len(index)) + hashlib.sha1(index).digest()
    tail += b"\0" if v == 9 else b""
    if v >= 8:
        tail += b"".join(n.encode().ljust(32, b"\0") for n in (["Zlib", "", "", ""] if small else ["Zlib", "", "", "", ""]))
    return out + index + tail


@pytest.mark.parametrize("version", [1, 2, 3, 4, 5, 6, 7, "8a", 8, 9])
@pytest.mark.parametrize("compress", [False, True])
def test_older_versions(version, compress):
    if compress and version in (1, 2):
        return
    files = [f for f in FILES if f[1] or not compress]
    footer, mount, found = entries(old(version, files, compress=compress))
    assert (footer.version, mount, found) == (8 if version == "8a" else version, "../../../", dict(files))


def test_round_trip_of_version_11():
    footer, mount, found = entries(made(mount="../../../Game/"))
    assert (footer.version, mount, found) == (11, "../../../Game/", dict(FILES))
    assert made() == made()


def test_damage_is_found():
    good = made()
    for at in (60, len(good) - 300, len(good) - 190, len(good) // 2):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises((a.ArchiveError, UnicodeDecodeError, struct.error)):
            entries(bytes(bad))
    with pytest.raises(a.ArchiveError):
        entries(good[:-1])
    with pytest.raises(a.ArchiveError):
        made([("A", b""), ("a", b"")])


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcé/XY.", min_size=1, max_size=8).filter(lambda p: all(p.split("/"))), st.binary(max_size=50), max_size=6))
def test_any_files_come_back(files):
    files = list({p.lower(): (p, c) for p, c in files.items()}.values())
    assert entries(made(files))[2] == dict(files)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes_are_refused(data):
    with pytest.raises(a.ArchiveError):
        a.read_index(io.BytesIO(data), len(data))


def test_source_and_sink(spark, tmp_path):
    a.register(spark)
    folder = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in FILES], "path string, content binary").orderBy(F.lower("path")).coalesce(1)
    rows.write.format("overlay_archive").mode("append").option("name", "demo_P.pak").save(folder)
    back = spark.read.format("overlay_archive").load(folder)
    assert {r.path: bytes(r.content) for r in back.collect()} == dict(FILES)
    assert back.where("not sha1_ok").count() == 0
    one = back.where("path = 'root.txt'").select("path", "logical").collect()
    assert [tuple(r) for r in one] == [("root.txt", 1)]
    bare = spark.read.format("overlay_archive").option("content", "false").load(folder)
    assert sorted(r.logical for r in bare.collect()) == sorted(len(c) for _, c in FILES)
    assert bare.where("content is not null").count() == 0
    with pytest.raises(Exception, match="exists"):
        rows.write.format("overlay_archive").mode("append").option("name", "demo_P.pak").save(folder)
    with pytest.raises(Exception, match="_P.pak"):
        rows.write.format("overlay_archive").mode("append").option("name", "demo.pak").save(folder)
