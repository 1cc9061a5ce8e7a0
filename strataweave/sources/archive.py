"""Archives as a PySpark data source: ``spark.read.format("overlay_archive")``.

Every file of versions 1 to 11 below a path is listed on the driver by its
footer and index only; entries are then decoded by tasks, a stretch of entries
each. Predicates on ``path`` are pushed down, and with the option ``content`` =
``false`` entry metadata is read without any payload. Checks: one footer layout
fits, index and payload SHA-1, entry headers equal to the index, ranges apart.

Writing (version 11) puts the rows of one partition, which must be sorted by
path, into one archive next to its final name and renames it on commit. With the
option ``parts`` = ``true`` every partition becomes an archive of its own, its
name numbered by its paths' order; ``split`` makes such partitions of a bounded size.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "archive string, version int, mount string, path string, method string, stored long, logical long, sha1 string, sha1_ok boolean, sha256 string, content binary"
MAGIC = 0x5A6F12E1
#: Most entries and bytes of an index that a reader takes.
MOST_ENTRIES, MOST_INDEX = 2_000_000, 1 << 30
STRETCH_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Content of an archive written in parts, about.
PART_BYTES = 128 << 20
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
OLD_METHODS = ("None", "Zlib", "Gzip", "Oodle")


class ArchiveError(ValueError):
    """Bytes that aren't a sound archive, or that need what isn't there (encryption, a codec)."""


@dataclass(frozen=True)
class Footer:
    version: int
    index_offset: int
    index_size: int
    index_sha1: bytes
    methods: tuple[str, ...]
    small_method: bool = False  # one byte for the method in entries (the first form of version 8)


@dataclass(frozen=True)
class Entry:
    path: str
    offset: int
    stored: int
    logical: int
    method: int
    sha1: bytes | None
    blocks: tuple[tuple[int, int], ...]
    block_size: int


class _Bytes(io.BytesIO):
    def get(self, form: str):
        size = struct.calcsize("<" + form)
        data = self.read(size)
        if len(data) < size:
            raise ArchiveError("the index ends too early")
        found = struct.unpack("<" + form, data)
        return found[0] if len(found) == 1 else found

    def text(self) -> str:
        n = self.get("i")
        if abs(n) > 1 << 16:
            raise ArchiveError("a text is too long")
        data = self.read(-2 * n if n < 0 else n)
        return data.decode("utf-16-le" if n < 0 else "utf-8").rstrip("\0")


def fstring(text: str) -> bytes:
    if text.isascii():
        return struct.pack("<i", len(text) + 1) + text.encode() + b"\0"
    data = (text + "\0").encode("utf-16-le")
    return struct.pack("<i", -len(data) // 2) + data


#: Versions from, GUID, encryption flag, frozen flag, codec slots, one-byte method.
_LAYOUTS = [(11, 1, 1, 0, 5, 0), (10, 1, 1, 0, 5, 0), (9, 1, 1, 1, 5, 0), (8, 1, 1, 0, 5, 0), (8, 1, 1, 0, 4, 1), (7, 1, 1, 0, 0, 0)] + [(v, 0, int(v >= 4), 0, 0, 0) for v in range(6, 0, -1)]


def read_footer(tail: bytes, size: int) -> Footer:
    """The one footer that the last bytes of an archive of ``size`` bytes fit."""
    found = []
    for version, guid, flag, frozen, slots, small in _LAYOUTS:
        length = 16 * guid + flag + 44 + frozen + 32 * slots
        data = _Bytes(tail[-length:])
        if len(tail) < length:
            continue
        data.read(16 * guid)
        encrypted = data.get("B") if flag else 0
        magic, told, offset, index_size = data.get("IIQQ")
        sha1 = data.read(20)
        is_frozen = data.get("B") if frozen else 0
        names = [data.read(32).split(b"\0")[0].decode("ascii", "replace") for _ in range(slots)]
        if magic != MAGIC or told != version or offset + index_size > size:
            continue
        if encrypted or is_frozen:
            raise ArchiveError("encrypted and frozen indexes aren't read")
        found.append(Footer(version, offset, index_size, sha1, ("None", *[n for n in names if n]) if slots else OLD_METHODS, bool(small)))
    if len(found) != 1:
        raise ArchiveError("not an archive" if not found else "several footers fit")
    return found[0]


def _record(data: _Bytes, footer: Footer) -> Entry:
    """An entry record of older indexes, which is also the header before each payload."""
    offset, stored, logical = data.get("QQQ")
    method = data.get("B") if footer.small_method else data.get("I")
    if footer.version == 1:
        data.get("Q")
    sha1, blocks, block_size = data.read(20), (), 0
    if footer.version >= 3:
        if method:
            blocks = tuple(data.get("QQ") for _ in range(data.get("I")))
        if data.get("B"):
            raise ArchiveError("encrypted and deleted entries aren't read")
        block_size = data.get("I")
    return Entry("", offset, stored, logical, method, sha1, blocks, block_size)


def header_size(footer: Footer, method: int, n_blocks: int) -> int:
    size = 24 + (1 if footer.small_method else 4) + (8 if footer.version == 1 else 0) + 20
    return size + ((4 + 16 * n_blocks if method else 0) + 5 if footer.version >= 3 else 0)


def _encoded(data: _Bytes, footer: Footer, path: str) -> Entry:
    bits = data.get("I")
    method, n_blocks = bits >> 23 & 63, bits >> 6 & 0xFFFF
    if bits >> 22 & 1:
        raise ArchiveError("encrypted entries aren't read")
    block_size = data.get("I") if bits & 63 == 63 else (bits & 63) << 11
    offset = data.get("I" if bits >> 31 & 1 else "Q")
    logical = data.get("I" if bits >> 30 & 1 else "Q")
    stored = data.get("I" if bits >> 29 & 1 else "Q") if method else logical
    blocks, at = [], header_size(footer, method, n_blocks)
    if method:
        for size in [stored] if n_blocks == 1 else [data.get("I") for _ in range(n_blocks)]:
            blocks.append((at, at + size))
            at += size
    return Entry(path, offset, stored, logical, method, None, tuple(blocks), min(block_size, logical) if n_blocks == 1 else block_size)


def path_hash(path: str, seed: int) -> int:
    """64-bit FNV-1a over the lower-case path in UTF-16."""
    value = (FNV_BASIS + seed) & (2**64 - 1)
    for byte in path.lower().encode("utf-16-le"):
        value = (value ^ byte) * FNV_PRIME & (2**64 - 1)
    return value


def _part(file, offset: int, size: int, sha1: bytes, what: str) -> bytes:
    if size > MOST_INDEX:
        raise ArchiveError(f"the {what} is too large")
    file.seek(offset)
    data = file.read(size)
    if len(data) < size or hashlib.sha1(data).digest() != sha1:
        raise ArchiveError(f"the {what} differs from its hash")
    return data


def read_index(file, size: int) -> tuple[Footer, str, list[Entry]]:
    """Footer, mount and entries (in path order) of an open archive."""
    file.seek(max(0, size - 512))
    footer = read_footer(file.read(512), size)
    index = _Bytes(_part(file, footer.index_offset, footer.index_size, footer.index_sha1, "index"))
    mount, count = index.text(), index.get("I")
    if count > MOST_ENTRIES:
        raise ArchiveError("too many entries")
    if footer.version < 10:
        entries = []
        for _ in range(count):
            path = index.text()
            entries.append(Entry(path, *list(_record(index, footer).__dict__.values())[1:]))
    else:
        entries = _modern_entries(file, footer, index, count)
    if len({e.path.lower() for e in entries}) < len(entries):
        raise ArchiveError("paths repeat")
    end = 0
    for e in sorted(entries, key=lambda e: e.offset):
        if e.offset < end:
            raise ArchiveError("entries overlap")
        end = e.offset + header_size(footer, e.method, len(e.blocks)) + e.stored
    if end > footer.index_offset:
        raise ArchiveError("entries reach into the index")
    return footer, mount, sorted(entries, key=lambda e: e.path)


def _modern_entries(file, footer: Footer, index: _Bytes, count: int) -> list[Entry]:
    seed = index.get("Q")
    parts = []
    for what in ("path hash index", "directory index"):
        if not index.get("I"):
            raise ArchiveError(f"there is no {what}")
        offset, size = index.get("QQ")
        parts.append(_Bytes(_part(file, offset, size, index.read(20), what)))
    encoded = _Bytes(index.read(index.get("I")))
    if index.get("I"):
        raise ArchiveError("entries that aren't encoded aren't read")
    hashes, folders = parts
    by_hash = dict(hashes.get("Qi") for _ in range(hashes.get("I")))
    entries = []
    for _ in range(folders.get("I")):
        folder = folders.text().strip("/")
        for _ in range(folders.get("I")):
            path, at = (f"{folder}/" if folder else "") + folders.text(), folders.get("i")
            if by_hash.get(path_hash(path, seed)) != at:
                raise ArchiveError(f"the indexes differ on {path}")
            encoded.seek(at)
            entries.append(_encoded(encoded, footer, path))
    if not len(entries) == count == len(by_hash):
        raise ArchiveError("the indexes differ in their number of entries")
    return entries


def _unpack(method: str, data: bytes, logical: int) -> bytes:
    if method == "Zlib":
        out = zlib.decompress(data)
    elif method == "Gzip":
        out = gzip.decompress(data)
    elif method == "Zstd":
        import zstandard

        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=logical)
    else:
        raise ArchiveError(f"unsupported codec {method}")
    if len(out) != logical:
        raise ArchiveError("a block has another length than told")
    return out


def read_entry(file, footer: Footer, e: Entry, *, strict: bool = True) -> tuple[bytes, str, bool]:
    """An entry's bytes, the SHA-1 it declares, and whether its stored bytes have it."""
    file.seek(e.offset)
    header = _record(_Bytes(file.read(header_size(footer, e.method, len(e.blocks)))), footer)
    if (header.stored, header.logical, header.method) != (e.stored, e.logical, e.method) or header.offset not in (0, e.offset) or (e.sha1 or header.sha1) != header.sha1:
        raise ArchiveError(f"the header of {e.path} differs from the index")
    data = file.read(e.stored)
    sound = len(data) == e.stored and hashlib.sha1(data).digest() == header.sha1
    if strict and not sound:
        raise ArchiveError(f"{e.path} differs from its hash")
    if not e.method:
        return data, header.sha1.hex(), sound
    start = header_size(footer, e.method, len(e.blocks)) + (0 if footer.version >= 5 else e.offset)
    out, left = [], e.logical
    for a, b in e.blocks or ((start, start + e.stored),):
        size = min(left, e.block_size or left)
        out.append(_unpack(footer.methods[e.method], data[a - start : b - start], size))
        left -= size
    if left:
        raise ArchiveError(f"{e.path} has too few blocks")
    return b"".join(out), header.sha1.hex(), sound


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_content = str(options.get("content", "true")).lower() == "true"
        self.strict = str(options.get("strict", "true")).lower() == "true"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        fs, folder = located(self.path)
        info = fs.get_file_info(folder)
        files = [folder] if info.type == pafs.FileType.File else sorted(x.path for x in fs.get_file_info(pafs.FileSelector(folder, recursive=True)) if x.path.endswith(".pak"))
        out = []
        for name in files:
            with fs.open_input_file(name) as f:
                footer, mount, entries = read_index(f, f.size())
            held, size = [], 0
            for e in entries:
                if self.wanted is not None and e.path not in self.wanted:
                    continue
                held.append(e)
                size += e.stored
                if size >= STRETCH_BYTES:
                    out.append(InputPartition((name, footer, mount, held)))
                    held, size = [], 0
            if held:
                out.append(InputPartition((name, footer, mount, held)))
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        name, footer, mount, entries = partition.value
        fs, _ = located(self.path)
        held, size = [], 0
        with fs.open_input_file(name) as f:
            for e in entries:
                content, sha1, sound = read_entry(f, footer, e, strict=self.strict) if self.with_content else (None, None, None)
                row = {"archive": name, "version": footer.version, "mount": mount, "path": e.path, "method": footer.methods[e.method], "stored": e.stored, "logical": e.logical}
                row |= {"sha1": sha1, "sha1_ok": sound, "sha256": hashlib.sha256(content).hexdigest() if content is not None else None, "content": content}
                held.append(row)
                size += len(content or b"")
                if size >= BATCH_BYTES or len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


_ARROW = pa.schema(
    [("archive", pa.string()), ("version", pa.int32()), ("mount", pa.string()), ("path", pa.string()), ("method", pa.string()), ("stored", pa.int64()), ("logical", pa.int64())]
    + [("sha1", pa.string()), ("sha1_ok", pa.bool_()), ("sha256", pa.string()), ("content", pa.binary())]
)


def _header(stored: int, sha1: bytes) -> bytes:
    return struct.pack("<QQQI", 0, stored, stored, 0) + sha1 + struct.pack("<BI", 0, 0)


def write_archive(out, mount: str, entries: Iterator[tuple[str, bytes]]) -> int:
    """A version 11 archive of (path, content) in path order, one entry in memory at a time; the number of entries."""
    listed, at, last = [], 0, None
    for path, content in entries:
        if last is not None and path.lower() <= last:
            raise ArchiveError("entries must come in the order of their lower-case paths, each once")
        last = path.lower()
        data = _header(len(content), hashlib.sha1(content).digest()) + content
        out.write(data)
        listed.append((path, at, len(content)))
        at += len(data)
    encoded, offsets, folders = b"", {}, {}
    for path, offset, size in listed:
        offsets[path] = len(encoded)
        wide = (offset >= 1 << 32, size >= 1 << 32)
        bits = (not wide[0]) << 31 | (not wide[1]) << 30 | 1 << 29
        encoded += struct.pack("<I", bits) + struct.pack("<Q" if wide[0] else "<I", offset) + struct.pack("<Q" if wide[1] else "<I", size)
        folder, _, name = path.rpartition("/")
        parts = folder.split("/") if folder else []
        for n in range(len(parts) + 1):
            folders.setdefault("/".join(parts[:n]) + "/", [])
        folders[f"{folder}/"].append((name, path))
    seed = zlib.crc32(mount.lower().encode("utf-16-le"))
    hashes = struct.pack("<I", len(listed)) + b"".join(struct.pack("<Qi", path_hash(p, seed), offsets[p]) for p, _, _ in listed) + struct.pack("<I", 0)
    tree = struct.pack("<I", len(folders))
    for folder in sorted(folders):
        tree += fstring(folder) + struct.pack("<I", len(folders[folder]))
        tree += b"".join(fstring(name) + struct.pack("<i", offsets[path]) for name, path in sorted(folders[folder]))
    head = fstring(mount) + struct.pack("<IQ", len(listed), seed)
    size = len(head) + 2 * (4 + 16 + 20) + 4 + len(encoded) + 4
    index, place = head, at + size
    for part in (hashes, tree):
        index += struct.pack("<IQQ", 1, place, len(part)) + hashlib.sha1(part).digest()
        place += len(part)
    index += struct.pack("<I", len(encoded)) + encoded + struct.pack("<I", 0)
    out.write(index + hashes + tree + b"\0" * 16 + struct.pack("<BIIQQ", 0, MAGIC, 11, at, len(index)) + hashlib.sha1(index).digest() + b"\0" * 160)
    return len(listed)


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (path, content) of one sorted partition to ``<path>/<name>``; any further partition is refused, unless ``parts`` is set."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.name = options["path"], options.get("name", "merged_P.pak")
        self.mount, self.overwrite = options.get("mount", "../../../"), overwrite
        self.parts = str(options.get("parts", "false")).lower() == "true"
        if not self.name.endswith("_P.pak"):
            raise ArchiveError("the name must end with _P.pak")

    def write(self, iterator):
        fs, folder = located(self.folder)
        fs.create_dir(folder, recursive=True)
        staged = f"{folder}/.{uuid.uuid4().hex}.partial"
        first: list[str] = []

        def rows():
            for batch in iterator:
                for path, content in zip(batch.column("path"), batch.column("content"), strict=True):  # one entry at a time as Python bytes
                    first or first.append(path.as_py().lower())
                    yield path.as_py(), content.as_py()

        with fs.open_output_stream(staged) as out:
            count = write_archive(out, self.mount, rows())
        with fs.open_input_file(staged) as f:  # as strict as any reader, in the task that wrote it
            footer, _, entries = read_index(f, f.size())
            for e in entries:
                read_entry(f, footer, e)
        return Written(staged, count, first[0] if first else "")

    def commit(self, messages):
        fs, folder = located(self.folder)
        told = [m for m in messages if m is not None]
        full = sorted((m for m in told if m.count), key=lambda m: m.first) or told[:1]
        names = [f"{folder}/{self.name}"]
        if self.parts:
            names = [f"{folder}/{self.name.removesuffix('_P.pak')}_{n:06}_P.pak" for n in range(len(full))]
        exists = not self.overwrite and any(x.type != pafs.FileType.NotFound for x in fs.get_file_info(names))
        if len(full) != len(names) or exists:
            self.abort(messages)
            raise ArchiveError("the archive exists" if exists else "sort the rows into one partition")
        for m, target in zip(full, names, strict=True):
            fs.move(m.staged, target)
        self.abort([m for m in told if m not in full])

    def abort(self, messages):
        fs, _ = located(self.folder)
        for m in messages:
            if m is not None and fs.get_file_info(m.staged).type == pafs.FileType.File:
                fs.delete_file(m.staged)


class Written(WriterCommitMessage):
    def __init__(self, staged: str, count: int, first: str):
        self.staged, self.count, self.first = staged, count, first


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "overlay_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, overwrite)


def split(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (path, content) in sorted partitions of about ``part_bytes``, for the option ``parts``."""
    total = rows.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    key = F.lower("path")
    return rows.repartitionByRange(max(1, -(-total // part_bytes)), key).sortWithinPartitions(key)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
