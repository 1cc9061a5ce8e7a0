"""WARC archives as a PySpark data source: ``spark.read.format("warc")``.

Reading plans one partition per archive file. Predicates on ``record_type``,
``target_uri``, ``payload_digest``, ``record_id`` and ``refers_to`` are pushed
down. The headers of a record are parsed first; a record that the predicates
exclude, or whose payload isn't asked for (option ``payload``: ``false``), is
skipped without keeping any of it: by its Content-Length where the file isn't
compressed, by the ``sl`` skip-lengths field of its gzip member where it has
one. Other gzip members, of one record or of many, are inflated to their end in
pieces, of which only headers and wanted payloads are kept. What is read to a
member's end is checked against its CRC.

Writing puts one gzip member per record into files of about ``file_mb``
megabytes. A file counts once the driver has listed it in the manifest on
commit, so that files of failed or repeated attempts are never read.

Defined results
- A null payload is written as an empty one. The header of a null target or
  digest is left out (read back as null). A target with control characters is
  written with them and its percent signs escaped, marked by a header of its
  own, and read back as it was. Folders without a manifest are read by their ``.warc``
  and ``.warc.gz`` files. An empty table writes a manifest without files.
- Cut-off records and malformed headers raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from strataweave.llm.common import written

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary, headers map<string,string>"
)
#: What the writer takes.
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload")
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_MANIFEST.json"
BATCH_BYTES = 8 << 20
HEAD_BYTES = 64 << 10
ESCAPED = "X-Target-URI-Escaped"
_GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """One gzip member whose header tells its own and its record's length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(record) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(packed) & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return _GZIP_HEAD + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": _line(row["target_uri"]),
        ESCAPED: "percent" if _line(row["target_uri"]) != row["target_uri"] else None,
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}" if row["payload_digest"] is not None else None,
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": f"<{row['refers_to']}>" if revisit and row["refers_to"] else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(text: str | None) -> str | None:
    """A header value: of a text with control characters, these and all percent signs are escaped."""
    if text is None or not any(c < " " or c == "\x7f" for c in text):
        return text
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\x7f%" else c for c in text)


def _target(headers: dict[str, str]) -> str | None:
    text = headers.get("WARC-Target-URI")
    return unquote(text) if text is not None and ESCAPED in headers else text


def _size(headers: dict[str, str]) -> int:
    told = headers.get("Content-Length", "")
    if not told.isdigit():
        raise ValueError(f"a record without a length: {headers.get('WARC-Record-ID')}")
    return int(told)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:] if line)


def _row(headers: dict[str, str], block: bytes | None) -> dict:
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    digest = headers.get("WARC-Payload-Digest")
    size, payload = None, None
    if block is not None:
        payload = block
        if headers.get("Content-Type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            told = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(told[0]) if told else len(payload)
        if headers.get("WARC-Type") == "revisit":
            payload = None
        size = size if size is not None else len(block)
    return {
        "record_id": bare("WARC-Record-ID"),
        "record_type": headers.get("WARC-Type"),
        "target_uri": _target(headers),
        "payload_digest": digest.removeprefix("sha1:") if digest else None,
        "refers_to": bare("WARC-Refers-To"),
        "payload_bytes": size,
        "payload": payload,
        "headers": headers,
    }


class _Inflated:
    """What a gzip member holds, read onwards."""

    def __init__(self, file):
        self.file, self.unpacker, self.buffer = file, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.unpacker.eof:
            return False
        data = self.unpacker.unconsumed_tail or self.file.read(HEAD_BYTES)
        if not data:
            raise ValueError("the archive ends inside a record")
        try:
            self.buffer += self.unpacker.decompress(data, 1 << 20)
        except zlib.error as e:
            raise ValueError(f"a damaged gzip member: {e}") from e
        return True

    def head(self) -> bytes | None:
        """The next record's headers; None at the member's end."""
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", seen)) < 0 or not self.buffer[:end].strip():
            if end >= 0:  # blank lines between records
                del self.buffer[: end + 4]
                seen = 0
                continue
            seen = max(0, len(self.buffer) - 3)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 4]
        return out.lstrip(b"\r\n")

    def read(self, n: int, keep: bool) -> bytes:
        """The next ``n`` bytes, or nothing, if they needn't be kept."""
        out = bytearray()
        while n:
            part = self.buffer[:n]
            del self.buffer[: len(part)]
            n -= len(part)
            if keep:
                out += part
            if n and not self._more():
                raise ValueError("the archive ends inside a record")
        return bytes(out)

    def end(self) -> int:
        """The place in the file after the member."""
        return self.file.tell() - len(self.unpacker.unused_data)


class _Stream:
    """Records of one archive: headers first, then the block or a skip over it."""

    def __init__(self, file, wants, with_payload: bool):
        self.file, self.wants, self.with_payload = file, wants, with_payload
        self.decoded = 0  # blocks that were decoded, for tests

    def _read(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) < n:
            raise ValueError("the archive ends inside a record")
        return data

    def __iter__(self) -> Iterator[dict]:
        while start := self.file.read(10):
            yield from self._packed(start) if start[:2] == b"\x1f\x8b" else self._plain(start)

    def _take(self, headers: dict[str, str]) -> bool:
        return all((_target(headers) if name == "WARC-Target-URI" else headers.get(name)) in values for name, values in self.wants.items())

    def _member(self, at: int) -> Iterator[dict]:
        self.file.seek(at)
        member = _Inflated(self.file)
        while (head := member.head()) is not None:
            headers = _headers(head)
            taken = self._take(headers)
            keep = taken and self.with_payload
            self.decoded += keep
            body = member.read(_size(headers), keep)
            if taken:
                yield _row(headers, body if keep else None)
        self.file.seek(member.end())

    def _plain(self, start: bytes) -> Iterator[dict]:
        head = bytearray(start)
        while b"\r\n\r\n" not in head:
            more = self.file.read(1024)
            if not more:
                if head.strip():
                    raise ValueError("the archive ends inside a record")
                return
            head += more
        block, _, rest = bytes(head).partition(b"\r\n\r\n")
        headers = _headers(block.lstrip(b"\r\n"))
        size = _size(headers)
        at = self.file.tell() - len(rest)
        if self._take(headers):
            self.file.seek(at)
            self.decoded += self.with_payload
            yield _row(headers, self._read(size) if self.with_payload else None)
        self.file.seek(at + size + 4)

    def _packed(self, start: bytes) -> Iterator[dict]:
        begin = self.file.tell() - len(start)
        extra = self._read(struct.unpack("<H", self._read(2))[0]) if start[3] == 4 else b""
        if extra[:2] != b"sl" or len(extra) != 12:  # any other member
            yield from self._member(begin)
            return
        packed, _ = struct.unpack("<II", extra[4:12])
        at = self.file.tell()
        unpacker = zlib.decompressobj(-15)
        got, tail, head, seen, crc = 0, b"", bytearray(), 0, 0
        while (end := head.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(head) - 3)
            if not tail:
                tail = self._read(min(packed - got, HEAD_BYTES))
                got += len(tail)
            more = unpacker.decompress(tail, 4096)  # without input, what was held back
            if not more and not tail:
                raise ValueError("the archive ends inside a record")
            head += more
            crc = zlib.crc32(more, crc)
            tail = unpacker.unconsumed_tail
        block, rest = bytes(head[:end]), bytes(head[end + 4 :])
        headers = _headers(block)
        if self._take(headers):
            body = None
            if self.with_payload:
                self.decoded += 1
                left = self._read(packed - got) if packed > got else b""
                more = unpacker.decompress(tail + left) + unpacker.flush()
                if zlib.crc32(more, crc) != struct.unpack("<I", self._read(4))[0]:
                    raise ValueError(f"a damaged record: {headers.get('WARC-Record-ID')}")
                body = (rest + more)[: _size(headers)]
                if len(body) < _size(headers):
                    raise ValueError("the archive ends inside a record")
            yield _row(headers, body)
        self.file.seek(at + packed + 8)


_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("headers", pa.map_(pa.string(), pa.string())),
    ]
)


class WarcReader(DataSourceReader):
    #: column -> (header, how its value reads there)
    PUSHED = {
        "record_type": ("WARC-Type", str),
        "target_uri": ("WARC-Target-URI", str),
        "payload_digest": ("WARC-Payload-Digest", "sha1:{}".format),
        "record_id": ("WARC-Record-ID", "<{}>".format),
        "refers_to": ("WARC-Refers-To", "<{}>".format),
    }

    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.wants: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                name, shown = self.PUSHED[f.attribute[0]]
                values = {shown(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.wants[name] = self.wants.get(name, values) & values
            else:
                yield f

    def partitions(self):
        fs, folder = _located(self.path)
        manifest = f"{folder}/{MANIFEST}"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read())
        else:
            names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.endswith((".warc", ".warc.gz"))]
        return [InputPartition(f"{self.path}/{name}") for name in sorted(names)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        fs, file = _located(partition.value)
        rows, size = [], 0
        with fs.open_input_file(file) as f:
            for row in _Stream(f, self.wants, self.with_payload):
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        rows = [r | {"headers": list(r["headers"].items())} for r in rows]
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(float(options.get("file_mb", 64)) * 1e6)

    def write(self, iterator):
        fs, folder = _located(self.path)
        fs.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = member(record_bytes(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return WarcFiles(names)

    def commit(self, messages):
        fs, folder = _located(self.path)
        fs.create_dir(folder, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, folder = _located(self.path)
        for m in messages:
            for name in m.names if m is not None else ():
                fs.delete_file(f"{folder}/{name}")


class WarcFiles(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(records: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Records (record_key, record_id, target_uri, payload) ready to be written.

    Of equal payloads of at least ``min_bytes``, the record of the largest key
    is the response and the others revisit it; records that repeat that key are
    responses too. A null key counts as the smallest. Other columns are dropped.
    """
    records = records.select("record_key", "record_id", "target_uri", "payload", F.sha1("payload").alias("sha1"))
    groups = (
        records.where(F.length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max(F.struct("record_key", "record_id")).alias("last"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("sha1", "last")
    )
    # written, so that both sides of the join are plain shuffles, which adaptive execution can split
    groups = written(groups, "payloads")
    revisits = F.col("last").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("last.record_key"))
    return records.join(groups, "sha1", "left").select(
        "record_id",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        _base32(F.col("sha1")).alias("payload_digest"),
        F.when(revisits, F.col("last.record_id")).alias("refers_to"),
        "payload",
    )


def _base32(sha1_hex):
    """Upper-case base32 of 160 bits in hex: eight groups of 20 bits, four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(letters), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])
