"""Removal of repeated substrings: every byte of a string of LENGTH bytes that also starts earlier.

1. Anchors. In each window of LENGTH bytes the leftmost least hash of its grams
   of GRAM bytes is its anchor; equal windows have equal anchors at equal places,
   so only windows whose anchor occurs twice can repeat. Consecutive windows of
   one anchor are a fragment. Tasks send of each fragment its hashes and place to
   the bucket of its anchor; of equal ones, which are told by 128 bits of hashes,
   only the first they meet, and the places of the others (copies) aside.
2. Buckets. Every different fragment that has copies goes on with its bytes, and
   so does every one that shares with another of its anchor the whole longer side
   that a common window would have. Those that only have copies need no others
   beside them; neighbours of one text go on as one stretch.
3. Suffix arrays. Per shard of such fragments the Burrows-Wheeler transform is
   extended backward breadth first from the empty string, interval by interval;
   each round settles the places where the common prefix of neighbours has the
   next length, and the rounds stop at LENGTH. What is not settled by then is
   equal in LENGTH bytes: an interval is a class of windows, whose first place
   stays. All others are cut: those of other fragments by the interval, those of
   copies because their fragment is in the transform.

A suffix array takes SHARD_BYTES at most. An anchor with more than that (the
edge of a passage that very many documents share), or with more than HEAVY
different fragments in one block, is beyond it: its windows go, as 128-bit
hashes, through a grouped minimum that is combined map-side, which gives the
same classes. A task that meets such an anchor leaves a mark in the bucket, so
that all other fragments of that anchor go the same way.

Defined results
- A null or empty text has no bytes and loses none.
- Every row is cut by its own text. Rows are ordered by id, a null id after all
  others, and rows of one id, or of none, by a hash of the text. Rows that repeat
  both id and text (or have no id and one text) are one document: all lose what
  the first loses.
- Texts of any length are worked on whole; an empty table gives no rows; other
  columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import carried, documents, held, text_bytes, with_text_batches, written

LENGTH = 100
GRAM = 30
#: Half of what a window has beside its anchor: all of one side or the other of two equal windows is equal.
SIDE = (LENGTH - GRAM) // 2
#: Different fragments of an anchor in one task from which it isn't gathered any more.
HEAVY = 64
#: Bytes of text that a task works on at once, and the most that one suffix array takes.
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 1 << 19
#: Entries that a task holds before it sends them to their buckets.
HELD_ENTRIES = 500_000
#: Bytes of input per bucket of anchors.
BUCKET_BYTES = 64_000_000
LEAST_BUCKETS = 64
NULL_ID = np.iinfo(np.int64).max
_PLACE_BITS = 24

CUT, ASK, ASK_WINDOWS, WINDOW, COPY, CLASSED, ALONE = 0, 1, 2, 3, 4, 5, 6
#: Bytes of a stretch of neighbouring fragments, about.
STRETCH_BYTES = 1 << 15
_FOUND = "kind int, id_key long, row_key long, start long, n long, key long, key2 long"
_FOUND_NAMES = ["kind", "id_key", "row_key", "start", "n", "key", "key2"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Hashes of substrings as differences of prefix sums, modulo 2 ** 64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = np.uint64(pow(int(self.base), -1, 2**64))
            many = np.full(n, self.base), np.full(n, inverse)
            for x in many:
                x[0] = 1
            self.powers, self.inverses = (np.multiply.accumulate(x) for x in many)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, starts, ends) -> np.ndarray:
        return _mixed((prefixes[ends] - prefixes[starts]) * self.inverses[starts])


def _rolling() -> list[_Rolling]:
    return [_Rolling(seed) for seed in (1, 2, 3)]


def _fragments(data: np.ndarray, ends: np.ndarray):
    """Fragments of texts that lie one after the other: start, windows, anchor, hash, hashes of both sides."""
    rolling, n = held(_rolling)[0], len(data)
    nothing = *(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)), np.zeros((2, 0), np.uint16)
    if n < LENGTH:
        return nothing
    prefixes = rolling.prefixes(data)
    grams = n - GRAM + 1
    # differences of neighbouring prefix sums are slices, which are faster than gathers
    hashes = _mixed((prefixes[GRAM:] - prefixes[:grams]) * rolling.inverses[:grams])
    least = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(grams, dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: step - width], least[width - step :])
    place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    inside = np.ones(len(place) + 1, bool)
    inside[-1] = False
    for end in ends[:-1]:  # windows that reach into the next text
        inside[max(0, end - LENGTH + 1) : end] = False
    begins = inside[:-1].copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~inside[:-2]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return nothing
    # a fragment ends before the next one, or where windows leave the text
    left = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    stops = np.minimum(np.append(starts[1:], len(place)), left[np.searchsorted(left, starts, side="right")])
    at = place[starts]
    # 0 where the text ends before the side does
    text = np.searchsorted(ends, starts, side="right")
    sides = np.zeros((2, len(at)), np.uint16)
    for side, low, high in ((0, at - SIDE, at + GRAM), (1, at, at + GRAM + SIDE)):
        whole = (low >= np.append(0, ends)[text]) & (high <= ends[text])
        sides[side, whole] = rolling.of(prefixes, low[whole], high[whole]) % np.uint64(65535) + np.uint64(1)
    return starts, stops - starts, hashes[at], rolling.of(prefixes, starts, stops + LENGTH - 1), sides


def _window_hashes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    """Both hashes of all windows of fragments of ``data``, one after the other."""
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    hashes = [r.of(r.prefixes(data), at, at + LENGTH).view(np.int64) for r in held(_rolling)[1:]]
    return at, hashes


def _first(*keys: np.ndarray, place: tuple[np.ndarray, ...]):
    """Sorted order, whether an entry begins a group of equal keys, and whether it is later than the group's first."""
    order = np.lexsort((*reversed(place), *reversed(keys)))
    new, later = np.ones(len(order), bool), np.zeros(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        for p in place:
            later |= p[order] != p[head]
    return order, new, later


def _any(flags: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Whether a group, each of which begins where ``new``, has a flag."""
    return np.logical_or.reduceat(flags, np.flatnonzero(new)) if len(flags) else flags


#: Anchor, content, id, row, start, windows, whether it has copies, sides.
_PARTS = (np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.bool_, np.uint16, np.uint16)


def _packed(parts) -> bytes:
    return b"".join(np.ascontiguousarray(p, t).tobytes() for p, t in zip(parts, _PARTS, strict=True))


def _unpacked(blob: bytes):
    n, at = len(blob) // sum(np.dtype(t).itemsize for t in _PARTS), 0
    for t in _PARTS:
        yield np.frombuffer(blob, t, n, at)
        at += n * np.dtype(t).itemsize


def _found(kind: int, id_key, row_key, start, n, key=None, key2=None) -> pa.RecordBatch:
    zero = np.zeros(len(id_key), np.int64)
    columns = [id_key, row_key, start, n, zero if key is None else key, zero if key2 is None else key2]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(id_key), kind, np.int32)), *(pa.array(np.asarray(c).astype(np.int64, copy=False)) for c in columns)], _FOUND_NAMES)


def _joined(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The same bytes in as few runs as possible."""
    if not len(doc):
        return doc, row, start, end
    order = np.lexsort((start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order], end[order]
    other = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    group = np.cumsum(np.append(True, other))
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new = np.append(True, other | (start[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], row[new], start[new], reach[last]


def _cuts(doc, row, start, end) -> pa.RecordBatch:
    doc, row, start, end = _joined(*(np.asarray(x, np.int64) for x in (doc, row, start, end)))
    return _found(CUT, doc, row, start, end - start)


class _Block:
    """Texts (or stretches of long ones) of a task, worked on together."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.held: list[tuple] = []
        self._empty()

    def _empty(self) -> None:
        self.parts: list[bytes] = []
        self.rows: list[tuple[int, int]] = []
        self.offsets: list[int] = []
        self.size = 0

    def add(self, row: tuple[int, int], text: bytes) -> Iterator[pa.RecordBatch]:
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK_BYTES):
            part = text[at : at + BLOCK_BYTES + LENGTH - 1] if len(text) > BLOCK_BYTES else text
            if self.size + len(part) > BLOCK_BYTES + LENGTH:
                yield from self.flush()
            self.parts.append(part)
            self.rows.append(row)
            self.offsets.append(at)
            self.size += len(part)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, kind, blob): copies and heavy windows; entries are held."""
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        ends = np.cumsum([len(p) for p in self.parts]).astype(np.int64)
        starts, counts, anchor, content, sides = _fragments(data, ends)
        text = np.searchsorted(ends, starts, side="right")
        begin = np.append(0, ends)[:-1]
        doc, row = np.array(self.rows, np.int64).reshape(-1, 2).T[:, text]
        start = starts - begin[text] + np.array(self.offsets, np.int64)[text]
        self._empty()
        order, new, later = _first(anchor, content, place=(doc, row, start))
        kept = order[new]
        copied = _any(later, new)
        # anchors with very many different fragments
        _, which, many = np.unique(anchor[kept], return_inverse=True, return_counts=True)
        heavy = many[which] > HEAVY
        windows = kept[heavy]
        if len(windows):
            at, (h1, h2) = _window_hashes(data, starts[windows], counts[windows])
            w_doc, w_row = (np.repeat(x[windows], counts[windows]) for x in (doc, row))
            w_start = at + np.repeat(start[windows] - starts[windows], counts[windows])
            w_order, w_new, w_later = _first(h1, h2, place=(w_doc, w_row, w_start))
            # equal fragments of these anchors are as settled as equal windows
            gone, same = w_order[w_later], order[later & np.isin(anchor[order], anchor[windows])]
            cut = _cuts(np.append(w_doc[gone], doc[same]), np.append(w_row[gone], row[same]), np.append(w_start[gone], start[same]), np.append(w_start[gone], start[same] + counts[same] - 1) + LENGTH)
            yield self._row(int(h1[0] % self.buckets), CUT, np.stack([np.asarray(cut.column(n)) for n in ("id_key", "row_key", "start", "n")]).tobytes())
            one = w_order[w_new]
            yield self._row(int(h1[0] % self.buckets), WINDOW, np.stack([w_doc[one], w_row[one], w_start[one], h1[one], h2[one]]).tobytes())
            later &= ~np.isin(anchor[order], anchor[windows])
            _, mark = np.unique(anchor[windows], return_index=True)
            marks = windows[mark]
        else:
            marks = windows
        yield from self._copies(anchor, content, doc, row, start, counts, at=order[later])
        # a mark is an entry of no windows
        sent = np.concatenate([kept[~heavy], marks])
        none = np.zeros(len(marks), np.int64)
        self.held.append((anchor[sent], content[sent], doc[sent], row[sent], start[sent], np.concatenate([counts[kept[~heavy]], none]), np.concatenate([copied[~heavy], none > 0]), *sides[:, sent]))
        if sum(len(x[0]) for x in self.held) >= HELD_ENTRIES:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        """What is held, bucket by bucket; of equal entries the first, the others as copies."""
        if not self.held:
            return
        parts = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held = []
        anchor, content, doc, row, start, n, copied = parts[:7]
        order, new, later = _first(anchor, content, n == 0, place=(doc, row, start))
        yield from self._copies(anchor, content, doc, row, start, n, at=order[later & (n[order] > 0)])
        one = order[new]
        parts = [*(p[one] for p in parts[:6]), _any(copied[order] | later, new), *(p[one] for p in parts[7:])]
        bucket = (parts[0] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        parts, bucket = [p[order] for p in parts], bucket[order]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield self._row(int(bucket[a]), ASK, _packed([p[a:b] for p in parts]))

    def _copies(self, anchor, content, doc, row, start, n, at) -> Iterator[pa.RecordBatch]:
        if len(at):
            blob = np.stack([doc[at], row[at], start[at], n[at], anchor[at].view(np.int64), content[at].view(np.int64)]).tobytes()
            yield self._row(int(anchor[at[0]] % np.uint64(self.buckets)), COPY, blob)

    @staticmethod
    def _row(bucket: int, kind: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "kind", "entries"])


def _row_keys(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    return zip(batch.column("id_key").to_pylist(), batch.column("row_key").to_pylist(), strict=True)


def _anchored(buckets: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(buckets)
        for batch in batches:
            for row, text in zip(_row_keys(batch), text_bytes(batch.column("text")), strict=True):
                if len(text) >= LENGTH:
                    yield from block.add(row, text)
        if block.parts:
            yield from block.flush()
        yield from block.send()

    return anchors


def _resolved(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's entries: copies, and the fragments that go on to suffix arrays."""
    gathered = []
    for batch in rows:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            if kind == ASK:
                gathered.append(list(_unpacked(blob)))
                continue
            values = np.frombuffer(blob, np.int64)
            if kind == WINDOW:
                doc, row, start, h1, h2 = values.reshape(5, -1)
                yield _found(WINDOW, doc, row, start, np.full(len(doc), LENGTH), h1, h2)
            else:
                yield _found(kind, *values.reshape(4 if kind == CUT else 6, -1))
    if not gathered:
        return
    anchor, content, doc, row, start, n, copied, *sides = (np.concatenate(x) for x in zip(*gathered, strict=True))
    gathered.clear()
    _, which, many = np.unique(anchor, return_inverse=True, return_counts=True)
    marked = np.zeros(len(many), bool)
    marked[which[n == 0]] = True
    used = ((many > 1) | marked)[which] & (n > 0) | copied
    heavy = marked[which][used]
    anchor, content, doc, row, copied = anchor[used], content[used], doc[used], row[used], copied[used]
    start, n = start[used].astype(np.int64), n[used].astype(np.int64)
    sides = [s[used] for s in sides]
    order, new, later = _first(anchor, content, place=(doc, row, start))
    copy = order[later]
    yield _found(COPY, doc[copy], row[copy], start[copy], n[copy], anchor[copy].view(np.int64), content[copy].view(np.int64))
    one = order[new]
    if not len(one):
        return
    # fragments can share a window only if they share the whole side of the anchor that has most of it
    copied = _any(copied[order] | later, new)
    several = np.zeros(len(one), bool)
    for s in sides:
        _, which, many = np.unique(_mixed(anchor[one] + s[one]), return_inverse=True, return_counts=True)
        several |= (many > 1)[which] & (s[one] > 0)
    # no suffix array takes an anchor of more than SHARD_BYTES
    _, which = np.unique(anchor[one], return_inverse=True)
    total = np.bincount(which, np.where(several, n[one] + LENGTH, 0))
    windows = heavy[one] | (several & (total > SHARD_BYTES)[which])
    for kind, own in ((ASK_WINDOWS, one[windows]), (ASK, one[several & ~windows]), (ALONE, one[copied & ~several & ~windows])):
        yield _found(kind, doc[own], row[own], start[own], n[own], anchor[own].view(np.int64), content[own].view(np.int64))


def _stretches(row: int, fragments: list[dict]) -> list[dict]:
    """Neighbouring fragments of a text as one, each with a key of its own."""
    out: list[dict] = []
    for x in sorted(fragments, key=lambda x: x["start"]):
        if out and out[-1]["start"] + out[-1]["n"] == x["start"] and out[-1]["n"] < STRETCH_BYTES:
            out[-1]["n"] += x["n"]
        else:
            out.append({"start": x["start"], "n": x["n"], "key": (row ^ x["start"] * 0x9E3779B97F4A7C15) % (1 << 63), "key2": 0})
    return out


def _fetched(shards: int):
    """The bytes of asked fragments (kind ASK), or the hashes of their windows."""
    names = [*_FOUND_NAMES, "shard", "bytes"]

    def bare(x: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.int32()), pa.nulls(x.num_rows, pa.binary())], names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for (doc, row), text, asked in zip(_row_keys(batch), text_bytes(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                if before == (doc, row):  # a row that repeats id and text gives the same bytes
                    continue
                before = doc, row
                asked = [x for x in asked if x["start"] + x["n"] + LENGTH - 1 <= len(text)]
                plain, wide, alone = ([x for x in asked if x["kind"] == k] for k in (ASK, ASK_WINDOWS, ALONE))
                classed = wide + alone
                plain += _stretches(row, alone)
                if plain:
                    found = _found(ASK, [doc] * len(plain), [row] * len(plain), *([x[k] for x in plain] for k in ("start", "n", "key", "key2")))
                    pieces = [text[x["start"] : x["start"] + x["n"] + LENGTH - 1] for x in plain]
                    shard = pa.array([x["key"] % shards for x in plain], pa.int32())
                    yield pa.RecordBatch.from_arrays([*found.columns, shard, pa.array(pieces, pa.binary())], names)
                if wide:
                    starts, counts = (np.array([x[k] for x in wide], np.int64) for k in ("start", "n"))
                    at, (h1, h2) = _window_hashes(np.frombuffer(text, np.uint8), starts, counts)
                    found = _found(WINDOW, np.full(len(at), doc), np.full(len(at), row), at, np.full(len(at), LENGTH), h1, h2)
                    yield bare(found)
                if classed:
                    yield bare(_found(CLASSED, [doc] * len(classed), [row] * len(classed), *([x[k] for x in classed] for k in ("start", "n", "key", "key2"))))

    return fetch


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, or a few more (prefix doubling)."""
    rank, n = symbols.astype(np.int64), len(symbols)
    bits = np.int64(n.bit_length())
    places, done = np.arange(n), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - done] = rank[done:] + 1
        key = (rank << bits) | ahead  # symbols are numbered below n, so both fit
        if 3 * bits < 64:  # a plain sort with the place in the low bits is faster than sorting places
            key = np.sort((key << bits) | places)
            order = key & ((1 << bits) - 1)
            key >>= bits
        else:
            order = np.argsort(key)
            key = key[order]
        ranks = np.cumsum(np.append(0, key[1:] != key[:-1]))
        rank[order] = ranks
        done *= 2
        if done >= depth or ranks[-1] == n - 1:
            return order


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and class of every string of ``length`` bytes; equal strings have equal classes.

    Backward extension on the Burrows-Wheeler transform: an interval of suffixes
    that begin with some string is extended by every symbol before it; the
    extension of a string of length l is kept if it is the first to end at its
    place, where the common prefix of neighbours then has length l.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)  # with a separator of its own after each text
    n = int(ends[-1])
    symbols = np.zeros(n, np.int64)
    inner = np.ones(n, bool)
    inner[ends - 1] = False
    symbols[inner] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + len(texts)
    symbols[~inner] = np.arange(len(texts))
    # ranks of doubling need small numbers: the symbols that occur, in order
    symbols = (np.cumsum(np.bincount(symbols) > 0) - 1)[symbols]
    order = suffix_order(symbols, length + 1)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    step = back[order - 1]  # where the suffix one symbol longer stands; of the first, the last
    leading = symbols[order]
    bits = np.int64(n.bit_length())

    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    rows, interval = np.arange(n), np.zeros(n, np.int64)
    for _ in range(length):
        if not len(rows):
            break
        # of each interval, the rows that a symbol was put before lie side by side
        key = np.sort((interval << bits) | step[rows])
        at, interval = key & ((1 << bits) - 1), key >> bits
        ahead = leading[at]
        new = np.append(True, (interval[1:] != interval[:-1]) | (ahead[1:] != ahead[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        right = at[last] + 1
        fresh = ~settled[right]
        settled[right] = True
        kept = np.repeat(fresh, last - first + 1)
        rows, interval = at[kept], (np.cumsum(new) - 1)[kept]
    group = np.cumsum(settled[:-1])
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(n) - (ends - sizes - 1)[text]
    whole = (place + length <= sizes[text])[order]
    return text[order[whole]], place[order[whole]], group[whole]


def _sharded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts among the fragments of a shard, and which fragments its transforms hold; those of one anchor share one."""
    table = pa.Table.from_batches(list(rows)).sort_by("key")
    key = table.column("key").to_numpy()
    doc, row, start, n, key2 = (table.column(c).to_numpy() for c in ("id_key", "row_key", "start", "n", "key2"))
    pieces = table.column("bytes").to_pylist()
    bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    sizes = [sum(len(p) + 1 for p in pieces[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    size, begin = 0, 0
    for own, following, b in zip(sizes, [*sizes[1:], SHARD_BYTES + 1], bounds[1:], strict=True):
        size += own
        if size + following > SHARD_BYTES:
            text, place, group = repeated_windows(pieces[begin:b], LENGTH)
            classed = np.unique(text) + begin
            text, place, group = (x[np.bincount(group)[group] > 1] for x in (text, place, group))
            w_doc, w_row, w_start = doc[begin:b][text], row[begin:b][text], start[begin:b][text] + place
            order, _, later = _first(group, place=(w_doc, w_row, w_start))
            cut = order[later]
            yield _cuts(w_doc[cut], w_row[cut], w_start[cut], w_start[cut] + LENGTH)
            yield _found(CLASSED, doc[classed], row[classed], start[classed], n[classed], key[classed], key2[classed])
            size, begin = 0, b


def _remains(as_text: bool):
    """What is left of each text; as text, without the bytes of characters that a cut left incomplete."""

    def remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cuts in zip(text_bytes(batch.column("text")), batch.column("cuts").to_pylist(), strict=True):
                gone = np.array([(c["start"], min(c["start"] + c["n"], len(text))) for c in cuts or () if c["start"] < len(text)], np.int64).reshape(-1, 2)
                one = np.zeros(len(gone), np.int64)
                *_, a, b = _joined(one, one, gone[:, 0], gone[:, 1])
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
                rest = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if len(a) else text
                shown = rest.decode("utf-8", "ignore") if as_text else rest
                rows.append((len(text), len(text) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), shown))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
            more = batch.select([n for n in batch.schema.names if n == "row"])
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *more.columns]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest", *more.schema.names])

    return remains


def _keyed(source: DataFrame) -> DataFrame:
    return source.withColumn("id_key", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("row_key", F.xxhash64("doc_id", "text"))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(id_key, row_key, start, n): stretches to cut from rows (id_key, row_key, text); they may overlap."""
    with_text_batches(keyed.sparkSession)
    keyed = keyed.select("id_key", "row_key", "text")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    entries = keyed.mapInArrow(_anchored(buckets), "bucket int, kind int, entries binary")
    found = written(entries.groupBy("bucket").applyInArrow(_resolved, _FOUND), "substrings-found")

    asked = found.where(F.col("kind").isin(ASK, ASK_WINDOWS, ALONE))
    per_row = asked.groupBy("id_key", "row_key").agg(F.collect_list(F.struct("kind", "start", "n", "key", "key2")).alias("asked"))
    size = found.where(F.col("kind").isin(ASK, ALONE)).agg(F.sum(F.when(F.col("kind") == ASK, F.col("n") + LENGTH).otherwise(F.col("n")))).first()[0] or 0
    shards = max(LEAST_BUCKETS, size // (4 * SHARD_BYTES))
    # written, so that both sides of the join are plain shuffles, which adaptive execution can split
    with_texts = keyed.join(written(per_row, "substrings-asked"), ["id_key", "row_key"])
    fetched = written(with_texts.mapInArrow(_fetched(shards), _FOUND + ", shard int, bytes binary"), "substrings-fetched")
    among = written(fetched.where(F.col("kind") == ASK).groupBy("shard").applyInArrow(_sharded, _FOUND), "substrings-classes")

    classed = among.unionByName(fetched.drop("shard", "bytes")).where(F.col("kind") == CLASSED).select("key", "key2")
    copies = found.where(F.col("kind") == COPY).join(classed, ["key", "key2"]).withColumn("n", F.col("n") + LENGTH - 1)
    windows = found.where(F.col("kind") == WINDOW).unionByName(fetched.where(F.col("kind") == WINDOW).drop("shard", "bytes"))
    place = F.struct("id_key", "row_key", "start")
    first = windows.groupBy("key", "key2").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # written, so that both sides of the join are plain shuffles, which adaptive execution can split
    later = windows.join(written(first, "substrings-windows"), ["key", "key2"]).where(place != F.col("first"))
    cuts = [x.where(F.col("kind") == CUT) for x in (found, among)]
    names = ["id_key", "row_key", "start", "n"]
    return cuts[0].select(names).union(cuts[1].select(names)).union(copies.select(names)).union(later.select(names))


def without_repeats(docs: DataFrame, *, carry: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and what remains (rest) of every document; with ``carry`` also the row.

    ``rest`` is binary; ``as_text`` makes it a string, without what a cut left of a character.
    """
    source = documents(docs, carry=carry)
    keyed = _keyed(source)
    cuts = repeated_spans(keyed).groupBy("id_key", "row_key").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    # written, so that both sides of the join are plain shuffles, which adaptive execution can split
    joined = keyed.join(written(cuts, "substrings-cuts"), ["id_key", "row_key"], "left").drop("id_key", "row_key")
    kind = "string" if as_text else "binary"
    return joined.mapInArrow(_remains(as_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest {kind}" + carried(source, carry))
