"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A row is the set of its word shingles. Rows with equal sets form a class at
once, which goes on as one node. SuperMinHash signatures are cut into bands, and
nodes that share a band's value share a bucket. No bucket is expanded into its
pairs. First every member is compared with STARS members of its bucket, and the
most similar of each is verified on the full sets; union-find in tasks turns the
links into labels (equal labels: connected). What then still lies apart from the
label most members of its bucket have, the guests, is compared with all of the
bucket by signature, block by block. Guests with a similar signature, and what
is similar to them, meet on full sets, again in blocks, so that no link between
members of a bucket is lost. Connected components of all links name the groups.

Blocks are cut from a range partitioning on bucket (or label) and a hash, so
that a bucket of any size is spread over tasks, in blocks of a bounded size.

Two sets of similarity 0.8 share none of the BANDS buckets with a probability
of (1 - 0.8 ** ROWS) ** BANDS = 5e-8; those that agree in fewer than
LEAST_AGREEMENT of the slots, which for them is as improbable, aren't verified.

Defined results
- A text without words, or null, has an empty set and is linked with nothing.
- A text of fewer words than a shingle has one shingle of all its words.
- Every row is a document of its own, linked by its own text, whether its id is
  null, unique or repeated. A group is named by the smallest id of its rows, or
  null if none has an id; ``kept`` tells whether the row's id is that name (a
  null id and a null name are equal).
- ``chosen`` marks the rows of each group's first set that have the group's
  name; ``first_of_groups`` keeps exactly one row of each group.
- An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import WordIndex, documents, held, text_bytes, with_text_batches, word_numbers, written
from strataweave.llm.components import connected_components

BANDS, ROWS = 32, 4
STARS = 3
LEAST_AGREEMENT = 0.6
#: Signatures of a block; sets and bytes of a block of sets.
BLOCK_SIGNATURES = 512
BLOCK_SETS, BLOCK_BYTES = 256, 4 << 20
#: Links that one union-find takes.
FOREST_LINKS = 250_000
_COLUMNS = 4096

#: A prime, so that ``start + round * step`` is a permutation of the slots.
SLOTS = 131
_ROUND = np.uint64(0x9E3779B97F4A7C15)
_UNSEEN = np.uint64(2**64 - 1)
#: Elements that a step of several rounds has about.
_STEP = 512
_SMALL_PRODUCT = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_minhash(elements: np.ndarray) -> np.ndarray:
    """SLOTS values of a set of 64-bit numbers.

    Each element visits the slots in an order of its own; its value in the slot
    of round j lies in [j, j + 1). A slot keeps the least value. Once every slot
    has been visited, no later round can lower one, and the rounds end.
    """
    out = np.full(SLOTS, _UNSEEN)
    if not len(elements):
        return out
    order = mixed(elements ^ _ROUND)
    step = (order >> np.uint64(32)) % np.uint64(SLOTS - 1) + np.uint64(1)
    start = (order & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS)
    width = min(SLOTS, max(1, _STEP // len(elements)))
    for first in range(0, SLOTS, width):
        rounds = np.arange(first, min(first + width, SLOTS), dtype=np.uint64)[:, None]
        slots = (start + rounds * step) % np.uint64(SLOTS)
        values = (mixed(elements + rounds * _ROUND) >> np.uint64(8)) | (rounds << np.uint64(56))
        np.minimum.at(out, slots.ravel().astype(np.int64), values.ravel())
        if out.max() < np.uint64(first + width) << np.uint64(56):
            break
    return out


class _Shingles:
    """Sets of word shingles as sorted 64-bit numbers."""

    def __init__(self) -> None:
        self._empty()

    def _empty(self) -> None:
        self.index, self.hashes = WordIndex(), np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes], width: int) -> list[np.ndarray]:
        if self.index.full():
            self._empty()
        found = [word_numbers(self.index, t.lower().split()) for t in texts]
        new, self.index.new = self.index.new, []
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return [self._set(self.hashes[n], width) for n in found]

    @staticmethod
    def _set(words: np.ndarray, width: int) -> np.ndarray:
        if not len(words):
            return words
        width = min(width, len(words))
        n = len(words) - width + 1
        out = words[:n]
        for i in range(1, width):
            out = mixed(out * _ROUND + np.uint64(i)) + words[i : i + n]
        return np.unique(mixed(out))


def _sketched(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = held(_Shingles)
        for batch in batches:
            sets = shingles.sets(text_bytes(batch.column("text")), width)
            signatures = np.array([super_minhash(s) for s in sets]).reshape(-1, SLOTS)
            bands = pa.array(_bands(signatures).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32), bands),
                    pa.array([x.tobytes() for x in signatures.astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "row_key", "n_shingles", "digest", "bands", "signature"],
            )

    return sketch


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _bands(signatures: np.ndarray) -> np.ndarray:
    """BANDS numbers for each signature, one for every ROWS slots; different bands never share one but by chance."""
    rows = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(rows), 1))
    for i in range(ROWS):
        out = mixed(out * _ROUND + rows[:, :, i])
    return out.view(np.int64)


def _set_blobs(width: int):
    """The full sets of texts (node, digest, text); a text that isn't the node's, by a chance of its key, has another digest."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = held(_Shingles)
        for batch in batches:
            sets = shingles.sets(text_bytes(batch.column("text")), width)
            own = pa.array([_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            columns = [batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in columns], ["node", "elements"])

    return blobs


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each member and star that agree in LEAST_AGREEMENT of the slots: x, y, number of the star, agreement."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, own = np.asarray(batch.column("node")), _signatures(batch.column("signature"))
        for n in range(STARS):
            star = batch.column(f"star{n}")
            y = np.asarray(star.field("node"))
            agreement = (own == _signatures(star.field("signature"))).mean(axis=1)
            kept = (agreement >= LEAST_AGREEMENT) & (x != y)
            columns = [x[kept], y[kept], np.full(int(kept.sum()), n, np.int32), agreement[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "star", "agreement"])


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("a_elements").to_pylist(), batch.column("b_elements").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(kept, pa.bool_())) for n in ("x", "y")], ["x", "y"])

    return linked


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (x, y) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("x"), F.col("elements").alias("a_elements"))
    right = sets.select(F.col("node").alias("y"), F.col("elements").alias("b_elements"))
    return pairs.select("x", "y").join(left, "x").join(right, "y").mapInArrow(_linked(percent), "x long, y long")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (x, y) to links (node, root) that connect the same, FOREST_LINKS at a time."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    def stars() -> pa.RecordBatch:
        rooted = [(x, root(x)) for x in list(above)]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[n] for p in rooted], pa.int64()) for n in (0, 1)], ["node", "root"])

    links = 0
    for batch in batches:
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            a, b = root(x), root(y)
            above[max(a, b)] = min(a, b)
        links += batch.num_rows
        if links >= FOREST_LINKS:
            yield stars()
            links = 0
    yield stars()


def _labels(links: DataFrame, final: bool) -> DataFrame:
    """(node, component) of the ends of links (x, y); unless ``final``, what is connected may have several labels.

    One task for every FOREST_LINKS links contracts them. Where one held them
    all, its roots are the components; else rounds over the contracted links
    join what the tasks left apart.
    """
    tasks = -(-links.count() // FOREST_LINKS) or 1
    rooted = written(links.coalesce(tasks).mapInArrow(_contracted, "node long, root long"), "rooted")
    if final and tasks > 1:
        return written(connected_components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))), "groups")
    if tasks == 1:
        return rooted.withColumnRenamed("root", "component")
    return written(rooted.groupBy("node").agg(F.min("root").alias("component")), "labels")


def _blocked(key: str, fields: dict[str, int | None], most_rows: int, most_bytes: int):
    """Sorted rows to blocks: rows of one (key, guest) that lie side by side, with ``fields`` joined to blobs.

    A field's number is its length in bytes in each row, None if that varies; then its lengths are kept too.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId() << 32, 0
        group, rows, size = None, [], 0

        def flush() -> pa.RecordBatch:
            columns = {key: pa.array([group[0]], pa.int64()), "guest": [group[1]], "main": pa.array([group[2]], pa.int64()), "block": pa.array([part + made], pa.int64()), "n": pa.array([len(rows)], pa.int32())}
            for i, f in enumerate(fields):
                columns[f] = pa.array([b"".join(r[i] for r in rows)], pa.binary())
            columns["lengths"] = pa.array([np.array([len(r[-1]) for r in rows], np.int64).tobytes()], pa.binary())
            return pa.RecordBatch.from_pydict({n: columns[n] for n in ("block", key, "main", "guest", "n", *fields, "lengths") if n in columns})

        for batch in batches:
            table = [batch.column(f) for f in fields]
            table = [c.to_pylist() if pa.types.is_binary(c.type) else [int(x).to_bytes(8, "little", signed=True) for x in c.to_pylist()] for c in table]
            for of, *values in zip(batch.column(key).to_pylist(), batch.column("guest").to_pylist(), batch.column("main").to_pylist(), *table, strict=True):
                pass
        yield from ()

    return block


_BLOCK = "block long, key long, guest boolean, main long, nodes binary, components binary, lengths binary, data binary"


def _blocked(most_rows: int, most_bytes: int):
    """Rows (key, guest, main, node, component, data), sorted by key and guest, to blocks of equal key and guest."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        group, rows, size = None, [], 0

        def made() -> pa.RecordBatch:
            nodes, components, lengths = (np.array(x, np.int64).tobytes() for x in ([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows]))
            values = (number, *group, nodes, components, lengths, b"".join(r[2] for r in rows))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * 4)
            names = ("block", "key", "guest", "main", "nodes", "components", "lengths", "data")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for key, guest, main, *row in zip(*(batch.column(n).to_pylist() for n in ("key", "guest", "main", "node", "component", "data")), strict=True):
                if rows and (group != (key, guest, main) or len(rows) >= most_rows or size + len(row[2]) > most_bytes):
                    yield made()
                    number, rows, size = number + 1, [], 0
                group = (key, guest, main)
                rows.append(row)
                size += len(row[2])
        if rows:
            yield made()

    return block


def _meetings(rows: DataFrame, name: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Each pair of blocks of a key of which one is of guests, as columns a and b (of guests: a)."""
    ordered = rows.repartitionByRange("key", "guest", F.xxhash64("node")).sortWithinPartitions("key", "guest")
    blocks = written(ordered.mapInArrow(_blocked(most_rows, most_bytes), _BLOCK), name)
    side = F.struct("block", "guest", "main", "nodes", "components", "lengths", "data")
    a, b = blocks.where("guest").select("key", side.alias("a")), blocks.select("key", side.alias("b"))
    return a.join(b, "key").where("not b.guest or a.block <= b.block").select("a", "b")


def _side(struct: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(struct[n], np.int64) for n in ("nodes", "components", "lengths"))


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of signatures, the nodes that agree in LEAST_AGREEMENT of the slots with one of another label."""
    least = int(np.ceil(LEAST_AGREEMENT * SLOTS))
    for batch in batches:
        found: set[tuple[int, int, bool]] = set()
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            (a_nodes, a_labels, _), (b_nodes, b_labels, _) = _side(a), _side(b)
            x, y = (np.frombuffer(s["data"], np.uint8).reshape(-1, SLOTS).T for s in (a, b))
            if len(a_nodes) * len(b_nodes) <= _SMALL_PRODUCT:
                agreed = (x[:, :, None] == y[:, None, :]).sum(axis=0)
            else:
                agreed = np.zeros((len(a_nodes), len(b_nodes)), np.uint8)
                for slot in range(SLOTS):
                    agreed += x[slot][:, None] == y[slot][None, :]
            alike = (agreed >= least) & (a_labels[:, None] != b_labels[None, :])
            found.update((a["main"], n, True) for n in a_nodes[alike.any(axis=1)].tolist())
            found.update((a["main"], n, b["guest"]) for n in b_nodes[alike.any(axis=0)].tolist())
        columns = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["main", "node", "guest"])


def _block_links(percent: int):
    """As few links as connect what all links between the two blocks of sets connect."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                (a_nodes, _, a_sizes), (b_nodes, _, b_sizes) = _side(a), _side(b)
                sets = [np.split(np.frombuffer(s["data"], np.uint64), np.cumsum(n // 8)[:-1]) for s, n in ((a, a_sizes), (b, b_sizes))]
                i, j = _similar(*sets, percent)
                if not b["guest"]:  # the others are connected already: a link to any of them is as good as all
                    i, first = np.unique(i, return_index=True)
                    j = j[first]
                yield from _contracted(iter([pa.RecordBatch.from_arrays([pa.array(a_nodes[i]), pa.array(b_nodes[j])], ["x", "y"])]))

    return links


def _similar(a: list, b: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in two blocks of sorted sets that are similar enough, by products of presence matrices."""
    sets = [*a, *b]
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    row, ordered = np.repeat(np.arange(len(sets)), sizes)[order], elements[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    column = np.cumsum(new) - 1
    # only elements of two sets or more count
    several = np.bincount(column)[column] > 1
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    shared = np.zeros((len(a), len(b)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + _COLUMNS, _COLUMNS))
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        present = np.zeros((len(sets), _COLUMNS), np.float32)
        present[row[low:high], column[low:high] - i * _COLUMNS] = 1
        shared += present[: len(a)] @ present[len(a) :].T
    total = sizes[: len(a), None] + sizes[None, len(a) :]
    return np.nonzero(100 * shared.astype(np.int64) >= percent * (total - shared.astype(np.int64)))


def _members(classes: DataFrame) -> DataFrame:
    """(key, node, signature) of the buckets of two nodes or more."""
    entries = classes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return written(entries.join(shared, "key").join(classes.select("node", "signature"), "node").select("key", "node", "signature"), "members")


def _star_candidates(members: DataFrame) -> DataFrame:
    """(x, y): of each node and turn the most similar of its buckets' stars."""
    stars = members.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("node", F.lit(n)), "node", "signature")).alias(f"star{n}") for n in range(STARS)])
    # written, so that both sides of the join are plain shuffles, which adaptive execution can split
    against = members.join(written(stars, "stars"), "key")
    alike = against.mapInArrow(_star_links, "x long, y long, star int, agreement double")
    best = alike.groupBy("x").agg(*[F.max(F.when(F.col("star") == n, F.struct("agreement", "y"))).alias(f"best{n}") for n in range(STARS)])
    of_turns = F.array_compact(F.array_distinct(F.array(*[F.col(f"best{n}.y") for n in range(STARS)])))
    return best.select("x", F.explode(of_turns).alias("y"))


def _guests(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of several labels: key, main (the label most have), guest (of another label), node, component, data."""
    placed = members.join(labels, "node", "left").select("key", "node", "signature", F.coalesce("component", "node").alias("component"))
    mains = placed.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("most"), F.count("*").alias("labels"))
    mains = written(mains.where("labels > 1").select("key", F.col("most.component").alias("main")), "mains")
    return placed.join(mains, "key").select("key", (F.col("component") != F.col("main")).alias("guest"), "main", "node", "component", F.col("signature").alias("data"))


def _links_among_guests(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that ``labels`` leave apart, as few as connect the same."""
    meetings = _meetings(_guests(members, labels), "signature-blocks", BLOCK_SIGNATURES, BLOCK_BYTES)
    suspects = written(meetings.mapInArrow(_suspects, "main long, node long, guest boolean").distinct(), "suspects")
    sized = suspects.join(sets, "node").select(F.col("main").alias("key"), "guest", "main", "node", F.lit(0).cast("long").alias("component"), F.col("elements").alias("data"))
    found = _meetings(sized, "set-blocks", BLOCK_SETS, BLOCK_BYTES).mapInArrow(_block_links(percent), "node long, root long")
    return found.select(F.col("node").alias("x"), F.col("root").alias("y"))


def _named(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """digest, component_id and first (the digest of the group's first set) of each class."""
    linked = written(classes.select("node", "digest", "low").join(groups, "node"), "linked")
    names = written(linked.groupBy("component").agg(F.min(F.struct(F.col("low").isNull(), "low", "digest")).alias("name")), "names")
    named = linked.join(names, "component").select("digest", F.col("name.low").alias("name"), F.col("name.digest").alias("first"), F.lit(True).alias("linked"))
    # an id may be null, so the mark tells whether a class is linked at all
    name = F.when(F.col("linked"), F.col("name")).otherwise(F.col("low"))
    out = classes.select("digest", "low").join(named, "digest", "left").select("digest", name.alias("component_id"), F.coalesce("first", "digest").alias("first"))
    return written(out, "named")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row (doc_id, text).

    Beside them row_key (a hash of id and text), digest (of the set, null if
    empty) and chosen (whether the row has its group's first set and name).
    """
    with_text_batches(docs.sparkSession)
    keyed = documents(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    sketches = written(keyed.mapInArrow(_sketched(width), "doc_id long, row_key long, n_shingles long, digest binary, bands array<long>, signature binary"), "sketches")

    # equal sets: one class, for which the row of the smallest id stands
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "bands", "signature")).alias("first")
    classes = sketches.where("digest is not null").groupBy("digest").agg(first)
    # numbered once, in what is written
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("first.doc_id").alias("low"), "first.row_key", "first.bands", "first.signature"), "classes")

    members = _members(classes)
    needed = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", "row_key")
    # merged, since what is needed grows with the corpus, and sorted by key, so that dropping copies takes no shuffle of its own
    texts = keyed.join(written(needed, "needed").hint("merge"), "row_key").dropDuplicates(["row_key", "node", "text"])
    sets = written(texts.mapInArrow(_set_blobs(width), "node long, elements binary"), "sets")

    links = written(_verified(_star_candidates(members), sets, percent), "links")
    labels = _labels(links, final=False)
    more = _links_among_guests(members, labels, sets, percent)
    every = written(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).union(more), "all-links")
    named = _named(classes, _labels(every, final=True))

    out = sketches.select("doc_id", "row_key", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    chosen = F.col("digest").isNull() | (kept & (F.col("digest") == F.col("first")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "row_key", "digest", chosen.alias("chosen"))


def first_of_groups(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one row of each group, which has the group's smallest id.

    Rows with empty sets stay, repeated ones once. Of rows that share id and
    text any may be the one that stays.
    """
    chosen = near_duplicates(docs, width=width, percent=percent).where("chosen")
    group = F.coalesce(F.col("digest"), F.col("row_key").cast("string").cast("binary"))
    one = written(chosen.groupBy(group.alias("group")).agg(F.min("row_key").alias("_row_key")).select("_row_key").distinct(), "chosen")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_row_key"))
    rows = keyed.join(one, "_row_key", "left_semi").withColumn("_id", F.col("row.doc_id")).withColumn("_text", F.col("row.text"))
    return rows.dropDuplicates(["_row_key", "_id", "_text"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
