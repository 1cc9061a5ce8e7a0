"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents become token ids and are cut into pieces of at most ``CAPACITY``
ids. Only the histogram of piece lengths (``CAPACITY`` counts, whatever the
corpus) reaches the driver. There lengths are placed longest first, always
into the shortest pack that still takes them; packs of one pattern are a single
entry with a count, so the plan is as small as the histogram. Pieces then find
their place by their rank among the pieces of their length.

Ranks are counted within salted groups of at most about ``GROUP_ROWS`` pieces,
so that a length that a third of all documents share is no larger task.

Defined results
- A null or empty text has the closing id alone.
- Rows that repeat a document id are documents of their own.
- An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.common import Ragged, WordIndex, documents, held, text_bytes, with_text_batches, word_numbers, written

CAPACITY = 4096
CLOSING_ID = 2
GROUP_ROWS = 1000
WORD_END = "</w>"
#: Stems that are encoded as one text.
LINE = 1000
ENDINGS = b"""!"#$%&()*+,-./:;<=>?@[]^_`{|}~"""
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


class _WordTokens:
    """Token ids of texts, from the ids of their distinct words.

    The vocabulary's normaliser and pre-tokeniser never look across white
    space, so a text has the ids of its words; and between a letter or digit
    and the punctuation that ends a word they always cut, so that a word has
    the ids of its stem and of its ending. Special tokens that a text spells
    out become their ids, as by the library.
    """

    def __init__(self, vocabulary: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.marks = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.is_last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word
        for token, n in self.tokenizer.get_vocab().items():
            self.is_last[n] = token.endswith(WORD_END)
        self._empty()

    def _empty(self) -> None:
        self.index, self.ids = WordIndex(), Ragged(np.uint32)
        self._empty_stems()

    def _empty_stems(self) -> None:
        self.stems, self.stem_ids = WordIndex(), Ragged(np.uint32)

    def _marked(self, lowered: bytes) -> bool:
        return any(m in lowered for m in self.marks)

    def _split(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The words' stems, and their closing punctuation where the pre-tokeniser cuts too."""
        whole, joined = words, b" ".join(words).lower()
        words = joined.split(b" ")
        stems = [w.rstrip(ENDINGS) for w in words]
        stems = [s if s[-1:].isalnum() or s.decode().lower()[-1:].isalnum() else w for s, w in zip(stems, words, strict=True)]
        endings = [w[len(s) :] for s, w in zip(stems, words, strict=True)]
        if self._marked(joined):  # the library cuts special tokens out itself, as they are written
            for n, word in enumerate(words):
                if self._marked(word):
                    stems[n], endings[n] = whole[n], b""
        return stems, endings

    def _append_stems(self, stems: list[str]) -> None:
        """Adds the ids of each stem; stems of letters alone are encoded many at a time."""
        plain = [s.isalpha() and (s.isascii() or s.lower().isalpha()) for s in stems]
        letters, rest = np.flatnonzero(plain).tolist(), [n for n, x in enumerate(plain) if not x]
        lines = [letters[a : a + LINE] for a in range(0, len(letters), LINE)]
        joined = self.tokenizer.encode_batch_fast([" ".join([stems[n] for n in line]) for line in lines], add_special_tokens=False)
        order, flat, lengths = [], [], []
        for line, encoded in zip(lines, joined, strict=True):
            ids = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.is_last[ids]) + 1
            if len(ends) != len(line):
                rest += line
                continue
            order += line
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        singly = [e.ids for e in self.tokenizer.encode_batch_fast([stems[n] for n in rest], add_special_tokens=False)]
        found = Ragged(np.uint32)
        found.extend(np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *lengths]))
        found.append(singly)
        rows = np.argsort(np.array(order + rest, np.int64))
        self.stem_ids.extend(found.gather(rows), found.lengths(rows))

    def _append_words(self, words: list[bytes]) -> None:
        if self.stems.full():
            self._empty_stems()
        stems, endings = self._split(words) if words else ([], [])
        parts = np.stack([word_numbers(self.stems, stems), word_numbers(self.stems, endings)], 1)
        new, self.stems.new = self.stems.new, []
        self._append_stems(b" ".join(new).decode().split(" ") if new else [])
        self.ids.extend(self.stem_ids.gather(parts.ravel()), self.stem_ids.lengths(parts).sum(1))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.index.full():
            self.index, self.ids = WordIndex(), Ragged(np.uint32)
        lowered = [t.lower() for t in texts]
        numbers = [word_numbers(self.index, (t if self._marked(x) else x).split()) for t, x in zip(texts, lowered, strict=True)]
        new, self.index.new = self.index.new, []
        self._append_words(new)
        return [self.ids.gather(n) for n in numbers]


def _cut(vocabulary: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(_WordTokens, vocabulary)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(text_bytes(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return cut


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of every text."""
    with_text_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_cut(vocabulary, capacity), _PIECES)


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one pack) with the number of packs of each."""
    packs: dict[int, list[list]] = defaultdict(list)  # by ids in use: [pattern, count]
    used: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while used and not packs[used[0]]:
                heapq.heappop(used)
            if used and used[0] + length <= capacity:
                filled, copies = used[0], 1
                pattern, count = packs[filled].pop()
                took = min(count, left)
                if count > took:
                    packs[filled].append([pattern, count - took])
            else:  # pieces of this length share new packs as far as they fit
                copies = min(left, capacity // length)
                filled, pattern, took = 0, (), left // copies
            left -= took * copies
            filled += length * copies
            if not packs[filled]:
                heapq.heappush(used, filled)
            packs[filled].append([pattern + (length,) * copies, took])
    return [(pattern, count) for filled in sorted(packs) for pattern, count in packs[filled]]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted; one per slot of a pattern."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for pattern, count in plan:
        offset = 0
        for length in pattern:
            rows.append((length, ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _placed(places: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.searchsorted(places[:, 0], np.arange(places[:, 0].max(initial=0) + 2))
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)).astype(np.int64) for n in ("length", "rank"))
            slot = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                slot[own] = firsts[n] + np.searchsorted(places[firsts[n] : firsts[n + 1], 1], rank[own], side="right") - 1
            at = places[slot]
            columns = [batch.column(n) for n in ("doc_id", "start")] + [pa.array(length)] + [batch.column(n) for n in ("ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], names)

    return place


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document with their sequence and the offset there."""
    pieces = written(token_pieces(docs, vocabulary, capacity), "pieces")
    histogram = pieces.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in histogram.collect()}  # at most `capacity` rows
    places = _places(plan_packs(counts, capacity))

    # at most `capacity` rows, whatever the corpus
    salts = F.broadcast(histogram.select("length", F.ceil(F.col("count") / GROUP_ROWS).alias("salts")))
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("n", F.row_number().over(order) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("n")).alias("rank"))
    return ranked.mapInArrow(_placed(places), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
