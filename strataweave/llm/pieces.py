"""SentencePiece encoding and decoding by a Viterbi pass over an Aho-Corasick automaton.

The automaton holds the pieces of a model. It reads a text once; at each
position it follows its output links through all pieces that end there, and
each relaxes the best score of the position from that of its start.

Unigram models take the sum of the pieces' scores. In byte-pair models the
merge order decides, not a sum: there a piece relaxes a position only if it is
compatible with the piece before it, that is if the merges of both together
give just these two pieces. Of all pieces that end at a position exactly one
path of compatible pieces exists, which is the one that merging would give.

Texts are encoded in units between which no piece can lie (spaces and the word
after them), each distinct unit once per Python worker.

Defined results
- A null or empty text has no ids. Characters without a piece become their
  UTF-8 bytes' pieces, or the unknown piece where a model has none.
- Decoding gives the text back, but for U+2581, which stands for a space, and
  for unknown pieces. ``exact`` tells whether it did.
- Repeated rows are encoded alike; an empty table gives no rows; other columns
  are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import Ragged, WordIndex, documents, held, text_bytes, with_text_batches, word_numbers

SPACE = "▁"
UNIGRAM, BPE = 1, 2
_UNKNOWN_PENALTY = 10.0
#: The unit table is emptied between batches once it holds this many units.
MOST_UNITS = 800_000


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's varint and length-delimited fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, message[at : at + size]
            at += size
        else:
            at += 8 if wire == 1 else 4


def _settings(model: bytes) -> tuple[int, bool, bool]:
    """Model type, whether a space is put first, whether the normaliser leaves texts as they are."""
    parts = {n: v for n, v in _fields(model) if n in (2, 3)}
    trainer, normaliser = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    plain = not normaliser.get(2) and not normaliser.get(4, 1) and normaliser.get(5, 1)
    return trainer.get(3, UNIGRAM), bool(normaliser.get(3, 1)), bool(plain)


class PieceModel:
    """A SentencePiece model file with its automaton."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            self.kind, self.prefix, self.plain = _settings(f.read())
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in every]
        self.score = [sp.get_score(i) for i in every]
        self.unknown = sp.unk_id()
        self.byte_id = {int(self.text[i][3:-1], 16): i for i in every if sp.is_byte(i)}
        self.id_byte = {i: bytes([b]) for b, i in self.byte_id.items()}
        usable = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {self.text[i]: i for i in usable}
        if self.kind == BPE:
            usable = self._learn_merges(usable)
        self.least = min((self.score[i] for i in usable), default=0.0)
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.text[i], (len(self.text[i]), i))
        self.automaton.make_automaton()
        self.single = {t for t in self.id_of if len(t) == 1}
        self.splits_at_break = not any("\n" in t for t in self.id_of)
        self.splits_at_space = not any(SPACE in t.lstrip(SPACE) for t in self.id_of)
        self.decoded = [self.id_byte.get(i) or ("" if sp.is_control(i) else " ⁇ " if i == self.unknown else self.text[i].replace(SPACE, " ")).encode() for i in every]

    # merges of byte-pair models

    def _learn_merges(self, usable: list[int]) -> list[int]:
        """The two parts each piece is merged from last; pieces that merging can't give go."""
        self.rank = dict.fromkeys(usable, -1)  # characters are there from the start
        merged = sorted((i for i in usable if len(self.text[i]) > 1), key=lambda i: (-self.score[i], i))
        self.rank.update({i: n for n, i in enumerate(merged)})
        self.parts: dict[int, tuple[int, int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        reached = [i for i in usable if len(self.text[i]) == 1]
        for i in merged:
            pair = self._last_merge(self.text[i])
            if pair:
                self.parts[i] = pair
                reached.append(i)
        return reached

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        parts = [self.id_of.get(c) for c in text]
        if None in parts:
            return None
        while len(parts) > 1:
            joined = [(self.rank[j], n) for n, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if (j := self.id_of.get(self.text[a] + self.text[b])) is not None]
            if not joined:
                return None
            n = min(joined)[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[n : n + 2] = [self.id_of[self.text[parts[n]] + self.text[parts[n + 1]]]]
        return None

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives just a and b.

        Takes the merges at the seam back, the latest first, and looks whether
        the seam could have been merged across before them.
        """
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        left, right, limit, answer = a, b, 1 << 60, True
        while True:
            across = self.id_of.get(self.text[left] + self.text[right])
            if across is not None and self.rank[across] < limit:
                answer = False
                break
            if self.rank[left] < 0 and self.rank[right] < 0:
                break
            if self.rank[left] > self.rank[right]:
                limit, left = self.rank[left], self.parts[left][1]
            else:  # of equal merges the left one goes first, so the seam's before this
                limit, right = self.rank[right] + 1, self.parts[right][0]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[a, b] = answer
        return answer

    # encoding and decoding

    def unit_ids(self, text: str) -> list[int]:
        """Ids of a normalised text (spaces as U+2581)."""
        n = len(text)
        score, last, begin = [float("-inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        reached, bpe = 0, self.kind == BPE

        def unknown_up_to(end: int) -> None:
            """A character without a piece is a step of its own; in order, since later steps start here."""
            nonlocal reached
            while reached < end:
                reached += 1
                if text[reached - 1] not in self.single:
                    cost = 0.0 if bpe else self.least - _UNKNOWN_PENALTY
                    if score[reached - 1] + cost > score[reached]:
                        score[reached], last[reached], begin[reached] = score[reached - 1] + cost, -1, reached - 1

        for at, (size, i) in self.automaton.iter(text):
            unknown_up_to(at)
            start, end = at + 1 - size, at + 1
            if score[start] == float("-inf") or (bpe and last[start] >= 0 and not self.fits(last[start], i)):
                continue
            reach = score[start] + (0.0 if bpe else self.score[i])
            if reach > score[end]:
                score[end], last[end], begin[end] = reach, i, start
        unknown_up_to(n)
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(text[begin[at] : at].encode()))
            else:
                out.append(self.unknown)
            at = begin[at]
        return out[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        data = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return data[1:] if self.prefix and data.startswith(b" ") else data


class Encoder:
    """Ids of texts, from the ids of their distinct units."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        m = self.model
        breaks = rb"\n" if m.splits_at_break else b""
        self.units = re.compile(rb" *[^ " + breaks + rb"]+| +" + (rb"|\n" if breaks else b"") if m.splits_at_space else rb"(?s).+")
        self._empty()

    def _empty(self) -> None:
        self.index, self.ids = WordIndex(), Ragged(np.int32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        m = self.model
        if not m.plain:
            texts = [m.library.normalize(t.decode()).replace(SPACE, " ").encode() for t in texts]
        elif m.prefix:
            texts = [b" " + t if t else t for t in texts]
        if self.index.full(MOST_UNITS):
            self._empty()
        found = [word_numbers(self.index, self.units.findall(t)) for t in texts]
        new, self.index.new = self.index.new, []
        self.ids.append([m.unit_ids(u.decode().replace(" ", SPACE)) for u in new])
        return [self.ids.gather(n) for n in found]


def _encoded(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(Encoder, path)
        model = encoder.model
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            ids = encoder.encode(texts)
            bytes_used = np.zeros(len(model.text), bool)
            bytes_used[list(model.id_byte)] = True
            columns = {
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "n_byte_tokens": pa.array([int(bytes_used[x].sum()) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                "exact": pa.array([model.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                "ids": pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate([np.zeros(0, np.int32), *ids])),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns.values()], ["doc_id", *columns])

    return encode


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, exact and ids of every whole text."""
    with_text_batches(docs.sparkSession)
    source = documents(docs)
    return source.mapInArrow(_encoded(model), "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, exact boolean, ids array<int>")


def _decoded(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(Encoder, path).model
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int32)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    with_text_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, text string")
