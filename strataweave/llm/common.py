"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.sources.folders import new_folder, shared_folder, written

__all__ = ["new_folder", "shared_folder", "written"]

#: Rows and bytes per Arrow batch for operators that hold whole texts in Python.
TEXT_ROWS = 1000
TEXT_BYTES = 8 << 20


def with_text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def documents(docs: DataFrame, *, carry: bool = False) -> DataFrame:
    """doc_id and text, and with ``carry`` the whole row beside them as ``row``."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *whole)


def carried(df: DataFrame, carry: bool) -> str:
    """The type of the carried column, for the schema of what comes out."""
    return f", row {df.schema['row'].dataType.simpleString()}" if carry else ""


#: A word table is emptied between batches once it holds this many words, or this many bytes of them.
#: A batch is bounded in bytes itself (or is one text), and so is what it can add.
MOST_WORDS = 300_000
MOST_WORD_BYTES = 16 << 20


class WordIndex(dict):
    """Number of each distinct word; words seen first are listed in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        self.size += len(word)
        return number

    def full(self, most: int = MOST_WORDS) -> bool:
        return len(self) > most or self.size > MOST_WORD_BYTES


class Ragged:
    """Rows of integers of different lengths, appended to and gathered by row number."""

    def __init__(self, dtype) -> None:
        self.flat = np.zeros(0, dtype)
        self.ends = np.zeros(1, np.int64)

    def append(self, rows: Sequence[Sequence[int]]) -> None:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        more = np.fromiter(chain.from_iterable(rows), self.flat.dtype, int(lengths.sum()))
        self.extend(more, lengths)

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Appends rows of these lengths, given one after the other."""
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows + 1] - self.ends[rows]

    def gather(self, rows: np.ndarray) -> np.ndarray:
        starts, lengths = self.ends[rows], self.lengths(rows)
        shift = starts - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 texts; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_numbers(index: WordIndex, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


_held: dict[tuple, object] = {}


def _give_back() -> None:
    """Returns freed memory to the system, where the C library has a call for that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held(make: Callable, *args):
    """``make(*args)``, kept in this Python worker for its next tasks; what another operator kept goes."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _held:
        _held.clear()
        _give_back()
        _held[key] = make(*args)
    return _held[key]
