"""Quality rules: repetition and length, and how well public vocabularies fit a text.

Base rules reject texts of few words or of much repetition. Of the others, the
fertility of two public vocabularies decides: characters per token of a
byte-level vocabulary, the share of byte-fallback tokens and the entropy of the
token distribution of a piece vocabulary. Each script has its own bands, and so
have the languages whose clean text was measured; the language is that of the
column ``lang``.

Words are the unit: a text's tokens are those of its words with a space before
each, so every distinct word is tokenised once per Python worker.

Defined results
- A null or empty text has no words and fails the base rules.
- The measures of a text without tokens are null.
- A null or unmeasured language, or one in another script than its own, is
  judged by the script's band, as is every text of a table without ``lang``.
- Repeated rows are judged alike; an empty table gives no rows; other columns
  are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import Ragged, WordIndex, carried, documents, held, text_bytes, with_text_batches, word_numbers

MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
#: The word table is emptied between batches once it holds this many words.
MOST_WORDS = 200_000
SYMBOLS = b"#*$%&|<>"
#: From so many tokens on, more of them need not be more varied.
FULL_TOKENS = 1024


@dataclass(frozen=True)
class Band:
    """What a clean text of a script measures; outside, it is rejected."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    #: Bits of entropy against those of as many different tokens, FULL_TOKENS at most.
    min_entropy_share: float


#: Fixed values. By the script of most letters; a text without letters is "none".
BANDS: dict[str, Band] = {
    "latin": Band(1.65, 9.0, 0.10, 0.50),
    "greek": Band(0.5, 6.0, 0.30, 0.40),
    "cyrillic": Band(0.7, 8.0, 0.30, 0.40),
    "arabic": Band(0.5, 6.0, 0.50, 0.40),
    "devanagari": Band(0.3, 5.0, 0.60, 0.35),
    "han": Band(0.3, 3.0, 0.60, 0.35),
    "kana": Band(0.3, 3.0, 0.50, 0.35),
    "hangul": Band(0.3, 3.0, 0.70, 0.35),
    "other": Band(0.2, 9.0, 0.90, 0.30),
    "none": Band(1.0, 9.0, 0.10, 0.45),
}
SCRIPTS = tuple(BANDS)
#: Fixed values by script and language. The floors are 95 % of the first percentile of clean
#: text: documents of even id that labels.parquet of sf0.1 calls quality 1 and base rules pass.
LANGUAGE_BANDS: dict[tuple[str, str], Band] = {
    ("latin", "de"): Band(2.07, 9.0, 0.10, 0.616),
    ("latin", "en"): Band(2.00, 9.0, 0.10, 0.636),
    ("latin", "es"): Band(1.78, 9.0, 0.10, 0.623),
    ("latin", "fr"): Band(1.83, 9.0, 0.10, 0.613),
}
#: First and last code points of the scripts that have bands.
RANGES = [
    (0x41, 0x24F, "latin"),
    (0x370, 0x3FF, "greek"),
    (0x400, 0x52F, "cyrillic"),
    (0x600, 0x6FF, "arabic"),
    (0x900, 0x97F, "devanagari"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]


def _script(letter: str) -> str:
    return next((name for low, high, name in RANGES if low <= ord(letter) <= high), "other")


class _WordMeasures:
    """Per distinct word: characters, symbols, letters by script, tokens of both vocabularies."""

    def __init__(self, pieces: str, ranks: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self._empty()

    def _empty(self) -> None:
        self.index, self.ids = WordIndex(), Ragged(np.int32)
        self.numbers = np.zeros((0, 4 + len(SCRIPTS)), np.int64)
        self.hashes = np.zeros(0, np.uint64)

    def rows(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.index.full(MOST_WORDS):
            self._empty()
        found = [word_numbers(self.index, t.split()) for t in texts]
        new, self.index.new = self.index.new, []
        if new:
            words = [w.decode() for w in new]
            ids = self.pieces.encode(words, num_threads=1)
            self.ids.append(ids)
            more = np.zeros((len(new), self.numbers.shape[1]), np.int64)
            more[:, 0] = [len(w) for w in words]
            more[:, 1] = [len(w) - len(w.translate(None, SYMBOLS)) for w in new]
            more[:, 2] = [len(x) for x in ids]
            more[:, 3] = [len(self.bytes.encode_ordinary(" " + w)) for w in words]
            for i, w in enumerate(words):
                if w.isascii():
                    more[i, 4] = sum(map(str.isalpha, w))
                else:
                    for c in filter(str.isalpha, w):
                        more[i, 4 + SCRIPTS.index(_script(c))] += 1
            self.numbers = np.concatenate([self.numbers, more])
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, hashes])
        return found


#: Fixed odd numbers, one for each place in a window.
_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words that the text has twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    windows = hashes[:n] * _PLACES[0]
    for i in range(1, WINDOW):
        windows = windows + hashes[i : i + n] * _PLACES[i]
    order = np.argsort(windows)
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    return float(-(share * np.log2(share)).sum())


_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("script", pa.string()),
    ("chars_per_token", pa.float64()),
    ("byte_share", pa.float64()),
    ("token_entropy", pa.float64()),
    ("entropy_share", pa.float64()),
]
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_token double, byte_share double, token_entropy double, entropy_share double"


def _measured(vocabularies: tuple[str, str, str]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(_WordMeasures, *vocabularies)
        for batch in batches:
            texts, rows = text_bytes(batch.column(1)), []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), texts, words.rows(texts), strict=True):
                sums = words.numbers[found].sum(axis=0)
                letters = sums[4:]
                script = SCRIPTS[int(letters.argmax())] if letters.any() else "none"
                ids = words.ids.gather(found)
                bits = entropy(ids) if len(ids) else None
                rows.append(
                    (
                        doc_id,
                        len(found),
                        int(sums[0]),
                        int(sums[1]),
                        duplicate_lines(text),
                        repeated_words(words.hashes[found]),
                        script,
                        float(sums[0] / sums[3]) if sums[3] else None,
                        float(words.is_byte[ids].mean()) if len(ids) else None,
                        bits,
                        bits / np.log2(min(len(ids), FULL_TOKENS)) if len(ids) > 1 else bits,
                    )
                )
            columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
            rest = batch.select([n for n in batch.schema.names if n == "row"])
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *rest.columns], [*(n for n, _ in _FIELDS), *rest.schema.names])

    return measure


def _inside(b: Band) -> Column:
    return (
        F.col("chars_per_token").between(b.min_chars_per_token, b.max_chars_per_token)
        & (F.col("byte_share") <= b.max_byte_share)
        & (F.col("entropy_share") >= b.min_entropy_share)
    )


def judge_quality(
    docs: DataFrame,
    *,
    pieces: str,
    ranks: str,
    pattern: str,
    bands: Mapping[str, Band] = BANDS,
    language_bands: Mapping[tuple[str, str], Band] = LANGUAGE_BANDS,
    carry: bool = False,
) -> DataFrame:
    """Measures, base_failed and kept of every document (doc_id, text, and lang if there is one); with ``carry`` also the row."""
    with_text_batches(docs.sparkSession)
    told = "lang" in docs.columns
    source = documents(docs if carry or not told else docs.select("doc_id", "text", "lang"), carry=carry or told)
    measured = source.mapInArrow(_measured((pieces, ranks, pattern)), _SCHEMA + carried(source, carry or told))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    language = F.lower(F.col("row.lang").cast("string")) if told else F.lit(None).cast("string")
    fits, own = F.lit(False), F.lit(False)
    for (script, lang), b in language_bands.items():
        known = (F.col("script") == script) & language.eqNullSafe(lang)
        fits, own = fits | (known & _inside(b)), own | known
    for script, b in bands.items():
        fits = fits | (~own & (F.col("script") == script) & _inside(b))
    judged = measured.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(fits, F.lit(False)))
    return judged if carry else judged.drop("row")
