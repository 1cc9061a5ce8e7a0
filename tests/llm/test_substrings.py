import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
import pytest

from strataweave.llm import substrings
from strataweave.llm.substrings import repeated_windows, without_repeats

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(docs, length=100):
    """Rows of COLUMNS by a dictionary of all strings, for unique document ids."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, shared=6, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoé ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(14, 60)) for _ in range(shared)]
    docs = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "x" * 5000, "ab" * 400, "abcde " * 100, "abcde " * 100, "漢字 " * 60, "é" * 200]
    for _ in range(n):
        docs.append(text(rng.randint(0, 30)) + "".join(rng.choice(passages) + text(rng.randint(0, 20)) for _ in range(rng.randint(0, 3))))
    for _ in range(10):
        docs.append(rng.choice(docs[12:]))
    order = list(enumerate(docs))
    rng.shuffle(order)
    return order


def run(spark, docs, rows, parts=5):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, start int, key string").repartition(parts)
    return rows(without_repeats(df), *COLUMNS)


@pytest.mark.parametrize("seed", [1, 2])
def test_removes_what_all_strings_repeat(spark, rows, seed):
    docs = corpus(seed)
    assert run(spark, docs, rows) == brute(docs)


def test_anchors_of_very_many_fragments_go_by_window(spark, rows, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    side = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 150)))
    docs = [(i, side() + passage + side()) for i in range(400)] + [(1000 + i, side() + passage[40:190] + side()) for i in range(5)]
    assert run(spark, docs, rows, parts=3) == brute(docs)


def test_long_texts_are_worked_on_in_stretches():
    rng = random.Random(4)
    part = bytes(rng.choice(b"abcdefghijklmnop") for _ in range(3000))
    text = bytes(rng.choice(b"abcdefghijklmnop") for _ in range(20000)) + part + b"-" + part
    old, substrings.BLOCK_BYTES = substrings.BLOCK_BYTES, 4096
    try:
        block = substrings._Block(1)
        found = [*block.add((7, 0), text), *block.flush(), *block.send()]
    finally:
        substrings.BLOCK_BYTES = old
    rows = [r for x in found for r in substrings._resolved(iter([x.select(["kind", "entries"])]))]
    assert rows
    starts = [s for x in found if x.column("kind")[0].as_py() == substrings.ASK for s in list(substrings._unpacked(x.column("entries")[0].as_py()))[4].tolist()]
    assert max(starts) > 22000


def test_repeated_and_null_ids_and_empty_tables(spark, rows):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None)], "doc_id long, text string")
    found = {(r.doc_id, r.n_bytes, r.n_removed) for r in without_repeats(df).collect()}
    assert found == {(1, 300, 0), (None, 300, 300), (None, 0, 0)}
    assert rows(without_repeats(df.limit(0)), "doc_id") == []


def test_rows_are_cut_by_their_own_text(spark):
    rng = random.Random(8)
    t, u, q, v = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4))
    docs = [(1, t), (None, t), (None, u), (5, t), (5, u + q), (None, v), (None, v), (None, v + q), (5, t)]
    df = spark.createDataFrame([(x, i, 0, 0) for i, x in docs], "text string, doc_id long, id_key long, row_key long").repartition(3)
    found = sorted(((r.doc_id or 99, r.n_bytes, r.n_removed) for r in without_repeats(df, carry=True).collect()))
    alone, after = sorted([(99, 300, 0), (99, 300, 0), (99, 600, 600)]), sorted([(99, 300, 300), (99, 300, 300), (99, 600, 300)])
    rest = [r for r in found if r[0] != 99]
    assert rest == [(1, 300, 0), (5, 300, 300), (5, 300, 300), (5, 600, 0)]
    ours = [r for r in found if r[0] == 99]
    # of the rows without id that share v, the one of the smaller hash keeps it
    assert ours == sorted([(99, 300, 300), (99, 300, 300), *alone]) or ours == sorted([(99, 300, 300), (99, 300, 300), *after])


def test_a_line_of_many_documents(spark, rows):
    rng = random.Random(21)
    line = "".join(rng.choice("abcdefgh ") for _ in range(170))
    docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + "\n" + line * rng.randint(1, 2)) for i in range(500)]
    assert run(spark, docs, rows, parts=4) == brute(docs)


def test_every_cut_follows_from_a_class(spark):
    """Without the classes of suffix arrays (or of windows) nothing of a copy is cut."""
    block = substrings._Block(4)
    rng = random.Random(6)
    t = bytes(rng.choice(b"abcdefgh ") for _ in range(700))
    sent = [x for i in range(3) for x in block.add((i, 0), t)] + [*block.flush(), *block.send()]
    found = [r for x in sent for r in substrings._resolved(iter([x.select(["kind", "entries"])]))]
    kinds = {k for x in found for k in x.column("kind").to_pylist()}
    assert kinds == {substrings.COPY, substrings.ALONE}


def test_classes_of_the_transform_are_equal_strings():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice((1, 2, 3, 6))
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        text, place, group = (x.tolist() for x in repeated_windows(texts, length))
        strings = {}
        for t, p, g in zip(text, place, group, strict=True):
            assert strings.setdefault(g, texts[t][p : p + length]) == texts[t][p : p + length]
        assert len(set(strings.values())) == len(strings)
        assert len(set(zip(text, place, strict=True))) == sum(max(0, len(t) - length + 1) for t in texts)


def test_no_suffix_array_takes_more_than_a_shard(spark, rows, monkeypatch):
    # about four fragments of the passage's edge in each of many blocks: never heavy in one of them
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    side = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 150)))
    docs = [(i, side() + passage + side()) for i in range(300)]
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 1500)
    monkeypatch.setattr(substrings, "HEAVY", 64)
    block = substrings._Block(1)
    sent = [x for i, t in docs for x in block.add((i, 0), t.encode())] + [*block.flush(), *block.send()]
    found = [r for r in substrings._resolved(iter([x.select(["kind", "entries"]) for x in sent]))]
    totals = {}
    for x in found:
        for kind, n, key in zip(*(x.column(c).to_pylist() for c in ("kind", "n", "key")), strict=True):
            if kind in (substrings.ASK, substrings.ASK_WINDOWS):
                kinds, size = totals.get(key, (set(), 0))
                totals[key] = (kinds | {kind}, size + n + substrings.LENGTH)
    assert any(size > substrings.SHARD_BYTES for _, size in totals.values())
    assert all(kinds == {substrings.ASK_WINDOWS} for kinds, size in totals.values() if size > substrings.SHARD_BYTES)


def test_anchors_beyond_a_shard_lose_the_same_bytes(spark, rows, monkeypatch):
    resolved, limit = substrings._resolved, 1500

    # the limit holds in the workers, while a bucket is resolved
    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, substrings.SHARD_BYTES = substrings.SHARD_BYTES, limit
        try:
            yield from resolved(batches)
        finally:
            substrings.SHARD_BYTES = old

    monkeypatch.setattr(substrings, "_resolved", small)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    side = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 150)))
    docs = [(i, side() + passage + side()) for i in range(60)] + [(1000 + i, side() + passage[40:190] + side()) for i in range(5)]
    assert run(spark, docs, rows, parts=3) == brute(docs)
