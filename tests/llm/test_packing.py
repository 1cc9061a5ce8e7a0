import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from strataweave.llm.common import WordIndex
from strataweave.llm.packing import _WordTokens, pack, plan_packs

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello, world's   end.\n\nNaïve   Ångström ΣΑΣ 123 45",
    "a\x1cb\x85c d e <|endoftext|> f",
    "word " * 6000,
    "word " * 6000,
    "İ= Aİ, \u0338é! x\u0338= ²! Ⅷ. (ok) ... a.b,c. it's's",
    "a <|endoftext|> b<|startoftext|>c, <|ENDOFTEXT|> <|endoftext|>. x<|endoftext|><|endoftext|>|> <|endoftext",
    "don't we'll é ́x " * 50,
]


def brute(text):
    t = Tokenizer.from_file(VOCABULARY)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(found, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids, at = brute(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            piece = b"".join(int(i).to_bytes(4, "little") for i in ids[at : at + r.length])
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(piece), len(ids))
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_pieces_hold_every_id_once(spark):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, length string, salt int")
    check(pack(df, VOCABULARY).collect(), docs, 4096)


def test_many_documents_of_one_length(spark):
    docs = [(i, "same words here") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pack(df, VOCABULARY, 64).collect()
    check(found[:0], [], 64)
    assert len({(r.sequence_id, r.offset) for r in found}) == 3000
    n = found[0].length
    assert max(r.sequence_id for r in found) + 1 == -(-3000 // (64 // n))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, VOCABULARY).collect() == []


def test_plan_uses_every_length_and_the_shortest_pack():
    plan = plan_packs({3: 1, 5: 1, 6: 1, 2: 1}, 8)
    assert sorted(plan) == [((5, 3), 1), ((6, 2), 1)]
    histogram = {n: (n * 7919) % 50 for n in range(1, 100)}
    used = defaultdict(int)
    for pattern, count in plan_packs(histogram, 100):
        assert sum(pattern) <= 100
        for n in pattern:
            used[n] += count
    assert {n: c for n, c in histogram.items() if c} == dict(used)


def test_words_of_one_lower_case_form_are_held_once():
    words = _WordTokens(VOCABULARY)
    words.encode([b"Some words, SOME Words, some words,"])
    assert len(words.index) == 2


def test_ids_stay_when_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(WordIndex, "full", lambda index: True)
    words = _WordTokens(VOCABULARY)
    for text in [x or "" for x in TEXTS] * 2:
        assert [*words.encode([text.encode()])[0].tolist(), 2] == brute(text)
