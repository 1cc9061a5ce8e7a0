import random

import public_tokenizers
import pytest
import sentencepiece

from strataweave.llm.pieces import BPE, UNIGRAM, Encoder, _fields, _settings, decode, encode

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    "",
    " ",
    "Hello world",
    "  two  spaces   here ",
    "tabs\tand\nbreaks\n\n  indented",
    "Größe, naïve café; Ελληνικά русский 漢字かな 한국어 \U0001f600\U0001f468‍\U0001f469",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "<s> </s> <unk> <0x41> </s>",
    "x▁y ▁",
    "\x00\x01\x7f 　",
    "the " * 3000,
]


def varint(n):
    out = b""
    while True:
        n, b = n >> 7, n & 127
        if not n:
            return out + bytes([b])
        out += bytes([b | 128])


def with_kind(data, kind):
    """The model file's bytes with another model type."""

    def message(fields):
        return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in fields)

    out, at = b"", 0
    trainer = next(v for n, v in _fields(data) if n == 2)
    plain = [(n, v) for n, v in _fields(trainer) if n in (3, 35, 40, 41, 42)]
    plain = [(n, kind if n == 3 else v) for n, v in plain]
    for n, v in _fields(data):
        if n == 2:
            v = message(plain)
        out += varint(n << 3 | 2) + varint(len(v)) + v
    return out + data[len(data) : at]


def samples():
    rng = random.Random(11)
    letters = "aeiou thnsrldSTE.,'\néü漢█ "
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    words = "the and of internationalization understand antidisestablishmentarianism wherever 1234567 https://example.com/a?b=c don't".split()
    made += [" ".join(rng.choice(words) + rng.choice(["", "s", ",", "ing", "  "]) for _ in range(20)) for _ in range(60)]
    return TEXTS + made


def test_byte_pair_ids_are_those_of_the_library():
    with open(PATH, "rb") as f:
        assert _settings(f.read())[0] == BPE
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoder = Encoder(PATH)
    texts = samples()
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == sp.encode(text), text
        assert encoder.model.decode(ids).decode("utf-8", "replace") == sp.decode(ids.tolist())


def test_unigram_ids_have_the_best_score(tmp_path):
    with open(PATH, "rb") as f:
        data = with_kind(f.read(), UNIGRAM)
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    encoder = Encoder(str(path))
    model = encoder.model
    assert model.kind == UNIGRAM
    for text in samples()[11:120]:
        units = encoder.units.findall(b" " + text.encode())
        for unit in units[:6]:
            shown = unit.decode().replace(" ", "▁")[:14]
            best = brute(model, shown)
            ids = model.unit_ids(shown)
            got = sum(model.score[i] for i in ids if i not in model.id_byte)
            got += sum(model.least - 10 for c in shown if c not in model.single)
            assert got == pytest.approx(best)


def brute(model, text):
    """The best total over all segmentations."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in model.id_of:
                best[end] = max(best[end], best[start] + model.score[model.id_of[piece]])
            elif end - start == 1:
                best[end] = max(best[end], best[start] + model.least - 10)
    return best[-1]


def test_tables_nulls_and_round_trip(spark):
    texts = [None, *TEXTS, TEXTS[2]]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "no id", 5)], "doc_id long, text string, ids int")
    encoded = encode(df, PATH)
    found = {r.doc_id: r for r in encoded.collect()}
    assert len(found) == len(texts) + 1
    back = {r.doc_id: r.text for r in decode(encoded, PATH).collect()}
    for i, t in enumerate(texts):
        assert found[i].n_tokens == len(found[i].ids)
        assert found[i].exact == ("▁" not in (t or ""))
        assert back[i] == (t or "").replace("▁", " ")
    assert encode(df.limit(0), PATH).collect() == []
