import re
from collections import Counter

import pytest

from strataweave.llm import queries
from strataweave.llm.quality import BANDS, judge_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = [
    None,
    "",
    " \n\t",
    "a b c d e " * 8,
    "one two three four five six seven eight nine ten eleven twelve",
    "line one\nline one\n \n\nline one \nline two",
    "#* $% & | <> ##",
    "ünï cödé\x85wörds\xa0hére now \x1c and \x0b then",
    "x y z w v u t s r q p x y z w v k l m n",
    "x " * 30000,
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_and_nulls(spark):
    docs = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, "some text", "x"), (1, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    found = judge_quality(df, **queries.quality_vocabularies()).collect()
    assert len(found) == len(docs)
    by_id = {r.doc_id: r for r in found}
    for i, t in enumerate(CASES):
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)
    assert by_id[0].chars_per_token is None and not by_id[0].kept


def test_bands_reject_by_script(spark):
    clean = "The weather in the mountains changed quickly and every traveller looked for shelter near the old stone bridge before night."
    noise = "".join(chr(0x10A0 + i % 40) + " " for i in range(80))
    symbols = "q9x#&* z7w$%| k3j<>& " * 3 + " ".join(f"{i}#{i * 7}&*{i * 13}$" for i in range(60))
    df = spark.createDataFrame([(1, clean), (2, noise), (3, symbols)], "doc_id long, text string")
    kept = {r.doc_id: (r.script, r.kept) for r in judge_quality(df, **queries.quality_vocabularies()).collect()}
    assert kept[1] == ("latin", True)
    assert kept[2][0] == "other"
    assert not kept[3][1]
    assert set(BANDS) >= {"latin", "none", "other"}


def test_measures_are_those_of_the_vocabularies(spark):
    import public_tokenizers
    import sentencepiece
    import tiktoken  # noqa: F401

    text = "Words, größer 漢字 and \U0001f600 done by ten or more words here"
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    ids = [i for w in text.split() for i in sp.encode(w)]
    (r,) = judge_quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), **queries.quality_vocabularies()).collect()
    assert r.byte_share == pytest.approx(sum(map(sp.is_byte, ids)) / len(ids))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert judge_quality(df, **queries.quality_vocabularies()).collect() == []


@pytest.mark.parametrize("carry", [False, True])
def test_language_bands_reject_junk_and_keep_clean_text(spark, carry):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1")  # bands are set from even ids
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    judged = judge_quality(docs.join(labels, "doc_id"), **queries.quality_vocabularies(), carry=carry)
    judged = judged if carry else judged.join(labels, "doc_id")
    quality = "row.quality" if carry else "quality"
    counts = {}
    for r in judged.where("not base_failed").selectExpr(f"{quality} as quality", "n_symbols > 0.5 * n_words as noise", "kept").collect():
        for name in [r.quality, *(["noise"] if r.noise else [])]:
            counts.setdefault(name, []).append(r.kept)
    share = {k: sum(v) / len(v) for k, v in counts.items()}
    assert share[1] >= 0.99
    assert share[0] <= 0.2
    assert share["noise"] <= 0.05


def test_unmeasured_languages_take_the_band_of_the_script(spark):
    noise = "Thnd*** iner*** ther*** $$$ onre*** hable*** ofan### " * 3 + "oulyha*** ertire### reesnd$$$ atston*** thing### lyonre***"
    clean = "The weather in the mountains changed quickly and every traveller looked for shelter near the old stone bridge before night."
    df = spark.createDataFrame([(1, clean, None), (2, clean, "fi"), (3, clean, "EN"), (4, noise, "en")], "doc_id long, text string, lang string")
    found = judge_quality(df, **queries.quality_vocabularies())
    assert "row" not in found.columns
    assert {r.doc_id for r in found.where("kept").collect()} == {1, 2, 3}
