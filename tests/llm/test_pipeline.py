"""The pipeline against brute-force versions of its stages, each on what the stage before it kept."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_minhash import brute as brute_groups
from test_packing import check as check_packing
from test_substrings import brute as brute_cuts

from strataweave.llm.common import written

SF = "/root/testdata/sf0.001"


def documents(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "near_dedup", "substring_dedup", "packing"]

    told = written(stages["language_id"](spark, docs, SF), "t1")
    assert told.columns == docs.columns
    letters = {d for d, r in documents(docs).items() if any(map(str.isalpha, r.text or ""))}
    assert set(documents(told)) <= letters and len(documents(told)) >= 0.995 * len(letters)

    good = written(stages["quality_rules"](spark, told, SF), "t2")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = {d for d, r in documents(told).items() if len((r.text or "").split()) >= 10 and labels.get(d) == 1}
    assert len(long & set(documents(good))) >= 0.98 * len(long)

    alone = written(stages["near_dedup"](spark, good, SF), "t3")
    groups = brute_groups([(d, r.text) for d, r in documents(good).items()], 5)
    assert set(documents(alone)) == {d for d, (_, _, kept) in groups.items() if kept}

    cut = written(stages["substring_dedup"](spark, alone, SF), "t4")
    assert cut.columns == docs.columns
    expected = {d: removed for d, _, removed, _, _ in brute_cuts([(d, r.text) for d, r in documents(alone).items()])}
    before = documents(alone)
    for d, r in documents(cut).items():
        assert len(before[d].text.encode()) - expected[d] - len(r.text.encode()) in range(4 * 3)
        assert r.n_chars == len(r.text)
        assert expected[d] or r.text == before[d].text

    packed = stages["packing"](spark, cut, SF).collect()
    check_packing(packed, [(d, r.text) for d, r in documents(cut).items()], 4096)


def test_rows_without_ids_and_repeated_ids_keep_their_own_texts(spark):
    rng = random.Random(17)
    words = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 3000").orderBy("doc_id").first().text.split()
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    t, u, o, n = (fresh(150) for _ in range(4))
    near = " ".join([*t.split()[:75], "changed", *t.split()[76:]])
    rows = [(1, t), (None, near), (None, u), (5, o), (5, o + " " + u), (None, n), (None, n)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    alone = written(corpus_pipeline.near_dedup(spark, docs, ""), "alone")
    left = sorted(((r.doc_id, r.text) for r in alone.collect()), key=repr)
    assert left == sorted([(1, t), (None, u), (5, o), (5, o + " " + u), (None, n)], key=repr)
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, alone, "").collect()}
    # o and u stay in one row each, whole
    assert (1, t) in cut and (None, n) in cut
    assert sum(x.count(o) for _, x in cut) == 1 and sum(x.count(u) for _, x in cut) == 1


def test_odd_rows_pass_through(spark):
    words = "the quick brown fox jumps over the lazy dog while seven other animals look on from the hill".split()
    text = " ".join(words)
    rows = [(1, text, "en", "s", 1, 7), (1, text, "en", "s", 1, 7), (2, None, None, None, None, None), (3, "", "en", "s", 0, 1), (4, "12 34", "en", "s", 5, 2), (None, text + " indeed", "en", "s", 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "odd")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred"]
    left = docs.select("doc_id", "lang_pred", F.length("text").alias("n")).collect()
    # the row without an id is a near copy of the first
    assert [(r.doc_id, r.lang_pred) for r in left] == [(1, 7)]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.collect() == []
