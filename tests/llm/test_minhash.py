import random

import numpy as np
import pytest

from strataweave.llm import minhash
from strataweave.llm.minhash import near_duplicates, super_minhash


def shingles(text, width):
    words = (text or "").lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(docs, width, percent=80):
    sets = {d: shingles(t, width) for d, t in docs}
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                low[rb] = ra
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [None, "", " \n", "one", "ONE", "One two", "one TWO"]
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(3, 150))]
        docs.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    # a large group of near copies, many of them not alike to one another
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append(" ".join(copy))
    order = list(enumerate(docs))
    rng.shuffle(order)
    return order


@pytest.mark.parametrize("width", [2, 5])
def test_groups_are_those_of_all_pairs(spark, width):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, component int, key string")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, width=width).collect()}
    assert found == brute(docs, width)


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(60000))
    docs = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, long), (2, long + " more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=repr)
    assert found == sorted([(4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (9, 2, False), (2, 2, True)], key=repr)


def planted_rows():
    """Near copies of one text whose ids are null or repeat with other texts, and others beside them."""
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    base, alone = fresh(200), fresh(200)
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (20, 60, 100, 140)]
    other, lone = " ".join(fresh(150)), " ".join(alone)
    copies = [(None, lone), (None, lone), (None, lone + " tail")]
    return [(1, " ".join(base)), (7, other), (7, near[0]), (None, near[1]), (None, near[2]), (9, near[3])], copies


def test_rows_are_documents_whatever_their_ids(spark):
    linked, alone = planted_rows()
    df = spark.createDataFrame([*linked, *alone], "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept, r.chosen) for r in near_duplicates(df).collect()), key=repr)
    want = [(1, 1, True, True), (7, 7, True, True), (7, 1, False, False), (None, 1, False, False), (None, 1, False, False), (9, 1, False, False)]
    chosen = [r for r in found if r[1] is None]
    assert [r for r in found if r[1] is not None] == sorted(want, key=repr)
    assert len(chosen) == 3 and {r[:3] for r in chosen} == {(None, None, True)} and 1 <= sum(r[3] for r in chosen) <= 2


def test_one_row_of_each_group_stays(spark):
    linked, alone = planted_rows()
    rows = [(t, i, n) for n, (i, t) in enumerate([*linked, *alone, *linked, (3, None), (3, None), (None, None), (4, "")])]
    df = spark.createDataFrame(rows, "text string, doc_id long, row string")
    left = minhash.first_of_groups(df)
    assert left.columns == df.columns
    found = left.collect()
    ids = sorted((r.doc_id for r in found), key=repr)
    assert ids == sorted([1, 7, None, 3, None, 4], key=repr)
    assert {r.text for r in found if r.doc_id == 7} == {linked[1][1]}
    assert all((r.text, r.doc_id, int(r.row)) in {(t, i, n) for t, i, n in rows} for r in found)


def test_a_hub_of_thousands_that_are_not_all_alike(spark):
    """A bucket of thousands, half of them too far from the hub; against all pairs by a matrix product."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 60, 80)
    texts = []
    for n in range(5000):
        copy = base.copy()
        places = rng.integers(0, 80, rng.integers(0, 12) if n else 0)
        copy[places] = rng.integers(0, 60, len(places))
        texts.append(copy)
    pairs = np.array([t[:-1] * 60 + t[1:] for t in texts])
    present = np.zeros((len(texts), 3600), np.float32)
    np.put_along_axis(present, pairs, 1, axis=1)
    shared, sizes = present @ present.T, present.sum(axis=1)
    near = 100 * shared >= 80 * (sizes[:, None] + sizes[None, :] - shared)
    low = np.arange(len(texts))
    while True:
        lower = np.where(near, low[None, :], len(texts)).min(axis=1)
        if (lower == low).all():
            break
        low = lower
    df = spark.createDataFrame([(n, " ".join(f"w{x}" for x in t)) for n, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(df, width=2).collect()}
    assert 500 < (low == 0).sum() < 5000
    assert found == dict(enumerate(low.tolist()))


def test_contraction_in_several_tasks_connects_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FOREST_LINKS", 20)
    rng = random.Random(4)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    found = minhash._labels(spark.createDataFrame(links, "x long, y long"), final=True).collect()
    low = {n: n for link in links for n in link}
    for _ in low:
        for x, y in links:
            low[x] = low[y] = min(low[x], low[y])
    assert {r.node: r.component for r in found} == low


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signature_is_the_least_value_of_every_slot():
    rng = np.random.default_rng(3)
    for n in (1, 5, 48, 49, 300):
        elements = rng.integers(0, 2**63, n, dtype=np.uint64)
        slots = [[] for _ in range(minhash.SLOTS)]
        for e in elements:
            alone = super_minhash(np.array([e]))
            assert sorted(alone >> np.uint64(56)) == list(range(minhash.SLOTS))  # its ranks are a permutation
            for k, v in enumerate(alone):
                slots[k].append(v)
        assert super_minhash(elements).tolist() == [min(s) for s in slots]


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(7)
    shared, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    agreed = [(super_minhash(np.r_[shared, own[:100]] + np.uint64(i)) == super_minhash(np.r_[shared, own[100:]] + np.uint64(i))).mean() for i in range(60)]
    assert abs(np.mean(agreed) - 0.8) < 0.02
