import numpy as np

from strataweave.llm import langid, queries

TEXTS = {
    "en": "the cat and the dog went to the old house with a friend and then they were there for days",
    "de": "der hund und die katze gingen mit einem freund zum alten haus und dann blieben sie dort",
    "fr": "le chien et le chat sont allés à la vieille maison avec un ami et puis ils sont restés",
}


def grams(text):
    data = text.lower().encode()
    out = set()
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "little")
            out.add(((code * langid._GRAM_FACTORS[n - 1] + n) % 2**32) >> 17)
    return out


def test_presence_is_of_each_text_alone():
    texts = ["Añb cab", "", "x", "the the the", "ß" * 3]
    for row, text in zip(langid.presence(texts), texts, strict=True):
        assert set(np.flatnonzero(row)) == grams(text)


def test_kernel_is_the_normalised_intersection():
    a, b = "hello there", "hello world"
    k = langid.kernel(langid.presence([a, b]), langid.presence([a, b]))
    assert np.allclose(np.diag(k), 1)
    assert np.isclose(k[0, 1], len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))))


def test_learns_and_rejects_texts_without_letters(spark):
    rows, n = [], 0
    for lang, text in TEXTS.items():
        words = text.split()
        for i in range(40):
            rows.append((n, " ".join(words[(i * 7 + j * (i % 3 + 1)) % len(words)] for j in range(12)), lang))
            n += 1
    rows += [(n, "unlabelled words", None), (None, "the house", "en"), (n + 1, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, sample_rows=60, landmarks=12)
    assert model.languages == ("de", "en", "fr")
    asked = spark.createDataFrame([(1, "the dog went there"), (2, "der hund und die katze"), (3, None), (4, "123 ... !!"), (5, ""), (5, ""), (6, "le chat " * 20000)], "doc_id long, text string")
    found = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(asked, model).collect())
    assert [x[:2] for x in found] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (5, "und"), (6, "fr")]
    assert all(0 <= s <= 1 for _, _, s in found)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(empty) is None
    asked = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert [tuple(r) for r in langid.predict(asked, None).collect()] == [(1, "und", 0.0, float("inf"))]


def test_fit_is_a_weighted_ridge_regression_on_landmark_features():
    """Outputs of new texts against one least-squares problem with the ridge as further rows."""
    samples = {lang: [" ".join(text.split()[i : i + 6]) for i in range(n)] for (lang, text), n in zip(TEXTS.items(), (12, 7, 9), strict=True)}
    bits = {lang: [np.packbits(langid.presence([t])[0]).tobytes() for t in texts] for lang, texts in samples.items()}
    model = langid.fit(bits, 9)
    marks = [t for lang in sorted(samples) for t in samples[lang][:3]]

    def alike(a, b):
        a, b = grams(a), grams(b)
        return len(a & b) / np.sqrt(len(a) * len(b))

    kernel = lambda texts: np.array([[alike(t, m) for m in marks] for t in texts])
    values, vectors = np.linalg.eigh(kernel(marks))
    features = lambda texts: kernel(texts) @ (vectors / np.sqrt(values))
    rows, targets = [], []
    for n, lang in enumerate(sorted(samples)):
        share = 1 / np.sqrt(len(samples[lang]))
        rows.append(features(samples[lang]) * share)
        targets.append(np.where(np.arange(3) == n, 1.0, -1.0)[None, :].repeat(len(samples[lang]), 0) * share)
    rows.append(np.sqrt(langid.RIDGE) * np.eye(9))
    targets.append(np.zeros((9, 3)))
    weights = np.linalg.lstsq(np.vstack(rows), np.vstack(targets), rcond=None)[0]
    asked = ["the old dog", "une vieille maison", "katze und hund", "x"]
    outputs = features(asked) @ weights
    best, score, margin = model.score(langid.presence(asked))
    shares = np.exp(langid.SHARPNESS * outputs)
    assert best.tolist() == outputs.argmax(axis=1).tolist()
    assert np.allclose(score, (shares / shares.sum(axis=1, keepdims=True)).max(axis=1), atol=1e-3)
    assert np.allclose(margin, outputs.max(axis=1) - outputs.min(axis=1), atol=1e-3)


def test_thousands_of_labels_are_bounded(spark):
    rows = [(i, f"some words of label {i % 2500}", f"l{i % 2500:04d}") for i in range(5000)]
    df = spark.createDataFrame([*rows, *((9000 + i, "often seen here", "l2499") for i in range(5))], "doc_id long, text string, lang string")
    model = langid.learn(df, sample_rows=400, landmarks=50)
    assert len(model.languages) == langid.MOST_LANGUAGES and "l2499" in model.languages and "l0000" in model.languages


def test_margins_tell_foreign_text(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out(docs.doc_id)).select("doc_id", "text", "lang"))
    clean = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    found = [r.margin for r in langid.predict(clean, model).collect()]
    assert all(m >= langid.LEAST_MARGIN for m in found)
    words = {r.lang: r.text for r in clean.where("n_chars > 2000").collect()}
    mixed = spark.createDataFrame([(n, words["en"][:1500] + "\n" + words[lang][:1500]) for n, lang in enumerate(("de", "fr"))], "doc_id long, text string")
    assert all(r.margin >= langid.LEAST_MARGIN for r in langid.predict(mixed, model).collect())
    # fixed values: the first article of the Declaration of Human Rights in languages that weren't learned, and no language
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "qzkw vjxp bnfh ytgd rrlm cxzq wpvk hjbn gfdt ylqm " * 8,
    ]
    asked = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string")
    assert all(r.margin < langid.LEAST_MARGIN for r in langid.predict(asked, model).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op3_language_id(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
