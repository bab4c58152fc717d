"""Language identification against all paths, and what is learned and kept."""

import itertools

import numpy as np

from dossier.llm import langid


def _total(scores, path, switch):
    return sum(scores[i, j] for i, j in enumerate(path)) - switch * sum(a != b for a, b in itertools.pairwise(path))


def test_viterbi_takes_a_path_without_the_best_label():
    scores = np.array([[-4.0, 0.0, -9.0]] * 3 + [[-4.0, -9.0, 0.0]] * 3)
    assert langid.viterbi(scores, 14.0).tolist() == [1, 1, 1, 2, 2, 2]


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for case in range(400):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = -rng.choice([0.0, 1.0, 3.0, 5.0, 9.0], (n, k))
        switch = float(rng.choice([1.0, 4.0, 9.0, 14.0]))
        most = max(_total(scores, p, switch) for p in itertools.product(range(k), repeat=n))
        assert abs(_total(scores, langid.viterbi(scores, switch).tolist(), switch) - most) < 1e-9, case


def test_every_labelled_language_is_learned(spark):
    rows = [(i, f"the weather was fine on day {i}", "en") for i in range(3000)] + [(9000, "жили были дед и баба", "ru"), (None, "καλημέρα σας", "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, sample=20)
    assert model.langs == ["el", "en", "ru"]
    assert [langid.label(model, t)[0] for t in ("баба и дед", "σας", "the day")] == ["ru", "el", "en"]


def test_no_labels(spark, none):
    assert langid.learn(none).langs == []
    assert langid.predict(none).collect() == []


def test_all_counts_of_each_language_are_kept(spark):
    rows = [(i, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijklmn"), "en") for i in range(50)] + [(99, "был", "ru")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.label(model, "был")[0] == "ru"
    for text, at in (("был", 1), ("ai", 0)):
        words = langid.Words(text)
        assert (model.table[words.two][:, at] > model.table[words.two][:, 1 - at]).any()


def test_held_out_accuracy(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"])
    langs = dict(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), strict=True))
    found = langid.predict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    judged = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"] and langs[r["doc_id"]]]
    assert len(found) == len(langs) and len(judged) > 100 and sum(judged) >= 0.97 * len(judged)


def test_mixed_documents_stay(spark):
    known = {"en": "the weather was fine and we went out", "ru": "жили были дед и баба у самого моря", "el": "καλημέρα σας τι κάνετε σήμερα εσείς"}
    rows = [(10 * i + k, text, lang, 1.5) for k, (lang, text) in enumerate(known.items()) for i in range(40)]
    rows += [
        (9001, " ".join(known.values()), None, 1.5),
        (9002, "これはまったくちがうもじでかかれたぶんしょう the", None, 1.5),
        (9003, "123 456", None, 1.5),
        (9004, None, None, 1.5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    kept = langid.identified_documents(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - {9002, 9003, 9004}
    assert {r["score"] for r in kept} == {1.5}
    assert langid.label(langid.learn(docs), rows[-4][1])[1] < 0.5
