import numpy as np

from orbweave.llm.langid import codewords, identify, op3_language_id, train


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 20):
        code = codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[i + 1 :]]
        assert min(apart) >= (1 if n == 2 else 2) and (n < 7 or min(apart) >= 5)


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    test = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    rows = [(k, "the quick brown fox and the dog", "en") for k in range(20)] + [(k, "der schnelle braune Fuchs und der Hund", "de") for k in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "und der Hund"), (None, "the dog"), (5, "é"), (6, "the fox " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in identify(asked, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "de" and got[None] == "en" and got[5] in ("en", "de") and got[6] == "en"
    assert train(docs.limit(0)) is None
    assert {r.lang_pred for r in identify(asked, None).collect()} == {"und"}
    one = train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in identify(asked.where("doc_id >= 4"), one).collect()} == {"en"}
    assert identify(asked.limit(0), model).count() == 0
