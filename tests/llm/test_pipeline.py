import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_clean_documents_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "encode"]
    first = corpus_pipeline.language(spark, docs, sf_dir)
    assert first.columns == corpus_pipeline.COLUMNS and first.count() >= docs.count() - 2
    second = corpus_pipeline.lines(spark, first, sf_dir)
    assert second.columns == corpus_pipeline.COLUMNS
    texts = {r.doc_id: r.text for r in docs.collect()}
    first_of, seen = {}, set()
    for r in sorted(second.collect(), key=lambda r: r.doc_id):
        got, was = r.text.split("\n"), texts[r.doc_id].split("\n")
        assert set(got) <= set(was)
        # a line of 20 words or more is a block by itself: one copy of it stays
        long = {x.strip() for x in got if len(x.split()) >= 20}
        assert not long & seen, r.doc_id
        seen |= long
        first_of.setdefault(r.text, r.doc_id)
    for t, k in texts.items():
        if k is not None and len(k.split()) < 20 and t in first_of.values():
            assert first_of[k] <= t  # short texts stay as they are


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")


def words(seed, n, kind="w"):
    rng = random.Random(seed)
    return " ".join(f"{kind}{rng.choice('abcdefghij')}{rng.choice('klmnopq')}" for _ in range(n))


def test_near_duplicates_loses_no_document_and_keeps_none_twice(spark):
    one, other = words(1, 60), words(2, 60, "z")
    rows = [(1, one, "a", "s"), (3, one, "a", "s"), (3, other, "a", "s"), (5, "short", "a", "s"), (5, "short", "a", "s"), (None, words(3, 50), "a", "s"), (None, words(4, 50), "a", "s"), (7, None, "a", "s"), (8, "", "a", "s"), (9, words(3, 50), "a", "s")]
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()), key=str)
    kept = [t for _, t in got]
    assert kept.count(one) == 1 and (3, other) in got and kept.count("short") == 1 and (7, None) in got and (8, "") in got
    assert kept.count(words(3, 50)) == 1 and kept.count(words(4, 50)) == 1 and len(got) == 7


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    base = [words(k, 80).split() for k in range(12)]
    rows = []
    for k in range(90):
        w = list(base[k % 12])
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        rows.append((k, " ".join(w), "a", "s"))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t, _, _ in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    groups = [find(k) for k in got]
    assert len(groups) == len(set(groups)) and set(groups) == {find(k) for k in sets}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeats, a text of one word, and a clashing extra column; then an empty table."""
    text = " ".join(["the thing in the house was there and that is what they said"] * 3)
    rows = [(1, text, "en", None), (1, text, "en", None), (None, None, None, None), (2, None, "en", "a"), (3, "", "en", "a"), (4, "word " * 20_000, "en", "a")]
    docs = table(spark, rows).withColumn("row_key", F.lit("x")).withColumn("lang_pred", F.lit("x")).withColumn("copies", F.lit(1))
    for some in (docs, docs.limit(0)):
        folder = tmp_path / f"sf{some.count()}"
        some.write.parquet(f"{folder}/documents.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert all(r.round_trip for r in got) and {r.doc_id for r in got} <= {1, 4}
    assert not got


def test_whole_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and all(r.n_tokens == len(r.token_ids) and r.round_trip for r in got)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, r.n_tokens) for r in again)
