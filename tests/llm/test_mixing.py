import re
from collections import defaultdict

from orbweave.llm.mixing import decide, mix, op7_mix_sources


def water(sizes, weights=(5, 2, 1), most=3):
    """The contract's targets by rounds of sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s] - 1e-9}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def run(spark, rows):
    return decide(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()


def test_targets_and_words_taken(spark):
    rows = [(k, "w " * (1 + 37 * k % 50), s) for k, s in enumerate((["a"] * 400 + ["b"] * 30 + ["c"] * 20 + [None] * 20 + ["e"]))]
    got = run(spark, rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken, largest = water(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and abs(r.copies - r.target / r.source_size) < 1 + 1e-9
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 * largest[s] + 1e-6
    again = run(spark, rows[::-1])
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_inclusion_is_random_but_follows_the_probability(spark):
    rows = [(k, "a b c", "a" if k % 2 else "b") for k in range(2000)]
    chosen = [r.doc_id for r in run(spark, rows) if r.source == "b" and r.copies == 1]
    assert 0.5 < len(chosen) / 1000 < 0.65  # 4/7 of the words of b are wanted
    low = sum(k < 1000 for k in chosen) / len(chosen)
    assert 0.4 < low < 0.6


def test_nulls_empty_texts_repeats_and_empty_table(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (4, "x y", "a"), (4, "x y", "a"), (None, "x", "a"), (5, "w " * 60_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.source, r.size): r for r in decide(docs).collect()}
    assert got[1, "a", 0].copies == 0 and got[2, "a", 0].copies == 0 and got[4, "a", 2].rows == 2
    out = mix(docs.withColumn("copies", docs.doc_id)).collect()
    assert len(out) == sum(r.copies for r in decide(docs).collect())
    assert {r.copies for r in out} <= {1, 2, 3, 4, 5, None}
    assert decide(docs.limit(0)).count() == 0


def test_query_holds_every_document(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op7_mix_sources(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)


def test_rows_without_an_id_are_rows_of_their_own(spark):
    rows = [(None, "w " * 10, "a")] * 1000 + [(k, "w " * 10, "b") for k in range(1000)]
    got = run(spark, rows)
    assert len(got) == 2000
    for s in "ab":
        words = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(words - next(r.target for r in got if r.source == s)) <= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mix(docs).where("source = 'a'").count() == sum(r.copies for r in got if r.source == "a")


def test_clashing_columns_are_kept(spark):
    names = ["_id", "_copies", "_size", "_words", "_copy", "full", "copies", "rows", "h", "own_id", "nth", "size"]
    docs = spark.createDataFrame([(k, "a b c", "s", *names) for k in range(5)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mix(docs).collect()
    assert len(out) == 5 and all([r[n] for n in names] == names and r.text == "a b c" for r in out)
