import random
import re

import pytest

from orbweave.llm.decontaminate import decontaminate, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, BENCH = "doc_id long, text string", "item_id long, text string"


def brute(text, items, size=10):
    """n_words, hit words, items, by trying each window at each place."""
    words = WORD.findall((text or "").translate(FOLD))
    hit, met = set(), set()
    for item, bench in items:
        ws = WORD.findall((bench or "").translate(FOLD))
        n = min(len(ws), size)
        for i in range(len(ws) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == ws[i : i + n]:
                    hit |= set(range(k, k + n))
                    met |= {item} - {None}
    return len(words), hit, sorted(met)


def check(found, docs, items, size=10):
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(docs)
    for k, text in docs:
        n, hit, met = brute(text, items, size)
        r = got[k]
        words = [w.span() for w in WORD.finditer((text or "").translate(FOLD))]
        spanned = {x for s in r.word_spans for x in range(s["start"], s["end"])}
        assert (r.n_words, r.n_hit, spanned, r["items"]) == (n, len(hit), hit, met), (k, text)
        assert [(s["start"], s["end"]) for s in r.char_spans] == [(words[s["start"]][0], words[s["end"] - 1][1]) for s in r.word_spans]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    words = ["ab", "cd", "É", "fooo", "x1", "straße", "李明", "g"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", " \x00 "]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 14, 30]))) for k in range(14)] + [(3, "AB cd straße G ab É x1"), (None, text(12)), (20, None), (21, "ab"), (22, "ab")]
    docs = [(0, None), (1, ""), (2, "-- \n"), (3, text(4000))]
    for k in range(4, 60):
        part = (rng.choice(items)[1] or "").split(" ")
        cut = " ".join(part[rng.randint(0, 2) :])
        docs.append((k, text(rng.randint(0, 25)) + cut.upper().replace("SS", "ss") + " " + text(rng.randint(0, 9))))
    return docs, items


def test_hits_match_brute_force(spark, planted):
    docs, items = planted
    check(find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)), docs, items)


def test_several_blocks_and_small_windows(spark, planted):
    docs, items = planted
    check(find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH), block_bytes=150), docs, items)
    check(find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH), size=3), docs, items, 3)


def test_windows_do_not_run_over_texts(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], BENCH)
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven eight nine ten"), (3, "one two three four five six seven eight nine ten")], DOCS).coalesce(1)
    assert {r.doc_id: r.n_hit for r in find_contamination(docs, bench).collect()} == {1: 0, 2: 0, 3: 10}


def test_removal_of_documents_and_spans(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, "Ünder: " + item + "! end", 7), (1, "clean", 8), (None, None, 9)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(1, item)], BENCH)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted((r.n_hit for r in kept.collect())) == [8, 9]
    cut = decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns and sorted((r.n_hit, r.text) for r in cut.collect()) == [(7, "Ünder: ! end"), (8, "clean"), (9, None)]


def test_empty_tables_repeats_and_long_texts(spark):
    empty, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w " * 10)], BENCH)
    assert find_contamination(empty, bench).count() == 0 and find_contamination(empty, spark.createDataFrame([], BENCH)).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000), (1, "w " * 300_000), (2, "v " * 300_000)], DOCS)
    assert sorted((r.doc_id, r.n_hit, len(r.word_spans)) for r in find_contamination(long, bench).collect()) == [(1, 300_000, 1), (1, 300_000, 1), (2, 0, 0)]
    assert sum(r.n_hit for r in find_contamination(long, spark.createDataFrame([], BENCH)).collect()) == 0
