import hashlib
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from orbweave.llm import batches
from orbweave.llm.ctph import fingerprints, likeness, op10_document_fingerprints, with_next


def prints(texts):
    return fingerprints(*batches.string_bytes(pa.array(texts, pa.string())))


def test_fingerprints_depend_on_the_text_alone():
    rng = random.Random(6)
    texts = ["", "a", "é🤖", "x" * 5000] + [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(2000))) for _ in range(20)]
    assert prints(texts) == [prints([t])[0] for t in texts]
    assert prints(texts[::-1]) == prints(texts)[::-1]


def test_an_edit_changes_a_part(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(9999)}" for _ in range(3000)]
    a, b, c, d = " ".join(words), " ".join(words[:1500] + ["new"] + words[1500:]), " ".join(words[:1500] + [f"z{k}" for k in range(1500)]), " ".join(f"q{rng.randrange(9999)}" for _ in range(3000))
    pa_, pb, pc, pd = prints([a, b, c, d])
    got = spark.createDataFrame([(pa_, x) for x in (pa_, pb, pc, pd)], "a string, b string").select(likeness(F.col("a"), F.col("b")).alias("v")).collect()
    v = [r.v for r in got]
    assert v[0] == 1 and v[1] > 0.9 and 0.3 < v[2] < 0.8 and v[3] < 0.3


def edited(text, later):
    return text[: len(text) - len(text) // 2] + later[: len(text) // 2]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_next_documents(spark):
    rng = random.Random(8)
    rows = [(k * k * 7 - 50_000, f"text {k} " * rng.randrange(1, 9), k) for k in range(300)]
    rng.shuffle(rows)
    order = sorted(rows)
    want = {i: (sha(edited(t, order[(k + 1) % 300][1])), prints([order[(k + 1) % 300][1]])[0]) for k, (i, t, _) in enumerate(order)}
    for cast in (lambda i: i, lambda i: f"{i + 100_000:09d}"):
        docs = spark.createDataFrame([(cast(i), *r) for i, *r in rows], f"doc_id {'string' if cast(1) != 1 else 'long'}, text string, guest int")
        got = {r.doc_id: (r.edited_sha256, r.next_fingerprint) for r in with_next(docs.repartition(7)).collect()}
        assert got == {cast(i): w for i, w in want.items()}


def test_next_with_nulls_and_repeats(spark):
    rows = [(None, "none"), (3, "three"), (3, "three"), (1, None), (9, "nine")]
    got = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(0, "none", ""), (1, "", "three"), (3, "three", "three"), (3, "three", "nine"), (9, "nine", "none")]
    assert got == sorted((i, len(t), sha(edited(t, n))) for i, t, n in want)
    assert with_next(spark.createDataFrame([(1, "one")], "doc_id long, text string")).collect()[0].edited_sha256 == sha(edited("one", "one"))
    assert with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # one id for all rows
    docs = spark.range(3000).selectExpr("cast(null as bigint) AS doc_id", "concat('text ', id) AS text")
    assert with_next(docs).count() == 3000


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_likeness_is_the_edit_distance_at_common_sizes(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 900))) for _ in range(25)]
    texts += [t[: len(t) // 2] + " and " + t[len(t) // 2 :] for t in texts[:10]] + [t * 2 for t in texts[:5]]
    found = prints(texts)
    pairs = [(a, b) for a in found for b in found]

    def plain(a, b):
        if a == b:
            return 1.0
        (m, *p), (n, *q) = a.split(":"), b.split(":")
        p, q = {int(m): p[0], 2 * int(m): p[1]}, {int(n): q[0], 2 * int(n): q[1]}
        return max((1 - levenshtein(p[s], q[s]) / max(len(p[s]), len(q[s]), 1) for s in p.keys() & q.keys()), default=0.0)

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", likeness(F.col("a"), F.col("b")).alias("v")).collect()
    assert all(abs(r.v - plain(r.a, r.b)) < 1e-9 for r in got)


def test_repeated_passages_have_short_signatures():
    began = time.perf_counter()
    texts = [" " * 1_000_000, "ab " * 333_333, "the same line\n" * 70_000, "x" * 1_000_000, "0123456789abcdef" * 60_000]
    for t, p in zip(texts, prints(texts)):
        assert len(p) < 600 and prints([t]) == [p]
    assert time.perf_counter() - began < 20


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in op10_document_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        new = t[: len(t) - len(t) // 2] + docs[(k + 1) % len(docs)][1][: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert [got[i].fingerprint, got[i].edited_fingerprint] == prints([t, new])
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
