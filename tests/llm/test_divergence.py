import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from orbweave.llm.divergence import _by_source, _runs, divergence, kept_terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "lang string, source string, text string"


def brute(rows, least, top):
    """All kept terms for all pairs of groups."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = Counter(TERM.findall((text or "").translate(FOLD)))
        counts[lang, source] += words
        docs[lang].update(list(words))
        groups.add((lang, source))
    out = set()
    for lang in {g for g, _ in groups}:
        terms = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in terms) + 5 * len(terms)) for t in terms}
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for a in sources:
            found = {"pair": [(sum(abs(p[a][t] - p[b][t]) for t in terms), b) for b in sources if b != a], "term": [(p[a][t] - q[t], t) for t in terms if counts[lang, a][t] and p[a][t] > q[t]]}
            for part, items in found.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, a, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def documents(n, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "É", "ab", "x", "李") for b in ("", "a", "b", "cé", "d")]
    out = []
    for k in range(n):
        source = rng.choice([None, "", "hot", "hot", "hot", "s1", "s2", "s3", "sé"])
        lang = rng.choice(["en", "en", "de", None])
        own = words[hash((source or "x")[:1]) % 3 :: 3] if rng.random() < 0.5 else words
        out.append((lang, source, "".join(rng.choice(own) + rng.choice([" ", "1", "-", "\n"]) for _ in range(rng.randint(0, 12)))))
    return [*out, ("en", "hot", None), ("xx", "only", "rare word"), ("xx", "other", ""), ("en", "empty", ""), ("en", "long", "The " * 50_000)]


def rows_of(df):
    return [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]


def test_matches_brute_force(spark):
    for n, least, top in ((400, 30, 50), (300, 2, 3), (60, 30, 50)):
        rows = documents(n, n)
        got = rows_of(divergence(spark.createDataFrame(rows, KIND).repartition(7), least=least, top=top))
        assert len(got) == len(set(got)) and set(got) == brute(rows, least, top)


def test_groups_of_very_different_size(spark):
    """A small group's share at count 0 lies above shares of a large group's terms."""
    rows = [("en", "big", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300) for _ in range(1 + k % 40)))] * 3 + [("en", "small", "aa ba")] * 2 + [("en", "none", "1 2")]
    assert set(rows_of(divergence(spark.createDataFrame(rows, KIND), least=1))) == brute(rows, 1, 50)


def test_partial_rows_add_up_however_they_are_sent(spark):
    rows = documents(200, 9)
    key = lambda df: sorted((r.lang, r.term, r.source, r["count"], r.total) for r in df.collect())
    docs = spark.createDataFrame(rows, KIND)
    assert key(kept_terms(docs, held_rows=1)) == key(kept_terms(docs)) == key(kept_terms(docs.repartition(13)))


def test_runs_across_batches():
    table = pa.table({"lang": ["a"] * 9, "term": list("xxxxyyzzz"), "source": list("ppqqpppqq"), "docs": np.ones(9, int), "count": np.arange(9)})
    for size in (1, 2, 3, 9):
        got = pa.concat_tables([_by_source(t) for t in _runs(iter(table.to_batches(size)), _by_source)]).to_pylist()
        assert [(r["term"], r["source"], r["docs"], r["count"]) for r in got] == [("x", "p", 2, 1), ("x", "q", 2, 5), ("y", "p", 2, 9), ("z", "p", 1, 6), ("z", "q", 2, 15)]


def test_empty_table_and_clashing_columns(spark):
    assert divergence(spark.createDataFrame([], KIND)).count() == 0
    rows = spark.createDataFrame([("en", "a", "x y", 1, "p"), ("en", "b", "x", 2, "p")], KIND + ", item int, term string")
    assert sorted(rows_of(divergence(rows, least=1)))[0][:4] == ("en", "a", "pair", "b")
