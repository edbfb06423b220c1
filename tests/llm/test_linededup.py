import random

from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.llm.linededup import common_blocks, line_dedup, pair_blocks, patience

line = st.integers(0, 6)


@settings(max_examples=200, deadline=None)
@given(st.lists(line, max_size=25), st.lists(line, max_size=25))
def test_alignment_is_increasing_and_equal(a, b):
    got = patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    if a == b:
        assert got == [(k, k) for k in range(len(a))]


def test_blocks_need_words():
    assert common_blocks([(0, 3), (1, 4), (5, 5)], [0, 0, 0, 12, 9, 30], 20) == [3, 4, 5]
    assert common_blocks([(0, 3), (1, 5)], [9] * 6, 20) == []


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_the_first_holder_keeps_every_line(spark):
    rng = random.Random(3)
    shared = [sentence(rng, 60) for _ in range(4)]
    rows = []
    for k in range(120):
        own = [sentence(rng, rng.randrange(1, 15)) for _ in range(6)]
        at = rng.randrange(6)
        rows.append((k, "\n".join(own[:at] + (shared[k % 4 : k % 4 + 1] if k % 2 else []) + ["The end."] + own[at:])))
    rows += [(200 + k, rows[k][1]) for k in range(5)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for k, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, k)
    for k, t in rows[:120]:
        again = [x for x in t.split("\n") if len(x.split()) >= 20 and first[x] < k]
        # the line behind the passage is the same in all documents: it belongs to the block
        want = [x for x in t.split("\n") if x not in again and not (again and x == "The end.")]
        assert got[k].text == "\n".join(want), k
    assert all(got[200 + k].text == "" and got[200 + k].n_removed == 7 + k % 2 for k in range(5))


def test_edge_cases(spark):
    long = sentence(random.Random(4), 30)
    rows = [(1, None, "x"), (2, "", "x"), (None, long, "x"), (3, long, "x"), (3, long, "x"), (4, f"a\n{long}\n{long}", "x"), (5, "\n" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    got = line_dedup(docs).collect()
    assert len(got) == len(rows) and all(r.lines == "x" for r in got)
    assert [r.text for r in got if r.doc_id == 3] == [long, long]
    assert [r.text for r in got if r.doc_id is None] == [long]
    assert [r.n_removed for r in got if r.doc_id == 4] == [1]
    assert {r.doc_id: r.n_lines for r in got if r.doc_id in (1, 2, 5)} == {1: 0, 2: 1, 5: 5001}
    assert line_dedup(docs.limit(0)).count() == 0


def all_pairs(rows):
    """The texts that are left when each document is aligned with every earlier one."""
    split = [(k, t.split("\n")) for k, t in sorted(rows)]
    out = {}
    for n, (k, b) in enumerate(split):
        count = lambda lines: [len(x.split()) for x in lines]
        gone = {j for _, a in split[:n] for j in pair_blocks([hash(x) for x in a], count(a), [hash(x) for x in b], count(b), 20)}
        out[k] = "\n".join(x for j, x in enumerate(b) if j not in gone)
    return out


def left(spark, rows):
    return {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_first_holder_that_aligns_nothing_is_not_the_last_partner(spark):
    rng = random.Random(5)
    own = lambda n=3: sentence(rng, n)
    twice, one, two = sentence(rng, 50), sentence(rng, 50), sentence(rng, 50)
    rows = [(0, "\n".join([twice, own(), twice]))] + [(1 + k, "\n".join([own(), twice, own()])) for k in range(40)]
    rows += [(100, "\n".join([one, own(), two]))] + [(101 + k, "\n".join([own(), two, own(), one, own()])) for k in range(40)]
    # each line of the block has an earlier first holder that has only this line
    block = [sentence(rng, 9) for _ in range(6)]
    rows += [(200 + k, "\n".join([own(), x, own()])) for k, x in enumerate(block)]
    rows += [(210 + k, "\n".join([own(), *block, own()])) for k in range(40)]
    got = left(spark, rows)
    assert got == all_pairs(rows)
    # document 0 has the passage twice, so no line of it is an anchor; its window is shared all the same
    assert [k for k, t in got.items() if twice in t] == [0]


def test_random_documents_equal_all_pairs(spark):
    rng = random.Random(6)
    pool = [sentence(rng, rng.choice([1, 2, 3, 4, 9, 25])) for _ in range(30)] + ["", ""]
    rows = []
    for k in range(150):
        at = rng.randrange(25)
        mix = [rng.choice(pool) for _ in range(rng.randrange(6))]
        rows.append((k, "\n".join(mix + pool[at : at + rng.randrange(3, 9)] + [sentence(rng, 2)] + pool[at - 7 : at][: rng.randrange(1, 7)])))
    got, want = left(spark, rows), all_pairs(rows)
    assert {k: t for k, t in got.items() if t != want[k]} == {}


def test_passages_of_short_lines_are_found(spark):
    rng = random.Random(7)
    verse = "\n".join(sentence(rng, rng.randrange(1, 5)) for _ in range(30))
    rows = [(k, f"{sentence(rng, 3)}\n{verse}\n{sentence(rng, 3)}") for k in range(3)]
    got = left(spark, rows)
    assert got == all_pairs(rows) and [k for k, t in got.items() if verse in t] == [0]


def test_clashing_columns_are_kept(spark):
    long = sentence(random.Random(8), 30)
    names = ["_id", "_h", "_gone", "id", "h", "gone", "full", "lines", "words"]
    docs = spark.createDataFrame([(k, long, *names, 7) for k in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names) + ", n_lines int")
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert all([r[n] for n in names] == names and r.n_lines == 1 for r in got.values()) and [got[1].text, got[2].text] == [long, ""]


def common_runs(a, b, least=20):
    """Places of b in a run of lines, of so many words or more, that a has too: every run at every place, without any alignment."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(len(x.split()) for x in b[j : j + n]) >= least:
                out |= set(range(j, j + n))
    return out


def test_repeated_and_moved_lines_go_like_all_common_runs(spark):
    rng = random.Random(9)
    own = lambda n=3: sentence(rng, n)
    four, other, verse = own(4), own(4), [own(7) for _ in range(4)]
    rows = [
        (1, "\n".join([own(), *[four] * 10, own()])), (2, "\n".join([own(), own(), *[four] * 10, own()])),
        (3, "\n".join([own(), *[four, other] * 8, own()])), (4, "\n".join([own(), *[four, other] * 6, own()])),
        (5, "\n".join([own(), *verse, own(), *[other] * 6])), (6, "\n".join([*[other] * 6, own(), *verse, own()])),
        (7, "\n".join([own(), *["", four, ""] * 9, own()])), (8, "\n".join([own(), own(), *["", four, ""] * 9])),
    ]
    for k in range(40):
        rows.append((10 + k, "\n".join(x for _ in range(rng.randint(1, 4)) for x in ([own()] + rng.choice([verse, [other, four] * 5, [four] * 7, ["", other] * 8])))))
    split = [(k, t.split("\n")) for k, t in rows]
    got = left(spark, rows)
    for n, (k, b) in enumerate(split):
        runs = {j for _, a in split[:n] for j in common_runs(a, b)}
        once = {j for _, a in split[:n] for j in common_runs(a, b) if all(a.count(x) >= b.count(x) for x in set(a) & set(b))}
        stay = [x for j, x in enumerate(b) if j not in runs]
        if once == runs:
            assert got[k].split("\n") == (stay or [""]), k
        assert len(got[k].split("\n")) >= len(stay)
    assert [four in got[k] for k in (1, 2)] == [True, False] and other not in got[4] and verse[0] not in got[6]
