import random
import re

import pytest

from orbweave.llm import neardup
from orbweave.llm.components import connected_components
from orbweave.llm.neardup import near_duplicates

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(rng, words, rate):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in words if rng.random() > rate / 9)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_a_large_group_of_near_copies_matches_brute_force(spark, width, percent):
    rng = random.Random(width)
    base = [f"w{rng.randrange(10**4)}" for _ in range(150)]
    other = [f"e{rng.randrange(10**6)}" if rng.random() < 0.07 else w for w in base]
    rows = [(0, " ".join(base))] + [(k, edited(rng, base if k % 3 else other, rng.choice([0.0, 0.01, 0.03, 0.05, 0.07]))) for k in range(1, 160)]
    rows += [(k, " ".join(f"x{rng.randrange(10**5)}" for _ in range(40)) + " " + " ".join(base[:40])) for k in range(200, 240)]
    rows += [(k, rows[k % 40][1].upper()) for k in range(300, 320)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


@pytest.mark.parametrize("leader_edits", [0, 1])
def test_far_members_of_a_group_are_not_tried_with_all_others(spark, monkeypatch, leader_edits):
    """Copies with many edits of their own, some that share edits, and a few short ones: candidates stay few, links are all found."""
    rng = random.Random(leader_edits)
    base = [f"w{k}" for k in range(150)]

    def changed(words, k, some=100):
        words = list(words)
        for at in rng.sample(range(len(words)), k):
            words[at] = f"e{rng.randrange(some)}"
        return words

    middle = changed(base, leader_edits)
    rows = [middle] + [changed(base, rng.choice([1, 2, 3])) for _ in range(60)] + [changed(base, rng.choice([5, 6, 7])) for _ in range(200)]
    rows += [changed(rng.choice(rows[60:]), 2) for _ in range(40)] + [changed(base[: 150 - k], 1) for k in range(3, 20)] + [changed(base, 2)[k:] for k in range(3, 20)]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    tried, confirmed = [], neardup._confirmed

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(neardup, "_confirmed", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)
    assert len(tried) == 2 and tried[1] < 2 * len(rows)


def test_nulls_short_texts_repeats_and_clashing_columns(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n", 7), (4, "one two", 7), (5, "ONE  two", 7), (5, "ONE  two", 7), (None, "one two", 7), (6, "a " * 30000, 7), (7, "a " * 29000, 7)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component long"), width=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is not None) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False)]
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 300), (300, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}
