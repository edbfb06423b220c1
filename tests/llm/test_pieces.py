import random
import time

import numpy as np
import pyarrow as pa
import pytest

from orbweave.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


TEXTS = ["", " ", "a", " a ", "Hello  world\n\tfoo 你好 🤖x", "🤖🤖 \n\n 🤖", "  b   c\n\n d", "internationalization" * 40, "1234567890 https://www.example.com/a?b=c&d=e", "\n", " \n ", "é" * 300, "ﬁ ½ Å ​ x", "\x00\x01 tab\t"]


def test_ids_equal_the_library(vocabulary, library):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz      ,.-'ÉéüñАбв中\n0123456789🤖"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(60)]
    ids, begin = pieces.encode(vocabulary, pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == library.encode(t), repr(t)


def test_runs_of_spaces_equal_the_library(vocabulary, library):
    texts = [" " * k for k in range(60)] + ["x" + " " * k + y for k in range(40) for y in ("the", "中 y", "\n")]
    ids, begin = pieces.encode(vocabulary, pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == library.encode(t), repr(t)


def test_long_words_equal_the_library(vocabulary, library):
    rng = random.Random(6)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["a" * 3001, "ab" * 1500, "é中x" * 700, "".join(rng.choice(base64) for _ in range(3000)), "".join(rng.choice("etaoin") for _ in range(1500))]
    ids, begin = pieces.encode(vocabulary, pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == library.encode(t), t[:20]


@pytest.mark.parametrize("unit", [" ", "a", "token", "ab ", "a  ", "中", "\n"])
def test_a_million_characters_end_soon(vocabulary, unit):
    began = time.perf_counter()
    ids, begin = pieces.encode(vocabulary, pa.array([unit * (1_000_000 // len(unit))]))
    body, at = pieces.decode(vocabulary, ids, begin)
    assert body.tobytes().decode() == unit * (1_000_000 // len(unit)) and time.perf_counter() - began < 10


def test_plain_viterbi_has_the_largest_sum_of_scores():
    v = pieces.load(merges=False)
    rng = random.Random(7)
    words = ["".join(rng.choice("theraninsé🤖") for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["the" * 150]
    value = {p: s for p, (s, _) in v.scores.items() if not p.startswith(pieces.SPACE * 2)}
    ids, begin = pieces.encode(v, pa.array(words))
    name = {i: p for p, (_, i) in v.scores.items()}
    for k, w in enumerate(words):
        w = pieces.SPACE + w
        best = [0.0] + [-1e300] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - 16), j):
                best[j] = max(best[j], best[i] + value.get(w[i:j], v.values[-1] if j - i == 1 else -1e300))
        got = [name.get(i) for i in ids[begin[k] : begin[k + 1]].tolist()]
        total = sum(value[p] for p in got if p) + v.values[-1] * sum(c not in value for c in w)
        assert abs(total - best[-1]) < 1e-6, w


def test_query_equals_the_library_on_all_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = pieces.op5_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.token_ids == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.token_ids) and r.round_trip


def test_round_trip(vocabulary):
    ids, begin = pieces.encode(vocabulary, pa.array(TEXTS))
    body, at = pieces.decode(vocabulary, ids, begin)
    raw = body.tobytes()
    assert [raw[at[k] : at[k + 1]].decode() for k in range(len(TEXTS))] == TEXTS


def test_a_forgotten_cache_changes_nothing(vocabulary, monkeypatch):
    want = pieces.encode(vocabulary, pa.array(TEXTS))[0]
    monkeypatch.setattr(pieces, "CACHE", 10)
    assert np.array_equal(pieces.encode(vocabulary, pa.array(TEXTS))[0], want)


def test_documents(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "a b\nc", 5), (3, "a b\nc", 5), (None, "x▁y", 5), (4, "long word " * 30_000, 5)]
    got = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].token_ids == [] and by[1].round_trip and by[2].n_tokens == 0
    assert by[3].token_ids == library.encode("a b\nc") and by[3].round_trip and not by[None].round_trip
    assert by[4].n_tokens == len(library.encode(rows[-1][1])) and by[4].round_trip
    assert pieces.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
