import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from orbweave.llm.secrets import find_secrets, randomness_p

ASSIGN = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_base_spans_match_a_plain_scan(spark):
    texts = [
        None, "", "é🤖 Password : 'abc123' and TOKEN=abc", "secret: token: abcdefgh", "token=token=secret123 api_key=\"A.b-c_d/e+f=\"", "AKIA" + "A1" * 8 + " AKIA" + "B" * 15, "0123456789abcdef01234567" * 2 + " 0123456789abcdef0123456",
        "apikey='zzzzzz'passwd:yyyyyyy", "tokén=abcdefgh token =  =abcdefg", "x" * 200_000 + " secret=hunter22",
    ]
    df = spark.createDataFrame([(k, t, "kept?") for k, t in enumerate(texts)], "doc_id long, text string, secrets string")
    got = {r.doc_id: [(s.start, s.kind_no, s.end, s.kind) for s in r.secrets if s.kind_no < 3] for r in find_secrets(df).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    sets = [string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"]
    tokens = ["".join(rng.choice(sets[k % 4]) for _ in range(40)) for k in range(60)]
    tokens = [t for t in tokens if any(c.isdigit() for c in t)]
    words = [f"{rng.choice(['report', 'version', 'meeting', 'station'])}_{rng.choice(['january', 'february', 'summary'])}_20{rng.randrange(10, 30)}" for _ in range(300)]
    rows = [(k, f"the value {t} here") for k, t in enumerate(tokens)] + [(1000 + k, f"see {w} and 12345678901234567890 there") for k, w in enumerate(words)]
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "random"] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == [(10, 10 + len(t))] for k, t in enumerate(tokens)) >= 0.9 * len(tokens)
    assert not any(got[1000 + k] for k in range(len(words)))


def test_p_falls_with_length_and_rises_with_structure(spark):
    rng = random.Random(2)
    token = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(96))
    rows = [(token[:20],), (token[:40],), (token,), ("abcdefghijklmnopqrstuvwxyz0123456789",), ("0" * 40 + "a",), ("short1",), ("1" * 30,)]
    p = [r[0] for r in spark.createDataFrame(rows, "t string").select(randomness_p(F.col("t"))).collect()]
    assert p[0] > p[1] > p[2] and p[3] > 0.001 and p[4] > 0.9 and p[5] is None and p[6] is None


def test_empty_table_and_repeats(spark):
    assert find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    two = find_secrets(spark.createDataFrame([(1, "secret=abcdef"), (1, "secret=abcdef"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted(len(r.secrets) for r in two) == [0, 1, 1]


def test_query_digest(spark, sf_dir):
    from orbweave.llm.secrets import op1_secret_scan

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_secret_scan(spark, sf_dir).collect():
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
