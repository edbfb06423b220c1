import math
import re

from orbweave.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, find_licenses, template_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    t = (text or "").translate(FOLD)
    words = WORD.findall(t)
    starts = sorted((k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    blocks = t.split("\n") + [p for p in re.split(r"\n\s*\n", t) if "\n" in p.replace("\r", "").strip(" ")]
    met = {}
    for name, ws in template_words(TEMPLATES).items():
        for b in blocks:
            both = len(set(ws) & set(WORD.findall(b)))
            if both >= math.ceil(CONTAINMENT * len(ws) - 1e-9):
                met[name] = max(met.get(name, 0), both / len(ws))
    return len(words), starts, sorted(met.items())


def test_phrases_and_templates_match_brute_force(spark):
    mit = TEMPLATES["mit-grant"]
    texts = [
        None, "", "MIT License", "mit, LICENSE mit license", "the MIT-License under the apache   license (GNU General Public License)", mit, mit.replace(" ", "\n"), "intro words\n\n" + mit.replace(", ", ",\n") + "\n\nmore", " ".join(mit.split()[:30]),
        TEMPLATES["apache-notice"] + "\n" + TEMPLATES["gpl-notice"], "permission is here but nothing else of it", "Ünïted mit license\r\n\r\nfoo\nbar", "word " * 50_000 + TEMPLATES["bsd-terms"],
    ]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, templates int")
    got = {r.doc_id: (r.n_words, sorted((s["at"], s.label) for s in r.starts), [(t.label, t.score) for t in r.templates]) for r in find_licenses(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_empty_table_and_repeats(spark):
    assert find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [len(r.starts) for r in find_licenses(spark.createDataFrame([(None, "mit license"), (None, "mit license")], "doc_id long, text string")).collect()] == [1, 1]
