"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of it is learned by a binary classifier on hashed byte bigrams and trigrams of
the whole text: the log-odds of the languages with the bit against those without, averaged over the text's n-grams.
A text's language is the one whose codeword has the least loss, bits weighted by how well they did, for that
language, on the training rows. The score says how far the second one is; a low one flags the text as ambiguous.

Training takes at most about TRAIN_ROWS rows of a language (by a hash of the id); n-gram counts are summed on
the executors, so the driver gets one table of counts a language. Prediction reads the text alone and is a map: no
shuffle, no key.

Defined results: a null or letterless text is `und` with score 0; without any training row every text is `und`; a
null id is no training row and not held out (its remainder is null: false); repeated rows are rows; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm import batches
from orbweave.llm.storage import checkpointed

UNKNOWN = "und"
#: Rows of a language that training takes, about.
TRAIN_ROWS = 2_000
TRAIN_TASKS = 8
BUCKETS = 1 << 16
#: Least score of a text that isn't flagged as ambiguous.
CLEAR = 0.05
_LETTER = re.compile(r"[^\W\d_]")

#: ASCII letters fold to lower case, other ASCII bytes to a space; bytes of other letters stay.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 0x20
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +-1: all splits of up to 4 languages; beyond that the best spread of 200 seeded draws."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 4:
        bits = [[1 if (k >> r) & 1 else -1 for r in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(bits, np.float32).T.copy()
    width = max(15, math.ceil(10 * math.log2(n)))
    draws = [np.where(np.random.default_rng(k).random((n, width)) < 0.5, -1, 1).astype(np.float32) for k in range(200)]

    def spread(code):
        apart = (width - code @ code.T) / 2
        useless = sum(abs(col.sum()) == n for col in code.T)
        return (np.min(apart[~np.eye(n, dtype=bool)]) - useless, apart.sum())

    return max(draws, key=spread)


def ngrams(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the bigram and of the trigram that start at each byte (a text ends with spaces), and its borders."""
    sizes = np.diff(at)
    wide = at + 2 * np.arange(len(at))
    text = np.full(wide[-1] + 2, 0x20, np.uint8)
    text[np.repeat(2 * np.arange(len(sizes)), sizes) + np.arange(len(body))] = _PLAIN[body]
    x = text.astype(np.uint32)
    two = x[:-2] << 8 | x[1:-1]
    three = two << 8 | x[2:]
    fold = lambda v, salt: ((v * np.uint32(2654435761) ^ np.uint32(salt)) * np.uint32(2246822519) >> np.uint32(17)).astype(np.uint16)
    return fold(two, 0), fold(three, 97) + np.uint16(BUCKETS // 2), wide


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (langs, bits)
    weights: np.ndarray  # (bits, BUCKETS)
    trust: np.ndarray  # (langs, bits), rows add up to 1

    def margins(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(bits, texts): mean log-odds over the n-grams of each text."""
        two, three, wide = ngrams(body, at)
        begin, number = wide[:-1], np.diff(wide)
        return np.stack([np.add.reduceat(w[two] + w[three], begin) / number for w in self.weights]) if len(number) else np.zeros((len(self.weights), 0))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text, and its score."""
        if len(self.langs) == 1:
            return np.zeros(margins.shape[1], int), np.ones(margins.shape[1])
        loss = np.stack([(t[:, None] * np.exp(-np.clip(4 * c[:, None] * margins, -8, 8))).sum(0) for c, t in zip(self.code, self.trust, strict=True)])
        best = loss.argmin(0)
        two = np.partition(loss, 1, axis=0)
        return best, np.clip(1 - two[0] / two[1], 0, 1)


def _text_parts(stream: Iterator[pa.RecordBatch], text: str):
    for batch in stream:
        for a, b in batches.pieces(batch, text):
            part = batch.slice(a, b - a)
            yield part, *batches.string_bytes(part.column(part.schema.get_field_index(text)))


def _counts(langs: list[str]):
    """mapInArrow function on (lang, text): counts of buckets by language, a row for each language in the partition."""

    def run(stream):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        place = {x: k for k, x in enumerate(langs)}
        for part, body, at in _text_parts(stream, "text"):
            two, three, wide = ngrams(body, at)
            lang = np.repeat([place[x] for x in part.column(0).to_pylist()], np.diff(wide))
            for grams in (two, three):
                total += np.bincount(lang * BUCKETS + grams[: len(lang)], minlength=total.size).reshape(total.shape)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in some], pa.string()), pa.array([total[k].tobytes() for k in some], pa.binary())], names=["lang", "counts"])

    return run


def _margins(model: Model):
    """mapInArrow function on (lang, text): lang, margins."""

    def run(stream):
        for part, body, at in _text_parts(stream, "text"):
            m = model.margins(body, at).T
            yield pa.RecordBatch.from_arrays([part.column(0), batches.list_array(m.reshape(-1).astype(np.float64), np.arange(len(m) + 1) * m.shape[1], pa.float64())], names=["lang", "margins"])

    return run


def train(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from about `rows` rows at most of each language; None where no row has a language and a text."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows / sizes[k]))]), F.col("lang"))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    # bounded by rows * languages, so a few tasks do; the scan itself keeps all of its tasks
    sample = checkpointed(sample.repartition(TRAIN_TASKS))
    total = np.zeros((len(langs), BUCKETS))
    for r in sample.mapInArrow(_counts(langs), "lang string, counts binary").collect():
        total[langs.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
    rate = (total + 0.5) / (total.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(langs))
    one = lambda side: np.log(rate[side].mean(0)) if side.any() else np.zeros(BUCKETS)
    weights = np.stack([one(c > 0) - one(c < 0) for c in code.T]).astype(np.float32)
    model = Model(langs, code, weights, np.full(code.shape, 1 / code.shape[1]))
    if len(langs) > 1:
        known = sample.mapInArrow(_margins(model), "lang string, margins array<double>")
        right = known.groupBy("lang").agg(F.array(*[F.avg((F.element_at("margins", b + 1) * F.element_at(F.create_map(*[F.lit(x) for k, c in zip(langs, code[:, b], strict=True) for x in (k, float(c))]), F.col("lang")) > 0).cast("double")) for b in range(code.shape[1])]).alias("right"))
        for r in right.collect():
            trust = np.maximum(np.array(r["right"]) - 0.5, 0.01)
            model.trust[langs.index(r["lang"])] = trust / trust.sum()
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score (0 to 1), ambiguous."""
    fields = docs.select(*keep).schema

    def run(stream):
        for part, body, at in _text_parts(stream, text):
            column = part.column(part.schema.get_field_index(text))
            lettered = np.zeros(len(column), bool)
            ascii_letter = np.concatenate([[0], np.cumsum((_PLAIN[body] != 0x20) & (body < 128))])
            lettered = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
            for k in np.flatnonzero(~lettered & (np.diff(at) > 0)):
                lettered[k] = _LETTER.search(column[int(k)].as_py()) is not None
            langs, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            if model is not None:
                best, sure = model.decode(model.margins(body, at))
                langs[lettered] = np.array(model.langs, object)[best[lettered]]
                score[lettered] = sure[lettered]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(langs, pa.string()), pa.array(score), pa.array(score < CLEAR)], names=[*keep, "lang_pred", "score", "ambiguous"])

    read = docs.select(*keep) if text in keep else docs.select(*keep, text)
    return read.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, ambiguous boolean")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: learned from four fifths of the labelled documents, predicted for all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return identify(docs.drop("lang"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
