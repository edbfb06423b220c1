"""Chroma audio fingerprints of a media column, and their alignment.

A recording (a WAV file, or raw 16-bit mono samples) becomes frames of twelve pitch classes; sixteen filters, differences
of sums over boxes of the chroma image taken from its integral image, each give two bits of a 32-bit number for each
place in time. Recordings are aligned by the offsets at which they share numbers or parts of them: two numbers have a
vote for each two of their four bytes that agree, the offset with the most votes wins, and the bit error there says
how alike they are.

Recordings with equal fingerprints are one class; only classes are aligned. The queries are dealt to blocks of about
NUMBERS fingerprint numbers, however long each recording is; a block is an index by bytes that all tasks have, and every
class votes against it where it is. So votes are not shuffled; chance votes grow with queries times classes.

Defined results: a null, an empty and a too short recording have an empty fingerprint and match nothing; bytes that
do not begin as a WAV file are raw 16-bit samples; a broken WAV file has an empty fingerprint; a null id is not a query; repeated rows are one class; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm import batches
from orbweave.llm.storage import checkpointed

RATE, FRAME, HOP = 5_512, 2_048, 512
LOWEST, HIGHEST = 110.0, 1_760.0
WIDTH = 8
#: (kind, first pitch class, classes, frames): kinds split a box in time, in pitch, in both, or in three.
FILTERS = [(k % 4, (5 * k) % 12, 2 + k % 5, 2 + (3 * k) % (WIDTH - 1)) for k in range(16)]
CUT = 0.25
#: At most this part of the bits may differ, and so many numbers must be shared (in two bytes at least), for a match.
BIT_ERROR, LEAST_SHARED = 0.2, 3
NOTES, SEGMENTS = 48, 16
FRAMES = 1_024
#: Numbers of an index (some 200 bytes each in a task, 4 in the driver), and votes that are counted at a time.
NUMBERS, VOTES = 500_000, 2_000_000


def _wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of a WAV file with 8, 16, 24 or 32 bits; none of a broken one."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError, OSError, struct.error):
        return RATE, np.zeros(0, np.float32)
    if width not in (1, 2, 3, 4) or rate < 1:
        return RATE, np.zeros(0, np.float32)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:  # as the upper bytes of four
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x, width = wide.reshape(-1).view("<i4"), 4
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
    x = x.reshape(-1, channels).mean(1, dtype=np.float32)
    return rate, (x - 128) / 128 if width == 1 else x / np.float32(1 << (8 * width - 1))


def samples(data: bytes | None) -> np.ndarray:
    """Mono samples at RATE, -1 to 1; a low-pass filter comes before fewer samples."""
    rate, data = RATE, bytes(data or b"")
    if data[:4] == b"RIFF":
        rate, x = _wav(data)
    else:
        x = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768
    if rate != RATE and len(x):
        if rate > RATE:
            half = int(np.ceil(8 * rate / RATE))
            taps = np.sinc(np.arange(-half, half + 1) * 0.9 * RATE / rate) * np.hamming(2 * half + 1)
            x = np.convolve(x, (taps / taps.sum()).astype(np.float32), "same") if len(x) > 2 * half else x
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x).astype(np.float32)
    return x


_CLASS = np.full(FRAME // 2 + 1, -1)
_FREQUENCY = np.fft.rfftfreq(FRAME, 1 / RATE)
_IN = (_FREQUENCY >= LOWEST) & (_FREQUENCY <= HIGHEST)
_CLASS[_IN] = np.round(12 * np.log2(_FREQUENCY[_IN] / 440.0)).astype(int) % 12
_FOLD = np.stack([_CLASS == k for k in range(12)]).astype(np.float32)


def chroma(x: np.ndarray) -> np.ndarray:
    """(frames, 12), each frame of length 1 (or 0 where it is silent)."""
    if len(x) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames, window = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32)
    # some frames at a time, so that a long recording takes little more than its samples
    energy = np.concatenate([np.abs(np.fft.rfft(frames[k : k + FRAMES] * window, axis=1)) ** 2 @ _FOLD.T for k in range(0, len(frames), FRAMES)])
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0).astype(np.float32)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A 32-bit number for each place at which a window of WIDTH frames fits."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    # pitch classes are a circle
    whole = np.concatenate([image, image], 1)
    sums = np.zeros((len(image) + 1, 25))
    sums[1:, 1:] = whole.cumsum(0).cumsum(1)
    at = np.arange(n)

    def box(t0, t1, p0, p1):
        return sums[at + t1, p1] - sums[at + t0, p1] - sums[at + t1, p0] + sums[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for k, (kind, low, tall, wide) in enumerate(FILTERS):
        t, p = wide // 2, low + tall // 2
        whole_box = box(0, wide, low, low + tall)
        if kind == 0:
            a = box(0, t, low, low + tall)
        elif kind == 1:
            a = box(0, wide, low, p)
        elif kind == 2:
            a = box(0, t, low, p) + box(t, wide, p, low + tall)
        else:
            a = box(wide // 3, max(wide // 3 + 1, 2 * wide // 3), low, low + tall)
        ratio = np.log((1 + 8 * a) / (1 + 8 * (whole_box - a)))
        step = np.digitize(ratio, (-CUT, 0.0, CUT)).astype(np.uint32)
        out |= (step ^ (step >> np.uint32(1))) << np.uint32(2 * k)
    return out


def fingerprints(media: DataFrame, audio: str = "audio", keep: tuple[str, ...] = ("id",), decode=samples) -> DataFrame:
    """keep columns and fingerprint, array<int> (32 bits each).

    decode turns a value of the column into samples, one at a time: sound that is made from a value never is a column.
    """
    fields = media.select(*keep).schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                values = part.column(part.num_columns - 1)
                found = [fingerprint(chroma(decode(values[k].as_py()))).view(np.int32) for k in range(len(values))]
                begin = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], batches.list_array(np.concatenate(found) if found else np.zeros(0, np.int32), begin, pa.int32())], names=[*keep, "fingerprint"])

    return media.select(*keep, F.col(audio)).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fingerprint array<int>")


def bit_error(a: list[int], b: list[int], offset: int) -> float:
    """Part of the bits that differ where both last, b being moved by offset."""
    x, y = np.array(a, np.int32).view(np.uint32), np.array(b, np.int32).view(np.uint32)
    x, y = x[max(0, offset) :], y[max(0, -offset) :]
    n = min(len(x), len(y))
    return float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n) if n else 1.0


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _keys(numbers: np.ndarray) -> np.ndarray:
    """(6, numbers): a key for each two bytes of each number."""
    byte = [(numbers >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64) for k in range(4)]
    return np.stack([k << 16 | byte[i] << 8 | byte[j] for k, (i, j) in enumerate(_PAIRS)])


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, and so on, n places for each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _aligned(names: np.ndarray, found: list[np.ndarray], error: float, shared: int):
    """mapInArrow function on (class, fingerprint): query, class, offset, error of the matches with the queries named."""
    length = np.array([len(x) for x in found], np.int64)
    begin, numbers = np.cumsum(length) - length, np.concatenate(found)
    keys = _keys(numbers).ravel()
    order = np.argsort(keys, kind="stable")
    at = order % len(numbers)
    of = np.repeat(np.arange(len(found)), length)[at].astype(np.int32)
    here = (at - begin[of]).astype(np.int32)
    start = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=len(_PAIRS) << 16))])

    def votes(row, there, first, n, longest):
        """(row, query, offset) with enough numbers, the one with the most votes of each (row, query)."""
        hit = _ragged(first, n)
        q, h, far = of[hit], here[hit], longest + int(length.max())
        code = ((np.repeat(row, n) * len(found) + q) * (2 * far) + (h - np.repeat(there, n) + far)) * far + h
        code.sort()
        number = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        place = code[number] // far
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(new, len(place)))
        vote = np.diff(np.append(number[new], len(code)))
        place, vote = place[new][count >= shared], vote[count >= shared]
        pair, offset = place // (2 * far), place % (2 * far) - far
        best = np.lexsort((-offset, np.abs(offset), -vote, pair))
        pair, offset = pair[best], offset[best]
        top = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
        return pair[top] // len(found), pair[top] % len(found), offset[top]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                name = part.column(0).to_numpy(zero_copy_only=False)
                edge = part.column(1).offsets.to_numpy().astype(np.int64)
                edge, y = edge - edge[0], part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                size = np.diff(edge)
                mine = _keys(y)
                n = start[mine + 1] - start[mine]
                ends = np.concatenate([[0], np.cumsum(n.sum(0))])[edge]
                low = 0
                while low < len(size):
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] + VOTES, "right")) - 1)
                    cut = slice(edge[low], edge[high])
                    if ends[high] > ends[low]:
                        row = np.repeat(np.arange(low, high), size[low:high])
                        there = np.arange(edge[low], edge[high]) - edge[row]
                        r, q, offset = votes(np.tile(row, len(_PAIRS)), np.tile(there, len(_PAIRS)), start[mine[:, cut]].ravel(), n[:, cut].ravel(), int(size[low:high].max()))
                        other = names[q] != name[r]
                        r, q, offset = r[other], q[other], offset[other]
                        x0, y0 = np.maximum(0, offset), np.maximum(0, -offset)
                        m = np.minimum(length[q] - x0, size[r] - y0)
                        if len(m):
                            differ = np.bitwise_count(numbers[_ragged(begin[q] + x0, m)] ^ y[_ragged(edge[r] + y0, m)]).astype(np.int64)
                            wrong = np.add.reduceat(differ, np.cumsum(m) - m) / (32 * m)
                            ok = wrong <= error
                            yield pa.RecordBatch.from_arrays([pa.array(names[q[ok]], pa.int64()), pa.array(name[r[ok]], pa.int64()), pa.array(offset[ok], pa.int32()), pa.array(wrong[ok], pa.float64())], names=["query", "class", "offset", "error"])
                    low = high

    return run


def align(prints: DataFrame, queries, error: float = BIT_ERROR, shared: int = LEAST_SHARED) -> DataFrame:
    """From (id, fingerprint) and a condition on id: a row for each row of prints.

    id, class (smallest id with that fingerprint), and for queries: n_matches, the number of other classes that align
    with the query's class, best (the class with the least error), best_offset, best_error. Others have nulls there.
    """
    key = F.sha2(F.array_join("fingerprint", ","), 256)
    all_ = checkpointed(prints.withColumn("key", F.when(F.size("fingerprint") > 0, key)))
    classes = checkpointed(all_.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("class"), F.max(queries(F.col("id")).cast("int")).alias("asked"), F.first("fingerprint").alias("fingerprint")))
    heard = classes.select("class", "fingerprint")
    asked = classes.where("asked = 1").select("class", "fingerprint")
    blocks = -(-(asked.agg(F.sum(F.size("fingerprint"))).first()[0] or 0) // NUMBERS)
    found = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == k).toArrow().combine_chunks()
        if block.num_rows:
            names = block.column(0).to_numpy().astype(np.int64)
            lists = [c for c in block.column(1).chunks if len(c)]
            numbers = [x for c in lists for x in np.split(c.flatten().to_numpy().view(np.uint32), np.diff(c.offsets.to_numpy()).cumsum()[:-1])]
            part = checkpointed(heard.mapInArrow(_aligned(names, numbers, error, shared), "query bigint, class bigint, offset int, error double"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = heard.sparkSession.createDataFrame([], "query bigint, class bigint, offset int, error double")
    best = found.groupBy("query").agg(F.count("*").alias("n_matches"), F.min(F.struct("error", "class", "offset")).alias("x"))
    matched = best.select(F.col("query").alias("class"), "n_matches", F.col("x.class").alias("best"), F.col("x.offset").alias("best_offset"), F.col("x.error").alias("best_error"))
    named = checkpointed(classes.select("key", "class").join(matched, "class", "left"))
    out = all_.join(named, "key", "left").withColumn("_ask", F.coalesce(queries(F.col("id")), F.lit(False)))
    shown = lambda c: F.when(F.col("_ask"), c)
    return out.select("id", "class", shown(F.coalesce("n_matches", F.lit(0))).alias("n_matches"), *[shown(F.col(c)).alias(c) for c in ("best", "best_offset", "best_error")])


_BANK = np.sin(2 * np.pi * (110.0 * 2 ** (np.arange(NOTES) / 12))[:, None] * np.arange(1_380) / RATE).astype(np.float32)


def sonified(values: list | None) -> np.ndarray:
    """Samples of a vector: chords of four of its values each, at least SEGMENTS of them, which give notes and loudness in order. A null is no sound."""
    if not values:
        return np.zeros(0, np.float32)
    chords = max(SEGMENTS, -(-len(values) // 4))
    x = np.nan_to_num(np.resize(np.array([np.nan if y is None else y for y in values], np.float64), chords * 4)).reshape(chords, 4)
    note = (np.floor(np.clip(x * 2, -0.999, 0.999) * NOTES / 2) + NOTES // 2).astype(int) % NOTES
    sound = ((0.5 + np.abs(x)).astype(np.float32)[:, :, None] * _BANK[note]).sum(1).reshape(-1)
    return (sound / max(1e-6, np.abs(sound).max())).astype(np.float32)


def op9_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Each embedding made audible, fingerprinted and, where its id is divisible by 20, aligned with all others."""
    media = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("bigint").alias("id"), "embedding")
    found = align(fingerprints(media, "embedding", decode=sonified), lambda i: i % 20 == 0)
    return found.withColumnsRenamed({"id": "vec_id", "class": "class_id", "best": "best_class"})


QUERIES = {"op9_chroma_fingerprints": op9_chroma_fingerprints}
ORACLE_SQL: dict[str, str] = {}
