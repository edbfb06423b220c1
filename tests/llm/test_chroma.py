import io
import wave

import numpy as np

from orbweave.llm.chroma import RATE, align, bit_error, chroma, fingerprint, fingerprints, samples, sonified


def tune(seed, seconds=6.0):
    rng = np.random.default_rng(seed)
    notes = rng.integers(0, 36, (int(seconds * 4), 3))
    t = np.arange(RATE // 4) / RATE
    return np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (n / 12)[:, None] * t).sum(0) for n in notes]) / 3


def raw(x):
    return (np.clip(x, -1, 1) * 32000).astype(np.int16).tobytes()


def test_noise_and_loudness_change_few_bits():
    x = tune(1)
    f = lambda y: fingerprint(chroma(y.astype(np.float32))).view(np.int32)
    noise = np.random.default_rng(2).normal(0, 0.01, len(x))
    assert bit_error(f(x), f(0.3 * x + noise), 0) < 0.05 and bit_error(f(x), f(tune(3)), 0) > 0.25


def test_wav_files_are_read():
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(np.repeat(np.arange(-50, 50, dtype=np.int16), 2).tobytes())
    assert np.allclose(samples(buffer.getvalue()), np.arange(-50, 50) / 32768)


def test_alignment_finds_copies_and_cuts(spark):
    clips = {k: tune(k) for k in range(30)}
    cut = 8 * 512
    rows = [(k, raw(x)) for k, x in clips.items()] + [(100, raw(clips[3][cut:])), (101, raw(clips[3])), (120, raw(clips[7] * 0.5)), (200, None), (201, b""), (202, b"\0" * 99), (None, raw(clips[5]))]
    media = spark.createDataFrame([(a, b, 1) for a, b in rows], "id long, audio binary, class int")
    got = {r.id: r for r in align(fingerprints(media), lambda i: i % 20 == 0).collect()}
    assert len(got) == len(rows)
    assert (got[100].n_matches, got[100].best, got[100].best_offset) == (1, 3, -8)
    assert got[101]["class"] == 3 and got[101].n_matches is None
    assert got[120]["class"] == 7 or got[120].best == 7
    assert got[20].n_matches == 0 and got[200].n_matches == 0 and got[200]["class"] is None
    assert align(fingerprints(media.limit(0)), lambda i: i % 20 == 0).count() == 0


def brute_force(prints, queries):
    """(query, other): least bit error over all offsets with three numbers or more, where it is 0.2 or less."""
    out = {}
    for q in queries:
        for r in prints.keys() - {q}:
            a, b = prints[q], prints[r]
            least = min(bit_error(a, b, o) for o in range(3 - len(b), len(a) - 2))
            if least <= 0.2:
                out[q, r] = least
    return out


def test_noisy_copies_are_found(spark):
    rng = np.random.default_rng(9)
    prints = {1000 + k: fingerprint(chroma(tune(40 + k, 3.6).astype(np.float32))) for k in range(40)}
    noisy = lambda x, p: x ^ (rng.random((len(x), 32)) < p).astype(np.uint32) @ (np.uint32(1) << np.arange(32, dtype=np.uint32))
    copies = {}
    for k in range(40):
        x = prints[1000 + k]
        copies[2 * k] = x ^ np.uint32(1) << rng.integers(0, 32, len(x), np.uint32)
        copies[2 * k + 1] = noisy(x, 0.05 + 0.1 * k / 40)[k % 8 :]
    plain = {i: x.astype(np.uint32).view(np.int32).tolist() for i, x in (prints | copies).items()}
    want = {q for q, r in brute_force(plain, list(copies)) if r == 1000 + q // 2}
    rows = spark.createDataFrame(list(plain.items()), "id long, fingerprint array<int>")
    got = {r.id for r in align(rows, lambda i: i < 1000).where("id < 1000").collect() if r.best in (1000 + r.id // 2, r.id ^ 1)}
    assert len(want) >= 78 and len(got & want) >= 0.9 * len(want)


def test_every_value_of_a_long_vector_sounds():
    x = np.random.default_rng(8).normal(0, 0.3, 200)
    y = np.concatenate([x[:64], x[:63:-1]])
    assert len(sonified(list(x))) == 50 * 1_380 and not np.array_equal(sonified(list(x)), sonified(list(y)))
    assert len(sonified(list(x[:64]))) == len(sonified(list(x[:9]))) == 16 * 1_380


def test_broken_and_odd_wav_files():
    import io
    import wave

    import numpy as np

    from orbweave.llm.chroma import samples

    tone = np.sin(2 * np.pi * 440 * np.arange(22_050) / 22_050)

    def wav(width, rate=22_050):
        raw = (tone * 0.5 * (1 << (8 * width - 1))).astype(np.int64)
        data = b"".join(int(v).to_bytes(4, "little", signed=True)[:width] for v in raw) if width > 1 else (raw + 128).astype(np.uint8).tobytes()
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(rate)
            f.writeframes(data)
        return out.getvalue()

    for width in (1, 2, 3, 4):
        x = samples(wav(width))
        assert abs(len(x) - 5_512) <= 2 and 0.4 < np.abs(x).max() < 0.6
    assert [len(samples(b)) for b in (None, b"", b"RIFF junk", b"RIFF" + bytes(50), b"x")] == [0] * 5


def test_cuts_off_the_grid_are_found(spark):
    import numpy as np

    from orbweave.llm import chroma

    rng = np.random.default_rng(3)

    def tune():
        t = np.arange(1_378) / chroma.RATE
        x = np.concatenate([sum(np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 36) / 12) * t) for _ in range(3)) for _ in range(24)])
        return x / np.abs(x).max()

    tunes = [tune() for _ in range(30)]
    raw = lambda x: (np.clip(x, -1, 1) * 20_000).astype("<i2").tobytes()
    rows = [(20 * k, raw(x)) for k, x in enumerate(tunes)] + [(20 * k + 1, raw(x[256:] + 0.05 * rng.standard_normal(len(x) - 256))) for k, x in enumerate(tunes)]
    got = {r.id: r for r in chroma.align(chroma.fingerprints(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, audio binary")), lambda i: i % 20 == 0).collect()}
    hit = sum(got[20 * k].best == 20 * k + 1 for k in range(30))
    assert hit >= 27


def test_blocks_of_any_number_give_the_same_rows(spark, monkeypatch):
    rows = [(k, raw(tune(k % 9, 2.0 + k % 3))) for k in range(60)]
    prints = fingerprints(spark.createDataFrame(rows, "id long, audio binary")).persist()
    whole = sorted(align(prints, lambda i: i % 2 == 0).collect())
    monkeypatch.setattr("orbweave.llm.chroma.NUMBERS", 70)  # a block has a few recordings, or a long one alone
    assert sorted(align(prints, lambda i: i % 2 == 0).collect()) == whole
    prints.unpersist()
