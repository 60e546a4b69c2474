"""Codecs against sample-at-a-time versions, and the stored form's round trip."""

import hashlib
import zlib

import numpy as np
import pytest

from tracequarry.llm import telephony as T


def slow_adpcm(block: bytes) -> list[int]:
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(T.STEPS[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if nibble & bit else 0
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks_equals_one_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    got = T.decode_adpcm(blocks)
    assert got.shape == (50, 121)
    assert [slow_adpcm(b.tobytes()) for b in blocks] == got.tolist()


def slow_coded(x: list[int]) -> bytes:
    """One block, sample by sample."""
    index = next((k for k, s in enumerate(T.STEPS.tolist()) if s >= abs(x[1] - x[0])), 88)
    out, value, nibbles = bytearray((x[0] & 0xFFFF).to_bytes(2, "little") + bytes([index, 0])), x[0], []
    for sample in x[1:]:
        move, step = sample - value, int(T.STEPS[index])
        code, left, change = (8 if move < 0 else 0), abs(move), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            if left >= part:
                code, left, change = code | bit, left - part, change + part
        value = max(-32768, min(32767, value + (-change if code & 8 else change)))
        index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
        nibbles.append(code)
    return bytes(out + bytes(a | b << 4 for a, b in zip(nibbles[::2], nibbles[1::2])))


def test_coding_and_feature():
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.integers(-3000, 3000, (6, T.SAMPLES)), axis=1).clip(-32768, 32767).astype(np.int16)
    assert [b.tobytes() for b in T.encode_adpcm(x)] == [slow_coded(r.tolist()) for r in x]
    for data in (bytes(64), bytes(range(256)) * 2):
        mu = [int(T.MU[b]) for b in data]
        padded = mu + [0] * (-len(mu) % T.SAMPLES)
        ima = [v for k in range(0, len(padded), T.SAMPLES) for v in slow_adpcm(slow_coded(padded[k : k + T.SAMPLES]))][: len(mu)]
        loud = lambda v: f"{max(map(abs, v))}/{sum(a * a for a in v) // len(v)}/{sum((a < 0) != (b < 0) for a, b in zip(v, v[1:]))}"
        pcm = T.wave(T.PCM, 16000, 16, T.upsample(np.array(mu, np.int16)).astype("<i2").tobytes())
        want = f"mu={loud(mu)};a={loud([int(T.A[b]) for b in data])};ima={loud(ima)}:{zlib.crc32(np.array(ima, '<i2').tobytes()):08x};pcm=16000:{len(pcm)}:{zlib.crc32(pcm):08x}"
        assert T.features(data, T.through_adpcm([np.array(mu, np.int16)])[0]) == (want, pcm)


def test_tables_have_the_published_ends():
    assert T.MU[0x00] == -32124 and T.MU[0x80] == 32124 and T.MU[0xFF] == 0 and T.MU[0x7F] == 0
    assert T.A[0xD5] == 8 and T.A[0x55] == -8 and T.A[0xAA] == 32256 and T.A[0x2A] == -32256
    assert len(set(T.A.tolist())) == 256


def test_wave_round_trip_and_upsampling():
    data = bytes(range(256))
    assert T.read_wave(T.wave(T.MULAW, 8000, 8, data)) == (T.MULAW, 8000, data)
    with pytest.raises(ValueError):
        T.read_wave(b"RIFFxxxxJUNK")
    x = (10000 * np.sin(np.arange(400) * 2 * np.pi * 400 / 8000)).astype(np.int16)
    y = T.upsample(x)
    assert (y[0::2] == x).all()
    true = 10000 * np.sin(np.arange(800) * 2 * np.pi * 400 / 16000)
    assert np.abs(y[20:-20] - true[20:-20]).max() < 60
    assert (T.upsample(np.full(100, 1234, np.int16)) == 1234).all()


def test_rows(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "ß" * 200_000, "a"]
    rows = [(i if i != 2 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string, media binary" .replace("media binary", "media string"))
    got = sorted(T.store_telephony(docs, keep_files=True).collect(), key=lambda r: (r.n_bytes, r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(texts)
    for r in got:
        raw = b"" if r.doc_id is None and False else ("a" if r.doc_id is None else texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert T.read_wave(bytes(r.media))[2] == padded and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        kind, rate, pcm = T.read_wave(bytes(r.pcm))
        assert (kind, rate, len(pcm)) == (T.PCM, 16000, 4 * len(padded))
        assert (np.frombuffer(pcm, "<i2")[0::2] == T.mulaw_table()[np.frombuffer(padded, np.uint8)]).all()
    same = [r.feature for r in got if r.n_bytes == 1]
    assert len(same) == 2 and same[0] == same[1]
    assert T.store_telephony(docs.limit(0)).count() == 0
