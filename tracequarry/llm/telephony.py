"""Telephony audio columns: mu-law and A-law by lookup, IMA ADPCM by blocks, resampled PCM.

A payload of 8-bit telephony samples is kept in a RIFF/WAVE file (format 7, mu-law, mono, 8 kHz), which
holds it losslessly. Reading it back gives the samples, which are expanded by table; the same bytes can be
read as A-law samples. The expanded sound is also coded as IMA ADPCM blocks, which are decoded again, and it is
resampled to twice its rate and stored as 16-bit PCM. All arithmetic is on integers, so equal payloads give equal results everywhere.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracequarry.llm._text import slices, text_buffer

UNIT = 64  # payload bytes come in multiples of this; also the ADPCM block
RATE = 8000
MULAW, ALAW, PCM = 7, 6, 1  # WAVE format tags

# The step sizes and index moves of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
# Half-sample interpolation: a windowed sinc of 8 taps in units of 2**-14; the four on one side.
TAPS = (9993, -2509, 898, -190)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: 8 bits to 14-bit values scaled to 16 bits."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: 8 bits to 13-bit values scaled to 16 bits."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, step = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(part == 0, step + 8, (step + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor and next index for each (index, nibble)."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + MOVES[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (following * 16).astype(np.int32).ravel()


MU, A = mulaw_table(), alaw_table()
CHANGE, FOLLOWING = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: uint8 (n, block bytes) to int16 (n, 2 * (block bytes - 4) + 1).

    A block has its first sample (16 bits), its step index (8 bits; above 88 counts as 88), a spare byte,
    then nibbles, the low one first. Samples follow each other in a block; the step is taken over all blocks.
    """
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    turned = np.ascontiguousarray(blocks.T)
    value = (turned[0].astype(np.uint16) | (turned[1].astype(np.uint16) << np.uint16(8))).view(np.int16).astype(np.int32)
    state = np.minimum(turned[2], 88).astype(np.int32) * 16
    out[0] = value
    for k in range(4, size):
        both = turned[k]
        for half, nibble in enumerate((both & 15, both >> 4)):
            at = state + nibble
            value += CHANGE.take(at)
            np.clip(value, -32768, 32767, out=value)
            state = FOLLOWING.take(at)
            out[2 * (k - 4) + 1 + half] = value
    return out.T


SAMPLES = 2 * (UNIT - 4) + 1  # samples of an ADPCM block


def encode_adpcm(samples: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: int16 (n, SAMPLES) to uint8 (n, UNIT) blocks.

    Blocks stand alone: each begins with the step nearest above its first move, so all are coded side by side.
    """
    n = len(samples)
    turned = np.ascontiguousarray(samples.T).astype(np.int32)
    out = np.zeros((UNIT, n), np.uint8)
    value = turned[0].copy()
    first = np.minimum(np.searchsorted(STEPS, np.abs(turned[1] - turned[0])), len(STEPS) - 1).astype(np.int32)
    out[0], out[1], out[2] = value & 0xFF, (value >> 8) & 0xFF, first
    state = first * 16
    for k in range(1, SAMPLES):
        move = turned[k] - value
        left, step = np.abs(move), STEPS.take(state >> 4)
        nibble = np.where(move < 0, 8, 0).astype(np.int32)
        for bit in (4, 2, 1):
            high = left >= step
            nibble += bit * high
            left -= step * high
            step = step >> 1
        at = state + nibble
        value += CHANGE.take(at)
        np.clip(value, -32768, 32767, out=value)
        state = FOLLOWING.take(at)
        out[4 + (k - 1) // 2] |= (nibble << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.T


def upsample(samples: np.ndarray) -> np.ndarray:
    """int16 at a rate to int16 at twice the rate; the given samples stay, each gap gets a filtered value."""
    n = len(samples)
    padded = np.empty(n + 8, np.int32)
    padded[4 : n + 4] = samples
    padded[:4], padded[n + 4 :] = samples[0] if n else 0, samples[-1] if n else 0
    total = np.full(n, 1 << 13, np.int64)
    for k, tap in enumerate(TAPS):
        total += (padded[4 - k : n + 4 - k] + padded[5 + k : n + 5 + k]).astype(np.int64) * tap
    out = np.empty(2 * n, np.int16)
    out[0::2] = samples
    out[1::2] = np.clip(total >> 14, -32768, 32767)
    return out


def wave(kind: int, rate: int, bits: int, data: bytes) -> bytes:
    """A mono RIFF/WAVE file."""
    form = struct.pack("<HHIIHHH", kind, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    fact = b"" if kind == PCM else struct.pack("<4sII", b"fact", 4, len(data) * 8 // bits)
    body = struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data))
    pad = b"\0" * (len(data) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body) + len(data) + len(pad), b"WAVE") + body + data + pad


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and data of a mono RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _loudness(x: np.ndarray) -> str:
    wide = x.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"{int(np.abs(wide).max())}/{int(np.dot(wide, wide) // len(wide))}/{crossings}"


def features(data: bytes, adpcm: np.ndarray, rate: int = RATE) -> tuple[str, bytes]:
    """peak/mean square/zero crossings of each reading, CRC-32 of the decoded ADPCM and of the stored PCM; the PCM file."""
    raw = np.frombuffer(data, np.uint8)
    mu, a = MU[raw], A[raw]
    pcm = wave(PCM, 2 * rate, 16, upsample(mu).astype("<i2").tobytes())
    return f"mu={_loudness(mu)};a={_loudness(a)};ima={_loudness(adpcm)}:{zlib.crc32(adpcm.astype('<i2').tobytes()):08x};pcm={2 * rate}:{len(pcm)}:{zlib.crc32(pcm):08x}", pcm


def through_adpcm(sounds: list[np.ndarray]) -> list[np.ndarray]:
    """Each sound coded in ADPCM blocks and decoded again; blocks of all are handled together, a bounded number at a time."""
    counts = [-(-len(x) // SAMPLES) for x in sounds]
    flat = np.zeros((sum(counts), SAMPLES), np.int16)
    at = np.concatenate(([0], np.cumsum(counts)))
    for x, k in zip(sounds, at):
        flat.reshape(-1)[k * SAMPLES : k * SAMPLES + len(x)] = x
    back = np.concatenate([decode_adpcm(encode_adpcm(flat[k : k + 8192])) for k in range(0, len(flat), 8192)]) if len(flat) else flat
    return [np.ascontiguousarray(back[lo:hi]).ravel()[: len(x)] for x, lo, hi in zip(sounds, at, at[1:])]


MEDIA_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_telephony(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_files: bool = False) -> DataFrame:
    """Store each text's bytes as a mu-law file, read it back, and describe the sound.

    Returns id_col, the columns of MEDIA_SCHEMA and, with keep_files, media (the mu-law file) and pcm (the
    resampled 16-bit file). A null or empty text is a payload of 64 zero bytes. Equal texts give equal values;
    every row gives one row, repeated rows and null ids too. Other columns are ignored whatever their names.
    One pass without a shuffle; a task holds about one Arrow batch and the sound of 2 MB of text at a time.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {MEDIA_SCHEMA}" + (", media binary, pcm binary" if keep_files else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                yield _stored(batch.column(0).slice(lo, hi - lo), [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)], keep_files)

    names = [id_col, *(x.split()[0] for x in MEDIA_SCHEMA.split(", ")), "media", "pcm"]

    def _stored(ids: pa.Array, texts: list[bytes], keep: bool) -> pa.RecordBatch:
        media = [wave(MULAW, RATE, 8, payload(t)) for t in texts]
        back = [read_wave(m)[2] for m in media]
        decoded = through_adpcm([MU[np.frombuffer(b, np.uint8)] for b in back])
        made = [features(b, d) for b, d in zip(back, decoded)]
        cols = [
            ids, [len(t) for t in texts], [len(b) for b in back], [hashlib.sha256(b).hexdigest() for b in back], [zlib.crc32(b[-UNIT:]) for b in back],
            [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media], [f for f, _ in made],
        ]
        if keep:
            cols += [pa.array(media, pa.binary()), pa.array([p for _, p in made], pa.binary())]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names[: len(cols)])

    return docs.select(docs[id_col], docs[text_col].cast("string").alias("__text")).mapInArrow(run, schema)
