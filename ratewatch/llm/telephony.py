"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in RIFF files, expanded and resampled.

``to_media`` keeps a payload byte for byte as the samples (or ADPCM blocks) of a file; ``from_media`` reads the file
again, expands it to 16-bit PCM at 8 kHz and resamples that to 16 kHz. mu-law and A-law are looked up in tables of 256.
ADPCM is decoded step by step, all blocks of a batch at once: a block begins with its own state, so blocks don't depend
on each other.

Defined results: a null text counts as empty; an empty payload is one unit of blanks; the codec hangs on the payload
alone, so equal texts have equal media; bytes that no encoder would write (a step index above 88) are clipped; repeated
rows are done alike; an empty table gives an empty table.
Texts of any length are one file each; of two nibbles that come as near the smaller is written; further columns aren't
looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratewatch.llm.common import text_slices

UNIT = 192
RATE, RESAMPLED = 8000, 16000
#: The format tags of RIFF files.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
CODECS = tuple(TAGS)
#: Step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: inverted, with sign, 3 bits of exponent and 4 of mantissa over a bias of 132."""
    u = ~np.arange(256, dtype=np.int32) & 255
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: every second bit inverted; the lowest segment is linear."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    segment, mantissa = (a >> 4) & 7, (a & 15) << 4
    size = np.where(segment == 0, mantissa + 8, (mantissa + 264) << np.maximum(segment - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


_TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def _nibble_tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + nibble: what to add to the sample, and the next index."""
    index, nibble = np.divmod(np.arange(89 * 16), 16)
    step, size = STEPS[index], nibble & 7
    change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
    return np.where(nibble & 8, -change, change).astype(np.int32), np.clip(index + MOVES[size], 0, 88).astype(np.int32) * 16


_CHANGE, _NEXT = _nibble_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of blocks (n x size bytes: a sample, a step index, a zero, then nibbles, the low one first): n x (2 size - 7)."""
    n, size = blocks.shape
    data = blocks[:, 4:].T.astype(np.int32)
    nibbles = np.stack([data & 15, data >> 4], axis=1).reshape(-1, n)
    out = np.empty((nibbles.shape[0] + 1, n), np.int16)
    sample = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    out[0] = sample
    for i, nibble in enumerate(nibbles):
        at = state + nibble
        sample = np.minimum(np.maximum(sample + _CHANGE[at], -32768), 32767)
        state = _NEXT[at]
        out[i + 1] = sample
    return out.T


def encode_adpcm(pcm: np.ndarray, size: int = UNIT) -> np.ndarray:
    """Blocks of PCM rows (n x (2 size - 7)): for each sample the nibble that comes nearest, all rows at once."""
    n = len(pcm)
    x = pcm.astype(np.int32)
    sample, state = x[:, 0].copy(), np.zeros(n, np.int32)
    nibbles = np.empty((2 * (size - 4), n), np.int32)
    for i in range(len(nibbles)):
        reached = np.clip(sample[:, None] + _CHANGE[state[:, None] + np.arange(16)], -32768, 32767)
        nibbles[i] = np.abs(reached - x[:, i + 1, None]).argmin(axis=1)
        at = state + nibbles[i]
        sample, state = reached[np.arange(n), nibbles[i]], _NEXT[at]
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    return np.concatenate([head, (nibbles[::2] | nibbles[1::2] << 4).T.astype(np.uint8)], axis=1)


def phases(up: int, half: int = 16, beta: float = 8.0) -> np.ndarray:
    """Taps (of sum 2 ** 15) between two samples for each of the ``up - 1`` places there: a sinc under a Kaiser window of ``2 * half`` samples."""
    n = np.arange(1 - half, half + 1)
    t = np.arange(1, up)[:, None] / up - n
    taps = np.sinc(t) * np.i0(beta * np.sqrt(np.maximum(0, 1 - (t / half) ** 2)))
    whole = np.rint(taps / taps.sum(axis=1, keepdims=True) * (1 << 15)).astype(np.int64)
    whole[:, half - 1] += (1 << 15) - whole.sum(axis=1)
    return whole


_UP = 2
_PHASES = phases(_UP)


def resample(pcm: np.ndarray, taps: np.ndarray = _PHASES) -> np.ndarray:
    """So many times the rate by a polyphase filter: the samples stay, those between them are weighted sums of their neighbours.

    In whole numbers, so that results are the same everywhere. The first and the last sample go on beyond the ends.
    """
    up, half = len(taps) + 1, taps.shape[1] // 2
    x = np.pad(pcm.astype(np.int64), (half - 1, half), mode="edge")
    out = np.empty(up * len(pcm), np.int16)
    out[::up] = pcm
    for i, h in enumerate(taps):
        out[i + 1 :: up] = np.clip((np.convolve(x, h[::-1], "valid") + (1 << 14)) >> 15, -32768, 32767)
    return out


def riff(payload: bytes, codec: str) -> bytes:
    """A file with one channel at 8 kHz whose data are the payload."""
    if codec == "adpcm":
        samples = 2 * UNIT - 7
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * UNIT // samples, UNIT, 4, 2, samples)
    else:
        fmt = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def unriff(media: bytes) -> tuple[str, bytes]:
    """The codec and the data of such a file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF file of audio")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next((c for c, t in TAGS.items() if t == tag), None)
        elif name == b"data" and codec:
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in a known codec")


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, media``: each text as the data of a file, in a codec that its checksum names."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                raw = [t.encode("utf-8", "replace") for t in texts]
                padded = [r.ljust(max(UNIT, -(-len(r) // UNIT) * UNIT), b" ") for r in raw]
                media = [riff(p, CODECS[zlib.crc32(p) % len(CODECS)]) for p in padded]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def _feature(codec: str, pcm: np.ndarray, wide: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    negative = x < 0
    return f"{codec} samples={len(x)} peak={int(np.abs(x).max())} level={int(np.abs(x).sum()) // len(x)} crossings={int((negative[1:] != negative[:-1]).sum())} pcm16k={zlib.crc32(wide.astype('<i2').tobytes()):08x}"


def from_media(table: DataFrame, keep: list[str], media: str = "media", keep_pcm: bool = True) -> DataFrame:
    """The columns ``keep``, then ``payload`` as read back, ``feature``, and ``pcm`` (16-bit at 16 kHz; null unless kept)."""
    fields = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            for part, files in text_slices(batch, "__media"):
                found = [unriff(m) for m in files]
                blocks = [np.frombuffer(p, np.uint8).reshape(-1, UNIT) for c, p in found if c == "adpcm"]
                expanded = iter(())
                if blocks:
                    pcm = decode_adpcm(np.concatenate(blocks))
                    expanded = iter(np.split(pcm, np.cumsum([len(b) for b in blocks])[:-1]))
                features, waves = [], []
                for codec, payload in found:
                    pcm = next(expanded).ravel() if codec == "adpcm" else _TABLES[codec][np.frombuffer(payload, np.uint8)]
                    wide = resample(pcm)
                    features.append(_feature(codec, pcm, wide))
                    waves.append(wide.astype("<i2").tobytes() if keep_pcm else None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([p for _, p in found], pa.binary()), pa.array(features, pa.string()), pa.array(waves, pa.binary())], [*keep, "payload", "feature", "pcm"])

    return table.select(*keep, table[media].alias("__media")).mapInArrow(run, f"{fields}, payload binary, feature string, pcm binary")
