"""Telephony audio columns: G.711 and IMA ADPCM in WAV, expanded and resampled to PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import by_bytes, map_texts, materialize, read, tune

BLOCK = 192  # bytes of an ADPCM block, and the unit payloads are padded to
RATE = 8000
CODECS = ("mulaw", "alaw", "ima")
#: Format tags of the WAV container.
TAGS = {"mulaw": 7, "alaw": 6, "ima": 0x11, "pcm": 1}

#: IMA step sizes and index moves.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

#: One phase of a half-band filter, in 1/512.
HALF = np.array([-3, 13, -42, 288, 288, -42, 13, -3], np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, (a & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def compress(pcm: np.ndarray, codec: str) -> bytes:
    """8-bit codes whose expansion is nearest to each sample."""
    table = TABLES[codec].astype(np.int32)
    order = np.argsort(table, kind="stable")
    values = table[order]
    right = np.clip(np.searchsorted(values, pcm), 1, 255)
    nearer = right - (np.abs(pcm - values[right - 1]) <= np.abs(values[right] - pcm))
    return order[nearer].astype(np.uint8).tobytes()


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM of many IMA blocks (n, bytes) at once: one step per nibble, over all blocks.

    A step index beyond the table is read as the last one, so any bytes decode.
    """
    head = blocks[:, :4]
    value = (head[:, 0].astype(np.int32) | (head[:, 1].astype(np.int8).astype(np.int32) << 8)).astype(np.int32)
    index = np.minimum(head[:, 2], 88).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * body.shape[0], len(blocks)), np.int16)
    out[0] = value
    for i, codes in enumerate(body):
        for half, nibble in enumerate((codes & 15, codes >> 4)):
            step = STEPS[index]
            size = nibble & 7
            delta = (step >> 3) + step * (size >> 2) + (step >> 1) * ((size >> 1) & 1) + (step >> 2) * (size & 1)
            value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + MOVES[size], 0, 88)
            out[1 + 2 * i + half] = value
    return out.T


def upsample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and a half-band filter makes those between; the ends are held."""
    if not len(pcm):
        return pcm.astype(np.int16)
    wide = np.pad(pcm.astype(np.int32), (3, 4), mode="edge")
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((np.convolve(wide, HALF, "valid") + 256) >> 9, -32768, 32767)
    return out


def wav(data: bytes, codec: str, rate: int = RATE) -> bytes:
    align = {"ima": BLOCK, "pcm": 2}.get(codec, 1)
    extra = struct.pack("<HH", 2, (BLOCK - 4) * 2 + 1) if codec == "ima" else b"\0\0" if codec != "pcm" else b""
    per_second = rate * BLOCK // ((BLOCK - 4) * 2 + 1) if codec == "ima" else rate * align
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, align, {"ima": 4, "pcm": 16}.get(codec, 8)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data of a WAV file; raises ValueError for any other bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), None)
        elif name == b"data" and codec:
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no audio in the WAV file")


def expand(items: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of each (codec, data); the ADPCM blocks of all items are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(items)
    ima = [(i, np.frombuffer(data, np.uint8)[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)) for i, (codec, data) in enumerate(items) if codec == "ima"]
    if ima:
        pcm, at = ima_blocks(np.concatenate([b for _, b in ima])), 0
        for i, b in ima:
            out[i] = pcm[at : at + len(b)].reshape(-1)
            at += len(b)
    for i, (codec, data) in enumerate(items):
        if codec in TABLES:
            out[i] = TABLES[codec][np.frombuffer(data, np.uint8)]
        elif codec == "pcm":
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)
    return out


def resampled(media: DataFrame) -> DataFrame:
    """``doc_id, pcm_wav``: each row's ``media`` (WAV bytes) as 16-bit PCM at twice its rate.

    Null, empty or broken media give null; equal rows give equal bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media"):
            parsed = [_parsed(m) for m in batch.column("media").to_pylist()]
            out = [wav(samples(x), "pcm", 2 * p[1]) if p else None for x, p in zip(_expanded(parsed), parsed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "pcm_wav"])

    tune(media.sparkSession)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, "doc_id long, pcm_wav binary")


def samples(pcm: np.ndarray) -> bytes:
    """PCM at twice the rate, as the data of a file."""
    return upsample(pcm).astype("<i2").tobytes()


def _expanded(parsed: list) -> list[np.ndarray]:
    return expand([(p[0], p[2]) if p else ("", b"") for p in parsed])


def _parsed(media: bytes | None) -> tuple[str, int, bytes] | None:
    try:
        return unwav(bytes(media)) if media is not None else None
    except (ValueError, struct.error):
        return None


def payload_of(text: str) -> tuple[int, bytes]:
    """UTF-8 bytes of a text and their number before spaces fill up to a positive multiple of BLOCK."""
    raw = text.encode()
    return len(raw), raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def feature(wide: np.ndarray) -> str:
    """Samples, peak, zero crossings and mean size of resampled audio, in whole numbers."""
    if not len(wide):
        return "0:0:0:0"
    size = np.abs(wide.astype(np.int32))
    signs = wide >= 0
    return f"{len(wide)}:{int(size.max())}:{int(np.count_nonzero(signs[1:] != signs[:-1]))}:{int(size.sum(dtype=np.int64)) // len(wide)}"


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's bytes and its payload as the data of a WAV file.

    The payload's checksum picks the codec, whose unit (a G.711 code or an
    ADPCM block) is stored as it is, so the bytes read back are the payload.
    Null and empty texts are one unit of spaces; equal texts give equal files.
    """

    def work(texts: list[str]):
        sizes, payloads = zip(*map(payload_of, texts), strict=True)
        return sizes, list(map(container, payloads))

    return map_texts(docs, {"n_bytes": "long", "media": "binary"}, lambda: work)


def container(payload: bytes) -> bytes:
    return wav(payload, CODECS[zlib.crc32(payload) % len(CODECS)])


DESCRIBED = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string())]


def described(media: DataFrame) -> DataFrame:
    """Sizes and hashes of the payload, the file and the resampled PCM of every row of ``doc_id, n_bytes,
    media``, and what the audio is like. Null or broken media give nulls; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media"):
            files = batch.column("media").to_pylist()
            parsed, rows = [_parsed(m) for m in files], []
            for file, p, pcm in zip(files, parsed, _expanded(parsed), strict=True):
                if p is None:
                    rows.append((None,) * (len(DESCRIBED) - 2))
                    continue
                codec, _, data = p
                wide = upsample(pcm)
                out = wide.astype("<i2").tobytes()
                rows.append((len(data), _sha(data), zlib.crc32(data[-16:]), len(file), _sha(file), f"{codec}:{feature(wide)}", len(out), _sha(out)))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), DESCRIBED[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in DESCRIBED])

    tune(media.sparkSession)
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in DESCRIBED)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col("media").cast("binary").alias("media")).mapInArrow(run, schema)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op5_telephony(spark, sf_dir: str) -> DataFrame:
    return described(materialize(stored(read(spark, sf_dir, "documents"))))
