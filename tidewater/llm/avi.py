"""Media columns: AVI motion-JPEG clips, written losslessly, read back through their RIFF index, and cut into shots.

A payload (bytes, a multiple of 192) is stored as 8-bit grey frames of 16 x 12 samples. Each frame is a lossless JPEG
(SOF3, predictor 1) in a ``00dc`` chunk of an AVI file with an ``idx1`` index. The Huffman table gives the category of
a difference 9 - category bits, so that code and extra bits are always 9 bits together: such scans are packed and
unpacked as whole arrays. The reader takes any Huffman table: tables of another shape are decoded bit by bit.

Shots: the grey histograms of neighbouring frames are compared; a cut lies where their distance exceeds the mean of the
last eight distances by three standard deviations, and a floor. Each shot is a clip row with its start and end time.

A null or empty text is one frame of spaces; a very long one is packed and read in runs of frames. An empty table gives no rows. Null and repeated ids, and repeated rows, are rows like any other; columns
that are not named, whatever they are called, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
BINS, LOOKBACK, FLOOR = 16, 8, 0.2
AT_ONCE = 4096  # frames that are packed or unpacked at once

#: Categories 8..0 get codes of 1..9 bits: category and extra bits fill 9 bits together.
CATEGORIES = list(range(8, -1, -1))
_DHT = b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(CATEGORIES)
_SOF3 = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0])
_SOS = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
HEADER = b"\xff\xd8" + _DHT + _SOF3 + _SOS
END = b"\xff\xd9"


def _codes() -> np.ndarray:
    """The 9 bits of each difference -255..255."""
    out = np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2  # 9 - c bits: ones, then a zero
        out[d + 255] = prefix << c | (d if d >= 0 else d + (1 << c) - 1)
    return out


CODE = _codes()
DIFF = np.zeros(512, dtype=np.int16)
DIFF[CODE] = np.arange(-255, 256)


def predictions_removed(x: np.ndarray) -> np.ndarray:
    d = x.astype(np.int16)
    out = d.copy()
    out[:, :, 1:] -= d[:, :, :-1]
    out[:, 1:, 0] -= d[:, :-1, 0]
    out[:, 0, 0] -= 128
    return out


def predictions_added(d: np.ndarray) -> np.ndarray:
    out = d.astype(np.int32)
    out[:, 0, 0] += 128
    out[:, :, 0] = np.cumsum(out[:, :, 0], axis=1)
    return np.cumsum(out, axis=2).astype(np.uint8)


def encode_frames(payload: bytes) -> list[bytes]:
    frames, n = [], FRAME * 9 // 8
    for at in range(0, len(payload), AT_ONCE * FRAME):
        x = np.frombuffer(payload[at : at + AT_ONCE * FRAME], dtype=np.uint8).reshape(-1, HEIGHT, WIDTH)
        words = CODE[predictions_removed(x) + 255].reshape(-1) << 7
        bits = np.unpackbits(words.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, :9]
        packed = np.packbits(bits.reshape(len(x), -1), axis=1).tobytes()
        frames += [HEADER + packed[i : i + n].replace(b"\xff", b"\xff\0") + END for i in range(0, len(packed), n)]
    return frames


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(payload: bytes) -> bytes:
    frames = encode_frames(payload)
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _children(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def read_index(media: bytes) -> tuple[list[tuple[int, int]], float]:
    """Offset and length of each frame, as the idx1 chunk has them (or, without one, the movi list), and frames a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, walked, movi, fps = [], [], None, float(FPS)
    for name, at, size in _children(media, 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0])):
        if name == b"LIST" and media[at : at + 4] == b"hdrl":
            for inner, a, _ in _children(media, at + 4, at + size):
                if inner == b"avih":
                    fps = 1e6 / (struct.unpack_from("<I", media, a)[0] or 40_000)
        elif name == b"LIST" and media[at : at + 4] == b"movi":
            movi = (at, size)
        elif name == b"idx1" and movi:
            e = np.frombuffer(media, dtype=np.dtype("<u4"), count=size // 16 * 4, offset=at).reshape(-1, 4)
            video = e[e[:, 0] == struct.unpack("<I", b"00dc")[0]]
            base = movi[0] if not len(video) or media[movi[0] + int(video[0, 2]) : movi[0] + int(video[0, 2]) + 4] == b"00dc" else 0
            frames = [(base + o + 8, n) for o, n in zip(video[:, 2].tolist(), video[:, 3].tolist(), strict=True)]
    if not frames and movi:
        walked = [(a, n) for name, a, n in _children(media, movi[0] + 4, movi[0] + movi[1]) if name == b"00dc"]
    return frames or walked, fps


def _parse_jpeg(frame: bytes) -> tuple[int, int, dict[tuple[int, int], int], int]:
    """Height, width, the Huffman table (bits, code) -> category, and where the scan begins."""
    at, table, height, width = 2, {}, 0, 0
    while at < len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC3:
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xC4:
            code, k = 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    table[bits, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        at += 2 + size
        if marker == 0xDA:
            return height, width, table, at
    raise ValueError("no scan in the frame")


def _scan_by_bits(data: bytes, n: int, table: dict[tuple[int, int], int]) -> list[int]:
    bits, at, out = int.from_bytes(data, "big"), len(data) * 8, []

    def take(k: int) -> int:
        nonlocal at
        at -= k
        return (bits >> at) & ((1 << k) - 1)

    for _ in range(n):
        length, code = 1, take(1)
        while (length, code) not in table:
            length, code = length + 1, code << 1 | take(1)
        c = table[length, code]
        v = take(c) if c else 0
        out.append(v if not c or v >> (c - 1) else v - (1 << c) + 1)
    return out


def _unpacked(scans: list[bytes], height: int, width: int) -> np.ndarray:
    """Frames whose codes and extra bits are 9 bits together."""
    n = height * width
    bits = np.unpackbits(np.frombuffer(b"".join(scans), dtype=np.uint8).reshape(len(scans), -1), axis=1)[:, : n * 9].reshape(-1, 9)
    wide = np.zeros((len(bits), 16), dtype=np.uint8)
    wide[:, 7:] = bits
    return predictions_added(DIFF[np.packbits(wide, axis=1).view(">u2").reshape(-1)].reshape(-1, height, width))


def decode_frames(media: bytes) -> tuple[np.ndarray, float]:
    """All frames (n x height x width, uint8) and frames a second."""
    index, fps = read_index(media)
    if not index:
        return np.zeros((0, HEIGHT, WIDTH), np.uint8), fps
    first = media[index[0][0] : index[0][0] + index[0][1]]
    height, width, table, begin = _parse_jpeg(first)
    head, scans, same = first[:begin], [], True
    for at, size in index:
        same = same and media[at : at + begin] == head
        scans.append(media[at + begin : at + size - 2].replace(b"\xff\0", b"\xff"))
    if same and {(b, c) for (b, _), c in table.items()} == {(9 - c, c) for c in CATEGORIES} and len({len(s) for s in scans}) == 1:
        return np.concatenate([_unpacked(scans[i : i + AT_ONCE], height, width) for i in range(0, len(scans), AT_ONCE)]), fps
    out = []
    for at, size in index:
        h, w, table, begin = _parse_jpeg(media[at : at + size])
        d = _scan_by_bits(media[at + begin : at + size - 2].replace(b"\xff\0", b"\xff"), h * w, table)
        out.append(predictions_added(np.array(d).reshape(1, h, w)))
    return np.concatenate(out), fps


def _histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    flat = (np.arange(n)[:, None] * BINS + (frames.reshape(n, -1) >> 4)).ravel()
    return np.bincount(flat, minlength=n * BINS).reshape(n, BINS)


def shots(frames: np.ndarray, fps: float) -> list[tuple[int, int, int, int]]:
    """Clips (first frame, frame after the last, start ms, end ms)."""
    n = len(frames)
    if not n:
        return []
    hist = np.concatenate([_histograms(frames[i : i + AT_ONCE]) for i in range(0, n, AT_ONCE)])
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * frames[0].size)
    cuts = [0]
    if len(d):
        s, q = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
        i = np.arange(len(d))
        a = np.maximum(0, i - LOOKBACK)
        m = np.maximum(1, i - a)
        mean = (s[i] - s[a]) / m
        dev = np.sqrt(np.maximum(0, (q[i] - q[a]) / m - mean * mean))
        cuts += (np.flatnonzero(d > np.maximum(FLOOR, mean + 3 * dev)) + 1).tolist()
    ms = lambda f: round(f * 1000 / fps)
    return [(a, b, ms(a), ms(b)) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def payload_of(text: bytes | None) -> bytes:
    t = text or b""
    return t + b" " * (-len(t) % FRAME if t else FRAME)


@F.arrow_udf(T.BinaryType())
def to_avi(texts: pa.Array) -> pa.Array:
    """text -> an AVI file of its padded bytes (a null text counts as empty)."""
    return pa.array([write_avi(payload_of(t)) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


CLIPS = T.ArrayType(T.StructType().add("first_frame", "integer").add("end_frame", "integer").add("start_ms", "long").add("end_ms", "long"))


@F.arrow_udf(CLIPS)
def to_clips(media: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    names = [f.name for f in kind.value_type]
    return pa.array([None if m is None else [dict(zip(names, c, strict=True)) for c in shots(*decode_frames(m))] for m in media.to_pylist()], kind)


INSPECTED = T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string")


@F.arrow_udf(INSPECTED)
def inspect(media: pa.Array) -> pa.Array:
    """What an AVI file holds, as read back from its stored bytes; feature: the clips' number, longest and digest."""
    rows = []
    for m in media.to_pylist():
        frames, fps = decode_frames(m)
        back, clips = frames.tobytes(), shots(frames, fps)
        timed = ";".join(f"{a}-{b}@{s}-{e}" for a, b, s, e in clips)
        feature = f"clips={len(clips)} longest={max((e - s for _, _, s, e in clips), default=0)}ms digest={zlib.crc32(timed.encode()):08x}"
        rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): one AVI file per row of docs."""
    return docs.select(F.col(id_col).alias("doc_id"), to_avi(F.col(text_col).cast("string")).alias("media"))


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shot: doc_id, clip, first_frame, end_frame, start_ms, end_ms (a null file has no clips)."""
    return media.select(F.col(id_col).alias("doc_id"), F.posexplode(to_clips(F.col(media_col))).alias("clip", "c")).select("doc_id", "clip", "c.*")


def inspect_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes and what its AVI file gives back."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), inspect(to_avi(text)).alias("m")).select("doc_id", "n_bytes", "m.*")
