"""Media columns as AVI motion-JPEG.

Bytes are stored without loss as the quantised DCT coefficients of baseline JPEG frames: a frame of 24 x 24 grey
pixels is nine blocks of 64 coefficients and holds 576 bytes.  Byte b becomes the coefficient of magnitude category 8
whose eight amplitude bits are b (128..255 as itself, 0..127 as b - 255).  Both Huffman tables have one symbol of one
bit, category 8 without a run, so a coefficient takes nine bits and a block 72 bytes; a restart marker after each
block resets the DC predictor.  Frames lie in a RIFF file with an ``idx1`` index, by which they are found again.

Reading parses the RIFF index, decodes each intra frame to coefficients and pixels, and compares the grey histograms
of neighbouring frames.  A shot begins where the difference is above the mean of the last differences by a multiple of
their deviation, so the threshold adapts to the material.  Clips are the shots, as timed rows.

Defined results: null and empty texts are one frame of filler bytes; texts of any length become more frames; equal
texts give equal bytes; a file without frames has no clips; a broken file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm._batches import runs, two

FRAME, SIDE, BLOCKS, FILLER, FPS = 576, 24, 9, 255, 25
PART = 2048  # frames worked on at a time


def _zigzag() -> np.ndarray:
    """The row-major place of each coefficient in JPEG's order: along anti-diagonals, in turns up and down."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Pixels of a block from its coefficients in JPEG's order."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    return np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + b"\x01" + b"\x00" * 15 + b"\x08")
    + _segment(0xC4, b"\x10" + b"\x01" + b"\x00" * 15 + b"\x08")
    + _segment(0xDD, b"\x00\x01")
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
_MARKS = np.array([[0xFF, 0xD0 + i] for i in range(BLOCKS - 1)] + [[0xFF, 0xD9]], np.uint8)


def padded(payload: bytes) -> bytes:
    """``payload`` with filler bytes up to a positive multiple of a frame's."""
    n = max(FRAME, -(-len(payload) // FRAME) * FRAME)
    return payload + bytes([FILLER]) * (n - len(payload))


def jpeg_frames(payload: bytes) -> list[bytes]:
    """Baseline JPEG files that hold the bytes of ``payload``, a multiple of 576."""
    out = []
    for a in range(0, len(payload), FRAME * PART):
        data = np.frombuffer(payload[a : a + FRAME * PART], np.uint8)
        n = len(data) // FRAME
        bits = np.zeros((len(data), 9), np.uint8)
        bits[:, 1:] = np.unpackbits(data[:, None], axis=1)
        body = np.empty((n, BLOCKS, 74), np.uint8)
        body[:, :, :72] = np.packbits(bits.reshape(-1)).reshape(n, BLOCKS, 72)
        body[:, :, 72:] = _MARKS
        stuffed = body == 0xFF
        stuffed[:, :, 72:] = False
        width = 1 + stuffed.reshape(-1)
        to = np.cumsum(width)
        flat = np.zeros(to[-1], np.uint8)
        flat[to - width] = body.reshape(-1)
        cut = np.concatenate([[0], to.reshape(n, -1)[:, -1]]).tolist()
        raw = flat.tobytes()
        out += [HEADER + raw[x:y] for x, y in zip(cut, cut[1:], strict=False)]
    return out


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file of motion-JPEG frames with an index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [], [], 4
    for f in frames:
        pad = len(f) & 1
        movi.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\x00" * pad)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + pad
    body = b"AVI " + head + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the index names, and the frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    top, fps, movi, index = {}, float(FPS), 0, b""
    at = 12
    while at + 8 <= len(data):
        kind, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        top[data[at + 8 : at + 12] if kind == b"LIST" else kind] = (at + 8, size)
        at += 8 + size + (size & 1)
    if b"movi" not in top or b"idx1" not in top or b"hdrl" not in top:
        raise ValueError("an AVI file needs its header, its frames and its index")
    at = data.find(b"strh", top[b"hdrl"][0], sum(top[b"hdrl"]))
    if at >= 0:
        scale, rate = struct.unpack_from("<II", data, at + 8 + 20)
        fps = rate / max(scale, 1)
    movi = top[b"movi"][0]
    index = data[top[b"idx1"][0] : sum(top[b"idx1"])]
    frames = []
    for kind, _, offset, size in struct.iter_unpack("<4sIII", index):
        if kind[2:] in (b"dc", b"db"):
            begin = movi + offset + 8
            if data[begin - 8 : begin - 4] != kind or begin + size > len(data):
                raise ValueError("the index doesn't fit the frames")
            frames.append(data[begin : begin + size])
    return frames, fps


def _huffman(body: bytes) -> dict[int, dict[tuple[int, int], int]]:
    tables, at = {}, 0
    while at < len(body):
        counts, symbols = body[at + 1 : at + 17], body[at + 17 : at + 17 + sum(body[at + 1 : at + 17])]
        codes, code, k = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        tables[body[at]] = codes
        at += 17 + len(symbols)
    return tables


def decode_jpeg(frame: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Quantised coefficients (blocks x 64, JPEG's order), quantisers, width and height of a grey baseline JPEG file."""
    tables, quant, restart, at, scan = {}, {}, 0, 2, None
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while scan is None:
        marker, (size,) = frame[at + 1], struct.unpack_from(">H", frame, at + 2)
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            for i in range(0, len(body), 65):
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 65], np.uint8)
        elif marker == 0xC0:
            height, width, parts, q = *struct.unpack(">HHB", body[1:6]), body[8]
            if parts != 1:
                raise ValueError("only grey frames are decoded")
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            tables |= _huffman(body)
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            scan, dc, ac = at, tables[body[2] >> 4], tables[0x10 | body[2] & 15]
    blocks = -(-width // 8) * -(-height // 8)
    out = np.zeros((blocks, 64), np.int32)
    bits, n, at, before = 0, 0, scan, 0

    def take(k: int) -> int:
        nonlocal bits, n, at
        while n < k:
            byte = frame[at]
            at += 2 if byte == 0xFF else 1
            bits, n = bits << 8 | byte, n + 8
        n -= k
        value = bits >> n
        bits &= (1 << n) - 1
        return value

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code that no table has")

    def amplitude(k: int) -> int:
        v = take(k) if k else 0
        return v if not k or v >> k - 1 else v - (1 << k) + 1

    for b in range(blocks):
        if restart and b and b % restart == 0:
            bits, n, before = 0, 0, 0
            if frame[at] != 0xFF or not 0xD0 <= frame[at + 1] <= 0xD7:
                raise ValueError("a restart marker is missing")
            at += 2
        before += amplitude(symbol(dc))
        out[b, 0] = before
        i = 1
        while i < 64:
            s = symbol(ac)
            if not s:
                break
            i += s >> 4
            if s & 15:
                out[b, i] = amplitude(s & 15)
            i += 1
    return out, quant[q], width, height


def _own_coefficients(frames: list[bytes]) -> np.ndarray:
    """As :func:`decode_jpeg`, for many frames whose header is :data:`HEADER`: frames x 9 x 64 amplitude bytes."""
    data = np.frombuffer(b"".join(f[len(HEADER) :] for f in frames), np.uint8)
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
    data = data[~stuffed]
    if len(data) != len(frames) * BLOCKS * 74:
        raise ValueError("a frame is cut short")
    data = data.reshape(len(frames), BLOCKS, 74)
    bits = np.unpackbits(np.ascontiguousarray(data[:, :, :72])).reshape(-1, 9)
    if (data[:, :, 72:] != _MARKS).any() or bits[:, 0].any():
        raise ValueError("a marker or a code is wrong")
    return np.packbits(bits[:, 1:].reshape(-1)).reshape(len(frames), BLOCKS, 64)


def histograms(frames: list[bytes], bins: int = 16) -> tuple[np.ndarray, bytes]:
    """Each frame's grey histogram, and the bytes that frames of ours hold."""
    rows, held = [], []
    for a in range(0, len(frames), PART):
        part = frames[a : a + PART]
        if all(f.startswith(HEADER) for f in part):
            raw = _own_coefficients(part)
            held.append(raw.tobytes())
            value = raw.astype(np.float32)
            value -= 255 * (raw < 128)
            grey = np.clip(value.reshape(-1, 64) @ BASIS + 128, 0, 255).astype(np.uint8)
            frame = np.repeat(np.arange(len(part)) * bins, FRAME)
            rows.append(np.bincount(frame + grey.reshape(-1) // (256 // bins), minlength=len(part) * bins).reshape(-1, bins) / FRAME)
        else:
            for f in part:
                coefficients, quant, _, _ = decode_jpeg(f)
                grey = np.clip((coefficients * quant).astype(np.float32) @ BASIS + 128, 0, 255).astype(np.int64)
                rows.append(np.bincount(grey.reshape(-1) // (256 // bins), minlength=bins)[None, :] / grey.size)
    return (np.concatenate(rows) if rows else np.zeros((0, bins))), b"".join(held)


def shots(hist: np.ndarray, window: int = 12, times: float = 2.0, least: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Places where a shot begins (0 first), and the differences of neighbouring frames' histograms.

    A difference begins a shot if it is above ``least`` and above the mean of the ``window`` differences before it by
    ``times`` their deviation; before there are three, only ``least`` counts twice over.
    """
    if not len(hist):
        return np.zeros(0, np.int64), np.zeros(0)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    total, square = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(len(d))
    a = np.maximum(i - window, 0)
    n = np.maximum(i - a, 1)
    mean = (total[i] - total[a]) / n
    deviation = np.sqrt(np.maximum((square[i] - square[a]) / n - mean * mean, 0))
    limit = np.where(i - a >= 3, np.maximum(mean + times * deviation, least), 2 * least)
    return np.concatenate([[0], np.flatnonzero(d > limit) + 1]), d


def store(text: str | None) -> bytes:
    return write_avi(jpeg_frames(padded((text or "").encode())))


def clips(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Timed clip rows ``doc_id, clip, first_frame, frames, start_s, end_s`` of every text's stored form."""
    out = _rows(docs, id_col, text_col).select("doc_id", F.posexplode("clips").alias("clip", "c"))
    return out.select("doc_id", "clip", "c.first_frame", "c.frames", "c.start_s", "c.end_s")


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text's payload as read back and of its stored form, with its shots as a feature and as timed clips."""
    return _rows(docs, id_col, text_col)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip = pa.struct([("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]
        for batch in runs(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                media = store(text)
                frames, fps = read_avi(media)
                hist, payload = histograms(frames)
                begin, d = shots(hist)
                end = np.append(begin[1:], len(frames))
                mean = hist.mean(0) @ np.arange(hist.shape[1]) if len(hist) else 0.0
                feature = f"frames={len(frames)};shots={len(begin)};longest={int((end - begin).max())};change={d.mean() if len(d) else 0:.4f};grey={mean:.4f}"
                rows.append((len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, [(a, b - a, a / fps, b / fps) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return two(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:int,frames:int,start_s:double,end_s:double>>")
