"""Media columns: texts as 8-bit mono FLAC streams with seek points.

Writing: frames hold 576 samples. Each is coded by the fixed linear predictor of order 0, 1 or 2 with the smallest
residuals, Rice-coded with the parameter that makes it shortest, or verbatim if that is shorter. Each frame has a seek
point (beyond POINTS frames every second, third .. one has: a seek table's length has 24 bits).

Reading: `decode` reads any FLAC stream of up to 32 bits and 8 channels: constant, verbatim, fixed (orders 0 to 4) and
linear-predictive subframes, partitioned Rice residuals of both kinds with escape codes, wasted bits, stereo
decorrelation, with or without a seek table. Streams as written here are coded and decoded all frames of a group of
documents together, one numpy step for each sample position. Either way the CRC-8 of each header, the CRC-16 of each
frame and the MD5 of the stream are checked. Decoded streams are given out as PCM blocks with their sample offsets,
and any range of samples of a stream written here can be read through the seek table alone.

Defined results: a null or empty text is one frame of padding; equal texts give equal bytes; very long texts are one
row, decoded in groups of GROUP frames; repeated rows are coded each, null doc_ids kept; an empty table gives an empty
table; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read

BLOCK = 576
RATE = 8000
#: Frames coded together, and payload bytes gathered before coding: bound a task's memory.
GROUP = 2048
GATHER = 4 << 20
#: Points in a seek table at most.
POINTS = ((1 << 24) - 1) // 18
#: Unary parts stay below this, so that a code fits one 64-bit window.
UNARY = 16


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & mask
        table.append(x)
    return np.array(table, np.uint16 if bits == 16 else np.uint8)


_CRC16, _CRC8 = _crc_table(0x8005, 16), _crc_table(0x07, 8)
_CLZ16 = np.array([16 - x.bit_length() for x in range(1 << 16)], np.int64)


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = int(_CRC8[x ^ b])
    return x


def crc16_many(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-16 of each range of flat, one step for each byte position."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    crc = np.zeros(len(s), np.uint16)
    active = len(s)
    for i in range(int(n[0]) if len(n) else 0):
        while n[active - 1] <= i:
            active = int(np.searchsorted(-n[:active], -i, "left"))
        c = crc[:active]
        crc[:active] = (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)) ^ flat[s[:active] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """UTF-8's scheme, carried on to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFF ^ (lead << 1 | 1)) & 0xFF | n, *reversed(tail)])


_HEADERS: list[bytes] = []


def _header(number: int) -> bytes:
    """Sync, 576 samples, the stream's rate, mono, 8 bits, the frame's number, CRC-8."""
    while len(_HEADERS) <= min(number, 4095):
        _HEADERS.append(_make_header(len(_HEADERS)))
    return _HEADERS[number] if number < 4096 else _make_header(number)


def _make_header(number: int) -> bytes:
    body = b"\xff\xf8\x20\x02" + _coded_number(number)
    return body + bytes([crc8(body)])


def encode_frames(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """samples: (frames, 576) signed 8-bit values. The bytes of each frame."""
    count = len(samples)
    s = samples.astype(np.int32)
    best = None
    for order in range(3):
        r = s
        for _ in range(order):
            r = np.diff(r, axis=1)
        u = (r << 1) ^ (r >> 31)
        if best is None:
            best, orders, coded = u.sum(1), np.zeros(count, np.int64), u.copy()
        else:
            total = u.sum(1)
            better = total < best
            best = np.where(better, total, best)
            orders[better] = order
            coded[better, order:] = u[better]
    width = BLOCK - orders
    for order in (1, 2):
        coded[orders == order, :order] = 0
    peak = coded.max(1)
    least = np.maximum(0, np.ceil(np.log2((peak + 1) / UNARY))).astype(np.int64)
    mean = coded.sum(1) / width
    guess = np.maximum(least, np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64))
    ks, size = guess, None
    for k in (np.maximum(least, guess - 1), guess, guess + 1):
        bits = (coded >> k[:, None]).sum(1) + width * (k + 1)
        ks, size = (k, bits) if size is None else (np.where(bits < size, k, ks), np.minimum(bits, size))
    plain = size + 10 + 8 * orders >= 8 * BLOCK
    heads = [_header(n) for n in numbers]
    head_len = np.array([len(h) for h in heads], np.int64)
    body = np.where(plain, BLOCK, orders + (size + 10 + 7) // 8)
    length = head_len + 1 + body + 2
    start = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, np.uint8)
    for order in range(3):
        rows_of_order = np.flatnonzero(~plain & (orders == order))
        for k in np.unique(ks[rows_of_order]).tolist():
            rows = rows_of_order[ks[rows_of_order] == k]
            u = coded[rows, order:]
            q = u >> k
            first = (start[rows] + head_len[rows] + 1 + order) * 8
            for j in range(4):
                bits[first + 9 - j] = k >> j & 1
            end = np.cumsum(q + (k + 1), axis=1) + (first + 10)[:, None]
            bits[end - (k + 1)] = 1
            for j in range(k):
                bits[end - 1 - j] = u >> j & 1
    flat = np.packbits(bits)
    raw = (samples.astype(np.int16) & 0xFF).astype(np.uint8)
    at = start + head_len
    flat[at] = np.where(plain, 0b00000010, 0b00010000 | orders << 1)
    for i in range(2):
        rows = np.flatnonzero(~plain & (orders > i))
        flat[at[rows] + 1 + i] = raw[rows, i]
    for row in np.flatnonzero(plain).tolist():
        flat[at[row] + 1 : at[row] + 1 + BLOCK] = raw[row]
    for h, p in zip(heads, start.tolist(), strict=True):
        flat[p : p + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16_many(flat, start, length - 2)
    flat[start + length - 2], flat[start + length - 1] = crc >> np.uint16(8), crc & np.uint16(0xFF)
    out = flat.tobytes()
    return [out[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]


def stream(frames: list[bytes], pcm: bytes) -> bytes:
    """A whole FLAC stream: STREAMINFO, a seek point for each frame (of very many: for each k-th), the frames."""
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(frames) * BLOCK).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    at = np.arange(0, len(frames), -(-len(frames) // POINTS))
    points = np.zeros(len(at), [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    points["sample"] = at * BLOCK
    points["offset"] = (np.cumsum(sizes) - sizes)[at]
    points["samples"] = BLOCK
    table = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


def layout(media: bytes) -> tuple[int, int, bytes, np.ndarray] | None:
    """(samples, first byte of the frames, MD5, byte offset of each frame) of a stream as written here with a point for each frame."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    word, at = int.from_bytes(media[18:26], "big"), 42
    total = word & (1 << 36) - 1
    size = int.from_bytes(media[at + 1 : at + 4], "big")
    if media[4] or media[8:12] != struct.pack(">HH", BLOCK, BLOCK) or word >> 36 != RATE << 8 | 7 or media[at] != 0x83 or size * BLOCK != 18 * total:
        return None
    points = np.frombuffer(media, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")], total // BLOCK, at + 4)
    if (points["sample"] != np.arange(len(points)) * BLOCK).any() or (points["samples"] != BLOCK).any():
        return None
    return total, at + 4 + size, media[26:42], points["offset"].astype(np.int64)


class _Bits:
    """Reads bits of a byte string, most significant first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        a, end = self.at, self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the stream ends within a frame")
        self.at = end
        return int.from_bytes(self.data[a >> 3 : (end + 7) >> 3], "big") >> (-end & 7) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x - (1 << n) if n and x >> (n - 1) else x


def _unary(bits: _Bits) -> int:
    data, at = bits.data, bits.at
    n = 0
    while True:
        room = 8 - (at & 7)
        if at >> 3 >= len(data):
            raise ValueError("the stream ends within a frame")
        x = data[at >> 3] & ((1 << room) - 1)
        if x:
            n += room - x.bit_length()
            bits.at = at + room - x.bit_length() + 1
            return n
        n, at = n + room, at + room


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    """Rice residuals of all partitions; a partition of the escape parameter holds plain numbers."""
    kind = bits.take(2)
    if kind > 1:
        raise ValueError("an unknown residual coding")
    width = 4 + kind
    parts = bits.take(4)
    if size >> parts << parts != size or size >> parts < order:
        raise ValueError("partitions that do not divide the block")
    out: list[int] = []
    for i in range(1 << parts):
        n = (size >> parts) - (0 if i else order)
        k = bits.take(width)
        if k == (1 << width) - 1:
            plain = bits.take(5)
            out += [bits.signed(plain) for _ in range(n)]
            continue
        for _ in range(n):
            u = _unary(bits) << k | (bits.take(k) if k else 0)
            out.append((u >> 1) ^ -(u & 1))
    return out


#: The coefficients of the format's fixed predictors, by order, nearest sample first.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: _Bits, size: int, depth: int) -> list[int]:
    if bits.take(1):
        raise ValueError("a subframe without its zero bit")
    kind = bits.take(6)
    wasted = _unary(bits) + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > size:
            raise ValueError("a predictor longer than its block")
        out = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            weights, shift = _FIXED[order], 0
        else:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("an invalid linear predictor")
            weights = tuple(bits.signed(precision) for _ in range(order))
        for r in _residual(bits, size, order):
            out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("an unknown kind of subframe")
    return [x << wasted for x in out] if wasted else out


#: The format's codes of block sizes and sample depths (0: in the stream's head or after the number).
_SIZES = (0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
_DEPTHS = (0, 8, 12, 0, 16, 20, 24, 32)


def _frame(data: bytes, at: int, head: int) -> tuple[np.ndarray, int]:
    """((samples, channels), where the frame ends), after the checks of both its checksums. head: the depth in the stream's head."""
    bits = _Bits(data, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame where one should begin")
    bits.take(1)
    size, rate, channels, depth = (bits.take(n) for n in (4, 4, 4, 3))
    if bits.take(1) or size == 0 or rate == 15 or channels > 10 or depth == 3:
        raise ValueError("a reserved value in a frame's head")
    first = bits.take(8)
    bits.take(8 * max(0, (8 - (first ^ 0xFF).bit_length()) - 1))  # the rest of the number
    n = bits.take(8 if size == 6 else 16) + 1 if size in (6, 7) else _SIZES[size]
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if crc8(data[at : bits.at >> 3]) != bits.take(8):
        raise ValueError("a frame header's CRC-8 is wrong")
    depth = _DEPTHS[depth] or head
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    rows = [_subframe(bits, n, depth + (i == side)) for i in range(2 if side is not None else channels + 1)]
    bits.at = -(-bits.at // 8) * 8
    if crc16_many(np.frombuffer(data, np.uint8), np.array([at]), np.array([(bits.at >> 3) - at]))[0] != bits.take(16):
        raise ValueError("a frame's CRC-16 is wrong")
    x = np.array(rows, np.int64)
    if channels == 8:
        x[1] = x[0] - x[1]
    elif channels == 9:
        x[0] = x[0] + x[1]
    elif channels == 10:
        middle = x[0] << 1 | x[1] & 1
        x = np.stack(((middle + x[1]) >> 1, (middle - x[1]) >> 1))
    return x.T, bits.at >> 3


def decode(media: bytes) -> tuple[np.ndarray, int, int]:
    """((samples, channels), sample rate, bits of a sample) of any FLAC stream, fully checked."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info = 4, False, b""
    while not last:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            info = media[at + 4 : at + 4 + size]
        last, at = bool(kind >> 7), at + 4 + size
    word = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
    blocks, have = [np.zeros((0, channels), np.int64)], 0
    while at < len(media) and (not total or have < total):
        block, at = _frame(media, at, depth)
        blocks.append(block)
        have += len(block)
    out = np.concatenate(blocks)
    width = -(-depth // 8)
    if total and have != total or any(info[18:34]) and hashlib.md5(out.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest() != info[18:34]:
        raise ValueError("the samples differ from the stream's head")
    return out, rate, depth


def decode_frames(flat: np.ndarray, start: np.ndarray, length: np.ndarray, numbers: list[int]) -> np.ndarray:
    """The signed samples (frames, 576), after the checks of headers and CRCs."""
    count = len(start)
    heads = [_header(n) for n in numbers]
    head_len = np.array([len(h) for h in heads], np.int64)
    for i in range(int(head_len.max())):
        rows = np.flatnonzero(head_len > i)
        want = np.array([heads[r][i] for r in rows.tolist()], np.uint8)
        if (flat[start[rows] + i] != want).any():
            raise ValueError("a frame header or its CRC-8 is wrong")
    crc = crc16_many(flat, start, length - 2)
    if (crc != (flat[start + length - 2].astype(np.uint16) << np.uint16(8) | flat[start + length - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    at = start + head_len
    kind = flat[at]
    out = np.zeros((count, BLOCK), np.int32)
    plain = np.flatnonzero(kind == 0b00000010)
    if len(plain):
        out[plain] = flat[at[plain][:, None] + 1 + np.arange(BLOCK)].astype(np.int8)
    padded = np.concatenate((flat, np.zeros(8, np.uint8)))
    window = np.zeros(len(flat) + 1, np.uint64)
    for i in range(8):
        window |= padded[i : i + len(window)].astype(np.uint64) << np.uint64(56 - 8 * i) if i + len(window) <= len(padded) else np.append(padded[i:], np.zeros(len(window) + i - len(padded), np.uint8)).astype(np.uint64) << np.uint64(56 - 8 * i)
    for order in range(3):
        rows = np.flatnonzero(kind == (0b00010000 | order << 1))
        if not len(rows):
            continue
        for i in range(order):
            out[rows, i] = flat[at[rows] + 1 + i].astype(np.int8)
        p = (at[rows] + 1 + order) * 8
        head = window[p >> 3] >> np.uint64(54)
        k = (head & np.uint64(15)).astype(np.int64)
        if (head >> np.uint64(4)).any():
            raise ValueError("only one Rice partition with 4-bit parameters is read")
        p += 10
        res = np.empty((BLOCK - order, len(rows)), np.int32)
        keep = (64 - k).astype(np.uint64)
        low = np.where(k > 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        keep[k == 0] = 63
        for i in range(BLOCK - order):
            w = window[p >> 3] << (p & 7).astype(np.uint64)
            q = _CLZ16[w >> np.uint64(48)]
            step = q + 1
            u = q << k | (((w << step.astype(np.uint64)) & low) >> keep).astype(np.int64)
            res[i] = (u >> 1) ^ -(u & 1)
            p += step + k
        r = res.T
        if order == 0:
            out[rows] = r
        elif order == 1:
            out[rows, 1:] = r
            out[rows] = np.cumsum(out[rows], axis=1)
        else:
            s0, s1 = out[rows, 0], out[rows, 1]
            d = np.cumsum(np.concatenate(((s1 - s0)[:, None], r), axis=1), axis=1)
            out[rows] = np.cumsum(np.concatenate((s0[:, None], d), axis=1), axis=1)
    if len(plain) + sum(int((kind == (0b00010000 | o << 1)).sum()) for o in range(3)) != count:
        raise ValueError("an unknown kind of subframe")
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text padded with 255 to a positive multiple of the block)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (BLOCK - len(raw) if not raw else -len(raw) % BLOCK)


def store(payloads: list[bytes]) -> list[bytes]:
    """The FLAC stream of each payload; a byte b is the sample b - 128."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    samples = (flat.astype(np.int16) - 128).astype(np.int8).reshape(-1, BLOCK)
    numbers = [i for p in payloads for i in range(len(p) // BLOCK)]
    frames: list[bytes] = []
    for i in range(0, len(samples), GROUP):
        frames += encode_frames(samples[i : i + GROUP], numbers[i : i + GROUP])
    out, at = [], 0
    for p in payloads:
        n = len(p) // BLOCK
        out.append(stream(frames[at : at + n], samples[at : at + n].tobytes()))
        at += n
    return out


def load(media: list[bytes]) -> list[np.ndarray]:
    """The signed 8-bit samples of each mono stream, fully checked."""
    if any(layout(m) is None for m in media):
        return [load([m])[0] if layout(m) else _mono(m) for m in media]
    heads = [layout(m) for m in media]
    base = np.cumsum([0, *(len(m) for m in media[:-1])])
    flat = np.frombuffer(b"".join(media), np.uint8)
    start = np.concatenate([b + first + offsets for b, (_, first, _, offsets) in zip(base, heads, strict=True)])
    end = np.concatenate([b + np.append(first + offsets[1:], len(m)) for b, m, (_, first, _, offsets) in zip(base, media, heads, strict=True)])
    numbers = [i for h in heads for i in range(len(h[3]))]
    blocks = []
    for i in range(0, len(start), GROUP):
        a, b = start[i : i + GROUP], end[i : i + GROUP]
        blocks.append(decode_frames(flat[a[0] : b[-1]], a - a[0], b - a, numbers[i : i + GROUP]).astype(np.int8))
    samples = np.concatenate(blocks)
    out, at = [], 0
    for total, _, md5, offsets in heads:
        own = samples[at : at + len(offsets)].reshape(-1)
        at += len(offsets)
        if len(own) != total or hashlib.md5(own.tobytes()).digest() != md5:
            raise ValueError("the samples differ from the stream's MD5")
        out.append(own)
    return out


def _mono(media: bytes) -> np.ndarray:
    samples, _, depth = decode(media)
    if samples.shape[1] != 1 or depth != 8:
        raise ValueError("not 8-bit mono: use decode")
    return samples[:, 0].astype(np.int8)


def blocks_of(samples: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(sample offset, PCM) of each block of a stream's samples."""
    for at in range(0, len(samples), BLOCK):
        yield at, samples[at : at + BLOCK].tobytes()


def read_range(media: bytes, first: int, count: int) -> np.ndarray:
    """Samples [first, first + count), decoding only the frames that hold them."""
    if (found := layout(media)) is None:
        return _mono(media)[first : first + max(0, count)]
    total, body, _, offsets = found
    count = max(0, min(count, total - first))
    if not count:
        return np.zeros(0, np.int8)
    a, b = first // BLOCK, (first + count - 1) // BLOCK + 1
    start = offsets[a:b] + body
    end = np.append(start[1:], offsets[b] + body if b < len(offsets) else len(media))
    flat = np.frombuffer(media, np.uint8)
    blocks = decode_frames(flat[start[0] : end[-1]], start - start[0], end - start, list(range(a, b)))
    return blocks.reshape(-1)[first - a * BLOCK :][:count].astype(np.int8)


def feature_of(samples: np.ndarray) -> str:
    """Level, peak and zero crossings of a stream's samples."""
    x = samples.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};peak={int(np.abs(x).max())};zc={crossings}"


def _gathered(batches) -> Iterator[list[tuple]]:
    group, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n, p = payload_of(text)
            if group and size + len(p) > GATHER:
                yield group
                group, size = [], 0
            group.append((doc, n, p))
            size += len(p)
    if group:
        yield group


def media_column(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored FLAC stream of each text."""

    def run(batches):
        for group in _gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array([g[1] for g in group], pa.int64()), pa.array(store([g[2] for g in group]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(df.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(df: DataFrame) -> DataFrame:
    """From doc_id and media: the decoded PCM in blocks, each with its sample offset."""

    def run(batches):
        for b in batches:
            for doc, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, pcm = zip(*blocks_of(load([m])[0]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(pcm), pa.int64()), pa.array(at, pa.int64()), pa.array(pcm, pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return map_arrow(df.select("doc_id", "media"), run, "doc_id long, sample_offset long, pcm binary")


def digests(df: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back, and describe both."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for group in _gathered(batches):
            media = store([p for _, _, p in group])
            rows = []
            for (doc, n, _), m, samples in zip(group, media, load(media), strict=True):
                back = b"".join((np.frombuffer(pcm, np.int8).astype(np.int16) + 128).astype(np.uint8).tobytes() for _, pcm in blocks_of(samples))
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_arrow(df.select("doc_id", "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
