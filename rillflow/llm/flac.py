"""FLAC as a media column: encode bytes as 8-bit mono samples, decode them back, find samples by offset.

A stream has one frame per BLOCK samples. The encoder takes the best of the fixed predictors of order
0, 1 and 2 and a quantised linear predictor of order 2, and Rice-codes the residual; it writes a seek
point for every frame. The decoder verifies each frame's header (CRC-8) and body (CRC-16) and the
stream's MD5, decodes the Rice residuals and runs the predictors. Both work on many frames at once:
step t handles sample t of all frames of a batch.

Defined results: null and empty texts give 64 zero bytes; payloads are padded to a positive multiple of
PAD; repeated rows repeat; an empty table gives an empty result; extra columns are ignored. decode()
reads streams as encode() makes them, many at once. pcm_blocks() reads any stream: those of another make (up to 8
channels, 4 to 32 bits, all predictors, constant and verbatim subframes, Rice partitions, no seek table) frame after
frame in Python, which is far slower. Its samples are those of WAV files: channels in turn, 8 bits unsigned, wider
ones little-endian and signed. Of a damaged stream decode() raises and pcm_blocks() gives a row with the error. A
null stream has no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_batches

PAD, BLOCK, RATE = 64, 1024, 8000
#: Bits of a quantised coefficient and their binary point.
PRECISION, SHIFT = 12, 9
#: Frames coded at once; documents in a batch.
FRAMES, ROWS = 1024, 512
#: Fixed values of the format.
MARKER, SYNC, STREAMINFO, SEEKTABLE = b"fLaC", 0xFFF8, 0, 3
RATE_8K, SIZE_16BIT, SIZE_1024, BITS_8 = 0b0100, 0b0111, 0b1010, 0b001
FIXED, LPC = 0b001000, 0b100000


def _crc_table(bits: int, poly: int, step: int) -> np.ndarray:
    """The remainder of every step-bit value, most significant bit first."""
    x = np.arange(1 << step, dtype=np.uint32) << (bits - step)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for _ in range(step):
        x = np.where(x & top, (x << 1) ^ poly, x << 1) & mask
    return x


CRC8, CRC16 = _crc_table(8, 0x07, 8).tolist(), _crc_table(16, 0x8005, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(frames: list[bytes]) -> np.ndarray:
    """CRC-16 of each: two bytes a step. Frames are aligned at their ends; leading zeros don't count."""
    size = np.array([len(f) for f in frames])
    width = int(size.max(initial=0) + 1) // 2 * 2
    at = np.repeat(np.arange(1, len(frames) + 1) * width - np.cumsum(size), size) + np.arange(size.sum())
    flat = np.zeros(len(frames) * width, np.uint8)
    flat[at] = np.frombuffer(b"".join(frames), np.uint8)
    words = np.ascontiguousarray(flat.view(">u2").astype(np.uint16).reshape(len(frames), -1).T)
    c = np.zeros(len(frames), np.uint16)
    for w in words:
        c = CRC16[c ^ w]
    return c


@lru_cache(200_000)
def frame_header(number: int, size: int) -> bytes:
    """The header of frame ``number`` of ``size`` samples, with its CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:  # as in UTF-8, up to 36 bits
        n = next(n for n in range(1, 7) if number < 1 << (5 * n + 6))
        coded = bytes([(0xFF00 >> (n + 1)) & 0xFF | number >> (6 * n), *[0x80 | number >> (6 * i) & 0x3F for i in range(n - 1, -1, -1)]])
    code = SIZE_1024 if size == BLOCK else SIZE_16BIT
    head = struct.pack(">HBB", SYNC, code << 4 | RATE_8K, BITS_8 << 1) + coded + (b"" if size == BLOCK else struct.pack(">H", size - 1))
    return head + bytes([crc8(head)])


def header_length(data: bytes, at: int) -> int:
    lead = data[at + 4]
    coded = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    return 4 + coded + (2 if data[at + 2] >> 4 == SIZE_16BIT else 0) + 1


@lru_cache(200_000)
def read_header(head: bytes) -> tuple[int, int]:
    """Frame number and samples of a verified header."""
    sync, code, kind = struct.unpack(">HBB", head[:4])
    if sync != SYNC or crc8(head[:-1]) != head[-1]:
        raise ValueError("damaged frame header")
    if kind != BITS_8 << 1 or code >> 4 not in (SIZE_1024, SIZE_16BIT):
        raise ValueError("frame of an unsupported kind")
    number = head[4] if head[4] < 0x80 else head[4] & (0x7F >> (8 - (head[4] ^ 0xFF).bit_length()))
    for b in head[5 : len(head) - (3 if code >> 4 == SIZE_16BIT else 1)]:
        number = number << 6 | b & 0x3F
    return number, BLOCK if code >> 4 == SIZE_1024 else struct.unpack(">H", head[-3:-1])[0] + 1


def _bodies(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The subframe of each frame: data[start : start + size] as samples."""
    n, width = len(start), int(size.max())
    inside = np.arange(width) < size[:, None]
    s = np.where(inside, data[np.minimum(start[:, None] + np.arange(width), len(data) - 1)].astype(np.int32) - 128, 0)
    s1, s2 = np.zeros_like(s), np.zeros_like(s)
    s1[:, 1:], s2[:, 2:] = s[:, :-1], s[:, :-2]
    # sums of integers, exact in floats: equal frames get equal coefficients in any batch
    f, f1, f2 = s.astype(np.float64), s1.astype(np.float64), s2.astype(np.float64)
    r0, r1, r2 = (np.einsum("ij,ij->i", f, x) for x in (f, f1, f2))
    det = r0 * r0 - r1 * r1
    safe = np.where(det > 0, det, 1)
    top = 1 << (PRECISION - 1)
    c1, c2 = (np.clip(np.rint(np.where(det > 0, x / safe, 0) * (1 << SHIFT)), -top, top - 1).astype(np.int32) for x in (r1 * (r0 - r2), r0 * r2 - r1 * r1))
    residuals = [s, s - s1, s - 2 * s1 + s2, s - ((c1[:, None] * s1 + c2[:, None] * s2) >> SHIFT)]
    order_of = np.array([0, 1, 2, 2])
    for r, order in zip(residuals, order_of):
        r[~inside] = 0
        r[:, :order] = 0
    best = np.argmin([np.abs(r).sum(axis=1) for r in residuals], axis=0)
    r = np.choose(best[:, None], residuals)
    order = order_of[best]
    coded = inside & (np.arange(width) >= order[:, None])
    u = np.where(r < 0, -2 * r - 1, 2 * r)
    left = size - order
    k = np.argmin([(u >> i).sum(axis=1) + left * (1 + i) for i in range(11)], axis=0).astype(np.int32)
    # fields: (value, bits), a value being preceded by zeros
    is_lpc = best == 3
    kind = np.where(is_lpc, LPC | 1, FIXED | best) << 1
    eight, word = np.full(n, 8), np.full(n, PRECISION) * is_lpc
    first = [(kind, eight), (s[:, 0] & 255, eight * (order > 0)), (s[:, min(1, width - 1)] & 255, eight * (order > 1)), (np.full(n, (PRECISION - 1) << 5 | SHIFT), 9 * is_lpc), (c1 & (2 * top - 1), word), (c2 & (2 * top - 1), word), (k, np.full(n, 10))]
    value = np.concatenate([np.stack([v * (b > 0) for v, b in first], axis=1), np.where(coded, (1 << k)[:, None] | u & ((1 << k) - 1)[:, None], 0)], axis=1).astype(np.int32)
    bits = np.concatenate([np.stack([b for _, b in first], axis=1), np.where(coded, (u >> k[:, None]) + 1 + k[:, None], 0)], axis=1).astype(np.int64)
    ends = np.cumsum(bits, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    ends = (ends + base[:, None] * 8).ravel()
    value = value.ravel()
    out = np.zeros(int(n_bytes.sum()) * 8, np.uint8)
    at = np.flatnonzero(value)
    for j in range(PRECISION):
        v = value[at] >> j
        at, v = at[v > 0], v[v > 0]
        out[ends[at[(v & 1) == 1]] - 1 - j] = 1
    packed = np.packbits(out).tobytes()
    return [packed[b : b + m] for b, m in zip(base.tolist(), n_bytes.tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; lengths are positive multiples of PAD."""
    length = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    count = -(-length // BLOCK)
    doc = np.repeat(np.arange(len(payloads)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(length) - length, count) + number * BLOCK
    size = np.minimum(length[doc] - number * BLOCK, BLOCK)
    frames: list[bytes] = [b""] * len(doc)
    order = np.argsort(-size, kind="stable")
    for i in range(0, len(order), FRAMES):
        part = order[i : i + FRAMES]
        whole = [frame_header(n, m) + b for n, m, b in zip(number[part].tolist(), size[part].tolist(), _bodies(data, start[part], size[part]))]
        for j, frame, c in zip(part.tolist(), whole, crc16(whole).tolist()):
            frames[j] = frame + struct.pack(">H", c)
    out, at = [], 0
    for p, n in zip(payloads, count.tolist()):
        own = frames[at : at + n]
        at += n
        sizes = [len(f) for f in own]
        block = min(BLOCK, len(p))
        md5 = hashlib.md5(bytes(p).translate(SIGNED)).digest()
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        points, offset = [], 0
        for j, m in enumerate(sizes):
            points.append(struct.pack(">QQH", j * BLOCK, offset, min(BLOCK, len(p) - j * BLOCK)))
            offset += m
        head = MARKER + bytes([STREAMINFO]) + len(info).to_bytes(3, "big") + info + bytes([0x80 | SEEKTABLE]) + (18 * n).to_bytes(3, "big")
        out.append(b"".join([head, *points, *own]))
    return out


#: Unsigned bytes to signed samples.
SIGNED = bytes(b ^ 128 for b in range(256))


def seek_points(stream: bytes) -> tuple[list[tuple[int, int, int]], bytes, int]:
    """(first sample, byte offset in the stream, samples) of each frame, the MD5, and the samples in all."""
    if stream[:4] != MARKER:
        raise ValueError("not a FLAC stream")
    at, last, md5, total, points = 4, False, b"", 0, []
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == STREAMINFO:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 36 & 0xFF != 7:
                raise ValueError("only 8-bit mono streams are read")
            total, md5 = packed & ((1 << 36) - 1), body[18:34]
        elif kind == SEEKTABLE:
            points = list(struct.iter_unpack(">QQH", body))
        at += 4 + n
    return [(s, o + at, n) for s, o, n in points], md5, total


def _samples(frames: list[bytes], heads: list[int], size: np.ndarray) -> np.ndarray:
    """Samples by step and frame; frames come in falling order of size."""
    n, width = len(frames), int(size.max())
    whole = b"".join(frames)
    flat = np.frombuffer(whole + bytes(16 + 8), np.uint8).astype(np.uint64)
    word = np.zeros(len(flat) - 8, np.uint64)  # the 8 bytes from each byte on
    for j in range(8):
        word |= flat[j : j + len(word)] << np.uint64(56 - 8 * j)
    limit = len(whole) + 8
    lengths = np.array([len(f) for f in frames], np.int64)
    pos = (np.cumsum(lengths) - lengths + np.array(heads, np.int64)) * 8

    def look(p: np.ndarray) -> np.ndarray:
        return word[np.minimum(p >> 3, limit)] << (p & 7).astype(np.uint64)

    def take(bits: np.ndarray) -> np.ndarray:
        """An unsigned field of so many bits from each frame."""
        nonlocal pos
        got = np.where(bits > 0, (look(pos) >> np.uint64(1)) >> (63 - np.maximum(bits, 1)).astype(np.uint64), 0).astype(np.int64)
        pos = pos + bits
        return got

    signed = lambda v, bits: v - ((v >> (bits - 1)) << bits)
    all_ = np.ones(n, np.int64)
    kind = take(8 * all_) >> 1
    is_lpc = kind >= LPC
    order = np.where(is_lpc, kind - LPC + 1, kind - FIXED)
    if (order < 0).any() or (order > 2).any() or (is_lpc & (order != 2)).any():
        raise ValueError("a predictor of an unsupported kind")
    warm = [signed(take(8 * (order > i)), 8) for i in range(2)]
    form = take(9 * is_lpc)
    precision = (form >> 5) + 1
    c1, c2 = (signed(take(precision * is_lpc), precision) for _ in range(2))
    c1 = np.where(is_lpc, c1, np.choose(order, [0, 1, 2]))
    c2 = np.where(is_lpc, c2, np.choose(order, [0, 0, -1]))
    shift = np.where(is_lpc, form & 31, 0)
    k = take(10 * all_)
    if (k >> 4).any() or (k == 15).any():
        raise ValueError("Rice partitions of an unsupported kind")
    keep, rice = (63 - k).astype(np.uint64), k
    out = np.zeros((width, n), np.int32)
    s1 = s2 = np.zeros(n, np.int64)
    active = np.searchsorted(-size, -np.arange(width), side="left")  # frames with more than t samples
    sure, one = np.uint64(2**64 - 2**11), np.uint64(1)
    for t, a in enumerate(active.tolist()):
        p, s1, s2 = pos[:a], s1[:a], s2[:a]
        # zeros before the next one: from the exponent of the window as a float
        q = 1086 - ((look(p) & sure).astype(np.float64).view(np.int64) >> 52)
        if (far := q > 50).any():
            more = np.flatnonzero(far)
            q[more] = 0
            while len(more):
                w = look(p[more] + q[more]) & sure
                step = np.minimum(1086 - (w.astype(np.float64).view(np.int64) >> 52), 48)
                q[more] += step
                if (q[more] > 8 * len(whole)).any():
                    raise ValueError("a residual without an end")
                more = more[step == 48]
        after = p + q + 1
        u = (q << rice[:a]) | ((look(after) >> one) >> keep[:a]).astype(np.int64)
        after = after + rice[:a]
        s = ((u >> 1) ^ -(u & 1)) + ((c1[:a] * s1 + c2[:a] * s2) >> shift[:a])
        if t < 2:
            given = order[:a] > t
            s, after = np.where(given, warm[t][:a], s), np.where(given, p, after)
        out[t, :a] = s
        pos = after
        s1, s2 = s, s1
    return out


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """The payload of each stream and its seek points, all checksums verified."""
    where, points, digests = [], [], []
    for d, stream in enumerate(streams):
        at, md5, total = seek_points(stream)
        if sum(n for _, _, n in at) != total:
            raise ValueError("frames are missing")
        points.append(at)
        digests.append(md5)
        ends = [o for _, o, _ in at[1:]] + [len(stream)]
        where += [(d, o, e, n, j) for j, ((_, o, n), e) in enumerate(zip(at, ends))]
    if not where:
        return []
    size = np.array([w[3] for w in where], np.int64)
    parts: list[bytes] = [b""] * len(where)
    order = np.argsort(-size, kind="stable")
    for i in range(0, len(order), FRAMES):
        part = order[i : i + FRAMES].tolist()
        frames = [streams[where[x][0]][where[x][1] : where[x][2]] for x in part]
        heads = [header_length(f, 0) for f in frames]
        for x, f, h in zip(part, frames, heads):
            if read_header(f[:h]) != (where[x][4], where[x][3]):
                raise ValueError("a frame is not where the seek table says")
        stored = np.array([int.from_bytes(f[-2:], "big") for f in frames])
        if (crc16([f[:-2] for f in frames]) != stored).any():
            raise ValueError("damaged frame")
        rows = np.ascontiguousarray((_samples(frames, heads, size[part]) + 128).astype(np.uint8).T)
        for x, row in zip(part, rows):
            parts[x] = row[: size[x]].tobytes()
    out, at = [], 0
    for own, md5 in zip(points, digests):
        payload = b"".join(parts[at : at + len(own)])
        at += len(own)
        if hashlib.md5(payload.translate(SIGNED)).digest() != md5:
            raise ValueError("the samples are not those encoded")
        out.append((payload, own))
    return out


class Bits:
    """A stream read from a byte on, field after field."""

    def __init__(self, data: bytes, start: int) -> None:
        self.data, self.at = data, 8 * start

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the stream ends early")
        v = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7) & ((1 << n) - 1)
        self.at = end
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        """How many zeros stand before the next one, which is read as well."""
        n = 0
        while self.at >> 3 < len(self.data):
            left = 8 - (self.at & 7)
            rest = self.data[self.at >> 3] & ((1 << left) - 1)
            step = left - rest.bit_length()
            n, self.at = n + step, self.at + step
            if rest:
                self.at += 1
                return n
        raise ValueError("the stream ends early")


def _residuals(bits: Bits, size: int, order: int) -> Iterator[int]:
    """The residuals of a subframe, partition after partition."""
    method = bits.take(2)
    if method > 1:
        raise ValueError("residuals of a reserved kind")
    width, parts = 4 + method, 1 << bits.take(4)
    if size % parts or size // parts < order:
        raise ValueError("partitions that don't fit")
    for p in range(parts):
        n, k = size // parts - (0 if p else order), bits.take(width)
        if k == (1 << width) - 1:
            raw = bits.take(5)
            for _ in range(n):
                yield bits.signed(raw)
        else:
            for _ in range(n):
                u = bits.zeros() << k | bits.take(k)
                yield (u >> 1) ^ -(u & 1)


def _subframe(bits: Bits, size: int, width: int) -> list[int]:
    if bits.take(1):
        raise ValueError("damaged subframe")
    kind = bits.take(6)
    wasted = bits.zeros() + 1 if bits.take(1) else 0
    width -= wasted
    if width < 1:
        raise ValueError("damaged subframe")
    if kind == 0:
        s = [bits.signed(width)] * size
    elif kind == 1:
        s = [bits.signed(width) for _ in range(size)]
    elif FIXED <= kind <= FIXED + 4 or kind >= LPC:
        order = kind - LPC + 1 if kind >= LPC else kind - FIXED
        if order > size:
            raise ValueError("a predictor longer than its frame")
        s, shift = [bits.signed(width) for _ in range(order)], 0
        if kind >= LPC:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("a predictor of a reserved kind")
            c = [bits.signed(precision) for _ in range(order)]
        else:  # differences, over and over
            c = [(-1) ** i * comb(order, i + 1) for i in range(order)]
        for r in _residuals(bits, size, order):
            s.append(r + (sum(x * y for x, y in zip(c, reversed(s[len(s) - order :]))) >> shift))
    else:
        raise ValueError("a subframe of a reserved kind")
    return [v << wasted for v in s]


#: Sample sizes by their code, 0 being that of the stream.
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame(data: bytes, start: int, stream_bits: int) -> tuple[list[list[int]], int, int]:
    """Samples by channel, their bits and the byte after a frame, both checksums verified."""
    bits = Bits(data, start)
    if bits.take(15) != SYNC >> 1:
        raise ValueError("no frame where one should start")
    bits.take(1)
    size_code, rate_code, layout, bits_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    lead = bits.take(8)
    bits.take(0 if lead < 0x80 else 8 * (7 - (lead ^ 0xFF).bit_length()))
    if not size_code or rate_code == 15 or layout > 10 or bits_code == 3:
        raise ValueError("frame of a reserved kind")
    size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else bits.take(8 * (size_code - 5)) + 1 if size_code < 8 else 256 << (size_code - 8)
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if crc8(data[start : bits.at >> 3]) != bits.take(8):
        raise ValueError("damaged frame header")
    width = SAMPLE_BITS.get(bits_code, stream_bits)
    # of two channels one may be the difference, which is a bit wider
    sides = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(layout, (0,) * (layout + 1))
    s = [_subframe(bits, size, width + more) for more in sides]
    end = (bits.at + 7) >> 3
    if int(crc16([data[start:end]])[0]) != int.from_bytes(data[end : end + 2], "big") or end + 2 > len(data):
        raise ValueError("damaged frame")
    if layout == 8:
        s[1] = [x - d for x, d in zip(*s)]
    elif layout == 9:
        s[0] = [d + x for d, x in zip(*s)]
    elif layout == 10:
        whole = [(m << 1 | d & 1, d) for m, d in zip(*s)]
        s = [[(m + d) >> 1 for m, d in whole], [(m - d) >> 1 for m, d in whole]]
    return s, width, end + 2


def decode_any(stream: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    """decode() of one stream of any make; its seek points are found on the way."""
    if stream[:4] != MARKER:
        raise ValueError("not a FLAC stream")
    at, last, info = 4, False, b""
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        info = stream[at + 4 : at + 4 + n] if kind == STREAMINFO else info
        at += 4 + n
    if len(info) != 34:
        raise ValueError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    channels, width, total, md5 = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), info[18:34]
    size, parts, points, done = (width + 7) // 8, [], [], 0
    while done < total or (not total and at < len(stream)):
        s, bits, end = _frame(stream, at, width)
        if len(s) != channels or bits != width:
            raise ValueError("a frame unlike its stream")
        parts.append(b"".join(v.to_bytes(size, "little", signed=True) for row in zip(*s) for v in row))
        points.append((done, at, len(s[0])))
        done, at = done + len(s[0]), end
    payload = b"".join(parts)
    if total and done != total:
        raise ValueError("frames are missing")
    if any(md5) and hashlib.md5(payload).digest() != md5:
        raise ValueError("the samples are not those encoded")
    return payload.translate(SIGNED) if size == 1 else payload, points


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(PAD - len(raw) if not raw else -len(raw) % PAD)


def features(payload: bytes) -> str:
    """Sum, sum of squares, sign changes and peak of the samples, in integers."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"sum={s.sum()};energy={np.dot(s, s)};crossings={np.count_nonzero((s[1:] < 0) != (s[:-1] < 0))};peak={np.abs(s).max()}"


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, flac: the texts as FLAC streams."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, ROWS):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode([payload_of(t) for t in b.column(1).to_pylist()]), pa.binary())], ["doc_id", "flac"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, flac binary")


#: What a damaged stream may raise on its way through the decoder.
DAMAGED = (ValueError, IndexError, OverflowError, struct.error)


def each(streams: list[bytes]) -> list[tuple[tuple[bytes, list[tuple[int, int, int]]] | None, str | None]]:
    """What decode() gives for each stream, or the error; all at once, and one by one only if some are of another make or damaged."""
    try:
        return [(x, None) for x in decode(streams)]
    except DAMAGED:
        out = []
        for s in streams:
            try:
                out.append((decode_any(s), None))
            except DAMAGED as e:
                out.append((None, str(e) or type(e).__name__))
        return out


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, samples, byte_offset, pcm, error: the decoded blocks of doc_id, flac.

    first_sample and byte_offset are the seek point of the block's frame in the stream. A stream that can't be
    read gives one row with nothing but the error; no other stream is lost with it."""
    text_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, ROWS):
            rows = []
            for d, (found, error) in zip(b.column(0).to_pylist(), each(b.column(1).to_pylist())):
                if found is None:
                    rows.append((d, None, None, None, None, None, error))
                    continue
                payload, at = found
                width = len(payload) // max(1, sum(n for _, _, n in at))
                rows += [(d, j, s, n, o, payload[s * width : (s + n) * width], None) for j, (s, o, n) in enumerate(at)]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "block", "first_sample", "samples", "byte_offset", "pcm", "error"])

    return media.filter(F.col("flac").isNotNull()).select("doc_id", "flac").mapInArrow(run, f"doc_id {_id_type(media)}, block int, first_sample long, samples int, byte_offset long, pcm binary, error string")


def report(docs: DataFrame) -> DataFrame:
    """The texts stored as FLAC and read back: sizes, digests and features."""
    text_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, ROWS):
            texts = b.column(1).to_pylist()
            media = encode([payload_of(t) for t in texts])
            rows = [(len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), features(p)) for t, m, (p, _) in zip(texts, media, decode(media))]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
