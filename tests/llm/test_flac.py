"""FLAC: round trips, a plain bit-by-bit decoder, damage."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from rillflow.llm import flac

TEXTS = [None, "", "a", "x" * 64, "x" * 65, "é😀" * 700, "\x00" * 1024, "ab" * 512, "z" * 1025, "".join(chr(random.Random(1).randrange(32, 0x2FFF)) for _ in range(3000)), "word " * 40000]


def plain(stream):
    """A decoder that reads one bit after another."""
    points, _, total = flac.seek_points(stream)
    out = []
    for _, offset, n in points:
        head = flac.header_length(stream, offset)
        bits = "".join(f"{b:08b}" for b in stream[offset + head : offset + head + 3000])
        at = 0

        def take(k):
            nonlocal at
            at += k
            return int(bits[at - k : at] or "0", 2)

        def signed(k):
            v = take(k)
            return v - (1 << k) if v >> (k - 1) else v

        kind = take(8) >> 1
        order = kind - 31 if kind >= 32 else kind - 8
        s = [signed(8) for _ in range(order)]
        if kind >= 32:
            precision, shift = take(4) + 1, take(5)
            c = [signed(precision) for _ in range(order)]
        else:
            c, shift = [[], [1], [2, -1]][order], 0
        assert take(6) == 0
        k = take(4)
        while len(s) < n:
            q = 0
            while not take(1):
                q += 1
            u = q << k | take(k)
            s.append((u >> 1 if u % 2 == 0 else -(u + 1) // 2) + (sum(x * y for x, y in zip(c, reversed(s))) >> shift))
        out += s
    assert len(out) == total
    return bytes(v + 128 for v in out)


def test_round_trip_and_plain_decoder():
    payloads = [flac.payload_of(t) for t in TEXTS]
    assert all(len(p) % 64 == 0 and p for p in payloads)
    streams = flac.encode(payloads)
    assert [p for p, _ in flac.decode(streams)] == payloads
    assert [plain(s) for s in streams[:10]] == payloads[:10]
    assert streams[3] == flac.encode([payloads[3]])[0]


def test_random_bytes_and_long_zero_runs():
    rng = random.Random(2)
    payloads = [bytes(rng.randrange(256) for _ in range(64 * n)) for n in (1, 3, 17, 40)] + [bytes(1000) + b"\xff" + bytes(23), b"\x80" * 2048, bytes([0, 255]) * 640]
    assert [p for p, _ in flac.decode(flac.encode(payloads))] == payloads


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 70000, 3_000_000):
        head = flac.frame_header(n, 64)
        assert flac.header_length(head, 0) == len(head) and flac.read_header(head) == (n, 64)


def test_damage_is_found():
    [stream] = flac.encode([flac.payload_of("some text " * 300)])
    (_, start, _), *_ = flac.seek_points(stream)[0]
    for at in (start, start + 3, start + 40, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(bad)])


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, "a"])] + [(None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = flac.report(docs).collect()
    want = []
    for i, t, _ in rows:
        p = flac.payload_of(t)
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    media = flac.encoded(docs)
    assert {hashlib.sha256(r.flac).hexdigest() for r in media.collect()} == {r.media_sha256 for r in got}
    blocks = {(r.doc_id, r.block): r for r in flac.pcm_blocks(media).collect()}
    r = blocks[(10, 3)]
    assert r.first_sample == 3072 and r.pcm == flac.payload_of(TEXTS[10])[3072:4096]
    assert flac.report(docs.limit(0)).count() == 0


def test_documents():
    payloads = [flac.payload_of(t) for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    streams = flac.encode(payloads)
    assert [p for p, _ in flac.decode(streams)] == payloads
    assert sum(map(len, streams)) < sum(map(len, payloads))


def test_a_damaged_stream_gives_an_error_and_loses_no_other(spark):
    good = flac.encode([flac.payload_of("some text " * 200), flac.payload_of("more " * 900)])
    flipped = bytearray(good[0])
    flipped[-30] ^= 4
    streams = [good[0], bytes(flipped), good[1], b"RIFF and so on", b"", good[0][:90], None]
    media = spark.createDataFrame(list(enumerate(streams)), "doc_id long, flac binary").repartition(1)
    rows = flac.pcm_blocks(media).collect()
    assert {r.doc_id for r in rows if r.error} == {1, 3, 4, 5} and len([r for r in rows if r.error]) == 4
    for i, text in ((0, "some text " * 200), (2, "more " * 900)):
        pcm = b"".join(r.pcm for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.block))
        assert pcm == flac.payload_of(text)


def field(v, n):
    return format(v & ((1 << n) - 1), f"0{n}b") if n else ""


def remainder(data, bits, poly):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
    return c


def coded(r, parts, order, size, wide=False, escape=False):
    """Residuals in partitions, the first of them raw if asked for."""
    out, per = field(int(wide), 2) + field(parts, 4), size >> parts
    for p in range(1 << parts):
        own, r = r[: per - (0 if p else order)], r[per - (0 if p else order) :]
        if escape and not p:
            out += "1" * (5 if wide else 4) + field(20, 5) + "".join(field(x, 20) for x in own)
            continue
        k = 3 + p % 3
        out += field(k, 5 if wide else 4)
        for x in own:
            u = 2 * x if x >= 0 else -2 * x - 1
            out += "0" * (u >> k) + "1" + field(u, k)
    return out


def subframe(s, width, kind, order=0, wasted=0, **how):
    s, width = [v >> wasted for v in s], width - wasted
    flag = "1" + "0" * (wasted - 1) + "1" if wasted else "0"
    head, warm = lambda k: "0" + field(k, 6) + flag, "".join(field(v, width) for v in s[:order])
    if kind == "constant":
        return head(0) + field(s[0], width)
    if kind == "verbatim":
        return head(1) + "".join(field(v, width) for v in s)
    if kind == "fixed":
        r = s
        for _ in range(order):
            r = [b - a for a, b in zip(r, r[1:])]
        return head(8 + order) + warm + coded(r, how.pop("parts", 0), order, len(s), **how)
    c, shift = [(-1) ** i * (300 - 9 * i) for i in range(order)], 9
    r = [s[t] - (sum(x * s[t - 1 - i] for i, x in enumerate(c)) >> shift) for t in range(order, len(s))]
    return head(31 + order) + warm + field(11, 4) + field(shift, 5) + "".join(field(x, 12) for x in c) + coded(r, how.pop("parts", 0), order, len(s), **how)


def foreign(frames, channels, width, code):
    """A stream without a seek table: frames are (layout, channels' samples as heard, subframes)."""
    body, heard = b"", []
    for n, (layout, samples, subs) in enumerate(frames):
        head = int("11111111111110" + "00" + field(7, 4) + field(0, 4) + field(layout, 4) + field(code, 3) + "0" + field(n, 8) + field(len(samples[0]) - 1, 16), 2).to_bytes(7, "big")
        head += bytes([remainder(head, 8, 0x07)])
        bits = "".join(subs)
        frame = head + int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
        body += frame + remainder(frame, 16, 0x8005).to_bytes(2, "big")
        heard += [v for row in zip(*samples) for v in row]
    size = (width + 7) // 8
    pcm = b"".join(v.to_bytes(size, "little", signed=True) for v in heard)
    info = bytes(10) + (44100 << 44 | (channels - 1) << 41 | (width - 1) << 36 | len(heard) // channels).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC" + bytes([1, 0, 0, 5]) + b"other" + bytes([0x80, 0, 0, 34]) + info + body, pcm


def wave(n, width, seed):
    rng, v, out = random.Random(seed), 0, []
    for _ in range(n):
        v = max(-(1 << width - 2), min((1 << width - 2) - 1, v + rng.randrange(-40, 41)))
        out.append(v)
    return out


def test_streams_of_another_make(spark):
    a, b = wave(96, 16, 1), wave(96, 16, 2)
    mono = [("fixed", o, {}) for o in range(5)] + [("lpc", o, {}) for o in (1, 2, 8, 32)] + [("fixed", 2, {"parts": 3}), ("lpc", 4, {"parts": 2, "wide": True}), ("fixed", 1, {"parts": 1, "escape": True}), ("lpc", 3, {"escape": True, "wide": True}), ("verbatim", 0, {})]
    frames = [(0, [a], [subframe(a, 16, kind, order, **how)]) for kind, order, how in mono]
    frames += [(0, [[7] * 50], [subframe([7] * 50, 16, "constant")]), (0, [[8 * v for v in a[:40]]], [subframe([8 * v for v in a[:40]], 16, "fixed", 1, 3)]), (0, [[5]], [subframe([5], 16, "verbatim")])]
    side, mid = [x - y for x, y in zip(a, b)], [(x + y) >> 1 for x, y in zip(a, b)]
    stereo = [
        (1, [a, b], [subframe(a, 16, "fixed", 2), subframe(b, 16, "verbatim")]),
        (8, [a, b], [subframe(a, 16, "fixed", 1), subframe(side, 17, "lpc", 2)]),
        (9, [a, b], [subframe(side, 17, "fixed", 3), subframe(b, 16, "fixed", 0, parts=4)]),
        (10, [a, b], [subframe(mid, 16, "fixed", 2), subframe(side, 17, "fixed", 2)]),
    ]
    deep, small = wave(64, 24, 3), wave(64, 8, 4)
    made = [foreign(frames, 1, 16, 4), foreign(stereo, 2, 16, 0), foreign([(0, [deep], [subframe(deep, 24, "fixed", 2)])], 1, 24, 6), foreign([(0, [small], [subframe(small, 8, "fixed", 3)])], 1, 8, 1)]
    want = [pcm for _, pcm in made[:3]] + [bytes(v ^ 128 for v in made[3][1])]
    assert [flac.decode_any(s)[0] for s, _ in made] == want
    own = flac.payload_of("some text " * 300)
    assert flac.decode_any(flac.encode([own])[0]) == flac.decode(flac.encode([own]))[0]
    media = spark.createDataFrame(list(enumerate(s for s, _ in made)), "doc_id long, flac binary").repartition(1)
    rows = flac.pcm_blocks(media).orderBy("doc_id", "block").collect()
    assert not [r.error for r in rows if r.error] and [b"".join(r.pcm for r in rows if r.doc_id == i) for i in range(4)] == want
    for stream, _ in made:
        for at in range(len(stream) - len(stream) // 3, len(stream), 7):
            bad = bytearray(stream)
            bad[at] ^= 16
            with pytest.raises(flac.DAMAGED):
                flac.decode_any(bytes(bad))
