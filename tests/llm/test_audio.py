import hashlib
import os
import zlib

import pytest

from fieldtree.llm import mpeg_audio as M


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 936, 937, 938, 1900, 50_000])
def test_payloads(n):
    data = os.urandom(n)
    payload = M.padded(data)
    media = M.write_stream(payload)
    stream = M.parse_stream(media)
    assert M.read_payload(media, stream) == payload
    assert (stream.skipped, stream.bad_checksums, stream.table_frames, stream.table_bytes) == (0, 0, len(stream.offsets), stream.audio_bytes)
    assert M.toc_fits(stream) and stream.samples == 1152 * len(stream.offsets)
    assert all(media[at] == 0xFF for at in stream.offsets)


def test_resynchronises_and_sees_damage():
    media = M.write_stream(M.padded(bytes(range(256)) * 30))
    whole = M.parse_stream(media)
    at = whole.offsets[3]
    noise = b"\xff\xfb\x00junk\xff\xfa"
    spoiled = M.parse_stream(media[:at] + noise + media[at:])
    assert spoiled.skipped == len(noise) and len(spoiled.offsets) == len(whole.offsets)
    bad = bytearray(media)
    bad[at + 10] ^= 1  # side information
    assert M.parse_stream(bytes(bad)).bad_checksums == 1
    with pytest.raises(ValueError):
        M.read_payload(bytes(bad), M.parse_stream(bytes(bad)))
    tail = M.parse_stream(media + b"TAG" + bytes(125))
    assert tail.samples == whole.samples and tail.skipped == 0


def test_headers():
    head = M.parse_header(b"\xff\xfb\x90\x64")
    assert (head.version, head.layer, head.kbits, head.rate, head.length, head.samples) == (1, 3, 128, 44100, 417, 1152)
    assert M.parse_header(b"\xff\xf3\x40\xc4").samples == 576  # MPEG-2
    assert M.parse_header(b"\xff\xfb\xf0\x64") is None and M.parse_header(b"ab") is None


def test_table(spark, documents, odd_texts):
    rows = M.audio_features(documents.withColumnRenamed("n_chars", "feature")).collect()
    assert len(rows) == len(odd_texts) + 2
    for row in rows:
        if row.doc_id is None:
            continue
        data = (odd_texts[row.doc_id] or "").encode()
        payload = M.padded(data)
        assert (row.n_bytes, row.payload_bytes) == (len(data), len(payload))
        assert (row.payload_sha256, row.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert row.duration_s == row.n_samples / row.sample_rate and len(row.seek_offsets) == row.n_frames
    assert M.audio_features(documents.limit(0)).count() == 0


def slow_crc(bits):
    """The format's checksum, a bit at a time."""
    value = 0xFFFF
    for bit in bits:
        carry = (value >> 15) ^ bit
        value = (value << 1) & 0xFFFF
        if carry:
            value ^= 0x8005
    return value


def bits_of(data):
    return [b >> (7 - k) & 1 for b in data for k in range(8)]


def slow_stream(payload):
    """The stream that the operator writes, from the format's definition, a frame at a time."""
    kbits = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    frames, at = [], 0
    while at < len(payload) or not frames:
        rest = len(payload) - at
        index = next((k for k, r in enumerate(kbits) if 144 * r * 1000 // 48000 - 23 >= rest), len(kbits) - 1)
        size = 144 * kbits[index] * 1000 // 48000
        head = bytes([0xFF, 0xFA, (index + 1) << 4 | 1 << 2, 0xC0])
        body = payload[at : at + size - 23]
        frames.append((head + slow_crc(bits_of(head[2:] + bytes(17))).to_bytes(2, "big") + bytes(17) + body).ljust(size, b"\0"))
        at += len(body)
    info = 144 * 64 * 1000 // 48000
    total = info + sum(map(len, frames))
    starts = [info + sum(map(len, frames[:k])) for k in range(len(frames))]
    toc = bytes(starts[k * len(frames) // 100] * 256 // total for k in range(100))
    first = (bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0]) + bytes(17) + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc).ljust(info, b"\0")
    body = b"payload\0" + len(payload).to_bytes(8, "big") + zlib.crc32(payload).to_bytes(4, "big")
    safe = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    tag = b"PRIV" + safe(len(body)) + b"\0\0" + body
    lead = b"ID3\x04\0\0" + safe(len(tag)) + tag
    return lead + first + b"".join(frames), [len(lead) + s for s in starts]


@pytest.mark.parametrize("n", [0, 1, 64, 900, 937, 938, 2000, 9000])
def test_written_as_the_format_says(n):
    payload = M.padded(os.urandom(n))
    expected, offsets = slow_stream(payload)
    assert M.write_stream(payload) == expected
    row = M.store_and_read(5, payload)
    stream = M.parse_stream(expected)
    assert stream.offsets == offsets and stream.samples == stream.sounding == 1152 * len(offsets)
    assert (row[5], row[6], row[8], row[9], row[10], row[12]) == (len(expected), hashlib.sha256(expected).hexdigest(), len(offsets), 1152 * len(offsets), 48000, offsets)


def test_false_tags_skip_no_audio():
    media = M.write_stream(M.padded(bytes(8000)))
    whole = M.parse_stream(media)
    at = whole.offsets[3]
    for junk in (b"ID3\x04\0\0\x7f\x7f\x7f\x7f", b"ID3\x04\0\0\0\0\x02\0", b"APETAGEX" + b"\xff" * 24, b"TAG"):
        found = M.parse_stream(media[:at] + junk + media[at:])
        assert len(found.offsets) == len(whole.offsets) and found.skipped == len(junk), junk
    real = b"ID3\x04\0\0\0\0\0\x05hello"
    found = M.parse_stream(media[:at] + real + media[at:])
    assert (len(found.offsets), found.skipped) == (len(whole.offsets), 0)


def layer3(rest=b""):
    return (b"\xff\xfb\x90\xc4" + bytes(17) + rest).ljust(417, b"\0")


def test_vbri_table_and_delay():
    sizes = [417, 417, 417, 417]
    table = b"\xff\xfb\x90\xc4" + bytes(32) + b"VBRI" + (1).to_bytes(2, "big") + (529).to_bytes(2, "big") + bytes(2) + (417 * 5).to_bytes(4, "big") + (4).to_bytes(4, "big") + (4).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + b"".join(s.to_bytes(2, "big") for s in sizes)
    stream = M.parse_stream(table.ljust(417, b"\0") + layer3() * 4)
    assert (stream.table, stream.table_frames, stream.table_bytes, stream.samples, stream.delay, stream.sounding) == ("VBRI", 4, 2085, 4608, 529, 4079)
    assert stream.seek_points == [(k, 417 * (k + 1)) for k in range(4)] and [o for _, o in stream.seek_points] == stream.offsets
    xing = b"Xing" + (1).to_bytes(4, "big") + (3).to_bytes(4, "big") + (b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big"))
    stream = M.parse_stream(layer3(xing) + layer3() * 3)
    assert (stream.table, stream.table_frames, stream.samples, stream.delay, stream.padding, stream.sounding) == ("Xing", 3, 3456, 576, 1000, 1880)


def slow_layer2(head, body):
    """Checksum of a stereo Layer II frame of 128 kbit/s at 48 kHz: 27 subbands with fields of 4, 3 and 2 bits."""
    bits, at, used = bits_of(body), 0, 0
    for width in [4] * 11 + [3] * 12 + [2] * 4:
        for _ in range(2):
            used += any(bits[at : at + width])
            at += width
    return slow_crc(bits_of(head[2:]) + bits[: at + 2 * used])


@pytest.mark.parametrize("layer", [1, 2])
def test_checksums_of_the_other_layers(layer):
    head = b"\xff\xfe\x44\x04" if layer == 1 else b"\xff\xfc\x84\x04"  # 128 kbit/s, 48 kHz, stereo, protected
    length = M.parse_header(head).length
    assert (M.parse_header(head).layer, length) == ((1, 128) if layer == 1 else (2, 384))
    frames = []
    for k in range(3):
        body = os.urandom(length - 6)
        check = slow_crc(bits_of(head[2:] + body[:32])) if layer == 1 else slow_layer2(head, body)
        frames.append(head + check.to_bytes(2, "big") + body)
    assert (M.parse_stream(b"".join(frames)).checksums, M.parse_stream(b"".join(frames)).bad_checksums) == (3, 0)
    bad = b"".join(f[:4] + bytes([f[4] ^ 1]) + f[5:] for f in frames)
    assert (M.parse_stream(bad).checksums, M.parse_stream(bad).bad_checksums) == (3, 3)
