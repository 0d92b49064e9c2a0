"""Media columns: MPEG audio (operator 6).

``write_stream`` packs bytes into a well-formed MPEG-1 Layer III stream: an ID3v2 tag, a
variable-bitrate (Xing) frame with a seek table, then silent frames that carry the bytes behind
their empty side information. ``parse_stream`` reads any such stream: it skips tags, resynchronises
on frame headers, reads Xing and VBRI tables and the encoder's delay, verifies the checksums of all three
layers and gives the exact duration (samples, those without delay and padding, and rate) and the byte
offset of each frame. A tag counts only if it ends inside the data and the end, another tag or a frame
follows it; what is neither tag nor frame is counted as skipped.

Nulls and empty texts give a stream of one 64-byte payload of zeros. Repeated rows give repeated
results; an empty table gives an empty one; other columns are ignored. A stream of ``n`` payload
bytes takes memory in proportion to ``n``, one row at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import row_map, utf8

# Fixed values of the format: kbit/s by bitrate index, and Hz by rate index.
LAYER3_V1_KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LAYER3_V2_KBITS = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
LAYER2_V1_KBITS = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
LAYER1_V1_KBITS = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
LAYER1_V2_KBITS = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
RATES_V1 = (44100, 48000, 32000)

RATE = 48000
MONO_SIDE = 17
OVERHEAD = 4 + 2 + MONO_SIDE
UNIT = 64
#: Owner of the private tag frame that holds the payload's length and checksum.
OWNER = b"payload\0"


def _crc_table() -> np.ndarray:
    """Of the format's 16-bit checksum: polynomial x^16 + x^15 + x^2 + 1, high bit first."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table


CRC16 = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes, all rows at once."""
    value = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        value = ((value << 8) ^ CRC16[(value >> 8) ^ column]) & 0xFFFF
    return value


def crc16_bits(data: bytes, bits: int, value: int = 0xFFFF) -> int:
    """Of the first bits of some bytes, high bit first."""
    for byte in data[: bits >> 3]:
        value = (value << 8 & 0xFFFF) ^ int(CRC16[(value >> 8) ^ byte])
    for k in range(bits & 7):
        top = (value >> 15) ^ (data[bits >> 3] >> (7 - k) & 1)
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 3 for 2.5
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    samples: int
    joint: int = -1  # of joint stereo the mode extension, else -1

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return ((17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)) if self.layer == 3 else 0


# Fixed values of the format: of Layer II's tables of allocations the widths of their fields, as (width, subbands).
LAYER2_A = ((4, 11), (3, 12), (2, 4))
LAYER2_B = ((4, 11), (3, 12), (2, 7))
LAYER2_C = ((4, 2), (3, 6))
LAYER2_D = ((4, 2), (3, 10))
LAYER2_LOW = ((4, 4), (3, 7), (2, 19))


def _layer2_widths(head: Header) -> list[int]:
    each = head.kbits // (1 if head.mono else 2)
    if head.version > 1:
        table = LAYER2_LOW
    elif each < 56:
        table = LAYER2_D if head.rate == 32000 else LAYER2_C
    else:
        table = LAYER2_A if head.rate == 48000 or each <= 80 else LAYER2_B
    return [width for width, n in table for _ in range(n)]


def covered_bits(head: Header, body: bytes) -> int:
    """Bits behind the checksum that it covers, in a frame of Layer I or II: allocations, and in Layer II the selectors too."""
    channels = 1 if head.mono else 2
    widths = [4] * 32 if head.layer == 1 else _layer2_widths(head)
    bound = min(4 * head.joint + 4, len(widths)) if head.joint >= 0 else len(widths)
    bits = selectors = 0
    whole = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    for k, width in enumerate(widths):
        for _ in range(channels if k < bound else 1):
            used = whole >> (512 - bits - width) & ((1 << width) - 1)
            bits += width
            selectors += 2 * (channels if k >= bound else 1) * bool(used)
    return bits + (selectors if head.layer == 2 else 0)


_HEADERS: dict[bytes, Header | None] = {}


def parse_header(four: bytes) -> Header | None:
    """None where the bytes are no header with a known length (free format has none)."""
    if four in _HEADERS:
        return _HEADERS[four]
    out = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version = {3: 1, 2: 2, 0: 3}.get(four[1] >> 3 & 3)
        layer = {3: 1, 2: 2, 1: 3}.get(four[1] >> 1 & 3)
        index, rate_index = four[2] >> 4, four[2] >> 2 & 3
        if version and layer and 0 < index < 15 and rate_index < 3 and four[3] & 3 != 2:
            if version == 1:
                kbits = (LAYER1_V1_KBITS, LAYER2_V1_KBITS, LAYER3_V1_KBITS)[layer - 1][index]
            else:
                kbits = (LAYER1_V2_KBITS if layer == 1 else LAYER3_V2_KBITS)[index]
            rate = RATES_V1[rate_index] >> (version - 1)
            samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
            pad = four[2] >> 1 & 1
            length = (samples // 32 * kbits * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // rate + pad
            out = Header(version, layer, not four[1] & 1, kbits, rate, four[3] >> 6 == 3, length, samples, four[3] >> 4 & 3 if four[3] >> 6 == 1 else -1)
    if len(_HEADERS) < 100_000:
        _HEADERS[four] = out
    return out


def _frame_header(kbits: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, LAYER3_V1_KBITS.index(kbits) << 4 | RATES_V1.index(RATE) << 2, 0xC0))


#: Frame length by bitrate, at this rate without padding slots.
SIZES = {k: 144 * k * 1000 // RATE for k in LAYER3_V1_KBITS[1:]}
LARGEST = LAYER3_V1_KBITS[-1]
_LEADS = {k: (h := _frame_header(k, True)) + int(crc16(np.frombuffer(h[2:] + bytes(MONO_SIDE), np.uint8)[None])[0]).to_bytes(2, "big") + bytes(MONO_SIDE) for k in SIZES}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write_stream(payload: bytes) -> bytes:
    room = SIZES[LARGEST] - OVERHEAD
    full, rest = divmod(len(payload), room)
    frames = np.zeros((full, SIZES[LARGEST]), np.uint8)
    frames[:, :OVERHEAD] = np.frombuffer(_LEADS[LARGEST], np.uint8)
    frames[:, OVERHEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    lengths, audio = [SIZES[LARGEST]] * full, frames.tobytes()
    if rest or not full:
        kbits = next(k for k in SIZES if SIZES[k] - OVERHEAD >= rest)
        audio += (_LEADS[kbits] + payload[full * room :]).ljust(SIZES[kbits], b"\0")
        lengths.append(SIZES[kbits])
    info_size = SIZES[64]
    total = info_size + len(audio)
    starts = np.cumsum([info_size, *lengths])[:-1]
    toc = starts[np.arange(100) * len(lengths) // 100] * 256 // total
    info = _frame_header(64, False) + bytes(MONO_SIDE) + b"Xing" + struct.pack(">III", 7, len(lengths), total) + toc.astype(np.uint8).tobytes()
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + _syncsafe(len(private)) + b"\0\0" + private
    return b"ID3\4\0\0" + _syncsafe(len(tag)) + tag + info.ljust(info_size, b"\0") + audio


@dataclass
class Stream:
    tags: dict[str, bytes] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of audio frames
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    skipped: int = 0  # bytes outside tags and frames
    checksums: int = 0
    bad_checksums: int = 0
    delay: int = 0  # samples ahead of the sound and behind it, if the encoder says so
    padding: int = 0
    table: str | None = None  # Xing, Info or VBRI
    table_frames: int | None = None  # what the variable-bitrate table says
    table_bytes: int | None = None
    toc: bytes | None = None
    seek_points: list[tuple[int, int]] = field(default_factory=list)  # of a VBRI table: frames ahead, and byte offset
    table_at: int | None = None
    audio_bytes: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    @property
    def sounding(self) -> int:
        """Samples without the encoder's delay and padding."""
        return max(0, self.samples - self.delay - self.padding)


def _tag_said(data: bytes, at: int) -> int:
    """The size that a tag at a place gives itself; 0 if there is none or it ends outside the data."""
    size = 0
    if data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128 and 255 not in data[at + 3 : at + 5]:
        for b in data[at + 6 : at + 10]:
            size = size << 7 | b
        size += 10 + 10 * bool(data[at + 5] & 16)
    elif data[at : at + 3] == b"TAG" and len(data) == at + 128:
        size = 128
    elif data[at : at + 8] == b"APETAGEX" and len(data) >= at + 32:
        size = struct.unpack_from("<I", data, at + 12)[0] + 32
    return size if at + size <= len(data) else 0


def _tag_size(data: bytes, at: int) -> int:
    """The size of a tag at a place, if the end, another tag or a frame follows it."""
    size = _tag_said(data, at)
    end = at + size
    while size and data[end : end + 1] == b"\0" and not at:  # the first tag may be padded
        end += 1
    return end - at if size and (end == len(data) or _tag_said(data, end) or parse_header(data[end : end + 4])) else 0


def _tag_frames(tag: bytes) -> dict[str, bytes]:
    out, at, end, version = {}, 10, len(tag), tag[3]
    while at + 10 <= end and tag[at : at + 4].isalnum():
        raw = tag[at + 4 : at + 8]
        size = int.from_bytes(raw, "big") if version < 4 else sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0)))
        name = tag[at : at + 4].decode("ascii")
        body = tag[at + 10 : at + 10 + size]
        if name == "PRIV":
            owner, _, body = body.partition(b"\0")
            name += ":" + owner.decode("latin-1")
        out[name] = body
        at += 10 + size
    return out


def _synced(data: bytes, at: int, seen: Header | None) -> Header | None:
    """The header at a place, if another of its kind, a tag or the end follows its frame."""
    head = parse_header(data[at : at + 4])
    if head is None or at + head.length > len(data) or seen and (head.version, head.layer, head.rate) != (seen.version, seen.layer, seen.rate):
        return None
    end = at + head.length
    if end == len(data) or _tag_size(data, end):
        return head
    then = parse_header(data[end : end + 4])
    return head if then and (then.version, then.layer, then.rate) == (head.version, head.layer, head.rate) else None


def parse_stream(data: bytes) -> Stream:
    out, at, n, head, broken = Stream(), 0, len(data), None, True
    protected: dict[int, list[int]] = {}
    while at < n:
        size = _tag_size(data, at)
        if size:
            if data[at : at + 3] == b"ID3":
                out.tags |= _tag_frames(data[at : at + size])
            at += size
            continue
        # After a good frame a plain header will do; out of step, the next frame must agree too.
        now = _synced(data, at, head) if broken else parse_header(data[at : at + 4])
        if now is None or at + now.length > n or head and (now.version, now.layer, now.rate) != (head.version, head.layer, head.rate):
            broken = True
            found = data.find(b"\xff", at + 1)
            tag = min((x for x in (data.find(b"TAG", at + 1), data.find(b"ID3", at + 1)) if x >= 0), default=n) if found < 0 else n
            step = min(n if found < 0 else found, tag)
            out.skipped += step - at
            at = step
            continue
        broken = False
        first, head = head is None, now
        lead = at + 4 + now.side
        if first and now.layer == 3 and data[lead : lead + 4] in (b"Xing", b"Info"):
            out.table = data[lead : lead + 4].decode()
            flags, lead = struct.unpack_from(">I", data, lead + 4)[0], lead + 8
            out.table_at = at
            for bit, width in ((1, 4), (2, 4), (4, 100), (8, 4)):
                if flags & bit:
                    value = data[lead : lead + width]
                    if bit == 1:
                        out.table_frames = int.from_bytes(value, "big")
                    elif bit == 2:
                        out.table_bytes = int.from_bytes(value, "big")
                    elif bit == 4:
                        out.toc = value
                    lead += width
            if data[lead : lead + 4] in (b"LAME", b"Lavc", b"Lavf") and lead + 24 <= at + now.length:
                both = int.from_bytes(data[lead + 21 : lead + 24], "big")
                out.delay, out.padding = both >> 12, both & 0xFFF
        elif first and now.layer == 3 and data[at + 36 : at + 40] == b"VBRI" and now.length >= 62:
            out.table, out.table_at = "VBRI", at
            _, out.delay, _, out.table_bytes, out.table_frames, entries, scale, width, step = struct.unpack_from(">HHHIIHHHH", data, at + 40)
            raw = data[at + 62 : min(at + 62 + entries * width, at + now.length)]
            if 0 < width <= 4 and len(raw) == entries * width:
                sizes = [int.from_bytes(raw[k : k + width], "big") * scale for k in range(0, len(raw), width)]
                out.seek_points = [(k * step, at + int(x)) for k, x in enumerate(np.cumsum([now.length, *sizes])[:-1])]
        else:
            if now.protected and now.layer == 3:
                protected.setdefault(now.side, []).append(at)
            elif now.protected:
                bits = covered_bits(now, data[at + 6 : at + now.length])
                good = crc16_bits(data[at + 6 : at + now.length], bits, crc16_bits(data[at + 2 : at + 4], 16)) == int.from_bytes(data[at + 4 : at + 6], "big")
                out.checksums += 1
                out.bad_checksums += not good
            out.offsets.append(at)
            out.headers.append(now)
            out.samples += now.samples
        out.rate = now.rate
        out.audio_bytes += now.length
        at += now.length
    raw = np.frombuffer(data, np.uint8)
    for side, places in protected.items():
        where = np.array(places)[:, None]
        covered = np.concatenate([raw[where + np.arange(2, 4)], raw[where + np.arange(6, 6 + side)]], axis=1)
        stored = raw[where[:, 0] + 4].astype(np.uint32) << 8 | raw[where[:, 0] + 5]
        out.checksums += len(places)
        out.bad_checksums += int((crc16(covered) != stored).sum())
    return out


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The bytes that ``write_stream`` stored; raises ValueError if they don't have its checksum."""
    if "PRIV:payload" not in stream.tags:
        raise ValueError("the stream has no payload tag")
    length, checksum = struct.unpack(">QI", stream.tags["PRIV:payload"])
    parts = [data[at + 4 + 2 * h.protected + h.side : at + h.length] for at, h in zip(stream.offsets, stream.headers)]
    payload = b"".join(parts)[:length]
    if len(payload) != length or zlib.crc32(payload) != checksum or stream.bad_checksums:
        raise ValueError("the stream is damaged")
    return payload


def toc_fits(stream: Stream) -> bool:
    """Whether each seek-table entry names the place of its hundredth of the frames."""
    if stream.toc is None or stream.table_at is None or not stream.offsets:
        return False
    places = (np.array(stream.offsets, np.int64)[np.arange(100) * len(stream.offsets) // 100] - stream.table_at) * 256 // stream.table_bytes
    return bool((places.astype(np.uint8) == np.frombuffer(stream.toc, np.uint8)).all())


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate int, duration_s double, seek_offsets array<long>"


def store_and_read(doc_id: int | None, text: bytes) -> tuple:
    media = write_stream(padded(text))
    stream = parse_stream(media)
    payload = read_payload(media, stream)
    table = "fits" if stream.table_frames == len(stream.offsets) and stream.table_bytes == stream.audio_bytes and toc_fits(stream) else "differs"
    feature = f"mpeg1-layer3 frames={len(stream.offsets)} samples={stream.samples} rate={stream.rate} crc={stream.checksums - stream.bad_checksums}/{stream.checksums} vbr={table} seek={zlib.crc32(np.array(stream.offsets, '<i8').tobytes()):08x}"
    return (doc_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(stream.offsets), stream.samples, stream.rate, stream.seconds, stream.offsets)


def audio_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its text stored as an audio stream, read back and measured."""
    from pyspark.sql import functions as F

    return row_map(docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("payload")), SCHEMA, store_and_read, ["doc_id", "payload"])
