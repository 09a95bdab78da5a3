"""MPEG audio as a media column: writing byte payloads into frames, and reading any MPEG-1/2/2.5 audio stream back.

``store_audio`` puts a payload into the ancillary data of silent, checksummed MPEG-1 Layer III frames (mono, 32 kHz,
variable bit rate, an ID3v2 tag with the exact payload length and a Xing frame with frame count, byte count and seek
table). ``read_audio`` parses a stream from its bytes alone. It reads ID3v2 and ID3v1 tags, and finds frames by their sync
pattern: four bytes are a header only if another header of the same stream (version, layer, rate, protection, mono or
not), a tag or the end follows where the frame ends, and after damage only if two more do. A frame that can't be confirmed
that way, because what follows it is damaged, counts if the frame before it ended right there and its checksum, where that
is read, holds. Variable-bitrate tables (Xing or Info with their flags, VBRI) are checked against the
frames: count, bytes and each seek entry. Samples are exact, less the encoder's delay and padding where an Info tag names
them.

Not read: free-format streams (no frame size in the header), and checksums of Layers I and II, which cover bits whose
length depends on the bit allocation; their frames are found and counted, ``crc_checked`` stays 0.

Defined results: null text is the empty payload (64 zero bytes after padding); null media gives null features; bytes that
belong to no frame are skipped and counted; a frame whose checksum fails is skipped as a whole if another frame follows
it, else like any other damage; equal payloads give equal media; a stream without frames has no rate and 0 samples. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import table
from orrery.llm.token_counts import chunks

# Fixed values of the MPEG audio standard: kbit/s by (version group, layer), sample rates by version, samples a frame.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

RATE, SIDE = 32_000, 17
#: Frame bytes at 32 kHz by bit rate index 1..14, and what a frame carries besides header, checksum and side information.
SIZES = tuple(144_000 * k // RATE for k in BITRATES[1, 3])
OVERHEAD = 4 + 2 + SIDE


def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return tuple(out)


CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ CRC[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    channels: int
    side: int

    @property
    def stream(self) -> tuple[int, int, int, bool, int]:
        return self.version, self.layer, self.rate, self.protected, self.channels


@lru_cache(maxsize=4096)
def parse_header(raw: bytes) -> Header | None:
    """The frame header in four bytes, or None if they are none (free format counts as none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    bits, rates, mode = raw[2] >> 4, raw[2] >> 2 & 3, raw[3] >> 6
    if version == 1 or layer == 4 or bits in (0, 15) or rates == 3:
        return None
    group = 1 if version == 3 else 2
    kbps, rate = BITRATES[group, min(layer, 2) if group == 2 else layer][bits - 1], RATES[version][rates]
    samples, pad = SAMPLES[group, layer], raw[2] >> 1 & 1
    size = (12_000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    channels = 1 if mode == 3 else 2
    side = 0 if layer != 3 else {(1, 1): 17, (1, 2): 32, (2, 1): 9, (2, 2): 17}[group, channels]
    return Header(version, layer, not raw[1] & 1, kbps, rate, size, samples, channels, side)


@lru_cache(maxsize=64)
def _start(index: int) -> bytes:
    """Header, checksum and silent side information of a frame with this bit rate index."""
    head, side = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0)), bytes(SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """The payload as a tagged variable-bit-rate stream."""
    room = SIZES[-1] - OVERHEAD
    body, sizes = [], []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        index = next(i for i, s in enumerate(SIZES, 1) if s - OVERHEAD >= len(part))
        body.append(_start(index) + part + bytes(SIZES[index - 1] - OVERHEAD - len(part)))
        sizes.append(SIZES[index - 1])
    total = SIZES[0] + sum(sizes)
    toc = bytes(min(255, 256 * (SIZES[0] + (len(sizes) * i // 100) * SIZES[-1]) // total) for i in range(100))
    info = b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    first = _start(1) + info + bytes(SIZES[0] - OVERHEAD - len(info))
    text = b"\x00payload_bytes\x00%d" % len(payload)
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\x00\x00" + text
    return b"".join((b"ID3\x03\x00\x00", _syncsafe(len(frame)), frame, first, *body))


@dataclass
class Table:
    """A variable-bitrate table. ``seek`` holds (share of the frames, share of the bytes, width of an entry) or byte offsets by frame."""

    kind: str
    frames: int | None = None
    size: int | None = None
    toc: bytes | None = None
    steps: tuple[int, ...] = ()  # VBRI: bytes of each group of ``every`` frames
    every: int = 0
    delay: int = 0
    padding: int = 0


@dataclass
class Stream:
    header: Header | None = None
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    audio_bytes: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    table: Table | None = None
    table_ok: bool | None = None
    payload: bytes = b""


def _tags(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag at ``at`` and the offset after it."""
    end = at + 10 + sum(b << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
    out, p = {}, at + 10
    while p + 10 <= end and data[p : p + 1].isalnum():
        n = int.from_bytes(data[p + 4 : p + 8], "big") if data[at + 3] < 4 else sum(b << s for b, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0), strict=True))
        name, value = data[p : p + 4].decode("latin-1"), data[p + 11 : p + 10 + n].decode("latin-1")
        if name == "TXXX":
            name, _, value = value.partition("\x00")
        if name[:1]:
            out[name] = value
        p += 10 + n
    return out, min(end, len(data))


def _is_tag(data: bytes, at: int) -> bool:
    """Whether a whole ID3v2 head or the ID3v1 tag at the end stands here."""
    if data[at : at + 3] == b"ID3":
        return at + 10 <= len(data) and max(data[at + 6 : at + 10]) < 0x80
    return data[at : at + 3] == b"TAG" and at + 128 == len(data)


def _table(data: bytes, at: int, h: Header) -> Table | None:
    """The variable-bitrate table in the frame at ``at``, if it has one."""
    end, p = at + h.size, at + 4 + 2 * h.protected + h.side
    number = lambda at, n=4: int.from_bytes(data[at : at + n], "big")
    if data[p : p + 4] in (b"Xing", b"Info"):
        t, flags, q = Table(data[p : p + 4].decode()), number(p + 4), p + 8
        if flags & 1:
            t.frames, q = number(q), q + 4
        if flags & 2:
            t.size, q = number(q), q + 4
        if flags & 4:
            t.toc, q = data[q : q + 100], q + 100
        q += 4 * bool(flags & 8)
        if q + 24 <= end and data[q : q + 4].isalnum():  # the encoder's name; delay and padding are 12 bits each
            both = number(q + 21, 3)
            t.delay, t.padding = both >> 12, both & 0xFFF
        return t
    p = at + 4 + 32  # at this place whatever the side information
    if h.layer == 3 and data[p : p + 4] == b"VBRI":
        count, scale, width, every = (number(p + i, 2) for i in (18, 20, 22, 24))
        steps = tuple(scale * number(p + 26 + i * width, width) for i in range(count)) if width and p + 26 + count * width <= end else ()
        return Table("VBRI", number(p + 14), number(p + 10), steps=steps, every=every)
    return None


def _table_fits(t: Table, s: Stream, first: int) -> bool:
    """Whether count, bytes and seek entries of a table agree with the frames that were read; ``first`` is where its own frame starts."""
    if t.frames is not None and t.frames != len(s.offsets) or t.size is not None and t.size != s.audio_bytes:
        return False
    if t.toc is not None and s.offsets:
        # entry i: the 256th part of the stream where the frame at i percent starts; encoders round either way
        total = t.size or s.audio_bytes
        for i, entry in enumerate(t.toc):
            where = 256 * (s.offsets[min(len(s.offsets) - 1, len(s.offsets) * i // 100)] - first) / total
            if abs(entry - min(255, where)) > 1 + 256 * s.header.size / total:
                return False
    if t.steps and t.every:
        at = s.offsets[0] if s.offsets else 0
        for i, step in enumerate(t.steps):
            end = (i + 1) * t.every
            at += step
            if end < len(s.offsets) and at != s.offsets[end]:
                return False
    return True


def _follows(data: bytes, at: int, h: Header, times: int) -> bool:
    """Whether ``times`` headers of the stream follow the frame of ``h`` at ``at``; a tag or the end of the data confirms at once."""
    for _ in range(times):
        at += h.size
        if at == len(data) or _is_tag(data, at):
            return True
        after = parse_header(data[at : at + 4])
        if after is None or after.stream != h.stream:
            return False
        if at + after.size > len(data):  # cut short at the end
            return True
        h = after
    return True


def _checksum_holds(data: bytes, at: int, h: Header) -> bool:
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")


def read_stream(data: bytes) -> Stream:
    """Parse a whole stream; see the module's text for what counts as a frame."""
    s, at, parts, first, lost = Stream(), 0, [], 0, True
    while at < len(data):
        if data[at : at + 3] == b"ID3" and _is_tag(data, at):
            found, at = _tags(data, at)
            s.tags |= found
            continue
        if data[at : at + 3] == b"TAG" and _is_tag(data, at):
            s.tags.setdefault("TIT2", data[at + 3 : at + 33].rstrip(b"\x00 ").decode("latin-1"))
            break
        h = parse_header(data[at : at + 4])
        there = h is not None and at + h.size <= len(data) and (s.header is None or h.stream == s.header.stream)
        # in step with the frame before, one header has to follow, else two
        sure = there and _follows(data, at, h, 2 if lost else 1)
        checks = there and h.protected and h.layer == 3
        holds = checks and _checksum_holds(data, at, h)
        if there and not sure and not lost:
            sure = holds if checks else True
        if sure and checks:
            s.checked += 1
            s.failed += not holds
        if not sure:  # resynchronise at the next possible sync byte
            step = data.find(b"\xff", at + 1)
            step = len(data) if step < 0 else step
            s.skipped, at, lost = s.skipped + step - at, step, True
            continue
        end, lost = at + h.size, False
        if checks and not holds:  # its size is confirmed by what follows, its content is not
            s.skipped, at = s.skipped + h.size, end
            continue
        s.audio_bytes += h.size
        table = _table(data, at, h) if s.header is None else None
        if table:
            s.table, first = table, at
        else:
            s.offsets.append(at)
            s.samples += h.samples
            parts.append(data[at + 4 + 2 * h.protected + h.side : end])
        s.header, at = s.header or h, end
    if s.table:
        s.table_ok = _table_fits(s.table, s, first)
        s.samples = max(0, s.samples - s.table.delay - s.table.padding)
    s.payload = b"".join(parts)
    if s.tags.get("payload_bytes", "").isdigit():
        s.payload = s.payload[: int(s.tags["payload_bytes"])]
    return s


MEDIA_FIELDS = [("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("samples", pa.int64()), ("duration_s", pa.float64()), ("seek_offsets", pa.list_(pa.int64())), ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("skipped_bytes", pa.int64()), ("vbr_table_ok", pa.bool_()), ("payload", pa.binary())]
READ_DDL = "rate int, channels int, frames long, samples long, duration_s double, seek_offsets array<long>, crc_checked long, crc_failed long, skipped_bytes long, vbr_table_ok boolean, payload binary"


def store_audio(rows: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(key, n_bytes, media): each payload, padded with zero bytes to a positive multiple of 64, as an audio stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, 1):
                sizes, media = [], []
                for value in b.column(1):
                    raw = value.as_py() or b""
                    sizes.append(len(raw))
                    media.append(write_stream(raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    narrow = rows.select(key, payload)
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_audio(rows: DataFrame, digest_only: bool = False) -> DataFrame:
    """``rows`` (with a binary column ``media``) and what its streams hold.

    ``digest_only`` gives digests and a feature string in place of the payload and the seek offsets themselves.
    """
    names = [c for c in rows.columns if c != "media"]
    own = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name != "media"]
    ddl = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string" if digest_only else READ_DDL

    def full(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(MEDIA_FIELDS)
        s = read_stream(media)
        h = s.header
        return (h and h.rate, h and h.channels, len(s.offsets), s.samples, s.samples / h.rate if h else 0.0, s.offsets, s.checked, s.failed, s.skipped, s.table_ok, s.payload)

    def digest(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        s = read_stream(media)
        seeks = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.offsets))
        h = s.header
        feature = f"rate={h and h.rate};frames={len(s.offsets)};samples={s.samples};crc_failed={s.failed}/{s.checked};skipped={s.skipped};table={s.table_ok};seek_crc32={seeks}"
        return len(media), hashlib.sha256(media).hexdigest(), len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), feature

    types = [t for _, t in MEDIA_FIELDS] if not digest_only else [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, whole.schema.get_field_index("media")):
                out = [(digest if digest_only else full)(m.as_py()) for m in b.column("media")]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *cols], [*names, *(c.split()[0] for c in ddl.split(", "))])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in own), ddl]))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as audio media, read back."""
    docs = table(spark, sf_dir, "documents")
    payloads = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    return read_audio(store_audio(payloads), digest_only=True)


QUERIES = {"op7_media_columns": op7_media_columns}
SQL: dict[str, str] = {}
