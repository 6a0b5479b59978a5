"""MPEG audio as a container of bytes, and a reader of MPEG audio streams.

The writer stores 576 payload bytes a frame: MPEG-1 Layer III, one channel, 48 kHz, 224 kbit/s, with a checksum. Side
information is all zero (silence), so the payload rides in the frame's ancillary bytes and a player hears nothing. In
front stand an ID3v2 tag and a frame with a variable-bitrate (Xing) table.

The reader takes any bytes: it skips ID3v2 and ID3v1 tags, finds frame headers again after damage (a header counts if
another follows at its frame's end, or the stream ends there), reads the variable-bitrate table, verifies checksums, and
yields exact durations (samples over rate) and the byte offset of every frame.

Edge cases: a null text is empty and is stored as one frame of padding; repeated texts give equal files; bytes without
any frame give zero frames; texts of any length are stored whole.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import schema_of, slices, table, texts

BLOCK = 576  # payload bytes of a frame; also the samples of a granule

# Fixed values of the format: kbit/s by (MPEG-1 or not, layer) and index, samples a second of MPEG-1 by index.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def _crc_table() -> list[int]:
    made = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (0x8005 if crc & 0x8000 else 0)
        made.append(crc & 0xFFFF)
    return made


CRC_TABLE = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, all ones at the start."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    samples: int
    size: int
    side: int  # bytes of side information (Layer III)


@lru_cache(4096)
def header_of(four: bytes) -> Header | None:
    """What four bytes say as a frame header; None if they are none, or of a free or reserved kind."""
    if len(four) < 4:
        return None
    bits = int.from_bytes(four)
    version, layer, rate = bits >> 19 & 3, 4 - (bits >> 17 & 3), bits >> 10 & 3
    index, padding, mono = bits >> 12 & 15, bits >> 9 & 1, (bits >> 6 & 3) == 3
    if bits >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    first = version == 3
    kbps, hertz = KBPS[first, layer][index], RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    size = (12_000 * kbps // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + padding
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(layer, not bits >> 16 & 1, kbps, hertz, 1 if mono else 2, samples, size, side)


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of audio frames, for seeking
    headers: list[Header] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    checked: int = 0
    damaged: int = 0  # checksums that do not agree
    skipped: int = 0  # bytes that belong to no frame or tag
    tags: list[tuple[str, str]] = field(default_factory=list)
    table: dict = field(default_factory=dict)  # of a variable-bitrate header: frames, bytes, toc


def _id3v2(data: bytes, at: int) -> tuple[int, list[tuple[str, str]]]:
    """Bytes of the tag at `at` (0: none) and its text frames."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return 0, []
    synch = lambda four: four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]
    size, major, p, found = 10 + synch(data[at + 6 : at + 10]), data[at + 3], at + 10, []
    while p + 10 <= min(at + size, len(data)) and data[p] and major in (3, 4):
        raw = data[p + 4 : p + 8]
        n = synch(raw) if major == 4 else int.from_bytes(raw)
        if data[p : p + 1] == b"T" and n:
            body, codec = data[p + 10 : p + 10 + n], ("latin-1", "utf-16", "utf-16-be", "utf-8")
            found.append((data[p : p + 4].decode("latin-1"), body[1:].decode(codec[body[0] & 3], "replace").strip("\0")))
        p += 10 + n
    return size + (10 if data[at + 5] & 16 else 0), found


def _table(frame: bytes, header: Header) -> dict:
    """The Xing/Info or VBRI table of a frame, or nothing."""
    p = 4 + 2 * header.protected + header.side
    if frame[p : p + 4] in (b"Xing", b"Info") and len(frame) >= p + 8:
        flags, p, found = int.from_bytes(frame[p + 4 : p + 8]), p + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name], p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 4:
            found["toc"] = frame[p : p + 100]
        return found or {"frames": None}
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        return {"bytes": int.from_bytes(frame[46:50]), "frames": int.from_bytes(frame[50:54])}
    return {}


def parse(data: bytes) -> Stream:
    """Tags, table, frames and durations of a stream, resynchronising where it is damaged."""
    out, at, end, synced = Stream(), 0, len(data), False
    # an ID3v1 tag counts only where reading comes to its begin: bytes of a frame that reaches the end are none
    last = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    ticks: dict[int, int] = {}
    while at < end:
        if at == last:
            out.tags.insert(0, ("TIT1", data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")))
            break
        header = header_of(data[at : at + 4])
        after = at + header.size if header else 0
        if header and (after <= last or after == end) and (synced or after in (last, end) or header_of(data[after : after + 4]) or data[after : after + 3] == b"ID3"):
            guard = 4 + 2 * header.protected
            if not out.offsets and not out.table and header.layer == 3 and (found := _table(data[at:after], header)):
                out.table = found
            else:
                out.offsets.append(at)
                out.headers.append(header)
                ticks[header.rate] = ticks.get(header.rate, 0) + header.samples
            if header.protected and header.layer == 3:
                out.checked += 1
                out.damaged += crc16(data[at + 2 : at + 4] + data[at + guard : at + guard + header.side]) != int.from_bytes(data[at + 4 : at + 6])
            at, synced = after, True
            continue
        tag, frames = _id3v2(data, at)
        if tag:
            out.tags += frames
            at += tag
            continue
        synced = False
        later = data.find(b"\xff", at + 1, end)
        tagged = data.find(b"ID3", at + 1, end if later < 0 else later)
        jump = tagged if tagged >= 0 else later if later >= 0 else end
        jump = min(jump, last) if at < last else jump
        out.skipped += jump - at
        at = jump
    out.duration = sum((Fraction(n, rate) for rate, n in ticks.items()), Fraction(0))
    return out


HEAD = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | 0 << 16 | 12 << 12 | 1 << 10 | 3 << 6)
FRAME = header_of(HEAD)
LEAD = 6 + FRAME.side  # header, checksum, side information
FIXED = HEAD + struct.pack(">H", crc16(HEAD[2:] + bytes(FRAME.side))) + bytes(FRAME.side)


def payload_of(text: bytes) -> bytes:
    """`text` with bytes 255 behind it up to a positive multiple of BLOCK."""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def write(payload: bytes) -> bytes:
    """`payload`, a multiple of BLOCK bytes, as a stream."""
    title = b"\3lawframe payload"
    text_frame = b"TIT2" + struct.pack(">IH", len(title), 0) + title
    tag = b"ID3\4\0\0" + bytes(len(text_frame) >> s & 127 for s in (21, 14, 7, 0)) + text_frame
    blocks = range(0, len(payload), BLOCK)
    toc = bytes(256 * i // 100 for i in range(100))
    info = FIXED + b"Xing" + struct.pack(">III", 7, len(blocks), FRAME.size * (len(blocks) + 1)) + toc
    rest = bytes(FRAME.size - LEAD - BLOCK)
    frames = [piece for at in blocks for piece in (FIXED, payload[at : at + BLOCK], rest)]
    return b"".join([tag, info.ljust(FRAME.size, b"\0"), *frames])


def read(data: bytes) -> tuple[bytes, Stream]:
    """The payload of a written stream, from its frames as the reader finds them."""
    found = parse(data)
    return b"".join(data[at + LEAD : at + LEAD + BLOCK] for at in found.offsets), found


def store_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload (read back), seconds, offsets, table_frames, checked, damaged, skipped."""
    schema = schema_of(docs, ["doc_id"], "n_bytes long, media binary, payload binary, seconds double, offsets array<long>, table_frames long, checked long, damaged long, skipped long")

    def scan(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                media = write(payload_of(text))
                payload, s = read(media)
                rows.append((len(text), media, payload, float(s.duration), s.offsets, s.table.get("frames"), s.checked, s.damaged, s.skipped))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], schema.names)

    return texts(docs, "doc_id").mapInArrow(scan, schema)


def op10_audio(spark, sf_dir: str) -> DataFrame:
    """Digests of `store_audio`."""
    shown = [
        F.concat(F.lit(name + "="), F.coalesce(value.cast("string"), F.lit("-")))
        for name, value in (
            ("frames", F.size("offsets")), ("table", F.col("table_frames")), ("seconds", F.col("seconds")), ("checked", F.col("checked")),
            ("damaged", F.col("damaged")), ("skipped", F.col("skipped")), ("first", F.col("offsets")[0]), ("last", F.element_at("offsets", -1)),
            ("seek_crc32", F.crc32(F.array_join(F.col("offsets").cast("array<string>"), ","))),
        )
    ]
    return store_audio(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", *shown).alias("feature"),
    )
