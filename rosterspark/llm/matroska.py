"""Media columns in Matroska form: bytes stored as 8-bit sound, parsed back into tables of packets."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING_FLAG, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose children are read, at the level they stand on.
PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements that end a segment's or cluster's child of unknown size.
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Samples a second, samples in a frame, frames in a block, blocks in a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 8
UNIT = 64


def varint(value: int, width: int | None = None) -> bytes:
    """A size of 1 to 8 bytes; a leading bit tells how many. All ones is kept for "unknown"."""
    if width is None:
        width = next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_varint(data, at: int) -> tuple[int | None, int]:
    """(value, next place); None for "unknown"."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"size cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def read_id(data, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at] >> 4:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + width], "big"), at + width


def element(kind: int, *content: bytes) -> bytes:
    body = b"".join(content)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + varint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(kind: int, value: float) -> bytes:
    return element(kind, struct.pack(">d", value))


def lace(frames: list[bytes], kind: str) -> bytes:
    """Frames of one block with their sizes in front, all but the last one's."""
    sizes = [len(f) for f in frames]
    if kind == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == "ebml" and len(frames) > 1:
        head += varint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += varint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def unlace(data, at: int, end: int, kind: str) -> list[tuple[int, int]]:
    """(start, length) of the frames of a block's content."""
    if kind == "none":
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == "fixed":
        if (end - at) % count:
            raise ValueError("frames of a fixed lace differ")
        sizes = [(end - at) // count] * (count - 1)
    elif kind == "xiph":
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif count > 1:
        size, at = read_varint(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            step, at = read_varint(data, at)
            width = at - before
            step = (1 << 7 * width) - 1 if step is None else step
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames of a lace overrun their block")
    starts = [at + sum(sizes[:i]) for i in range(count)]
    return list(zip(starts, sizes, strict=True))


def mux(payload: bytes, *, rate: int = RATE, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """One mono track of unsigned 8-bit samples. Full blocks have fixed lacing, a shorter last frame EBML lacing."""
    scale = 1_000_000  # timestamps count milliseconds
    head = element(EBML, element(DOC_TYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, scale), real(DURATION, len(payload) * 1000 / rate), element(MUXER, b"media column"), element(WRITER, b"media column"))
    sound = element(AUDIO, real(SAMPLING, rate), number(CHANNELS, 1), number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), number(LACING_FLAG, 1), number(DEFAULT_DURATION, frame * 10**9 // rate), element(CODEC, b"A_PCM/INT/LIT"), sound)
    body = [info, element(TRACKS, track)]
    at, cues = sum(map(len, body)), []
    step = frame * laced
    for start in range(0, len(payload), step * blocks):
        time = start * 1000 // rate
        inside = [number(CLUSTER_TIME, time)]
        for begin in range(start, min(len(payload), start + step * blocks), step):
            frames = [payload[i : i + frame] for i in range(begin, min(len(payload), begin + step), frame)]
            kind = "none" if len(frames) == 1 else "fixed" if len({len(f) for f in frames}) == 1 else "ebml"
            flags = 0x80 | LACINGS.index(kind) << 1
            inside.append(element(SIMPLE_BLOCK, varint(1) + struct.pack(">hB", begin * 1000 // rate - time, flags), lace(frames, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, time), element(CUE_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, *inside))
        at += len(body[-1])
    return head + element(SEGMENT, *body, element(CUES, *cues))


@dataclass
class Media:
    """What a file holds: tracks (number, type, codec, rate, ns a frame), packets and cues (ns, track, place of cluster)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, first byte, length, keyframe, lacing, place of the cluster)
    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def demux(data: bytes) -> Media:
    """Walk the elements of a file. Unknown ones are stepped over; unknown sizes of segments and clusters are allowed."""
    media, waiting, size = Media(), [], len(data)
    kind, at = read_id(data, 0)
    if kind != EBML:
        raise ValueError("not an EBML file")
    length, at = read_varint(data, at)
    at += length or 0
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    entry: dict = {}
    cue: dict = {}
    cluster = [0, 0]  # place, timestamp
    segment = 0
    stack: list[tuple[int, int | None]] = []  # open parents and their ends

    def close() -> None:
        kind, _ = stack.pop()
        if kind == TRACK_ENTRY:
            media.tracks[entry.get("number", 0)] = dict(entry)
        elif kind == CUE_POSITIONS:
            media.cues.append((cue.get("time", 0), cue.get("track", 0), cue.get("cluster", 0)))
        elif kind == BLOCK_GROUP and group:
            block(group["at"], group["end"], not group.get("reference"))

    def block(a: int, b: int, key: bool | None) -> None:
        track, a = read_varint(data, a)
        relative, flags = struct.unpack_from(">hB", data, a)
        waiting.append((track, cluster[1] + relative, unlace(data, a + 3, b, LACINGS[flags >> 1 & 3]), bool(flags & 0x80) if key is None else key, LACINGS[flags >> 1 & 3], cluster[0]))

    group: dict = {}
    while at < size:
        while stack and stack[-1][1] is not None and at >= stack[-1][1]:
            close()
        here = at
        kind, at = read_id(data, at)
        length, at = read_varint(data, at)
        while stack and stack[-1][1] is None and stack[-1][0] == CLUSTER and kind in TOP_LEVEL:
            close()
        if length is None and kind not in (SEGMENT, CLUSTER):
            raise ValueError(f"unknown size of element {kind:x}")
        end = None if length is None else at + length
        if end is not None and end > size:
            raise ValueError(f"element {kind:x} is cut off")
        if kind in PARENTS:
            stack.append((kind, end))
            if kind == SEGMENT:
                segment = at
            elif kind == CLUSTER:
                cluster[:] = [here - segment, 0]
            elif kind == TRACK_ENTRY:
                entry = {}
            elif kind == BLOCK_GROUP:
                group = {}
            elif kind == CUE_POINT:
                cue = {}
            continue
        if kind == TIMESTAMP_SCALE:
            media.scale = uint(at, end)
        elif kind in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            entry[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns"}[kind]] = uint(at, end)
        elif kind == CODEC:
            entry["codec"] = data[at:end].decode("ascii", "replace")
        elif kind == SAMPLING:
            entry["rate"] = struct.unpack(">f" if length == 4 else ">d", data[at:end])[0]
        elif kind == CLUSTER_TIME:
            cluster[1] = uint(at, end)
        elif kind == SIMPLE_BLOCK:
            block(at, end, None)
        elif kind == BLOCK:
            group |= {"at": at, "end": end}
        elif kind == REFERENCE:
            group["reference"] = True
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}[kind]] = uint(at, end)
        at = end
    while stack:
        close()
    media.cues = [(t * media.scale, track, place) for t, track, place in media.cues]
    for track, time, frames, key, lacing, place in waiting:
        each = media.tracks.get(track, {}).get("frame_ns", 0)
        media.packets += [(track, time * media.scale + i * each, start, length, key, lacing, place) for i, (start, length) in enumerate(frames)]
    return media


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, and how many bytes there were."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_media(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media: the text's bytes, padded with zeros to a positive multiple of 64, as sound.

    A map over the rows. Null or empty text: 64 zeros. Null and repeated ids keep their rows. Empty table: no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            some = [padded(t) for t in batch.column(1).to_pylist()]
            for at in range(0, len(some), 500):
                part = some[at : at + 500]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([n for _, n in part], pa.int64()), pa.array([mux(p) for p, _ in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "id long, nth long, track long, timestamp_ns long, first_byte long, length long, keyframe boolean, lacing string, cluster_place long, cued boolean"


def packet_table(media: DataFrame, *, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """A row per packet: its track, timestamp, byte range, lacing, its cluster's place in the segment, and whether a cue points there.

    Null media have no packets; media that can't be read have one row with track -1. Rows count on their own, repeated or not.
    Empty table: no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in PACKETS.split(", ")]
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    found = demux(data)
                    cued = {place for _, _, place in found.cues}
                    rows = [(key, i, *p, p[-1] in cued) for i, p in enumerate(found.packets)]
                except (ValueError, IndexError, struct.error):
                    rows = [(key, 0, -1, None, None, None, None, None, None, None)]
                if rows:
                    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(media_column)).mapInArrow(run, PACKETS)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame, *, media_column: str = "media") -> DataFrame:
    """The rows without the media, but with what reading them back gives: the payload's size and checksums, and a summary of packets.

    ``feature``: counts of packets, clusters, cues and lacings, the end in ms, and a checksum of the packet table. Null
    media: null features; media that can't be read: their size and checksum, ``unreadable``, and nulls for the payload. Rows count
    on their own, repeated or not. Empty table: no rows.
    """
    rest = [c for c in media.columns if c != media_column]
    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in rest), FEATURES])

    def one(data: bytes | None) -> tuple:
        import hashlib
        import zlib
        from collections import Counter

        if data is None:
            return (None,) * 6
        try:
            found = demux(data)
        except (ValueError, IndexError, struct.error):
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), "unreadable"
        payload = b"".join([data[p[2] : p[2] + p[3]] for p in found.packets])
        lacings = Counter(p[5] for p in found.packets)
        rate = next((t.get("rate", 0) for t in found.tracks.values()), 0)
        last = found.packets[-1] if found.packets else (0, 0, 0, 0)
        table = zlib.crc32(repr(found.packets).encode())
        feature = f"packets={len(found.packets)};clusters={len({p[6] for p in found.packets})};cues={len(found.cues)};" + ";".join(f"{k}={lacings[k]}" for k in LACINGS)
        feature += f";end_ms={(last[1] // 10**6 + last[3] * 1000 // int(rate)) if rate else 0};table={table:08x}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            columns = zip(*[one(m) for m in batch.column(len(rest)).to_pylist()], strict=True) if batch.num_rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*rest, *(f.split()[0] for f in FEATURES.split(", "))])

    return media.select(*rest, media_column).mapInArrow(run, schema)
