"""Matroska: packet tables from a column of media bytes, and a small writer.

Files are read with no library: variable-length EBML elements, clusters of known and unknown size, simple blocks and block
groups, the four kinds of lacing, and cues. Each file is parsed in one task; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, tidy

EBML, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, KIND, CODEC, DEFAULT_DURATION = 0xD7, 0x83, 0x86, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: What may follow a cluster or segment of unknown size.
LEVEL_1 = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


class Malformed(ValueError):
    pass


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(element id with its marker bit, the place after it)."""
    if at >= end:
        raise Malformed(f"no element id at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > end:
        raise Malformed(f"bad element id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """(value of a variable-length integer, the place after it); None for the reserved all-ones value: unknown."""
    if at >= end or not data[at]:
        raise Malformed(f"bad length at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Malformed(f"cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of content, end of content, size known) of the elements from ``at``; unknown sizes reach to ``end``."""
    while at < end:
        kind, body = read_id(data, at, end)
        size, body = read_size(data, body, end)
        stop = end if size is None else body + size
        if stop > end:
            raise Malformed(f"element {kind:x} at {at} reaches beyond {end}")
        yield kind, body, stop, size is not None
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


@dataclass
class Track:
    number: int
    kind: int = 0
    codec: str = ""
    default_duration: int | None = None


@dataclass
class Packet:
    track: int
    lace: int  #: place in its block
    timestamp_ns: int
    duration_ns: int | None
    keyframe: bool
    offset: int
    size: int
    cluster: int  #: byte of the cluster's first element byte
    time: int  #: the block's time in units of the time scale
    cued: bool = False


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  #: (time, track, byte of the cluster)
    error: str | None = None


def frame_ranges(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose content after the flags is data[at:end]."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise Malformed(f"no lace count at {at}")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise Malformed(f"{end - at} bytes can't be {n} equal frames")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while True:
                    if at >= end:
                        raise Malformed("cut off in a lace size")
                    size, at = size + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            else:
                start = at
                size, at = read_size(data, at, end)
                if size is None:
                    size = (1 << 7 * (at - start)) - 1
                if k:
                    size += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("lace sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(media: Media, data: bytes, a: int, b: int, cluster: int, time: int, simple: bool, duration: int | None = None, reference: bool = False) -> None:
    number, at = read_size(data, a, b)
    if number is None or at + 3 > b:
        raise Malformed(f"bad block at {a}")
    relative, flags = struct.unpack_from(">hB", data, at)
    track = media.tracks.get(number, Track(number))
    key = bool(flags & 0x80) if simple else not reference
    frames = frame_ranges(data, at + 3, b, flags >> 1 & 3)
    step = track.default_duration
    if step is None and duration is not None:
        step = duration * media.scale // len(frames)
    for k, (offset, size) in enumerate(frames):
        start = (time + relative) * media.scale + k * (step or 0)
        media.packets.append(Packet(number, k, start, step if len(frames) > 1 or duration is None else duration * media.scale, key, offset, size, cluster, time + relative))


def _cluster(media: Media, data: bytes, cluster: int, a: int, b: int, known: bool) -> int:
    """Reads a cluster; returns where it ends."""
    at, time = a, 0
    while at < b:
        kind, body = read_id(data, at, b)
        if not known and kind in LEVEL_1:
            return at
        size, body = read_size(data, body, b)
        stop = body + (b - body if size is None else size)
        if stop > b:
            raise Malformed(f"element {kind:x} at {at} reaches beyond {b}")
        if kind == TIME:
            time = _number(data, body, stop)
        elif kind == SIMPLE:
            _block(media, data, body, stop, cluster, time, True)
        elif kind == GROUP:
            block, duration, reference = None, None, False
            for inner, x, y, _ in elements(data, body, stop):
                if inner == BLOCK:
                    block = x, y
                elif inner == DURATION:
                    duration = _number(data, x, y)
                elif inner == REFERENCE:
                    reference = True
            if block:
                _block(media, data, *block, cluster, time, False, duration, reference)
        at = stop
    return at


def _segment(media: Media, data: bytes, base: int, end: int) -> None:
    at = base
    while at < end:
        kind, body = read_id(data, at, end)
        size, body = read_size(data, body, end)
        stop = end if size is None else min(end, body + size)
        cut_off = size is not None and body + size > end
        if kind == CLUSTER:
            stop = _cluster(media, data, at, body, stop, size is not None)
        elif kind == INFO:
            for inner, x, y, _ in elements(data, body, stop):
                if inner == SCALE:
                    media.scale = _number(data, x, y)
        elif kind == TRACKS:
            for inner, x, y, _ in elements(data, body, stop):
                if inner == ENTRY:
                    track = Track(0)
                    for leaf, p, q, _ in elements(data, x, y):
                        if leaf == NUMBER:
                            track.number = _number(data, p, q)
                        elif leaf == KIND:
                            track.kind = _number(data, p, q)
                        elif leaf == CODEC:
                            track.codec = data[p:q].rstrip(b"\0").decode("ascii", "replace")
                        elif leaf == DEFAULT_DURATION:
                            track.default_duration = _number(data, p, q)
                    media.tracks[track.number] = track
        elif kind == CUES:
            for inner, x, y, _ in elements(data, body, stop):
                if inner == POINT:
                    time, places = 0, []
                    for leaf, p, q, _ in elements(data, x, y):
                        if leaf == CUE_TIME:
                            time = _number(data, p, q)
                        elif leaf == POSITIONS:
                            found = {k: _number(data, s, t) for k, s, t, _ in elements(data, p, q) if k in (CUE_TRACK, CUE_CLUSTER)}
                            places.append((found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))
                    media.cues += [(time, track, cluster) for track, cluster in places]
        if cut_off:
            raise Malformed(f"element {kind:x} at {at} reaches beyond {end}")
        at = stop


def parse(data: bytes) -> Media:
    """What can be read; ``error`` says why reading stopped before the end. What was read before stays."""
    media = Media()
    try:
        at, end, first = 0, len(data), True
        while at < end:
            kind, body = read_id(data, at, end)
            size, body = read_size(data, body, end)
            stop = end if size is None else body + size
            if first and kind != EBML:
                raise Malformed("no EBML header")
            first = False
            if kind == SEGMENT:
                _segment(media, data, body, min(stop, end))
            if stop > end:
                raise Malformed(f"element {kind:x} at {at} reaches beyond {end}")
            at = stop
    except Malformed as e:
        media.error = str(e)
    cued = set(media.cues)
    for p in media.packets:
        p.cued = p.lace == 0 and (p.time, p.track, p.cluster) in cued
    return media


_PACKETS = "track long, codec string, packet long, lace int, timestamp_ns long, duration_ns long, keyframe boolean, cued boolean, cluster_offset long, offset long, size long, md5 string, error string"


def packet_table(df: DataFrame, media: str = "media", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per packet: (key, track, codec, packet, lace, timestamp_ns, duration_ns, keyframe, cued, cluster_offset, offset, size,
    md5, error); ``packet`` counts within its track, offset and size are the packet's bytes within the file, cued packets can be
    sought by the cues.

    Only the columns ``media`` (binary) and ``key`` are read, whatever else there is. A null file gives no row. A file that is
    empty, cut off or no Matroska gives the packets before the fault and one row without a track whose ``error`` tells it.
    Null and repeated keys are carried as they are. An empty table gives no row. md5 of the payload is given if ``digest``.
    """
    df = bounded_batches(tidy(df, [key, media])).select(key, media)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = b.column(0), []
            for i, data in enumerate(b.column(1)):
                if not data.is_valid:
                    continue
                data = data.as_buffer().to_pybytes()
                found = parse(data)
                if not data:
                    found.error = "the file is empty"
                counts: dict[int, int] = {}
                for p in found.packets:
                    n = counts[p.track] = counts.get(p.track, -1) + 1
                    codec = found.tracks[p.track].codec if p.track in found.tracks else None
                    md5 = hashlib.md5(data[p.offset : p.offset + p.size], usedforsecurity=False).hexdigest() if digest else None
                    rows.append((i, p.track, codec, n, p.lace, p.timestamp_ns, p.duration_ns, p.keyframe, p.cued, p.cluster, p.offset, p.size, md5, None))
                if found.error:
                    rows.append((i, *[None] * 12, found.error))
                if len(rows) > 50_000:
                    yield _batch(keys, rows, key)
                    rows = []
            if rows:
                yield _batch(keys, rows, key)

    return df.mapInArrow(run, f"`{key}` {kind}, {_PACKETS}")


def _batch(keys: pa.Array, rows: list[tuple], key: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    at, *columns = zip(*rows)
    names = [x.split()[0] for x in _PACKETS.split(", ")]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, *names])


# --- Writing


def size_bytes(n: int, length: int | None = None) -> bytes:
    """A variable-length integer; the all-ones value of a length is reserved, so the next length is taken then."""
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(content)) + content


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block_content(track: int, relative: int, frames: list[bytes], lacing: int, keyframe: bool = True) -> bytes:
    head = size_bytes(track) + struct.pack(">hB", relative, (0x80 if keyframe else 0) | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            k = next(k for k in range(1, 9) if abs(d) <= (1 << 7 * k - 1) - 2)
            head += size_bytes(d + (1 << 7 * k - 1) - 1, k)
    return head + b"".join(frames)


def text_movie(text: str, per_cluster: int = 32, group: int = 4) -> bytes:
    """A file with two tracks, one second per line: track 1 has the lines, track 2 their lengths in bytes as 8 digits. Lines come in
    groups whose lacing goes in turns: block groups of one line each, Xiph, EBML; track 2 has fixed lacing. Each cluster has a cue."""
    lines = [x.encode("utf-8", "surrogatepass") for x in text.split("\n")]
    second = 1000
    tracks = element(TRACKS, b"".join(element(ENTRY, number(NUMBER, n) + number(0x73C5, n) + number(KIND, 0x11) + element(CODEC, c) + number(DEFAULT_DURATION, 10**9)) for n, c in ((1, b"S_TEXT/UTF8"), (2, b"S_TEXT/ASCII"))))
    body = element(INFO, number(SCALE, 10**6)) + tracks
    cues, parts, at = [], [body], len(body)
    for c in range(0, len(lines), per_cluster):
        content = [number(TIME, c * second)]
        for g in range(c, min(c + per_cluster, len(lines)), group):
            frames = lines[g : g + group]
            turn = g // group % 3
            if turn == 0 or len(frames) == 1:
                content += [element(GROUP, element(BLOCK, block_content(1, (g + k - c) * second, [f], NO_LACING)) + number(DURATION, second)) for k, f in enumerate(frames)]
            else:
                content.append(element(SIMPLE, block_content(1, (g - c) * second, frames, XIPH if turn == 1 else EBML_LACING)))
            content.append(element(SIMPLE, block_content(2, (g - c) * second, [b"%08d" % len(f) for f in frames], FIXED)))
        cluster = element(CLUSTER, b"".join(content))
        cues.append(element(POINT, number(CUE_TIME, c * second) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return head + element(SEGMENT, b"".join(parts))


def with_text_movies(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with a column of Matroska files made of its texts (null of null): media to read where a table has none."""

    @F.pandas_udf("binary")
    def write(texts):
        return texts.map(lambda t: None if t is None else text_movie(t))

    df = bounded_batches(tidy(df, [text]))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != media.lower()], write(F.col(text)).alias(media))


MOVIE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
)
SELECT doc_id, CAST(1 AS BIGINT) AS track, i AS packet, i * 1000000000 AS timestamp_ns, CAST(strlen(line) AS BIGINT) AS size, md5(line) AS md5, i % 32 = 0 AS cued FROM lines
UNION ALL
SELECT doc_id, 2, i, i * 1000000000, 8, md5(lpad(CAST(strlen(line) AS VARCHAR), 8, '0')), false FROM lines
"""
