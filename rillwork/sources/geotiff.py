"""GeoTIFF: a reader and a writer of single-band rasters, with the parts of TIFF that terrain models use.

Reads little- and big-endian files, strips and tiles, 8 to 64 bit integers and floats, no compression, LZW or deflate, predictors 1 to
3, and the scale, tiepoint and nodata tags. A raster is read in row bands, one row of the result per band, so a large file is many tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NODATA, Grid, Raster

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


@dataclass(frozen=True)
class Header:
    order: str
    height: int
    width: int
    dtype: np.dtype
    compression: int
    predictor: int
    chunk: tuple[int, int]  #: rows and columns of a strip or tile
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    cell: tuple[float, float]
    origin: tuple[float, float]
    nodata: float | None

    def grid(self, crs: str = "", unit: float = 1.0) -> Grid:
        a, e = self.cell
        if abs(a - e) > 0.03 * abs(a):
            raise ValueError(f"pixels must be square within 3 %: {a} by {e}")
        return Grid(self.height, self.width, a, self.origin[0], self.origin[1], crs, unit)


def read_header(data: bytes) -> Header:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("this is no TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple | str] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = _SIZES.get(kind, 1) * count
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind == 2:
            tags[tag] = data[place : place + count].split(b"\0")[0].decode("ascii", "replace")
        elif kind in _CODES:
            tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place)
    one = lambda tag, default: tags[tag][0] if tag in tags else default
    if one(277, 1) != 1 and one(284, 1) != 2:
        raise ValueError("only single-band rasters are read")
    form = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    height, width = one(257, 0), one(256, 0)
    tiled = 322 in tags
    chunk = (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height), width)
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = float(tags[42113]) if 42113 in tags and tags[42113].strip() else None
    return Header(order, height, width, np.dtype(f"{order}{form}{one(258, 8) // 8}"), one(259, 1), one(317, 1), chunk, tags[324 if tiled else 273], tags[325 if tiled else 279], (scale[0], scale[1]), (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), nodata)


def lzw_decode(data: bytes) -> bytes:
    """The LZW of TIFF: codes from the high bit, 9 to 12 bits wide, 256 clears, 257 ends."""
    out, table, width, bits, held, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> bits - 8 & 255)
            bits -= 8
            held &= (1 << bits) - 1

    table, width, prefix = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    size = 258
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = size
        size += 1
        if size == 4094:
            put(256, width)
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _chunk(data: bytes, h: Header, k: int) -> np.ndarray:
    raw = data[h.offsets[k] : h.offsets[k] + h.counts[k]]
    if h.compression == 5:
        raw = lzw_decode(raw)
    elif h.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif h.compression != 1:
        raise ValueError(f"compression {h.compression} isn't supported")
    rows, cols = h.chunk
    if 2 * len(h.offsets) and cols == h.width:
        rows = min(rows, h.height - k * h.chunk[0])
    if h.predictor == 3:
        b = np.cumsum(np.frombuffer(raw, np.uint8, rows * cols * h.dtype.itemsize).reshape(rows, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(b.reshape(rows, h.dtype.itemsize, cols).transpose(0, 2, 1)).view(h.dtype.newbyteorder(">")).reshape(rows, cols)
    x = np.frombuffer(raw, h.dtype, rows * cols).reshape(rows, cols)
    if h.predictor == 2:
        x = np.cumsum(x, axis=1, dtype=h.dtype.newbyteorder("="))
    return x


def read_array(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Rows first to last - 1 as doubles; nodata and NaN are NaN."""
    h = read_header(data)
    last = h.height if last is None else min(last, h.height)
    rows, cols = h.chunk
    across = -(-h.width // cols)
    out = np.empty((max(0, last - first), h.width))
    for k in range(first // rows * across, min(len(h.offsets), -(-last // rows) * across)):
        r, c = k // across * rows, k % across * cols
        part = _chunk(data, h, k)[: h.height - r, : h.width - c]
        a, b = max(r, first), min(r + len(part), last)
        out[a - first : b - first, c : c + part.shape[1]] = part[a - r : b - r]
    if h.nodata is not None:
        out[out == h.nodata] = np.nan
    return out


def write_bytes(z: np.ndarray, grid: Grid, dtype: str = "float32", nodata: float = NODATA, compression: str = "lzw") -> bytes:
    """A GeoTIFF with one strip per 64 rows; NaN becomes ``nodata``."""
    code = {"none": 1, "lzw": 5, "deflate": 8}[compression]
    kind = np.dtype(dtype).newbyteorder("<")
    values = np.where(np.isnan(z), nodata, z).astype(kind)
    pack = {1: lambda x: x, 5: lzw_encode, 8: zlib.compress}[code]
    strips = [pack(values[r : r + 64].tobytes()) for r in range(0, len(values), 64)]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags = [
        (256, 4, [grid.width]), (257, 4, [grid.height]), (258, 3, [kind.itemsize * 8]), (259, 3, [code]), (262, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 4, [64]),
        (279, 4, [len(s) for s in strips]), (339, 3, [sample]), (33550, 12, [grid.cell, grid.cell, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0]), (42113, 2, f"{nodata:g}\0".encode()),
    ]
    directory, extra = at + (at & 1), b""
    base = directory + 2 + 12 * len(tags) + 4
    body = struct.pack("<H", len(tags))
    for tag, t, v in tags:
        raw = v if t == 2 else struct.pack(f"<{len(v)}{_CODES[t]}", *v)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place = struct.pack("<I", base + len(extra))
            extra += raw + b"\0" * (len(raw) & 1)
        body += struct.pack("<HHI", tag, t, len(v)) + place
    return b"II*\0" + struct.pack("<I", directory) + b"".join(strips) + b"\0" * (at & 1) + body + struct.pack("<I", 0) + extra


def scan(spark: SparkSession, path: str, rows_a_task: int = 1024, crs: str = "", unit: float = 1.0) -> Raster:
    """The raster of a file as cells (row, col, value). The header is read on the driver, the bands of rows in tasks."""
    files = spark.read.format("binaryFile").load(path)
    header = read_header(files.select("content").first()[0])
    bands = spark.range(-(-header.height // rows_a_task)).select((F.col("id") * rows_a_task).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z = read_array(content, first, first + rows_a_task)
                row, col = np.repeat(np.arange(len(z)) + first, z.shape[1]), np.tile(np.arange(z.shape[1]), len(z))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(z.ravel(), mask=np.isnan(z.ravel()))], names=["row", "col", "value"])

    cells = files.select("content").crossJoin(bands).repartition("first").mapInArrow(decode, "row long, col long, value double")
    return Raster(header.grid(crs, unit), cells)


def export(raster: Raster, dtype: str = "float32", nodata: float = NODATA, compression: str = "lzw") -> bytes:
    """The bytes of a GeoTIFF. A file is one piece: the cells of the raster come to the driver, so this is for maps to be looked at."""
    got = raster.cells.select("row", "col", F.col("value").cast("double").alias("value")).toArrow()
    z = np.full((raster.grid.height, raster.grid.width), np.nan)
    z[got["row"].to_numpy(), got["col"].to_numpy()] = got["value"].to_numpy()
    return write_bytes(z, raster.grid, dtype, nodata, compression)
