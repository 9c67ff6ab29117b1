"""Shapefiles: points, lines and polygons with their dBASE attributes, read and written without a library."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT, LINE, POLYGON = 1, 3, 5


def read_shapes(data: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(record number from 0, parts of vertices); a null shape has no part."""
    if struct.unpack_from(">i", data, 0)[0] != 9994:
        raise ValueError("this is no shapefile")
    at, k = 100, 0
    while at + 8 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0] % 10
        body = at + 12
        if kind == POINT:
            yield k, [[struct.unpack_from("<2d", data, body)]]
        elif kind in (LINE, POLYGON):
            parts, points = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 40), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, body + 40 + 4 * parts)
            xy = list(zip(flat[::2], flat[1::2]))
            yield k, [xy[a:b] for a, b in zip(starts, starts[1:])]
        else:
            yield k, []
        at, k = at + 8 + 2 * words, k + 1


def read_attributes(data: bytes, encoding: str = "utf-8") -> tuple[list[str], list[list]]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    for at in range(32, head - 1, 32):
        if data[at] == 13:
            break
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), chr(data[at + 11]), data[at + 16], data[at + 17]))
    rows = []
    for k in range(n):
        at, row = head + k * size + 1, []
        for _, kind, width, decimals in fields:
            text = data[at : at + width].decode(encoding, "replace").strip("\0 ")
            at += width
            row.append(text if kind not in "NF" else None if not text or "*" in text else float(text) if decimals or "." in text or "e" in text.lower() else int(text))
        rows.append(row)
    return [f[0] for f in fields], rows


def write_shapes(kind: int, shapes: list[list[list[tuple[float, float]]]]) -> bytes:
    every = [p for s in shapes for part in s for p in part] or [(0.0, 0.0)]
    box = min(x for x, _ in every), min(y for _, y in every), max(x for x, _ in every), max(y for _, y in every)
    records = b""
    for k, shape in enumerate(shapes):
        if kind == POINT:
            body = struct.pack("<i2d", kind, *shape[0][0])
        else:
            flat = [p for part in shape for p in part]
            starts = [sum(len(q) for q in shape[:i]) for i in range(len(shape))]
            own = min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat)
            body = struct.pack("<i4d2i", kind, *own, len(shape), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        records += struct.pack(">2i", k + 1, len(body) // 2) + body
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, kind, *box, 0, 0, 0, 0) + records


def write_attributes(names: list[str], rows: list[list]) -> bytes:
    widths = [max([1, *(len(str(r[i] or "").encode()) for r in rows)]) for i in range(len(names))]
    if long := [n for n, w in zip(names, widths) if w > 254]:
        raise ValueError(f"texts of more than 254 bytes don't fit into the format: {long}")
    head = b"".join(n[:10].encode().ljust(11, b"\0") + b"N\0\0\0\0" + bytes([24, 6]) + b"\0" * 14 if all(isinstance(r[i], (int, float, type(None))) for r in rows) else n[:10].encode().ljust(11, b"\0") + b"C\0\0\0\0" + bytes([widths[i], 0]) + b"\0" * 14 for i, n in enumerate(names))
    number = [all(isinstance(r[i], (int, float, type(None))) for r in rows) for i in range(len(names))]
    body = b"".join(b" " + b"".join((b"" if v is None else f"{v:.6f}".encode()).rjust(24) if number[i] else str(v or "").encode().ljust(widths[i]) for i, v in enumerate(r)) for r in rows)
    return struct.pack("<4BIHH20x", 3, 120, 1, 1, len(rows), 32 + len(head) + 1, 1 + sum(24 if x else w for x, w in zip(number, widths))) + head + b"\r" + body + b"\x1a"


def scan(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(path_id, part, seq, x, y) of the features of a .shp file; only those whose box touches ``box`` (x low, y low, x high, y high)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                for k, parts in read_shapes(content):
                    xy = [p for part in parts for p in part]
                    if not xy or box and (max(x for x, _ in xy) < box[0] or min(x for x, _ in xy) > box[2] or max(y for _, y in xy) < box[1] or min(y for _, y in xy) > box[3]):
                        continue
                    rows = [(k, i, j, x, y) for i, part in enumerate(parts) for j, (x, y) in enumerate(part)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path_id", "part", "seq", "x", "y"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(decode, "path_id long, part long, seq long, x double, y double")


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """The attributes of a .dbf file, with path_id."""
    names, rows = read_attributes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    table = pa.table({"path_id": list(range(len(rows))), **{n: [r[i] for r in rows] for i, n in enumerate(names)}})
    return spark.createDataFrame(table)


def export_lines(vertices: DataFrame) -> tuple[bytes, bytes]:
    """(.shp, .dbf) of lines (path_id, seq, x, y); a layer to be looked at: it comes to the driver."""
    rows = vertices.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("g")).where(F.size("g") >= 2).orderBy("path_id").collect()
    return write_shapes(LINE, [[[(p["x"], p["y"]) for p in r["g"]]] for r in rows]), write_attributes(["HYDROID"], [[r["path_id"]] for r in rows])
