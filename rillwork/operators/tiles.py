"""Global fixpoints on rasters, tile by tile.

Each tile is solved on its own from what its neighbours' borders say, and then tells them its own border; the rounds go on until no
border changes. A round moves one strip of cells a tile side; the rounds follow the number of tiles that a path crosses, not
its cells. The result doesn't depend on the size of the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Grid
from .graph import cut

#: kernel(inputs [k, h, w], state [s, h, w], halo [s, h + 2, w + 2], row and column of its first cell) -> new state. The halo is NaN where
#: nothing is known, and inside.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], np.ndarray]

_ROW = "kind string, tr long, tc long, dr int, dc int, inputs binary, state binary, changed boolean"


def fixpoint(cells: DataFrame, grid: Grid, inputs: Sequence[str], states: Sequence[str], start: Kernel, kernel: Kernel, size: int = 512) -> DataFrame:
    """(row, col, one column per state) after the last round. NULL is NaN inside; ``start`` gives the first state."""
    height, width, k, s = grid.height, grid.width, len(inputs), len(states)

    def shape(tr: int, tc: int) -> tuple[int, int]:
        return min(size, height - tr * size), min(size, width - tc * size)

    def load(table: pa.Table) -> pa.Table:
        tr, tc = table["tr"][0].as_py(), table["tc"][0].as_py()
        h, w = shape(tr, tc)
        data = np.full((k, h, w), np.nan)
        at = table["row"].to_numpy() - tr * size, table["col"].to_numpy() - tc * size
        for i, name in enumerate(inputs):
            data[i][at] = table[name].to_numpy(zero_copy_only=False)
        none = np.full((s, h, w), np.nan)
        state = start(data, none, np.full((s, h + 2, w + 2), np.nan), tr * size, tc * size)
        return _rows(tr, tc, data, state, None, height, width, size)

    def step(tile: pa.Table, strips: pa.Table) -> pa.Table:
        if not tile.num_rows:
            return tile.select([n.split()[0] for n in _ROW.split(", ")]).slice(0, 0)
        tr, tc = tile["tr"][0].as_py(), tile["tc"][0].as_py()
        h, w = shape(tr, tc)
        data = np.frombuffer(tile["inputs"][0].as_py()).reshape(k, h, w)
        old = np.frombuffer(tile["state"][0].as_py()).reshape(s, h, w)
        halo = np.full((s, h + 2, w + 2), np.nan)
        for dr, dc, blob in zip(strips["dr"].to_pylist(), strips["dc"].to_pylist(), strips["state"].to_pylist()):
            where = (slice(None), *(slice(1, n + 1) if d == 0 else slice(0, 1) if d < 0 else slice(n + 1, n + 2) for d, n in ((dr, h), (dc, w))))
            halo[where] = np.frombuffer(blob).reshape(halo[where].shape)
        new = kernel(data, old, halo, tr * size, tc * size) if strips.num_rows else old
        return _rows(tr, tc, data, new, old, height, width, size)

    number = [F.col(c).cast("double").alias(c) for c in inputs]
    placed = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *number)
    placed = placed.withColumns({"tr": F.floor(F.col("row") / size).cast("long"), "tc": F.floor(F.col("col") / size).cast("long")})
    rows = cut(placed.groupBy("tr", "tc").applyInArrow(load, _ROW))
    while not rows.where("kind = 'strip' AND changed").isEmpty():
        tile, strips = rows.where("kind = 'tile'"), rows.where("kind = 'strip'")
        rows = cut(tile.groupBy("tr", "tc").cogroup(strips.groupBy("tr", "tc")).applyInArrow(step, _ROW))

    def unload(batches):
        for b in batches:
            for x in b.to_pylist():
                h, w = shape(x["tr"], x["tc"])
                state = np.frombuffer(x["state"]).reshape(s, -1)
                r = np.repeat(np.arange(h), w) + x["tr"] * size
                c = np.tile(np.arange(w), h) + x["tc"] * size
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), *(pa.array(v, mask=np.isnan(v)) for v in state)], names=["row", "col", *states])

    return rows.where("kind = 'tile'").select("tr", "tc", "state").mapInArrow(unload, ", ".join(["row long, col long", *(f"`{n}` double" for n in states)]))


def _rows(tr: int, tc: int, data: np.ndarray, state: np.ndarray, old: np.ndarray | None, height: int, width: int, size: int) -> pa.Table:
    state = np.ascontiguousarray(state, dtype=np.float64)
    out = {"kind": ["tile"], "tr": [tr], "tc": [tc], "dr": [0], "dc": [0], "inputs": [data.tobytes()], "state": [state.tobytes()], "changed": [False]}
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            r, c = tr + dr, tc + dc
            if (dr or dc) and 0 <= r and r * size < height and 0 <= c and c * size < width:
                side = (slice(None), slice(None) if dr == 0 else slice(0, 1) if dr < 0 else slice(-1, None), slice(None) if dc == 0 else slice(0, 1) if dc < 0 else slice(-1, None))
                strip = np.ascontiguousarray(state[side])
                # the neighbour sees this tile on the opposite side
                for name, x in zip(out, ("strip", r, c, -dr, -dc, None, strip.tobytes(), old is None or not np.array_equal(strip, old[side], equal_nan=True))):
                    out[name].append(x)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
    return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})


def padded(inner: np.ndarray, halo: np.ndarray) -> np.ndarray:
    """One state with its halo around it."""
    out = halo.copy()
    out[1:-1, 1:-1] = inner
    return out


NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
