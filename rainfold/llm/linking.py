"""Links inside groups of rows, without listing all pairs of a group.

Rows arrive dealt and sorted by their group; a group is bounded by its
operator (large ones are cut into blocks, and each pair of blocks is a group
of its own).  Inside a group the links are found exactly, tile by tile, and
only a spanning forest of them is emitted: at most one edge per linked row
and tile, whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TILE = 1024


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, begins): tables of whole groups and where the groups begin (one
    entry more than groups).  Input is sorted by ``keys`` (integers); a group
    cut by a batch border is carried over."""
    carried: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if carried is not None:
            rows = pa.concat_tables([carried, rows]).combine_chunks()
        begins = _begins(rows, keys)
        last = int(begins[-1])
        carried = rows.slice(last)
        if last:
            yield rows.slice(0, last), begins
    if carried is not None and carried.num_rows:
        yield carried, np.array([0, carried.num_rows])


def _begins(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for k in keys:
        v = rows.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def forest(mask: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """Spanning forest of the links in ``mask``: edges (row, column) that join
    exactly what the links join.  ``square``: rows and columns are the same
    nodes (a symmetric mask), else two sets."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return []
    m = mask[np.ix_(rows, cols)]
    edges = []
    if square:
        left = np.ones(len(rows), bool)
        while left.any():
            start = int(np.argmax(left))
            left[start] = False
            stack = [start]
            while stack:
                k = stack.pop()
                new = np.flatnonzero(m[k] & left)
                left[new] = False
                edges += [(int(rows[k]), int(cols[j])) for j in new]
                stack += new.tolist()
                if not left.any():
                    break
        return edges
    left_r, left_c = np.ones(len(rows), bool), np.ones(len(cols), bool)
    while left_r.any():
        start = int(np.argmax(left_r))
        left_r[start] = False
        stack = [(0, start)]
        while stack:
            side, k = stack.pop()
            if side == 0:
                new = np.flatnonzero(m[k] & left_c)
                left_c[new] = False
                edges += [(int(rows[k]), int(cols[j])) for j in new]
                stack += [(1, int(j)) for j in new]
            else:
                new = np.flatnonzero(m[:, k] & left_r)
                left_r[new] = False
                edges += [(int(rows[i]), int(cols[k])) for i in new]
                stack += [(0, int(i)) for i in new]
    return edges
