"""Arrow helpers for streams of rows that are sorted by a key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def run_starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """True where a row's key differs from the row before it; ``before`` is the key of the row before the first, if there is one.
    Nulls are equal to each other."""
    n = len(columns[0])
    starts = np.zeros(n, dtype=bool)
    if n:
        starts[0] = before is None or before != tuple(c[0].as_py() for c in columns)
        for c in columns:
            here, there = c.slice(1), c.slice(0, n - 1)
            other = pc.or_(pc.fill_null(pc.not_equal(here, there), False), pc.xor(here.is_null(), there.is_null()))
            starts[1:] |= other.to_numpy(zero_copy_only=False)
    return starts


def last_key(columns: list[pa.Array]) -> tuple:
    return tuple(c[len(c) - 1].as_py() for c in columns)
