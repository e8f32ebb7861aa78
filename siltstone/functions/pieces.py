"""Pieces of Arrow batches, so that what a worker makes of a batch is bounded by bytes and not by the batch's rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive spans (from, to) of rows that together have ``most`` bytes at most and 1000 rows, or of one row."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = int(np.clip(np.searchsorted(ends, before + most, "right"), at + 1, at + 1000))
        yield at, min(to, len(sizes))
        at = to
