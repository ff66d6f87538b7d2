"""Columns of nested series as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lists(values: object, depth: int) -> pa.Array:
    """A column of (nested) lists of numbers from Arrow or from Python objects."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values
    kind = pa.float64()
    for _ in range(depth):
        kind = pa.list_(kind)
    plain = lambda v: v if v is None or isinstance(v, (list, np.ndarray)) else list(v)
    try:
        return pa.array([plain(v) if depth == 1 or v is None else [plain(x) for x in v] for v in values], kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError) as wrong:
        raise ValueError("series must hold numbers") from wrong


class Channels:
    """A column of series as flat values: ``size`` and ``start`` of every (row, channel), size -1 where there is none.
    One-dimensional series have one channel."""

    def __init__(self, column: pa.Array, multi: bool = True) -> None:
        if multi:
            self.counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            channels = column.flatten()
        else:
            self.counts, channels = np.ones(len(column), np.int64), column
        rows = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        sizes = pc.fill_null(pc.list_value_length(channels), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.maximum(sizes, 0)
        self.values = channels.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.channels = int(self.counts.max(initial=0))
        self.size = np.full((len(self.counts), self.channels), -1, np.int64)
        self.start = np.zeros((len(self.counts), self.channels), np.int64)
        self.size[rows, at], self.start[rows, at] = sizes, np.cumsum(held) - held

    def whole(self) -> np.ndarray:
        """Whether a row has channels, each with entries, and no entry is missing."""
        gaps = np.concatenate([[0], np.cumsum(np.isnan(self.values))])
        there = np.arange(self.channels) < self.counts[:, None]
        broken = (self.size < 1) | (gaps[self.start + np.maximum(self.size, 0)] != gaps[self.start])
        return (self.counts > 0) & ~(broken & there).any(1)

    def dense(self, rows: np.ndarray, channels: int, length: int, first: np.ndarray | int = 0, empty: float = np.nan) -> np.ndarray:
        """(rows, channels, length) of some rows from their channel ``first`` on, ``empty`` where there is no entry. The rows
        lie next to each other in memory."""
        if channels == self.channels == 1 and length and len(self.size) and (self.size == length).all():  # the usual case
            return np.ascontiguousarray(self.values.reshape(-1, length)[rows].T)[:, None].transpose(2, 1, 0)
        which = np.broadcast_to(np.asarray(first), rows.shape)[None] + np.arange(channels)[:, None]
        size, start = self.size[rows[None], which], self.start[rows[None], which]
        at = np.arange(length)[:, None, None]
        held = at < size[None]
        out = np.full(held.shape, empty)
        out[held] = self.values[(start[None] + at)[held]]
        return out.transpose(2, 1, 0)
