"""Filling missing values from similar records: nearest-neighbour hot deck.

Records are hash-blocked on their observed mixed features: file and number of channels, and within these
label, subject and length. Every block is ordered along Hilbert curves of time and projected shapes of the
series (gaps drawn straight, scaled by the deviations of the file); a record looks for donors among the ``window`` records on
either side of it in every ordering of its blocks, across the borders of partitions too. The distance adds
differences of label, subject, time and length to that of the shapes. All orderings are range-partitioned
together, so that no hot file, subject or label loads one task; the work grows with the records, not with
their pairs. A block of at most ``window`` records is thus searched whole. Records for which the windows don't give ``k``
donors to every missing cell (a channel that is hardly ever observed) are compared with all records of the
file, in slices and parts of bounded size. Only features and the numbers of missing cells travel; the
values are fetched from the chosen donors.

A missing entry becomes the weighted median of what the k closest donors observe there, a missing label
their weighted majority; every donor counts once. Filled cells carry their donors.

Defined cases: the same idx delivered more than once counts once (earliest arrival); null series or
channels have no cells; listed positions beyond a series are ignored; where no record gives a donor,
the mean of the channel over the file and label, then the file, then 0 is taken (the file's most
frequent label, else 'unknown') and ``donors`` is empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwood.functions.arrays import Channels
from kelpwood.functions.hilbert import hilbert
from kelpwood.session import checkpointed, parallelism, stored

POINTS = 12  # resampled points a channel in the feature vector
STRIDE = 1 << 32  # cell number = channel * STRIDE + pos, more than a series can have entries
#: Orderings: the block (file alone, label, subject), whether it holds one length only, how much time weighs as an axis.
CURVES = (("s", False, 1), ("s", True, 0.2), ("l", True, 1), ("l", True, 0.2), ("l", True, 0), ("l", False, 0.2), ("f", True, 1), ("f", True, 0.2), ("f", False, 0.2))
FORTNIGHT = 14  # days on the axis of time that weigh as much as a deviation of the shape
WAVES = 12  # shapes that are turned into axes
AXES, BITS = 6, 10  # 60 bits: a place on the curve fits a bigint
SLICE, PART = 500, 4_000  # recipients and donors of one group of the exhaustive search
LABEL = -1  # the cell number of a label


def missing_numbers(tokens: Column) -> Column:
    """Numbers among a file's missing strings."""
    return F.filter(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.trim(t).try_cast("double")), lambda x: x.isNotNull())


def observed_series(series: Column, listed: Column, numbers: Column) -> Column:
    """The series with null for every missing entry: null, NaN, a missing number, or listed."""

    def channel(entries: Column, c: Column) -> Column:
        places = F.get(listed, c)
        return F.transform(entries, lambda x, p: F.when(x.isNotNull() & ~F.isnan(x) & ~F.array_contains(numbers, x) & ~F.coalesce(F.array_contains(places, p), F.lit(False)), x))

    return F.transform(series, channel)


def observed_records(records: DataFrame, context: DataFrame) -> DataFrame:
    """One row an idx: file_id, subject_id, split, source, recorded_at, ``series`` with null for
    missing entries and ``label`` trimmed, null where missing."""
    wanted = ["file_id", "subject_id", "split", "source", "label", "series", "missing_indices", "recorded_at"]
    once = records.filter("idx is not null").groupBy("idx").agg(F.min_by(F.struct(*wanted), F.struct(F.col("arrived_at"), F.xxhash64(F.to_json(F.struct("label", "series"))))).alias("r"))
    tokens = context.dropDuplicates(["file_id"]).select(F.col("file_id").alias("f"), F.coalesce("missing_strings", F.array().cast("array<string>")).alias("tokens"), missing_numbers(F.col("missing_strings")).alias("numbers"))
    joined = once.join(tokens, F.col("r.file_id") == F.col("f"), "left")
    none = F.array()
    numbers, texts = F.coalesce("numbers", none.cast("array<double>")), F.transform(F.coalesce("tokens", none.cast("array<string>")), lambda t: F.upper(t))
    label = F.regexp_replace("r.label", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return joined.select(
        "idx", "r.file_id", "r.subject_id", "r.split", "r.source", "r.recorded_at",
        observed_series(F.col("r.series"), F.col("r.missing_indices"), numbers).alias("series"),
        F.when(~F.coalesce(F.array_contains(texts, F.upper(label)), F.lit(False)), label).alias("label"),
    )


def missing_cells(series: Column) -> Column:
    """Cell numbers of the null entries."""
    return F.flatten(F.transform(F.coalesce(series, F.array().cast("array<array<double>>")), lambda ch, c: F.filter(F.transform(F.coalesce(ch, F.array().cast("array<double>")), lambda x, p: F.when(x.isNull(), c.cast("bigint") * STRIDE + p)), lambda k: k.isNotNull())))


def features(s: Channels) -> np.ndarray:
    """POINTS resampled points a channel, straight over the gaps; 0 where nothing is observed."""
    out = np.zeros((*s.size.shape, POINTS))
    gaps = np.concatenate([[0], np.cumsum(~np.isfinite(s.values))])
    whole = (s.size > 0) & (gaps[s.start + np.maximum(s.size, 0)] == gaps[s.start])
    for n in np.unique(s.size[whole]):
        at = np.linspace(0, n - 1, POINTS)
        low = np.minimum(at.astype(int), n - 1)
        r, c = np.nonzero(whole & (s.size == n))
        first, then = s.values[s.start[r, c][:, None] + low], s.values[s.start[r, c][:, None] + np.minimum(low + 1, n - 1)]
        out[r, c] = (then - first) * (at - low) + first
    for r, c in zip(*np.nonzero((s.size > 0) & ~whole), strict=True):
        a = s.values[s.start[r, c] : s.start[r, c] + s.size[r, c]]
        ok = np.isfinite(a)
        if ok.any():
            out[r, c] = np.interp(np.linspace(0, len(a) - 1, POINTS), np.flatnonzero(ok), a[ok])
    return out.reshape(len(out), -1) if s.channels else np.zeros((len(out), 1))


def _doubles(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds sizes of the channels and features."""
    for batch in batches:
        if batch.num_rows:
            s = Channels(batch["series"])
            sizes = s.size if s.channels else np.zeros((batch.num_rows, 0), np.int64)
            counts = pc.fill_null(pc.list_value_length(batch["series"]), 0).to_numpy(zero_copy_only=False)
            held = np.arange(sizes.shape[1])[None] < counts[:, None]
            x = features(s)
            points = np.repeat(held, POINTS, axis=1) if s.channels else np.zeros(x.shape, bool)
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            more = [pa.ListArray.from_arrays(offsets(counts), pa.array(sizes[held], pa.int32())), pa.ListArray.from_arrays(offsets(counts * POINTS), pa.array(x[points], pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sizes", "features"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, n, sums, squares) of every group of a batch."""
    for batch in batches:
        groups = batch["grp"].dictionary_encode()
        at = groups.indices.to_numpy(zero_copy_only=False)
        for g, name in enumerate(groups.dictionary.to_pylist()):
            own = np.flatnonzero(at == g)
            x = batch["features"].take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(own)], pa.int64()), _doubles(x.sum(0)[None]), _doubles((x * x).sum(0)[None])], names=["grp", "n", "sums", "squares"])


PLACED = "key string, place bigint, idx bigint, asks boolean, cells array<bigint>, norm bigint, subject bigint, day double, sizes array<int>, features array<float>"


@lru_cache(maxsize=256)
def _turns(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Projections and shifts of the curves over so many features: turns of the slowest waves of every channel."""
    random = np.random.default_rng([5, width])
    channels = max(1, width // POINTS)
    waves = np.cos(np.pi * (np.arange(POINTS) + 0.5)[None] * np.arange(POINTS)[:, None] / POINTS) * np.where(np.arange(POINTS) > 0, np.sqrt(2), 1)[:, None] / POINTS
    slow = np.zeros((min(width, max(WAVES, channels)), width))
    for k in range(len(slow)):
        c, wave = k % channels, k // channels
        slow[k, c * POINTS : (c + 1) * POINTS] = waves[wave]
    out = []
    for _ in CURVES:
        turn = np.linalg.qr(random.normal(size=(max(1, len(slow)), max(1, len(slow)))))[0][: len(slow), :AXES]
        out.append((slow.T @ turn, random.uniform(0, 1, turn.shape[1])))
    return out


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every ordering that a record takes part in; features divided by their spread."""
    kept = ["idx", "asks", "cells", "norm", "subject", "day", "sizes"]
    for batch in batches:
        lengths = pc.list_value_length(batch["features"]).to_numpy(zero_copy_only=False)
        for width in np.unique(lengths):
            rows = batch.take(pa.array(np.flatnonzero(lengths == width)))
            flat = lambda name: rows[name].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows.num_rows, width)  # noqa: B023, E731
            spread = flat("spread")
            x = flat("features") / np.where(spread > 0, spread, 1)
            points = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
            day = pc.fill_null(rows["day"], 0.0).to_numpy(zero_copy_only=False) / FORTNIGHT
            day = 6 - np.abs(day % 24 - 12)  # there and back, within the width of a shape axis
            longest = _longest(rows["sizes"])
            for curve, ((kind, sized, timed), (turn, shift)) in enumerate(zip(CURVES, _turns(int(width)), strict=True)):
                known = {"f": rows["grp"], "l": rows["norm"].cast(pa.string()), "s": rows["subject"].cast(pa.string())}[kind]
                key = pc.binary_join_element_wise(rows["grp"], f"{kind}{curve}", known, longest if sized else "", "|")
                axes = x @ turn
                if timed:
                    axes = np.column_stack([axes[:, : AXES - 1], day * timed])
                    shift = np.append(shift[: AXES - 1], 0.5)
                grid = np.clip((axes / 6 + 0.5 + shift) / 2, 0, 1) * ((1 << BITS) - 1)
                out = pa.RecordBatch.from_arrays([key, pa.array(hilbert(np.rint(grid), BITS)), *(rows[c] for c in kept), points], names=["key", "place", *kept, "features"])
                yield out.filter(key.is_valid())


def _longest(sizes: pa.ListArray) -> pa.Array:
    """Greatest size of each row as text; 0 where there is none."""
    n = pc.list_value_length(sizes).to_numpy(zero_copy_only=False)
    out = np.zeros(len(n), np.int64)
    np.maximum.at(out, np.repeat(np.arange(len(n)), n), sizes.flatten().to_numpy(zero_copy_only=False))
    return pa.array(out).cast(pa.string())


class _Rows:
    """Placed rows as arrays."""

    def __init__(self, rows: pa.RecordBatch | pa.Table) -> None:
        column = lambda name: rows[name].combine_chunks() if isinstance(rows, pa.Table) else rows[name]
        plain = lambda name, null: pc.fill_null(column(name), null).to_numpy(zero_copy_only=False)

        def padded(name: str, null: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
            lists = column(name)
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.full((len(n), int(n.max(initial=1))), null, kind)
            out[np.arange(out.shape[1])[None] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            return out, n

        self.n = rows.num_rows
        self.idx, self.asks, self.day = plain("idx", 0), plain("asks", False), plain("day", -1e9)
        self.norm, self.subject = plain("norm", 0), plain("subject", 0)
        self.named, self.owned = column("norm").is_valid().to_numpy(zero_copy_only=False), column("subject").is_valid().to_numpy(zero_copy_only=False)
        self.sizes, _ = padded("sizes", -1, np.int64)
        self.longest = np.maximum(self.sizes.max(1, initial=0), 0)
        self.features, self.width = padded("features", 0, np.float32)
        cells = column("cells")
        counts = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
        self.cell, self.cell_start = cells.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])
        self.codes = np.unique(self.cell)
        self.missing = np.sort(np.repeat(np.arange(self.n), counts) * max(1, len(self.codes)) + np.searchsorted(self.codes, self.cell))

    def lacks(self, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether rows miss a cell."""
        if not len(self.codes):
            return np.zeros(np.broadcast(row, cell).shape, bool)
        code = np.minimum(np.searchsorted(self.codes, cell), len(self.codes) - 1)
        key = row * len(self.codes) + code
        at = np.minimum(np.searchsorted(self.missing, key), len(self.missing) - 1)
        return (self.missing[at] == key) & (self.codes[code] == cell)


def distances(t: _Rows, asks: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distances of the rows ``asks`` (n) to the rows ``other`` (n, m)."""
    away = t.features[asks][:, None] - t.features[other]
    d = np.einsum("rmd,rmd->rm", away, away, dtype=float) / np.maximum(1, t.width[asks])[:, None]
    d += 0.5 * (t.named[asks][:, None] & t.named[other] & (t.norm[asks][:, None] != t.norm[other]))
    d += 0.25 * ~(t.owned[asks][:, None] & t.owned[other] & (t.subject[asks][:, None] == t.subject[other]))
    return d + 0.05 * np.minimum(np.abs(t.day[asks][:, None] - t.day[other]), 30) / 30 + 0.02 * np.abs(t.longest[asks][:, None] - t.longest[other])


def closest(t: _Rows, asks: np.ndarray, other: np.ndarray, fit: np.ndarray, k: int) -> list[np.ndarray]:
    """(idx, cell, donor, at, distance) of the k closest donors of every missing cell of the rows ``asks`` among the rows
    ``other`` (n, m) where they ``fit``; at is the donor's own cell, at the same place of a series of another length."""
    d = np.where(fit, distances(t, asks, other), np.inf)
    few = min(4 * k, d.shape[1])
    wide = int((d <= np.partition(d, few - 1, axis=1)[:, few - 1 : few]).sum(1).max()) if 0 < few < d.shape[1] else d.shape[1]  # ties of the last included
    first = lambda n: np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)

    def sorted_by_distance(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, far = np.take_along_axis(other, which, 1), np.take_along_axis(d, which, 1)
        order = np.lexsort((t.idx[near], far), axis=1)
        return np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)

    near, far_off = sorted_by_distance(first(wide))
    counts = t.cell_start[asks + 1] - t.cell_start[asks]
    of = np.repeat(np.arange(len(asks)), counts)
    cell = t.cell[np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + t.cell_start[asks][of]]
    out = []
    todo = np.arange(len(of))
    while len(todo) and few:
        donor, far, c = near[of[todo], :few], far_off[of[todo], :few], np.maximum(cell[todo] // STRIDE, 0)[:, None]
        n, m = t.sizes[donor, c], t.sizes[asks[of[todo]][:, None], c]
        p = (cell[todo] % STRIDE)[:, None]
        at = np.where(n == m, p, np.minimum(n - 1, np.rint(p * (n - 1) / np.maximum(1, m - 1)).astype(np.int64))) + c * STRIDE
        seen = np.where(cell[todo][:, None] == LABEL, t.named[donor], (n > 0) & ~t.lacks(donor, at)) & np.isfinite(far)
        chosen = seen & (np.cumsum(seen, 1) <= k)
        whole = (chosen.sum(1) >= k) | (few == d.shape[1])
        q, j = np.nonzero(chosen & whole[:, None])
        out.append([t.idx[asks[of[todo[q]]]], cell[todo[q]], t.idx[donor[q, j]], np.where(cell[todo[q]] == LABEL, LABEL, at[q, j]), far[q, j]])
        todo = todo[~whole]
        if len(todo):  # beyond the closest few
            few = d.shape[1]
            near, far_off = sorted_by_distance(first(few))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5


FOUND = "idx bigint, cell bigint, near array<struct<distance: double, donor: bigint, at: bigint>>"


def _found(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """A row for every missing cell of a recipient with what it found."""
    idx, cell, donor, at, distance = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 5
    idx, cell, donor, at = (c.astype(np.int64) for c in (idx, cell, donor, at))
    order = np.lexsort((cell, idx))
    idx, cell = idx[order], cell[order]
    start = np.flatnonzero(np.append(True, (np.diff(idx) != 0) | (np.diff(cell) != 0))) if len(idx) else np.zeros(0, np.int64)
    near = pa.StructArray.from_arrays([pa.array(distance[order]), pa.array(donor[order]), pa.array(at[order])], names=["distance", "donor", "at"])
    return pa.RecordBatch.from_arrays([pa.array(idx[start]), pa.array(cell[start]), pa.ListArray.from_arrays(pa.array(np.append(start, len(idx)), pa.int32()), near)], names=["idx", "cell", "near"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(idx, cell, near) with the k closest donors; one met in several orderings counts once."""
    once = F.filter("all", lambda r, i: ~F.exists(F.slice("all", 1, i), lambda o: o["donor"] == r["donor"]))
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))  # at most k an ordering
    return found.groupBy("idx", "cell").agg(all_.alias("all")).select("idx", "cell", F.slice(once, 1, k).alias("near"))


def _in_windows(rows: pa.RecordBatch, lo: int, hi: int, window: int, k: int, split: int | None = None) -> list[list[np.ndarray]]:
    """What the recipients among the rows lo..hi of a sorted stretch find within their windows; with ``split`` only on
    the other side of that row."""
    if hi <= lo:
        return []
    t = _Rows(rows)
    key = rows["key"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
    out = []
    every = np.flatnonzero(t.asks[lo:hi]) + lo
    for at in range(0, len(every), 256):
        asks = every[at : at + 256]
        place = asks[:, None] + np.concatenate([np.arange(-window, 0), np.arange(1, window + 1)])[None]
        fit = (place >= 0) & (place < t.n)
        place = np.clip(place, 0, t.n - 1)
        fit &= (key[place] == key[asks][:, None]) & (t.idx[place] != t.idx[asks][:, None])
        if split is not None:
            fit &= (place < split) != (asks < split)[:, None]
        some = fit.any(1)
        if some.any():
            out.append(closest(t, asks[some], place[some], fit[some], k))
    return out


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _windows(window: int, k: int):
    """Compare within a sorted partition; also hand out the rows next to its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, head, rest, done = TaskContext.get().partitionId(), [], None, 0
        whole = lambda found, rows, border: pa.RecordBatch.from_arrays(
            [*found.columns, *(pa.nulls(found.num_rows, f.type) for f in rows.schema), pa.nulls(found.num_rows, pa.int32()), pa.nulls(found.num_rows, pa.bool_())] if border is None
            else [*(pa.nulls(rows.num_rows, f.type) for f in found.schema), *rows.columns, pa.array(np.full(rows.num_rows, border[0], np.int32)), pa.array(np.full(rows.num_rows, border[1]))],
            names=[*found.schema.names, *(f"r_{c}" for c in rows.schema.names), "border", "after"],
        )
        pieces = (batch[at : at + 8192] for batch in batches for at in range(0, batch.num_rows, 8192))
        for batch in _and_none(pieces):
            # rows stay until all rows of their window have come
            if batch is not None:
                if sum(b.num_rows for b in head) < window:
                    head.append(batch[:window])
                rest = batch if rest is None else _one([rest, batch])
            if rest is None:
                continue
            end = rest.num_rows if batch is None else max(done, rest.num_rows - window)
            found = _found(_in_windows(rest, done, end, window, k))
            if found.num_rows:
                yield whole(found, rest, None)
            if batch is None:
                yield whole(_found([]), _one(head)[:window], (part, True))
                yield whole(_found([]), rest[max(0, rest.num_rows - window) :], (part + 1, False))
                continue
            keep = max(0, end - window)
            rest, done = rest[keep:], end - keep

    return run


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _across(window: int, k: int):
    """Compare the rows on both sides of a border."""

    def run(rows: pa.Table) -> pa.Table:
        before, after = (rows.filter(pc.equal(rows["after"], v)).sort_by([("key", "ascending"), ("place", "ascending"), ("idx", "ascending")]) for v in (False, True))
        if not before.num_rows or not after.num_rows:
            return pa.Table.from_batches([_found([])])
        both = pa.concat_tables([before, after]).combine_chunks().to_batches()[0]
        return pa.Table.from_batches([_found(_in_windows(both, 0, both.num_rows, window, k, before.num_rows))])

    return run


def _everywhere(k: int):
    """Compare all recipients of a group with all its donors."""

    def run(rows: pa.Table) -> pa.Table:
        t = _Rows(rows.combine_chunks())
        takes, gives = (pc.fill_null(rows[c].combine_chunks(), False).to_numpy(zero_copy_only=False) for c in ("takes", "gives"))
        asks, donors, out = np.flatnonzero(takes), np.flatnonzero(gives), []
        for at in range(0, len(asks), 16):
            own = asks[at : at + 16]
            other = np.broadcast_to(donors, (len(own), len(donors)))
            if len(donors):
                out.append(closest(t, own, other, t.idx[other] != t.idx[own][:, None], k))
        return pa.Table.from_batches([_found(out)])

    return run


def _weighted(rows: Column) -> Column:
    """Weighted median of rows of (value, weight)."""
    ordered = F.array_sort(rows)
    half = F.aggregate(ordered, F.lit(0.0), lambda a, r: a + r["weight"]) / 2
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(ordered, start, lambda a, r: F.struct((a["w"] + r["weight"]).alias("w"), F.when(a["v"].isNotNull(), a["v"]).when(a["w"] + r["weight"] >= half, r["value"]).alias("v")))["v"]


def placed_records(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with ``spread``, counts): the spread of each feature over the file's records of as many channels, and the
    number of these."""
    sums = base.select("grp", "features").mapInArrow(_sums, "grp string, n bigint, sums array<double>, squares array<double>")
    points = sums.select("grp", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("point", "v")).groupBy("grp", "point").agg(F.sum("n").alias("n"), F.sum("v.sums").alias("s"), F.sum("v.squares").alias("q"))
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))
    spreads = points.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("point", spread.alias("s")))), lambda r: r["s"]).alias("spread"))
    counts = sums.groupBy("grp").agg(F.sum("n").alias("n"))
    return base.join(spreads, "grp", "left").withColumn("spread", F.coalesce("spread", F.array().cast("array<double>"))), counts


def nearest_donors(base: DataFrame, k: int, window: int, parts: int | None = None) -> DataFrame:
    """(idx, cell, near): the k closest donors of every missing cell.

    base: checkpointed rows with grp, idx, asks, cells, norm (hashed), subject, day, sizes, features.
    """
    spark = base.sparkSession
    rows, counts = placed_records(base)
    placed = rows.select("grp", "idx", "asks", "cells", "norm", "subject", "day", "sizes", "features", "spread").mapInArrow(_place, PLACED)
    parts = parts or max(1, min(parallelism(spark), base.count() * len(CURVES) // (16 * window)))
    order = ["key", "place", "idx"]
    sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    both = ", ".join([FOUND, *(f"r_{c}" for c in PLACED.split(", ")), "border int", "after boolean"])
    seen = checkpointed(sorted_rows.mapInArrow(_windows(window, k), both))
    edges = seen.filter("border is not null").select("border", "after", *(F.col(f"r_{c.split()[0]}").alias(c.split()[0]) for c in PLACED.split(", ")))
    within = seen.filter("border is null").select("idx", "cell", "near")
    if parts > 1:
        within = within.unionByName(edges.groupBy("border").applyInArrow(_across(window, k), FOUND))
    best = checkpointed(_merged(within, k))
    # who lacks donors in windows that don't hold the whole file
    wide = counts.filter(F.col("n") > window + 1).select("grp", F.col("n").alias("n_rows"))
    had = best.filter(F.size("near") >= k).groupBy("idx").agg(F.count("*").alias("n_served"))
    lacking = checkpointed(base.filter("asks").join(wide, "grp").join(had, "idx", "left").filter(F.coalesce("n_served", F.lit(0)) < F.size("cells")).select("grp", "idx", "n_rows"))
    if not lacking.limit(1).count():
        return best
    groups = lacking.groupBy("grp").agg(F.count("*").alias("r"), F.first("n_rows").alias("n")).select("grp", F.ceil(F.col("r") / SLICE).cast("int").alias("slices"), F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("idx"), F.col(n)).cast("int")
    own = rows.select("grp", "idx", "cells", "norm", "subject", "day", "sizes", F.zip_with("features", "spread", lambda x, s: F.when(s > 0, x / s).otherwise(x).cast("float")).alias("features"))
    takers = own.join(lacking.select("idx"), "idx", "left_semi").join(groups, "grp").withColumn("slice", dealt("slices")).withColumn("part", every("parts"))
    givers = own.join(groups, "grp").withColumn("part", dealt("parts")).withColumn("slice", every("slices"))
    flagged = lambda rows, takes: rows.drop("slices", "parts").withColumn("asks", F.lit(takes)).withColumn("takes", F.lit(takes)).withColumn("gives", F.lit(not takes))
    rest = flagged(takers, True).unionByName(flagged(givers, False)).groupBy("grp", "slice", "part").applyInArrow(_everywhere(k), FOUND)
    return _merged(best.unionByName(rest), k)


def hot_deck(records: DataFrame, context: DataFrame, k: int = 5, window: int = 100, parts: int | None = None) -> DataFrame:
    """One row an idx: series and label filled, and ``filled``: what was filled, cell by cell, as
    array<struct<field, channel, pos, value, label, donors>>. ``parts`` sets the range partitions of the orderings."""
    grp = F.concat_ws("|", F.coalesce(F.col("file_id").cast("string"), F.lit("?")), F.coalesce(F.size("series"), F.lit(-1)).cast("string"))
    ready = observed_records(records, context).withColumn("norm", F.upper("label")).withColumn("cells", missing_cells(F.col("series"))).withColumn("wants_label", F.col("label").isNull()).withColumn("grp", grp)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)
    base = stored(ready.mapInArrow(_shaped, f"{kinds}, sizes array<int>, features array<float>"))
    asked = F.when(F.col("wants_label"), F.concat("cells", F.array(F.lit(LABEL).cast("bigint")))).otherwise(F.col("cells"))
    compact = base.select("grp", "idx", (F.size(asked) > 0).alias("asks"), asked.alias("cells"), F.when(F.col("norm").isNotNull(), F.xxhash64("norm")).alias("norm"), F.col("subject_id").alias("subject"), (F.unix_micros(F.col("recorded_at").cast("timestamp")) / 86.4e9).alias("day"), "sizes", "features")
    found = nearest_donors(compact, k, window, parts)
    best = found.select("idx", "cell", F.inline("near"))
    at = lambda part: (F.col("at") % STRIDE if part else F.floor(F.col("at") / STRIDE)).cast("int")
    given = base.select(F.col("idx").alias("donor"), "series", "label")
    valued = best.join(given, "donor").select("idx", "cell", "distance", "donor", F.when(F.col("cell") >= 0, F.get(F.get("series", at(0)), at(1))).alias("value"), F.when(F.col("cell") < 0, F.col("label")).alias("label"))
    close = valued.groupBy("idx", "cell").agg(F.sort_array(F.collect_list(F.struct("distance", "donor", "value", "label"))).alias("close"))
    weighted = F.transform("close", lambda r: F.struct(r["value"].alias("value"), (1 / (r["distance"] + 0.05)).alias("weight")))
    votes = F.transform(F.array_distinct(F.transform("close", lambda r: r["label"])), lambda x: F.struct(F.aggregate(F.filter("close", lambda r: r["label"] == x), F.lit(0.0), lambda a, r: a + 1 / (r["distance"] + 0.05)).alias("w"), x.alias("label")))
    deck = close.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct(F.when(F.col("cell") >= 0, _weighted(weighted)).alias("value"), F.when(F.col("cell") < 0, F.array_max(votes)["label"]).alias("label"), F.array_distinct(F.transform("close", lambda r: r["donor"])).alias("donors"))))).alias("deck"))
    # fallbacks: means by file, label and channel, pre-aggregated
    flat = base.select("file_id", "norm", F.posexplode("series").alias("channel", "values")).select("file_id", "norm", "channel", F.aggregate(F.filter("values", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(F.filter("values", lambda x: x.isNotNull())).alias("n"))
    by_label = flat.groupBy("file_id", "norm", "channel").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    label_mean = by_label.filter("n > 0").groupBy(F.col("file_id").alias("lf"), F.col("norm").alias("ln")).agg(F.map_from_entries(F.collect_list(F.struct("channel", F.col("s") / F.col("n")))).alias("label_mean"))
    file_mean = by_label.groupBy("file_id", "channel").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m")).filter("m is not null").groupBy(F.col("file_id").alias("ff")).agg(F.map_from_entries(F.collect_list(F.struct("channel", "m"))).alias("file_mean"))
    usual = base.filter("norm is not null").groupBy("file_id", "label").count().groupBy(F.col("file_id").alias("uf")).agg(F.max_by("label", F.struct("count", "label")).alias("usual"))
    whole = base.join(deck, "idx", "left").join(label_mean, F.col("file_id").eqNullSafe(F.col("lf")) & F.col("norm").eqNullSafe(F.col("ln")), "left").join(file_mean, F.col("file_id").eqNullSafe(F.col("ff")), "left").join(usual, F.col("file_id").eqNullSafe(F.col("uf")), "left")

    def value(cell: Column, c: Column) -> Column:
        return F.coalesce(F.element_at("deck", cell)["value"], F.element_at("label_mean", c), F.element_at("file_mean", c), F.lit(0.0))

    donors = lambda cell: F.coalesce(F.element_at("deck", cell)["donors"], F.array().cast("array<bigint>"))
    filled_label = F.coalesce(F.element_at("deck", F.lit(-1).cast("bigint"))["label"], F.col("usual"), F.lit("unknown"))
    whole = whole.withColumn("marks", F.transform("cells", lambda k: F.struct(F.lit("series").alias("field"), F.floor(k / STRIDE).cast("int").alias("channel"), (k % STRIDE).cast("int").alias("pos"), value(k, F.floor(k / STRIDE).cast("int")).alias("value"), F.lit(None).cast("string").alias("label"), donors(k).alias("donors"))))
    mark = F.array(F.struct(F.lit("label").alias("field"), F.lit(-1).alias("channel"), F.lit(-1).alias("pos"), F.lit(None).cast("double").alias("value"), filled_label.alias("label"), donors(F.lit(-1).cast("bigint")).alias("donors")))
    return whole.select(
        "idx", "file_id", "subject_id", "split", "source", "recorded_at",
        F.transform("series", lambda ch, c: F.transform(ch, lambda x, p: F.coalesce(x, value(c.cast("bigint") * STRIDE + p, c)))).alias("series"),
        F.when(F.col("wants_label"), filled_label).otherwise(F.col("label")).alias("label"),
        F.when(F.col("wants_label"), F.concat("marks", mark)).otherwise(F.col("marks")).alias("filled"),
    )


def filled_cells(filled: DataFrame) -> DataFrame:
    """One row a filled cell: idx, field, channel, pos, value, label, donors."""
    return filled.select("idx", F.inline("filled"))


def violations(filled: DataFrame, records: DataFrame, context: DataFrame) -> DataFrame:
    """Per file what every filling must keep: records, filled entries and labels, and how many records have entries or
    labels left missing or observed ones changed, how many cells have the record itself or one donor twice among
    their donors, and how many donated entries lie outside what the file's channel observes (all 0)."""
    before = observed_records(records, context).select("idx", F.col("series").alias("__series"), F.col("label").alias("__label"))
    both = filled.join(before, "idx")
    gaps = F.exists(F.coalesce("series", F.array().cast("array<array<double>>")), lambda c: F.exists(c, lambda x: x.isNull()))
    left = F.coalesce(gaps, F.lit(False)) | F.col("label").isNull()
    same = lambda a, b: F.coalesce(a.eqNullSafe(b), F.lit(False))
    kept = F.transform("series", lambda c, i: F.transform(c, lambda x, j: F.when(F.get(F.get("__series", i), j).isNotNull(), x)))
    changed = ~same(kept, F.col("__series")) | (F.col("__label").isNotNull() & ~same(F.col("label"), F.col("__label")))
    of = lambda field: F.size(F.filter("filled", lambda r: r["field"] == field)).cast("bigint")
    rows = both.select("file_id", of("series").alias("cells"), of("label").alias("labels"), left.cast("bigint").alias("left"), changed.cast("bigint").alias("changed"), F.size(F.filter("filled", lambda r: F.array_contains(r["donors"], F.col("idx")) | (F.size(F.array_distinct(r["donors"])) != F.size(r["donors"])))).cast("bigint").alias("own"))
    total = rows.groupBy("file_id").agg(F.count("*").alias("n_records"), F.sum("cells").alias("n_entries"), F.sum("labels").alias("n_labels"), F.sum("left").alias("n_left"), F.sum("changed").alias("n_changed"), F.sum("own").alias("n_wrong_donors"))
    ranges = before.join(filled.select("idx", "file_id"), "idx").select("file_id", F.posexplode("__series").alias("channel", "c")).groupBy("file_id", "channel").agg(F.min(F.array_min("c")).alias("low"), F.max(F.array_max("c")).alias("high"))
    cells = filled.select("file_id", F.inline("filled")).filter("field = 'series' and size(donors) > 0").join(ranges, ["file_id", "channel"])
    outside = cells.groupBy("file_id").agg(F.sum((~F.col("value").between(F.col("low"), F.col("high"))).cast("bigint")).alias("n_outside"))
    return total.join(outside, "file_id", "left").withColumn("n_outside", F.coalesce("n_outside", F.lit(0).cast("bigint")))
