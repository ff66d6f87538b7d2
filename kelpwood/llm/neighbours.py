"""Most similar vectors for every vector, over several shifted Hilbert orderings.

1. Equal vectors are brought to one representative with the k + 1 smallest ids of its copies; a
   group of copies of any size thus costs one row (Spark prunes it before the shuffle).
2. Each representative is projected by ``curves`` random rotations of the leading principal axes,
   shifted, laid on a grid and given its place on a Hilbert curve. The axes and scale are fitted on
   a bounded sample of ``fit_rows`` rows; every row is indexed.
3. All orderings are range-partitioned and sorted together; the vectors travel in single precision.
   Every row is compared with the ``window`` rows on either side of it in each ordering, in blocks.
   Rows next to a partition's border are compared again across it.
4. The windows' best are merged by row. Where distances lie so close to each other (or to a limit that
   the caller names) that single precision can't order them, they are computed again from the stored
   vectors. Copies are expanded, and the k nearest by (distance, id) come out.

Distances are those of vectors in single precision, but for the ones computed again. Defined cases: vectors that are null, of another length than ``dim``, or hold null, NaN or infinite
entries take no part; null ids take none; a repeated (id, vector) row counts once; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwood.functions.hilbert import hilbert
from kelpwood.session import checkpointed, parallelism

AXES, BITS = 6, 10  # 60 bits: a place on the curve fits a bigint
CLOSE = 1e-5  # relative difference from which single precision orders distances
MORE = 3  # neighbours beyond k that are kept for that


class Curves:
    """The projections, shifts and scale of all orderings, fitted on a sample."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        centre = sample.mean(0) if len(sample) else np.zeros(dim)
        axes = np.linalg.eigh((sample - centre).T @ (sample - centre))[1].T[::-1] if len(sample) > 1 else np.eye(dim)  # leading axes first
        self.centre, self.maps, self.low, self.wide, self.shift = centre, [], [], [], []
        lead = min(dim, 2 * AXES)
        for t in range(curves):
            turn = np.linalg.qr(random.normal(size=(lead, lead)))[0][: min(AXES, lead)]
            m = turn @ axes[:lead] if t else axes[: min(AXES, dim)]
            seen = (sample - centre) @ m.T if len(sample) else np.zeros((1, len(m)))
            self.maps.append(m)
            self.low.append(seen.min(0))
            self.wide.append(np.maximum(seen.max(0) - seen.min(0), 1e-9))
            self.shift.append(random.uniform(0, 0.5, len(m)))

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        unit = ((x - self.centre) @ self.maps[t].T - self.low[t]) / self.wide[t]  # 0..1 over the sample
        grid = np.clip((unit + self.shift[t]) / 1.5, 0, 1) * ((1 << BITS) - 1)
        return hilbert(np.rint(grid), BITS)


def _best(x: np.ndarray, ids: np.ndarray, window: int, k: int, only: tuple[int, int] | None = None) -> list[list[dict]]:
    """For each row of a sorted stretch the k nearest of the rows at most ``window`` places off.

    only: compare just rows on different sides of that place, within the window.
    """
    x = x.astype(float)
    n, block, out = len(x), max(64, window), []
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        a, b = max(0, lo - window), min(n, hi + window)
        own, other = x[lo:hi], x[a:b]
        rough = (own * own).sum(1)[:, None] + (other * other).sum(1)[None] - 2 * own @ other.T
        off = np.arange(a, b)[None] - np.arange(lo, hi)[:, None]
        bad = (off == 0) | (np.abs(off) > window)
        if only is not None:
            bad |= (np.arange(a, b)[None] < only) == (np.arange(lo, hi)[:, None] < only)
        rough[bad] = np.inf
        few = min(k + 4, rough.shape[1])  # a few more, for rounding
        near = np.argpartition(rough, few - 1, axis=1)[:, :few]
        exact = np.sqrt(((own[:, None] - other[near]) ** 2).sum(2))
        exact[np.take_along_axis(rough, near, 1) == np.inf] = np.inf
        names = ids[a:b][near]
        order = np.lexsort((names, exact), axis=1)[:, :k]
        exact, names = np.take_along_axis(exact, order, 1), np.take_along_axis(names, order, 1)
        out.append((exact, names))
    return out


def _stack(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    pad = lambda m, v: np.pad(m, ((0, 0), (0, k - m.shape[1])), constant_values=v)
    return np.concatenate([pad(d, np.inf) for d, _ in parts]), np.concatenate([pad(i, -1) for _, i in parts])


def _near_arrays(d: np.ndarray, i: np.ndarray) -> pa.Array:
    ok = np.isfinite(d)
    sizes = np.concatenate([[0], np.cumsum(ok.sum(1))])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(d[ok].astype(np.float32)), pa.array(i[ok], pa.int64())], names=["distance", "id"]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _windows(dim: int, window: int, k: int):
    """Compare within a sorted partition; also hand out the rows next to its borders."""
    near = pa.list_(pa.struct([("distance", pa.float32()), ("id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, head, tail, rest, rest_done = TaskContext.get().partitionId(), [], None, None, 0
        names = ["border", "curve", "place", "id", "vec", "near"]
        for batch in [*_chunks(batches), None]:
            # rows stay until all rows of their window have come
            if batch is not None:
                rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                if sum(b.num_rows for b in head) < window:
                    head.append(batch[:window])
            if rest is None:
                continue
            curve = rest["curve"].to_numpy(zero_copy_only=False)
            end = rest.num_rows if batch is None else max(0, rest.num_rows - window)
            cuts = [0, *(np.flatnonzero(np.diff(curve)) + 1), rest.num_rows]
            parts = [_stack(_best(_matrix(rest["vec"][a:b], dim), rest["id"][a:b].to_numpy(zero_copy_only=False), window, k), k) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            d, i = np.concatenate([p[0] for p in parts])[rest_done:end], np.concatenate([p[1] for p in parts])[rest_done:end]
            if len(d):
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), rest["id"][rest_done:end], pa.nulls(n, pa.list_(pa.float32())), _near_arrays(d, i)], names=names)
            keep = max(0, end - window)
            tail, rest, rest_done = rest[max(0, rest.num_rows - window) :], rest[keep:], max(0, end - keep)
        if tail is not None:
            first = pa.Table.from_batches(head).combine_chunks().to_batches()[0][:window]
            for border, rows in ((part, first), (part + 1, tail)):
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, border, np.int32)), rows["curve"], rows["place"], rows["id"], rows["vec"], pa.nulls(n, near)], names=names)

    return run


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch[at : at + rows]


def _border(dim: int, window: int, k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby("curve"):
            own = own.sort_values(["place", "id"]).drop_duplicates("id")
            d, i = _stack(_best(np.stack(own["vec"].to_numpy()), own["id"].to_numpy(), window, k), k)
            out += [(int(x), [{"distance": float(p), "id": int(q)} for p, q in zip(ds, js, strict=True) if np.isfinite(p)]) for x, ds, js in zip(own["id"], d, i, strict=True)]
        return pd.DataFrame(out, columns=["id", "near"])

    return run


def nearest(rows: DataFrame, idx: str, vec: str, k: int = 5, dim: int = 32, curves: int = 8, window: int = 192, fit_rows: int = 10_000, seed: int = 7, limit: float | None = None) -> DataFrame:
    """(idx, neighbour, distance, place): the k most similar vectors of every vector.

    limit: a distance that the caller compares with; distances next to it are exact.
    """
    spark = rows.sparkSession
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = rows.filter(F.col(idx).isNotNull() & (F.size(vec) == dim)).filter(~bad).select(F.col(idx).cast("bigint").alias("idx"), F.transform(vec, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    first = Window.partitionBy("h", "vec").orderBy("idx")  # sorted by the hash, not by whole vectors
    copies = base.withColumn("h", F.xxhash64("vec")).withColumn("n", F.dense_rank().over(first)).filter(F.col("n") <= k + 1)
    reps = checkpointed(copies.groupBy("h", "vec").agg(F.array_sort(F.collect_set("idx")).alias("members")).select(F.col("members")[0].alias("id"), "vec", "members"))
    n = reps.count()
    drawn = reps.select("vec").orderBy(F.xxhash64("id")).limit(fit_rows).toPandas()["vec"]
    fitted = Curves(np.stack(drawn.to_numpy()) if len(drawn) else np.zeros((0, dim)), dim, curves, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["vec"], dim)
                short = batch["vec"].cast(pa.list_(pa.float32()))
                for t in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(fitted.places(x, t)), batch["id"], short], names=["curve", "place", "id", "vec"])

    parts = max(1, min(parallelism(spark), n * curves // (16 * window)))
    placed = reps.select("id", "vec").mapInArrow(place, "curve int, place bigint, id bigint, vec array<float>")
    ordered = placed.repartitionByRange(parts, "curve", "place", "id").sortWithinPartitions("curve", "place", "id")
    near = "near array<struct<distance: float, id: bigint>>"
    seen = checkpointed(ordered.mapInArrow(_windows(dim, window, k + 1), f"border int, curve int, place bigint, id bigint, vec array<float>, {near}"))
    across = seen.filter("border is not null").groupBy("border").applyInPandas(_border(dim, window, k + 1), f"id bigint, {near}")
    merged = seen.filter("border is null").select("id", "near").unionByName(across)
    best = merged.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, 2 * (k + MORE)).alias("best"))  # at most k + 1 an ordering
    # a neighbour met in several orderings counts once
    once = F.filter("best", lambda r, i: ~F.exists(F.slice("best", 1, i), lambda o: o["id"] == r["id"]))
    best = checkpointed(best.select("id", F.transform(F.slice(once, 1, k + MORE), lambda r: F.struct(r["distance"].cast("double").alias("distance"), r["id"].alias("other"))).alias("best")))
    near_limit = F.lit(False) if limit is None else F.exists("best", lambda r: F.abs(r["distance"] - limit) <= CLOSE * (1 + limit))
    tied = F.exists(F.slice("best", 1, k + 1), lambda r: F.exists("best", lambda o: (o["other"] != r["other"]) & (F.abs(o["distance"] - r["distance"]) <= CLOSE * (1 + r["distance"]))))
    best = best.withColumn("unsure", near_limit | tied)
    vectors = reps.select(F.col("id").alias("vid"), F.col("vec").alias("v"))
    pairs = best.filter("unsure").select("id", F.inline("best")).join(vectors, F.col("id") == F.col("vid")).select("id", "other", F.col("v").alias("a")).join(vectors, F.col("other") == F.col("vid"))
    exact = F.sqrt(F.aggregate(F.zip_with("a", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    again = pairs.select("id", exact.alias("distance"), "other").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("best"))
    best = best.filter("not unsure").select("id", "best").unionByName(again).select("id", F.slice("best", 1, k).alias("best"))
    several = reps.filter(F.size("members") > 1).select(F.col("id").alias("sid"), "members")
    wide = best.select("id", F.inline("best")).join(several, F.col("other") == F.col("sid"), "left").select("id", "distance", F.explode(F.coalesce(F.slice("members", 1, k), F.array("other"))).alias("item"))
    wide = wide.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "item"))), 1, k).alias("best"))  # at most k * k
    none = F.array().cast("array<struct<distance: double, item: bigint>>")
    known = reps.join(wide, "id", "left").select(F.explode("members").alias("idx"), "members", F.coalesce("best", none).alias("best"))
    own = F.transform(F.filter("members", lambda m: m != F.col("idx")), lambda m: F.struct(F.lit(0.0).alias("distance"), m.alias("item")))
    listed = known.select("idx", F.slice(F.array_sort(F.concat(own, "best")), 1, k).alias("best"))
    # copies beyond the first k + 1 of their group: their nearest are the first k of it
    crowds = reps.filter(F.size("members") > k).select(F.col("vec").alias("v"), "members")
    rest = base.join(crowds, F.col("vec") == F.col("v")).filter(~F.array_contains("members", F.col("idx"))).select("idx", F.transform(F.slice("members", 1, k), lambda m: F.struct(F.lit(0.0).alias("distance"), m.alias("item"))).alias("best")).dropDuplicates(["idx"])
    return listed.unionByName(rest).select("idx", F.posexplode("best").alias("at", "b")).select("idx", F.col("b.item").alias("neighbour"), F.col("b.distance").alias("distance"), (F.col("at") + 1).alias("place"))


def close_pairs(neighbours: DataFrame, most: float) -> DataFrame:
    """(idx_a, idx_b, distance), idx_a < idx_b: one is among the nearest of the other, within ``most``."""
    near = neighbours.filter(F.col("distance") <= most)
    return near.groupBy(F.least("idx", "neighbour").alias("idx_a"), F.greatest("idx", "neighbour").alias("idx_b")).agg(F.min("distance").alias("distance"))
