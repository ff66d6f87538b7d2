"""Same or near-same records across splits, by similarity-hash fingerprints.

Records of equal content (same file, same side, same observed entries) become one representative.
Windows of each channel, brought to mean 0 and deviation 1, are hashed to the signs of ``BITS``
random projections, twice with independent projections (gaps are drawn straight, which moves a code;
what moves one out of its blocks seldom moves the other too); a gap in one channel thus leaves the
codes of the others whole. Windows start at
0..``max_shift`` and have lengths of a geometric series, so that two records that agree under a
shift share a window that lies within their overlap. Codes of the train side and the held-out side
that agree in one of ``SEGMENTS`` blocks meet in a join; pairs within ``radius`` bits of that code, and
within ``whole_radius`` of the 128 bits of the window over all channels, are verified exactly under
every shift, then expanded from representatives to records.

A pair counts if for some shift of at most ``max_shift`` the entries observed in both are at least
``cover`` of the entries of the longer record and, each channel normalised over them, the root mean
squared difference is at most ``most``. Channels without deviation are all 0 after normalising.

Defined cases: repeated deliveries of an idx count once; null series, records without channels and
records observed on less than ``cover`` of their own entries have no pair; channels of different
lengths are padded with missing entries; other splits and null splits take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwood.functions.arrays import Channels
from kelpwood.session import stored

BITS, SEGMENTS = 64, 4  # four blocks of 16 bits
SEEDS = 11, 12  # of the codes of a channel


def window_lengths(n: int) -> list[int]:
    """Lengths of the series 1, 2, 3, .. (ratio at most 1.25 from 4 on) between 0.64 n and n."""
    out, w = [], 1
    while w <= n:
        if w >= int(0.64 * n):
            out.append(w)
        w = w + 1 if w < 8 else int(w * 1.25)
    return out


@lru_cache(maxsize=32)
def _directions(size: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, size, bits]).normal(size=(size, bits))


def matrix(series: list, channels: int, length: int) -> np.ndarray:
    out = np.full((channels, length), np.nan)
    for c, values in enumerate(series):
        if values is not None and len(values):
            out[c, : len(values)] = [np.nan if v is None else v for v in values]
    return out


def _filled(m: np.ndarray) -> np.ndarray:
    """Missing entries drawn straight between their neighbours."""
    if not np.isnan(m).any():
        return m
    m = m.copy()
    for row in m:
        ok = ~np.isnan(row)
        row[~ok] = np.interp(np.flatnonzero(~ok), np.flatnonzero(ok), row[ok]) if ok.any() else 0
    return m


def fingerprints(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, channels, seeds) of the channels and (rows, 2) of the whole windows (rows, channels, length),
    and which channels' codes count: those that vary, or all where none does. The code of a constant
    channel would bring all records together that have one."""
    centred = stack - stack.mean(2, keepdims=True)
    spread = centred.std(2, keepdims=True)
    unit = centred / np.where(spread > 1e-12, spread, 1)
    single = np.stack([np.packbits(unit @ _directions(stack.shape[2], BITS, seed) > 0, axis=2).view(">i8")[:, :, 0] for seed in SEEDS], axis=2)
    flat = unit.reshape(len(stack), -1)
    varied = spread[:, :, 0] > 1e-12
    whole = np.packbits(flat @ _directions(flat.shape[1], 128) > 0, axis=1).view(">i8").astype(np.int64)
    return single.astype(np.int64), whole, varied | ~varied.any(1, keepdims=True)


CODED = "place bigint, code bigint, second bigint, hi bigint, lo bigint, rep bigint"


def _codes(max_shift: int, cover: float):
    """Codes of every window of every record; place stands for file, channel, number of channels, kind and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole[at : at + 2000]
                s = Channels(batch["series"])
                file, rep, train = (batch[c].to_numpy(zero_copy_only=False) for c in ("file_id", "rep", "train"))
                channels, length = pc.list_value_length(batch["series"]).to_numpy(zero_copy_only=False).astype(np.int64), s.size.max(1, initial=0)
                shape = np.column_stack([file, train, channels, length]).astype(np.int64)
                kinds, which = np.unique(shape, axis=0, return_inverse=True)
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for g, (f, side, c, n) in enumerate(kinds.tolist()):
                    if n < 1:
                        continue
                    rows = np.flatnonzero(which.ravel() == g)
                    stack = s.dense(rows, c, n)
                    fit = (~np.isnan(stack)).sum((1, 2)) >= cover * c * n
                    rows, stack = rows[fit], stack[fit]
                    for m in np.flatnonzero(np.isnan(stack).any((1, 2))):
                        stack[m] = _filled(stack[m])
                    for w in window_lengths(n) if len(rows) else []:
                        for start in range(min(max_shift, n - w) + 1):
                            code, wide, counts = fingerprints(stack[:, :, start : start + w])
                            r, k = np.nonzero(counts)
                            # kind 0: train starts at 0..shift, held-out at 0; kind 1: train at 0, held-out at 1..shift
                            for kind in ([0, 1] if start == 0 else [0]) if side else ([0] if start == 0 else [1]):
                                place = _mixed(f, c, k, kind, w)
                                for held, new in zip(out, (place, code[r, k, 0], code[r, k, 1], wide[r, 0], wide[r, 1], rep[rows[r]]), strict=True):
                                    held.append(new)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["place", "code", "second", "hi", "lo", "rep"])

    return run


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit number of several."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
    return np.asarray(out).view(np.int64)


def differences(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, max_shift: int, cover: float) -> tuple[np.ndarray, np.ndarray]:
    """(least root mean squared difference, its shift) of pairs of stacks (pairs, channels, length),
    over the shifts that cover enough of ``sizes``, the entries of the longer records; inf if none."""
    best, at = np.full(len(a), np.inf), np.zeros(len(a), np.int32)
    for shift in sorted(range(-max_shift, max_shift + 1), key=abs):
        x, y = (a[:, :, shift:], b) if shift >= 0 else (a, b[:, :, -shift:])
        n = min(x.shape[2], y.shape[2])
        if n <= 0:
            continue
        x, y = x[:, :, :n], y[:, :, :n]
        both = ~np.isnan(x) & ~np.isnan(y)
        seen = both.sum(2, keepdims=True)
        enough = np.flatnonzero(seen.sum((1, 2)) >= cover * sizes - 1e-9)
        if not len(enough):
            continue
        both, seen, parts = both[enough], np.maximum(seen[enough], 1), []
        for m in (x[enough], y[enough]):
            m = np.where(both, m, 0)
            m = np.where(both, m - m.sum(2, keepdims=True) / seen, 0)
            spread = np.sqrt((m * m).sum(2, keepdims=True) / seen)
            parts.append(np.where(spread > 1e-12, m / np.where(spread > 1e-12, spread, 1), 0))
        rms = np.sqrt(((parts[0] - parts[1]) ** 2).sum((1, 2)) / both.sum((1, 2)))
        less = rms < best[enough]
        best[enough[less]], at[enough[less]] = rms[less], shift
    return best, at


def _verify(max_shift: int, cover: float, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole[at : at + 4000]
                train, held = (Channels(batch[c]) for c in ("train_series", "held_series"))
                channels = pc.list_value_length(batch["train_series"]).to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.maximum(train.size.max(1, initial=0), held.size.max(1, initial=0))
                rms, shift = np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, np.int32)
                for c, n in np.unique(np.column_stack([channels, size]), axis=0).tolist():
                    own = np.flatnonzero((channels == c) & (size == n))
                    rms[own], shift[own] = differences(train.dense(own, c, n), held.dense(own, c, n), np.full(len(own), c * n), max_shift, cover)
                kept = np.flatnonzero(rms <= most)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([batch["train_rep"].take(pa.array(kept)), batch["held_rep"].take(pa.array(kept)), pa.array(rms[kept]), pa.array(shift[kept])], names=["train_rep", "held_rep", "difference", "shift"])

    return run


def cross_split_pairs(records: DataFrame, max_shift: int = 3, cover: float = 0.8, most: float = 0.15, radius: int = 10, whole_radius: int = 28) -> DataFrame:
    """(train_idx, held_idx, split, train_source, held_source, difference, shift) of every overlap.

    records: one row an idx with file_id, split, source and ``series`` (null where missing).
    """
    split = F.lower(F.trim("split"))
    sided = records.withColumn("split", split).filter("split in ('train', 'validation', 'test') and size(series) > 0 and file_id is not null").withColumn("train", F.col("split") == "train")
    digest = F.md5(F.concat_ws("|", F.col("file_id").cast("string"), F.col("train").cast("string"), F.to_json(F.struct("series"), {"ignoreNullFields": "false"})))
    keyed = stored(sided.select("idx", "file_id", "split", "source", "train", "series", digest.alias("digest")))
    # a representative is named by its smallest idx; its members are found again by the whole digest
    reps = stored(keyed.groupBy("digest").agg(F.min("idx").alias("rep"), F.any_value("file_id").alias("file_id"), F.any_value("train").alias("train"), F.any_value("series").alias("series")))
    width = BITS // SEGMENTS
    blocks = [F.shiftrightunsigned(c, s * width).bitwiseAND((1 << width) - 1).cast("int") for c in ("code", "second") for s in range(SEGMENTS)]

    def of(train: bool) -> DataFrame:
        part = reps.filter(F.col("train") == train).select("file_id", "train", "rep", "series").mapInArrow(_codes(max_shift, cover), CODED).select("*", F.posexplode(F.array(*blocks)).alias("segment", "block"))
        name = "train" if train else "held"
        code = F.when(F.col("segment") < SEGMENTS, F.col("code")).otherwise(F.col("second"))
        return part.select(F.xxhash64("place", "segment", "block").alias("key"), code.alias(f"{name}_code"), *[F.col(c).alias(f"{name}_{c}") for c in ("hi", "lo", "rep")])

    apart = lambda c: F.bit_count(F.col(f"train_{c}").bitwiseXOR(F.col(f"held_{c}")))
    near = (apart("code") <= radius) & (apart("hi") + apart("lo") <= whole_radius)
    met = of(True).join(of(False), "key").filter(near).select("train_rep", "held_rep").distinct()
    series = lambda name: reps.filter(F.col("train") == (name == "train")).select(F.col("rep").alias(f"{name}_rep"), F.col("file_id").alias(f"{name}_file"), F.col("series").alias(f"{name}_series"))
    both = met.join(series("train"), "train_rep").join(series("held"), "held_rep").filter((F.col("train_file") == F.col("held_file")) & (F.size("train_series") == F.size("held_series")))
    found = both.select("train_rep", "held_rep", "train_series", "held_series").mapInArrow(_verify(max_shift, cover, most), "train_rep bigint, held_rep bigint, difference double, shift int")
    named = keyed.select("digest", "idx", "source", "split", "train").join(reps.select("digest", "rep"), "digest")
    members = lambda name: named.filter(F.col("train") == (name == "train")).select(F.col("rep").alias(f"{name}_rep"), F.col("idx").alias(f"{name}_idx"), F.col("source").alias(f"{name}_source"), *([F.col("split")] if name == "held" else []))
    return found.join(members("train"), "train_rep").join(members("held"), "held_rep").select("train_idx", "held_idx", "split", "train_source", "held_source", "difference", "shift")


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Overlaps by split and source: pairs, and records of either side."""
    return pairs.groupBy("split", "held_source", "train_source").agg(F.count("*").alias("n_pairs"), F.countDistinct("held_idx").alias("n_held"), F.countDistinct("train_idx").alias("n_train"))
