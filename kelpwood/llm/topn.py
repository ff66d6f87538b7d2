"""Top N items within every group by a merge of sorted runs.

Every task first keeps, of the rows of a group that it holds in memory together, those of the n best items,
so that crowded groups shrink before anything is shuffled. The rows of a group are dealt to runs by the hash
of their item, as many as the session has shuffle partitions (16 at least), so a group of any size is
spread over that many tasks and all rows of one item meet in one run. Every run is sorted by
(group, score descending, item) with Spark's spilling sort; a scan keeps each group's first N
distinct items and seeks to the next group. What is left, at most N * runs rows a group, is merged
group by group with a tree of losers over the runs, again seeking on after N outputs.

Ties go to the smaller item; an item given more than once counts with its highest score. Rows with
null group, item or score, and NaN scores, are no candidates. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwood.session import parallelism

HELD = 100_000  # rows a task prunes together


class LoserTree:
    """Tournament of the heads of sorted runs: the inner nodes hold losers, ``winner`` the least head."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(1, self.k)
        self.winner = -1
        for run in range(self.k):
            self._enter(run)

    def _less(self, a: int, b: int) -> bool:
        x = self.runs[a][self.at[a]] if self.at[a] < len(self.runs[a]) else None
        y = self.runs[b][self.at[b]] if self.at[b] < len(self.runs[b]) else None
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _enter(self, run: int) -> None:
        """First match of a run: it waits at the first free node on its way up."""
        node = (run + self.k) // 2
        while node >= 1:
            if self.tree[node] < 0:
                self.tree[node] = run
                return
            if self._less(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.winner = run

    def head(self) -> tuple | None:
        run = self.winner
        return self.runs[run][self.at[run]] if run >= 0 and self.at[run] < len(self.runs[run]) else None

    def advance(self) -> None:
        """Take the winner's head off and replay its path."""
        run = self.winner
        self.at[run] += 1
        node = (run + self.k) // 2
        while node >= 1:
            if self._less(self.tree[node], run):
                self.tree[node], run = run, self.tree[node]
            node //= 2
        self.winner = run


def merge(runs: list[list[tuple]], n: int) -> list[tuple]:
    """First n entries with distinct items of sorted runs of (-score, item)."""
    if len(runs) == 1:
        return runs[0][:n]  # a run's items are distinct
    tree, out, seen = LoserTree(runs), [], set()
    while len(out) < n and (head := tree.head()) is not None:
        if head[1] not in seen:
            seen.add(head[1])
            out.append(head)
        tree.advance()
    return out


def _groups(table: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Starts of the stretches of equal keys in a sorted batch, and its end."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for name in names:
        codes = table[name].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut at group ends where a group fits; a longer group comes in several batches."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        cut = int(_groups(batch, names)[-2])
        if cut:
            yield batch[:cut]
        rest = batch[cut:]
    if rest is not None and rest.num_rows:
        yield rest


def pruned(table: pa.RecordBatch, keys: list[str], n: int) -> pa.RecordBatch:
    """The rows of each group's n best items, each item once with its highest score."""
    group = np.zeros(table.num_rows, np.int64)
    for key in keys:
        codes = table[key].dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    score, item = table["__score"].to_numpy(zero_copy_only=False), table["__item"].to_numpy(zero_copy_only=False)
    order = np.lexsort((-score, item, group))
    g, i = group[order], item[order]
    order = order[np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]))]  # each item of a group once
    order = order[np.lexsort((item[order], -score[order], group[order]))]
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return table.take(pa.array(order[rank < n]))


def _prune(keys: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= HELD:
                yield pruned(pa.Table.from_batches(held).combine_chunks().to_batches()[0], keys, n)
                held, rows = [], 0
        if held:
            yield pruned(pa.Table.from_batches(held).combine_chunks().to_batches()[0], keys, n)

    return run


def _scan(keys: list[str], n: int):
    """Keep the first n distinct items of each group of a sorted run."""
    marks = [*keys, "__run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _groups(batch, marks)
            items = batch["__item"].to_numpy(zero_copy_only=False)
            take = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(batch[m][int(lo)].as_py() for m in marks) if lo == 0 or hi == batch.num_rows else None
                if key is None or key != last:
                    seen = set()
                last = key
                at = lo
                while at < hi and len(seen) < n:  # beyond n outputs: on to the next group
                    if items[at] not in seen:
                        seen.add(items[at])
                        take.append(at)
                    at += 1
            if take:
                yield batch.take(pa.array(take))

    return run


def _merge(keys: list[str], n: int):
    """Merge the runs of each group, which stand one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, keys):
            starts = _groups(batch, keys)
            runs = batch["__run"].to_numpy(zero_copy_only=False)
            scores, items = batch["__score"].to_numpy(zero_copy_only=False), batch["__item"].to_numpy(zero_copy_only=False)
            take, ranks = [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                cuts = [lo, *(np.flatnonzero(np.diff(runs[lo:hi])) + lo + 1), hi]
                parts = [[(-scores[k], items[k], k) for k in range(a, b)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                best = [x[2] for x in merge(parts, n)]
                take += best
                ranks += range(1, len(best) + 1)
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(out[k] for k in keys), out["__item"], out["__score"], pa.array(ranks, pa.int32())], names=[*keys, "item", "score", "rank"])

    return run


def top_n(rows: DataFrame, keys: list[str], item: str, score: str, n: int, runs: int | None = None) -> DataFrame:
    """(keys..., item, score, rank) of the n items with the highest scores in every group."""
    spark = rows.sparkSession
    runs = runs or parallelism(spark, 16)
    good = F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    for k in keys:
        good &= F.col(k).isNotNull()
    dealt = rows.filter(good).select(*keys, F.col(item).cast("bigint").alias("__item"), F.col(score).cast("double").alias("__score"), F.pmod(F.xxhash64(item), F.lit(runs)).cast("int").alias("__run"))
    types = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in dealt.columns)
    parts = parallelism(spark)
    order = [*keys, "__run", F.desc("__score"), "__item"]
    sorted_runs = dealt.mapInArrow(_prune(keys, n), schema).repartition(parts, *keys, "__run").sortWithinPartitions(*order).mapInArrow(_scan(keys, n), schema)
    merged = sorted_runs.repartition(parts, *keys).sortWithinPartitions(*order)
    return merged.mapInArrow(_merge(keys, n), ", ".join([*(f"`{k}` {types[k]}" for k in keys), "item bigint, score double, rank int"]))
