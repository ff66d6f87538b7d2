"""Exact nearest rows of a stated query set, in blocks.

Queries and rows are dealt into blocks and parts of bounded size; each (block, part) is compared in one
group with numpy and hands on only each query's k nearest, so no pair is shuffled; every row is, once for
each ``block_rows`` queries. The work is queries times rows: use it for stated query sets and as a yardstick for approximate search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwood.functions import distances as D


def masked_matrix(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances over the positions observed (not NaN) in both; inf where there are none."""
    qo, xo = ~np.isnan(q), ~np.isnan(x)
    q0, x0 = np.where(qo, q, 0), np.where(xo, x, 0)
    d = (q0 * q0) @ xo.T.astype(float) + qo.astype(float) @ (x0 * x0).T - 2 * q0 @ x0.T
    return np.where(qo.astype(float) @ xo.T.astype(float) > 0, np.maximum(d, 0), np.inf)


def _compare(names: tuple[str, ...], k: int):
    known = [D.get(n) for n in names]

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(queries) and len(rows):
            arrays = lambda s: [np.array([np.nan if v is None else v for v in x], float) for x in s]
            q, x = arrays(queries["series"]), arrays(rows["series"])
            qi, xi = queries["idx"].to_numpy(), rows["idx"].to_numpy()
            total = np.full((len(q), len(x)), np.inf)
            for size in {len(v) for v in q}:
                a, b = [i for i, v in enumerate(q) if len(v) == size and size], [j for j, v in enumerate(x) if len(v) == size]
                if not a or not b:
                    continue
                mq, mx = np.stack([q[i] for i in a]), np.stack([x[j] for j in b])
                d = np.zeros((len(a), len(b)))
                for measure in known:
                    if measure.name == "euclidean":
                        d += np.sqrt(masked_matrix(mq, mx))
                        continue
                    for r in range(len(a)):
                        both = ~np.isnan(mq[r]) & ~np.isnan(mx)
                        got = D.evaluate(measure, [mq[r][o] for o in both], [mx[j][o] for j, o in enumerate(both)])
                        d[r] += np.where(np.isnan(got), np.inf, got)
                total[np.ix_(a, b)] = d
            total[qi[:, None] == xi[None]] = np.nan
            # of every query all rows up to the distance of its k-th, then these in order
            kth = np.partition(np.where(np.isnan(total), np.inf, total), min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            r, j = np.nonzero(total <= kth[:, None])
            order = np.lexsort((xi[j], total[r, j], r))
            r, j = r[order], j[order]
            first = np.searchsorted(r, np.arange(len(q)))
            kept = np.arange(len(r)) - first[r] < k
            r, j = r[kept], j[kept]
            return pd.DataFrame({"idx": qi[r], "neighbour": xi[j], "distance": total[r, j]})
        return pd.DataFrame({"idx": [], "neighbour": [], "distance": []})

    return run


def exact_nearest(queries: DataFrame, rows: DataFrame, k: int = 5, distances: tuple[str, ...] = ("euclidean",), block_rows: int = 2_000, part_rows: int = 5_000) -> DataFrame:
    """(idx, neighbour, distance, place): per query the k nearest other rows by the sum of the masked
    distances, ties to the smaller idx. Series of other lengths are infinitely far."""
    own = lambda df: df.filter("idx is not null and series is not null").select(F.col("idx").cast("bigint").alias("idx"), F.col("series").alias("series"))
    queries, rows = own(queries), own(rows)
    blocks, parts = max(1, math.ceil(queries.count() / block_rows)), max(1, math.ceil(rows.count() / part_rows))
    dealt = lambda n: F.pmod(F.xxhash64("idx"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = queries.withColumn("block", dealt(blocks)).withColumn("part", every(parts))
    x = rows.withColumn("part", dealt(parts)).withColumn("block", every(blocks))
    near = q.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInPandas(_compare(distances, k), "idx bigint, neighbour bigint, distance double")
    best = near.groupBy("idx").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("best"))  # parts * k
    return best.select("idx", F.posexplode("best").alias("at", "b")).select("idx", F.col("b.neighbour").alias("neighbour"), F.col("b.distance").alias("distance"), (F.col("at") + 1).alias("place"))
