from __future__ import annotations

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpwood.llm.topn import merge, pruned, top_n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 9)), max_size=8), min_size=1, max_size=9), st.integers(1, 6))
def test_merge(parts, n):
    runs = []
    for part in parts:  # a run: sorted, its items distinct
        best = {}
        for score, item in sorted(part):
            best.setdefault(item, (score, item))
        runs.append(sorted(best.values()))
    want, seen = [], set()
    for score, item in sorted(x for r in runs for x in r):
        if item not in seen:
            seen.add(item)
            want.append((score, item))
    assert merge(runs, n) == want[:n]


def test_against_brute_force(spark):
    random.seed(1)
    rows = [(random.choice([1, 1, 1, 2, 3]), random.randrange(300), random.randrange(20) / 10) for _ in range(4000)]
    rows += [(None, 1, 1.0), (1, None, 9.0), (1, 5, None), (2, 6, float("nan")), (4, 7, 0.5), (4, 7, 0.5)]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], "g int, j long, s double, rank string, __run int")
    got = sorted((r["g"], r["rank"], r["item"], r["score"]) for r in top_n(frame, ["g"], "j", "s", 5, runs=4).collect())
    want = []
    for g in {r[0] for r in rows if r[0] is not None}:
        best = {}
        for k, j, s in rows:
            if k == g and j is not None and s is not None and s == s:
                best[j] = max(best.get(j, -1), s)
        order = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        want += [(g, n + 1, j, s) for n, (j, s) in enumerate(order)]
    assert got == sorted(want)
    assert top_n(frame.limit(0), ["g"], "j", "s", 5).count() == 0


def test_batches_of_one_group(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = spark.range(500).selectExpr("'a' as g", "'b' as h", "id % 250 as j", "double(id % 10) as s")
        got = [(r["item"], r["score"]) for r in top_n(frame, ["g", "h"], "j", "s", 6, runs=3).orderBy("rank").collect()]
        assert got == [(9 + 10 * k, 9.0) for k in range(6)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2), st.integers(0, 6), st.integers(-3, 3)), min_size=1, max_size=40), st.integers(1, 4))
def test_pruning_keeps_the_best(rows, n):
    table = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([float(r[3]) for r in rows])], names=["g", "h", "__item", "__score"])
    got = {(r["g"], r["h"], r["__item"], r["__score"]) for r in pruned(table, ["g", "h"], n).to_pylist()}
    want = set()
    for key in {r[:2] for r in rows}:
        best = {}
        for r in rows:
            if r[:2] == key:
                best[r[2]] = max(best.get(r[2], -9), r[3])
        want |= {(*key, i, float(s)) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]}
    assert got == want
