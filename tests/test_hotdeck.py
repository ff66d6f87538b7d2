from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from kelpwood.operators import hotdeck as H

CONTEXT = "file_id int, missing_strings array<string>, label string"
RECORD = "idx long, file_id int, subject_id long, split string, source string, label string, series array<array<double>>, missing_indices array<array<int>>, recorded_at timestamp, arrived_at timestamp, cells string"
T = datetime(2025, 1, 1)


def record(idx, series, missing=None, label="up", file=1, at=T):
    return (idx, file, 1, "train", "s", label, series, missing, at, at, "clash")


@pytest.fixture(scope="module")
def context(spark):
    return spark.createDataFrame([(1, ["NA", "-9", ""], "clash"), (2, None, None)], CONTEXT)


def test_cells_and_values(spark, context):
    nan = float("nan")
    rows = [record(i, [[1.0 * i, 2.0, 3.0], [5.0, 6.0, 7.0]]) for i in range(10, 20)]
    rows += [record(1, [[None, nan, -9.0], [5.0, 6.0, 7.0]], [[0], [1, 99, -1]]), record(1, [[None, nan, -9.0], [5.0, 6.0, 7.0]], [[0], [1, 99, -1]]), record(2, [[1.0, 2.0, 3.0], [5.0, 6.0, 7.0]], None, " na "), record(3, None, None, None), record(4, [], None, ""), record(5, [None, [None]], [None, None], None, 2), record(6, [[1.0]], [[0]], "x", 7), record(None, [[1.0]], None)]
    frame = spark.createDataFrame(rows, RECORD)
    out = H.hot_deck(frame, context)
    got = {r["idx"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, *range(10, 20)]
    cells = {(r["idx"], r["field"], r["channel"], r["pos"]) for r in H.filled_cells(out).collect()}
    assert cells == {(1, "series", 0, 0), (1, "series", 0, 1), (1, "series", 0, 2), (1, "series", 1, 1), (2, "label", -1, -1), (3, "label", -1, -1), (4, "label", -1, -1), (5, "series", 1, 0), (5, "label", -1, -1), (6, "series", 0, 0)}
    assert got[1]["series"][1] == [5.0, 6.0, 7.0] and got[1]["series"][0][1:] == [2.0, 3.0]  # donors agree there
    assert got[2]["label"] == "up" and got[3]["label"] == "up" and got[5]["label"] == "unknown" and got[6]["series"] == [[0.0]]
    assert got[10]["series"] == [[10.0, 2.0, 3.0], [5.0, 6.0, 7.0]] and not got[10]["filled"]  # observed values stay
    assert all(f["donors"] for f in got[1]["filled"])


def test_hot_block_is_split_and_stays_whole(spark, context):
    rows = [record(i, [[float(i % 5), None if i % 50 == 0 else 1.0]]) for i in range(1500)]
    out = H.hot_deck(spark.createDataFrame(rows, RECORD), context, window=20, parts=5)
    assert out.count() == 1500
    assert {r["value"] for r in H.filled_cells(out).collect()} == {1.0} and H.filled_cells(out).count() == 30


def test_empty(spark, context):
    frame = spark.createDataFrame([], RECORD)
    assert H.hot_deck(frame, context).count() == 0
    one = spark.createDataFrame([record(1, [[None, 2.0]])], RECORD)
    assert H.hot_deck(one, context.limit(0)).first()["series"] == [[2.0, 2.0]]


def mixed_records(n, seed=4):
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        wave = np.sin(np.arange(10 + i % 3) * random.uniform(0.2, 0.8) + random.uniform(0, 6))
        m = (random.uniform(0.5, 2, (2, 1)) * wave + random.normal(size=(2, len(wave))) * 0.05).tolist()
        if i % 4 == 0:
            m[0][i % 10] = m[1][(i // 4) % 10] = None
        rows.append(record(i, m, None, None if i % 11 == 0 else f"l{i % 2}", 1, T + timedelta(hours=int(random.integers(2000)))))
    return rows


def cells(filled):
    return {(r["idx"], r["field"], r["channel"], r["pos"]): (r["value"], r["label"], tuple(r["donors"])) for r in H.filled_cells(filled).collect()}


def brute(spark, frame, context, k=5):
    """The closest donors of every cell among all records, by an exhaustive search of the whole file."""
    everywhere = cells(H.hot_deck(frame, context, k, window=3000, parts=1))
    return {c: set(d) for c, (_, _, d) in everywhere.items()}


def test_recall(spark, context):
    frame = spark.createDataFrame(mixed_records(3000), RECORD)
    want = brute(spark, frame, context)
    for parts in (1, 7):
        got = cells(H.hot_deck(frame, context, parts=parts))
        assert set(got) == set(want) and all(len(d) == len(set(d)) == 5 for _, _, d in got.values())
        assert sum(len(want[c] & set(got[c][2])) for c in want) >= 0.9 * sum(len(d) for d in want.values())


def test_small_blocks_are_exact_and_the_rest_is_searched_everywhere(spark, context):
    lone = spark.createDataFrame([record(i, [[float(i), float(i + 1)]], None, None if i == 500 else f"x{i}") for i in range(1000)], RECORD)
    assert H.filled_cells(H.hot_deck(lone, context)).first()["donors"] == [499, 501, 498, 502, 497]
    # only seven records, far from each other, observe the channel that the others miss
    few = {3, 250, 500, 600, 750, 980, 999}
    rows = [record(i, [[float(i), float(i + 1)], [1.0 if i in few else None, 1.0]], None, "a") for i in range(1000)]
    got = cells(H.hot_deck(spark.createDataFrame(rows, RECORD), context, window=20))
    assert len(got) == 993 and got[610, "series", 1, 0][2] == (600, 500, 750, 250, 980) and all(len(d) == 5 for _, _, d in got.values())


def test_better_than_the_mean(spark, context):
    random = np.random.default_rng(8)
    rows, held = [], {}
    for i in range(800):
        m = (np.sin(np.arange(16) / 3 + random.uniform(0, 6)) * random.uniform(1, 3) + random.normal(size=16) * 0.05).tolist()
        if i % 3 == 0:
            held[i] = (i % 16, m[i % 16])
            m[i % 16] = None
        rows.append(record(i, [m]))
    got = {r["idx"]: r["series"][0] for r in H.hot_deck(spark.createDataFrame(rows, RECORD), context).collect()}
    error = np.mean([abs(got[i][p] - v) for i, (p, v) in held.items()])
    means = {i: np.mean([x for x in rows[i][6][0] if x is not None]) for i in held}
    assert error < 0.25 * np.mean([abs(means[i] - v) for i, (_, v) in held.items()])
