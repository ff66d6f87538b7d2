from __future__ import annotations

import numpy as np

from kelpwood.llm.overlap import cross_split_pairs, differences, fingerprints, overlap_report, window_lengths

SCHEMA = "idx long, file_id int, split string, source string, series array<array<double>>, rep string, train string"


def naive(a, b, most=3):
    best = np.inf
    size = max(a.size, b.size)
    for shift in range(-most, most + 1):
        pairs = [[(a[c, t + shift], b[c, t]) for t in range(b.shape[1]) if 0 <= t + shift < a.shape[1] and not np.isnan(a[c, t + shift]) and not np.isnan(b[c, t])] for c in range(len(a))]
        if sum(map(len, pairs)) < 0.8 * size:
            continue
        total = 0.0
        for p in pairs:
            if p:
                u, v = (np.array(x) for x in zip(*p, strict=True))
                norm = lambda x: (x - x.mean()) / x.std() if x.std() > 1e-12 else x - x.mean()
                total += ((norm(u) - norm(v)) ** 2).sum()
        best = min(best, np.sqrt(total / sum(map(len, pairs))))
    return best


def test_differences_agree_with_the_definition():
    random = np.random.default_rng(0)
    for _ in range(60):
        a, b = random.normal(size=(2, 9)), random.normal(size=(2, 9))
        a[random.random(a.shape) < 0.1], b[random.random(b.shape) < 0.1] = np.nan, np.nan
        got = differences(a[None], b[None], np.array([18]), 3, 0.8)[0][0]
        assert np.isclose(got, naive(a, b), equal_nan=True) or got == naive(a, b) == np.inf


def test_windows_always_shared():
    for n in range(1, 60):
        for m in range(int(np.ceil(0.8 * n)), n + 1):
            least = int(np.ceil(0.8 * n))
            assert any(w <= least for w in set(window_lengths(n)) & set(window_lengths(m))), (n, m)


def test_all_true_pairs(spark):
    random = np.random.default_rng(1)
    series = lambda m: [[None if np.isnan(v) else float(v) for v in c] for c in m]
    rows, arrays = [], {}
    for i in range(120):
        m = random.normal(size=(2, 20)).cumsum(1)
        rows.append((i, 1, "train", "s", series(m)))
        arrays[i] = m
        if i % 3 == 0:
            n = m[:, i % 4 :] * 2 + 5 + random.normal(size=m[:, i % 4 :].shape) * 0.02
            if i % 2:
                n[0, 3] = np.nan
            rows.append((1000 + i, 1, " Test" if i % 2 else "validation", "t", series(n)))
            arrays[1000 + i] = n
    rows += [(2000 + k, 1, "test", "t", rows[0][4]) for k in range(3)]  # copies
    rows += [(3000, 1, None, "t", rows[0][4]), (3001, 2, "test", "t", rows[0][4]), (3002, 1, "test", None, None), (3003, 1, "test", "t", []), (3004, 1, "test", "t", [None, []]), (3005, 1, "test", "t", [[None] * 20] * 2)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    found = cross_split_pairs(frame)
    got = {(r["train_idx"], r["held_idx"]) for r in found.collect()}
    want = {(t, h) for t in arrays if t < 1000 for h in arrays if h >= 1000 and naive(arrays[t], arrays[h]) <= 0.15} | {(0, 2000 + k) for k in range(3)}
    assert got == want and len(want) >= 43
    assert sum(r["n_pairs"] for r in overlap_report(found).collect()) == len(want)
    assert cross_split_pairs(frame.limit(0)).count() == 0


def test_constant_channels_do_not_gather():
    flat = np.stack([np.zeros((2, 8)), np.stack([np.zeros(8), np.arange(8.0)])])
    counts = fingerprints(flat)[2]
    assert counts.tolist() == [[True, True], [False, True]]


def test_pair_with_gaps_meets_by_the_second_code(spark):
    random = np.random.default_rng(1438)  # no block of the first codes of this pair agrees
    a = random.normal(size=(2, 20)).cumsum(1)
    b = a + random.normal(size=a.shape) * 0.02 * a.std(1, keepdims=True)
    b[random.random(b.shape) < 0.13] = np.nan
    assert naive(a, b) < 0.1
    series = lambda m: [[None if np.isnan(v) else float(v) for v in c] for c in m]
    frame = spark.createDataFrame([(1, 1, "train", "s", series(a), "clash", "clash"), (2, 1, "test", "t", series(b), "clash", "clash")], SCHEMA)
    assert [(r["train_idx"], r["held_idx"]) for r in cross_split_pairs(frame).collect()] == [(1, 2)]


def test_recall_near_the_limit(spark):
    random = np.random.default_rng(6)
    rows, pairs, k = [], [], 0
    series = lambda m: [[None if np.isnan(v) else float(v) for v in c] for c in m]
    while len(pairs) < 240:
        m = random.normal(size=(3, 22)).cumsum(1)
        unit = (m - m.mean(1, keepdims=True)) / m.std(1, keepdims=True)
        shift, noise = int(random.integers(0, 4)), random.uniform(0.05, 0.15)
        n = unit[:, shift:] + random.normal(size=unit[:, shift:].shape) * noise
        for x in (m, n):
            x[random.random(x.shape) < random.choice([0, 0.03, 0.06])] = np.nan
        held = np.pad(n, ((0, 0), (0, 22 - n.shape[1])), constant_values=np.nan)
        if 0.05 <= differences(m[None], held[None], np.array([66]), 3, 0.8)[0][0] <= 0.15:
            rows += [(k, 1, "train", "s", series(m), "", ""), (100_000 + k, 1, "test", "t", series(n), "", "")]
            pairs.append((k, 100_000 + k))
            k += 1
    found = {(r["train_idx"], r["held_idx"]) for r in cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found & set(pairs)) >= 0.97 * len(pairs)
