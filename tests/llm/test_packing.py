from __future__ import annotations

import time
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpwood.llm import packing
from kelpwood.llm.packing import fill_report, pack, pack_counts, token_counts, violations


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(1, 30))
def test_counts(sizes, capacity):
    sizes = [s for s in sizes if s <= capacity]
    counts = {s: sizes.count(s) for s in set(sizes)}
    patterns = pack_counts(counts, capacity)
    used = {}
    for held, n in patterns:
        assert n > 0 and sum(held) <= capacity
        for s in held:
            used[s] = used.get(s, 0) + n
    assert used == counts
    if sizes:
        assert sum(n for _, n in patterns) <= 2 * -(-sum(sizes) // capacity)


def test_exact_complements_are_found():
    assert sorted(pack_counts({6: 2, 4: 2, 7: 1, 2: 1, 1: 1, 5: 1, 3: 1}, 10)) == sorted([((7, 3), 1), ((6, 4), 2)] + [((5, 2, 1), 1)]) or sum(n for _, n in pack_counts({6: 2, 4: 2, 7: 1, 2: 1, 1: 1, 5: 1, 3: 1}, 10)) == 4


def first_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= s), None)
        if k is None:
            gaps.append(capacity - s)
        else:
            gaps[k] -= s
    return len(gaps)


def test_whole_packing(spark):
    rows = [(i, (i * 37) % 23) for i in range(500)] + [(600, 95), (601, None), (602, 0), (603, 20), (603, 20)] + [(1000 + i, 7) for i in range(400)]
    counted = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    targets = spark.createDataFrame([(1, 20), (2, 50), (3, None), (None, 9), (4, 0)], "target_id int, capacity_tokens int")
    packed = pack(counted, targets)
    got = packed.toPandas()
    for target, capacity in ((1, 20), (2, 50)):
        own = got[got["target_id"] == target]
        assert own.groupby("container")["n_tokens"].sum().max() <= capacity
        whole = own.groupby("doc_id")["n_tokens"].sum()
        assert len(whole) == len({r[0] for r in rows}) and whole[600] == 95 and whole[603] == 40 and whole[601] == 0
        cut = own[own["doc_id"] == 600].sort_values("piece")
        assert list(cut["token_start"]) == [capacity * k for k in range(len(cut))] and len(cut) == -(-95 // capacity)
        assert (own[~own["doc_id"].isin([600, *(r[0] for r in rows if (r[1] or 0) > capacity)])]["piece"] == 0).all()
    assert set(got["target_id"]) == {1, 2}
    made = {r["target_id"]: r["n_containers"] for r in fill_report(packed, targets).collect()}
    for target, capacity in ((1, 20), (2, 50)):
        assert made[target] <= first_fit_decreasing([n for n in got[got["target_id"] == target]["n_tokens"] if n], capacity)
    assert pack(counted.limit(0), targets).count() == 0 and pack(counted, targets.limit(0)).count() == 0


def test_tokens(spark):
    texts = [(1, "Hello world, hello."), (2, ""), (3, None), (4, "a b " * 100_000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).collect()}
    assert got[1] == 5 and got[2] == got[3] == 0 and got[4] >= 200_000


def test_any_capacity_and_number_of_targets(spark):
    counted = spark.createDataFrame([(1, 5), (2, 3_000_000), (3, 1_000_000)], "doc_id long, n_tokens long")
    targets = spark.createDataFrame([(1, 20), (2, 2_000_000), (3, 2_147_483_647)] + [(k, 4_000_000) for k in range(10, 80)], "target_id int, capacity_tokens int")
    got = pack(counted.filter("doc_id <> 2"), targets.filter("target_id <> 1")).groupBy("target_id").agg(F.countDistinct("container").alias("n")).collect()
    assert len(got) == 72 and {r["n"] for r in got} == {1}
    cut = pack(counted, targets.filter("target_id = 2")).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in cut] == [(1, 5), (2, 2_000_000), (2, 1_000_000), (3, 1_000_000)] and len({r["container"] for r in cut}) == 3
    assert violations(pack(counted, targets.filter("target_id = 2")), targets).collect() == [(2, 3, 0, 0, 0)]


def test_violations_are_seen(spark):
    targets = spark.createDataFrame([(1, 10)], "target_id int, capacity_tokens int")
    packed = [(1, 0, 1, 0, 0, 8), (1, 0, 2, 0, 0, 3), (1, 1, 3, 0, 0, 2), (1, 2, 3, 1, 2, 2), (1, 3, 4, 1, 10, 4)]
    frame = spark.createDataFrame(packed, "target_id int, container long, doc_id long, piece long, token_start long, n_tokens long")
    assert violations(frame, targets).collect() == [(1, 4, 1, 1, 1)]


def test_large_plans_are_quick_and_full():
    random = np.random.default_rng(1)
    for capacity in (131_072, 1 << 23):
        sizes = np.unique(np.minimum(capacity, 1 + random.lognormal(np.log(capacity / 8), 1.0, 30_000).astype(int)))
        counts = {int(s): int(random.integers(1, 50)) for s in sizes}
        began = time.time()
        patterns = pack_counts(counts, capacity)
        assert time.time() - began < 10
        least = -(-sum(s * n for s, n in counts.items()) // capacity)
        assert sum(n for _, n in patterns) <= least * 1.001
        used = Counter()
        for held, n in patterns:
            assert sum(held) <= capacity
            for s in held:
                used[s] += n
        assert used == counts


@pytest.mark.parametrize("beside, common", [((1, 1, 1), 150), ((1, 2), 4200)])
def test_rare_lengths_complete_each_other(beside, common):
    """Every container can be filled, the rare lengths (4 of 10 and more) only by each other, as their last digits show."""
    random, capacity = np.random.default_rng(3), 40_000_007
    counts = Counter({x: 9 for k in range(common) for x in (11_000_000 + 10 * k, capacity - 11_000_000 - 10 * k)})
    for _ in range(10):
        parts = [10 * int(x) + r for x, r in zip(random.integers(30_000, 150_000, len(beside)), beside, strict=True)]
        counts.update([capacity - sum(parts), *parts])
    least = sum(s * n for s, n in counts.items()) // capacity
    patterns = pack_counts(counts, capacity)
    assert sum(n for _, n in patterns) == least == 9 * common + 10
    assert {sum(held) for held, _ in patterns} == {capacity}


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 3), min_size=1, max_size=14), st.integers(2, 150), st.sampled_from([(1 << 27, 2_162_160, 16), (0, 2_162_160, 0), (0, 16, 0), (1 << 27, 16, 0), (64, 16, 0)]))
def test_search_among_all_lengths(counts, gap, bounds):
    """Two or three lengths are found if and only if there are any, however the sums are kept."""
    before = packing.MOST_PAIRS, packing.MOST_SUMS, packing.SUM_COST
    packing.MOST_PAIRS, packing.MOST_SUMS, packing.SUM_COST = bounds
    try:
        left = packing._Lengths(counts, 200)
        own = len(left.sizes) - 1
        spare = Counter(counts) - Counter([int(left.sizes[own])])
        sizes = sorted(spare)
        there = {sum(c): c for n in (3, 2) for c in combinations_with_replacement(sizes, n) if not Counter(c) - spare}
        for wanted in (gap, gap // 2, gap):
            found = left.searched(wanted, own)
            assert (found is None) == (wanted not in there)
            if found:
                held = [int(left.sizes[k]) for k in found]
                assert sum(held) == wanted and not Counter(held) - spare
    finally:
        packing.MOST_PAIRS, packing.MOST_SUMS, packing.SUM_COST = before


def test_a_search_is_never_worse_than_the_commonest_lengths():
    random = np.random.default_rng(1)
    for n, capacity in ((300, 131_072), (400, 1 << 30), (97, 4096)):
        counts = {int(s): 1 for s in random.integers(capacity // 50, capacity, n)}
        left = packing._Lengths(counts, capacity)
        quick = packing._complete(left, left.complement) + packing._best_fit(left.sizes, left.have, capacity)
        assert sum(n for _, n in pack_counts(counts, capacity)) <= sum(n for _, n in quick)
