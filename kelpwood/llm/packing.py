"""Filling fixed-capacity containers with texts, by exact complements over counts of lengths.

Only the counts of lengths matter for a packing, and there are at most ``capacity`` of them however
many texts there are. The packing is therefore made on the counts: from the longest length down, the
gap it leaves is looked up among the single lengths, the sums of two and the sums of three that are
still available, and as many containers as the counts allow are filled exactly at once. A first pass tries
the commonest lengths by hash: of the sums of two, one length is among the ``SINGLES`` commonest, of the
sums of three, two are among the ``PAIRED`` commonest, whose sums are indexed; such a look-up costs the same
however many lengths there are. Unless this gives the least number of containers possible, a second pass
searches what is left among all lengths, so that no four lengths that fill a container are missed; which sums
exist at all is kept in a table, so most searches without a result end at once. What no combination completes
is placed by best fit, longest first, again in bulk. As the second pass may use up short lengths that best fit
needs, the one of the two packings with fewer containers is taken, the second if they have as many. The result
is a list of patterns (lengths, number of containers), at most a few per length; every text then finds its
container from its length and its rank among the texts of that length, which is counted in salted
parts, so no length is ranked by one task.

A text longer than the capacity is cut at multiples of the capacity, no other text is cut. Defined
cases: null and empty texts have no tokens, need no room and are listed with container 0; repeated
documents are packed as often as they occur; null or non-positive capacities and an empty table give
an empty result for that target. Capacities and targets may be any number; more than ``MOST_LENGTHS``
distinct lengths of pieces (a million) raise an error, as the driver plans on their counts.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpwood.session import checkpointed, parallelism

TARGETS = 64  # planned in one go
MOST_LENGTHS = 1_000_000  # distinct lengths of pieces that the driver plans a packing on
MOST_DENSE = 1 << 24  # up to this length lengths are found by a table, beyond it by search
SINGLES, PAIRED = 4096, 128  # commonest lengths in the index of two and three lengths, which are tried first
MOST_SUMS = 2_162_160  # sums are told apart up to this many, beyond it by their rest, hence its many divisors
MOST_PAIRS = 1 << 27  # beyond that, sums told apart by their rest are found by a convolution, up to it one by one
SUM_COST = 16  # look-ups that take as long as the convolution does for each sum


@lru_cache(maxsize=2)
def _encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def token_counts(documents: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of whole texts under a public byte-level vocabulary; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks, pattern).encode_ordinary
        for batch in batches:
            counts = [len(encode(x)) if x else 0 for x in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, n_tokens bigint")


class _Sums:
    """Which sums of two and of three lengths exist up to ``reach``; some that don't may be held to, as a length
    may be taken more often than there is, or sums share a rest. Lengths used up later make no new sums."""

    def __init__(self, sizes: np.ndarray, reach: int) -> None:
        sizes = sizes[sizes <= reach]
        span, pairs = reach + int(sizes.max(initial=0)) + 1, len(sizes) ** 2  # no sum up to the reach meets another one
        step = 1 << max(0, span.bit_length() - 4)
        self.reach, self.modulus = reach, min(-(-span // step) * step, MOST_SUMS)
        if pairs < SUM_COST * self.modulus or (span > MOST_SUMS and pairs < MOST_PAIRS):  # one by one, sums of three are not kept
            self.cost, self.modulus = pairs, min(span, 8 * pairs + 1, MOST_PAIRS // 2)
            self.two, self.three = np.zeros(self.modulus, bool), None
            for s in sizes:
                self.two[(s + sizes) % self.modulus] = True
            return
        self.cost = SUM_COST * self.modulus  # in look-ups
        one = np.zeros(self.modulus)
        one[sizes % self.modulus] = 1
        one = np.fft.rfft(one)
        self.two = np.fft.irfft(one * one, self.modulus) > 0.5
        if span <= self.modulus:
            self.two[reach + 1 :] = False
        self.three = np.fft.irfft(np.fft.rfft(self.two.astype(float)) * one, self.modulus) > 0.5

    def may_be_three(self, gap: int) -> bool:
        return self.three is None or bool(self.three[gap % self.modulus])


class _Lengths:
    """The distinct lengths that are left and how many of each, found by their place in ascending order."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        kept = sorted(s for s, n in counts.items() if n > 0)
        self.sizes = np.array(kept, np.int64)
        self.have = np.array([counts[s] for s in kept], np.int64)
        self.capacity, self.renewed, self.sums, self.tried = capacity, None, None, 0
        self.table = None
        if kept and kept[-1] <= MOST_DENSE:
            self.table = np.full(kept[-1] + 2, -1, np.int32)  # nothing at both ends
            self.table[self.sizes] = np.arange(len(kept))

    def place(self, size: np.ndarray) -> np.ndarray:
        """Places of lengths, -1 where there is no such length."""
        if self.table is not None:
            return self.table.take(size, mode="clip")
        at = np.minimum(np.searchsorted(self.sizes, size), len(self.sizes) - 1)
        return np.where(self.sizes[at] == size, at, -1)

    def renew(self, longest: int) -> None:
        """The index: the commonest lengths up to a place, and the sums of every two of the commonest of them."""
        if self.renewed is not None and self.renewed - longest < max(64, len(self.sizes) // 256) and longest <= self.renewed:
            return
        self.renewed = longest
        own = np.flatnonzero(self.have[: longest + 1])
        common = own[np.argsort(-self.have[own], kind="stable")]
        self.single = np.sort(common[:SINGLES])
        few = np.sort(common[:PAIRED])
        i, j = np.triu_indices(len(few))
        sums = self.sizes[few[i]] + self.sizes[few[j]]
        order = np.argsort(sums, kind="stable")
        self.pair_sum, self.pair = sums[order], (few[i][order], few[j][order])

    def _best(self, parts: tuple[np.ndarray, ...], own: int) -> tuple[int, ...] | None:
        """Of combinations of places the one that can be made most often beside ``own``."""
        spare = self.have.copy() if len(self.have) < 64 else None
        left = (lambda x: spare[x]) if spare is not None else (lambda x: self.have[x] - (x == own))
        if spare is not None:
            spare[own] -= 1
        times = np.min([left(x) for x in parts], axis=0)
        while len(times):
            k = int(np.argmax(times))
            if times[k] < 1:
                return None
            chosen = tuple(int(x[k]) for x in parts)
            if len(set(chosen)) == len(chosen) or all(self.have[c] - (c == own) >= chosen.count(c) for c in chosen):
                return chosen
            times[k] = 0
        return None

    def complement(self, gap: int, own: int) -> tuple[int, ...] | None:
        """Places of one, two or three lengths whose sum is the gap beside the length at ``own``."""
        if gap == 0:
            return ()
        one = self.place(np.array([gap]))
        if one[0] >= 0 and self.have[one[0]] - (one[0] == own) > 0:
            return (int(one[0]),)
        self.renew(own)
        x = self.single[: np.searchsorted(self.sizes[self.single], gap)]
        y = self.place(gap - self.sizes[x])
        if (ok := y >= 0).any() and (two := self._best((x[ok], y[ok]), own)):
            return two
        most = np.searchsorted(self.pair_sum, gap)
        least = np.searchsorted(self.pair_sum, gap - self.sizes[own])  # the third is not longer than the first
        z = self.place(gap - self.pair_sum[least:most])
        ok = z >= 0
        return self._best((self.pair[0][least:most][ok], self.pair[1][least:most][ok], z[ok]), own) if ok.any() else None

    def searched(self, gap: int, own: int, renewed: bool = False) -> tuple[int, ...] | None:
        """The same of two or three lengths, among all that are left."""
        if renewed or self.sums is None or gap > self.sums.reach or self._stale():
            self.sums, self.tried = _Sums(self.sizes[: own + 1][self.have[: own + 1] > 0], min(2 * gap, self.capacity)), 0
        sums = self.sums
        pair, triple = sums.two[gap % sums.modulus], sums.may_be_three(gap)
        if not (pair or triple):
            return None
        left = np.flatnonzero(self.have[: min(own + 1, np.searchsorted(self.sizes, gap))])
        sizes = self.sizes[left]

        def two(gap: int, longest: int, *beside: int) -> tuple[int, ...] | None:
            x = left[np.searchsorted(sizes, gap - longest) : np.searchsorted(sizes, gap // 2, side="right")]
            z = self.place(gap - self.sizes[x])
            self.tried += len(x) + 100  # a call costs as much as about 100 look-ups
            x, z = x[z >= 0], z[z >= 0]
            return self._best((*(np.full(len(x), k) for k in beside), x, z), own) if len(x) else None

        if pair and (found := two(gap, int(self.sizes[own]))):
            return found
        if triple:
            first = left[np.searchsorted(sizes, -(-gap // 3)) :]  # the longest of the three
            self.tried += len(first)
            first = first[sums.two[(gap - self.sizes[first]) % sums.modulus]]
            for k in first[np.argsort(-self.have[first], kind="stable")].tolist():
                if found := two(gap - int(self.sizes[k]), int(self.sizes[k]), k):
                    return found
                if not renewed and self._stale():
                    return self.searched(gap, own, renewed=True)
        return None

    def _stale(self) -> bool:
        """If more look-ups were made since the sums were than their making costs."""
        return self.tried > self.sums.cost


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one container, number of such containers) that use up the counts."""
    left = _Lengths({s: n for s, n in counts.items() if s > 0}, capacity)
    sizes, have = left.sizes, left.have
    least = max(-(-sum(map(int.__mul__, sizes.tolist(), have.tolist())) // capacity), int(have[2 * sizes > capacity].sum()))
    quick = _complete(left, left.complement)
    first = quick + _best_fit(sizes, have.copy(), capacity)
    if sum(n for _, n in first) == least:  # no packing has fewer
        return first
    # what the commonest lengths don't complete, among all lengths; it may use up short lengths that best fit needs
    second = quick + _complete(left, left.searched)
    second += _best_fit(sizes, have, capacity)
    return min(second, first, key=lambda patterns: sum(n for _, n in patterns))


def _complete(left: _Lengths, complement) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of full containers, longest length first; they are taken off the counts that are left."""
    sizes, have, capacity = left.sizes, left.have, left.capacity
    patterns: list[tuple[tuple[int, ...], int]] = []
    for at in range(len(sizes) - 1, -1, -1):
        size = int(sizes[at])
        if 4 * size < capacity:  # four of the longest left don't fill a container
            break
        while have[at]:
            rest = complement(capacity - size, at)
            if rest is None:
                break
            each: dict[int, int] = defaultdict(int)
            for k in (at, *rest):
                each[k] += 1
            n = min(int(have[k]) // c for k, c in each.items())
            for k, c in each.items():
                have[k] -= n * c
            patterns.append(((size, *(int(sizes[k]) for k in rest)), n))
    return patterns


def _best_fit(sizes: np.ndarray, have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of all that is left, longest first: open containers by their gap, the gaps in ascending order."""
    patterns: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(held: tuple[int, ...], n: int, gap: int) -> None:
        if gap < 1:
            patterns.append((held, n))
            return
        if not open_[gap]:
            insort(gaps, gap)
        open_[gap].append((held, n))

    for at in range(len(sizes) - 1, -1, -1):
        size = int(sizes[at])
        while have[at]:
            fit = bisect_left(gaps, size)
            if fit == len(gaps):
                # as many as fit together in one container, in all containers but the last
                each = min(capacity // size, int(have[at]))
                held, n, gap, k = (), int(have[at]) // each, capacity, each
            else:
                gap = gaps[fit]
                held, most = open_[gap].pop()
                k = min(gap // size, int(have[at]))
                n = min(most, int(have[at]) // k)
                if n < most:
                    open_[gap].append((held, most - n))
                if not open_[gap]:
                    del gaps[fit]
            have[at] -= k * n
            put((*held, *(size,) * k), n, gap - k * size)
    return patterns + [p for own in open_.values() for p in own]


class Plan:
    """Where the texts of every length go: for a target and length, stretches of ranks."""

    def __init__(self, packings: dict[int, list[tuple[tuple[int, ...], int]]]) -> None:
        slots: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        taken: dict[tuple[int, int], int] = defaultdict(int)
        for target, patterns in packings.items():
            base = 0
            for sizes, m in patterns:
                for s in sizes:
                    slots[target, s].append((taken[target, s], base))
                    taken[target, s] += m
                base += m
        self.slots = {k: np.array(v, np.int64).T for k, v in slots.items()}

    def containers(self, target: int, size: int, ranks: np.ndarray) -> np.ndarray:
        start, base = self.slots[target, size]
        at = np.searchsorted(start, ranks, side="right") - 1
        return base[at] + ranks - start[at]


def _assign(plan: Plan, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target, size, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("target_id", "n_tokens", "rank"))
            out = np.zeros(len(target), np.int64)
            order = np.lexsort((size, target))
            cuts = np.flatnonzero((np.diff(target[order]) != 0) | (np.diff(size[order]) != 0)) + 1
            for rows in np.split(order, cuts):
                if len(rows) and size[rows[0]] > 0:
                    out[rows] = plan.containers(int(target[rows[0]]), int(size[rows[0]]), rank[rows])
            yield pa.RecordBatch.from_arrays([batch["target_id"], pa.array(out), batch[key], batch["piece"], batch["token_start"], batch["n_tokens"]], names=["target_id", "container", key, "piece", "token_start", "n_tokens"])

    return run


def pack(counted: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(target_id, container, key, piece, token_start, n_tokens): every piece of every text.

    counted: (key, n_tokens); it is read twice, so store it if it is dear to make.
    """
    wanted = targets.filter("target_id is not null and capacity_tokens >= 1").groupBy("target_id").agg(F.max("capacity_tokens").alias("capacity")).orderBy("target_id").toLocalIterator()
    out = []
    while (part := {r["target_id"]: r["capacity"] for r in islice(wanted, TARGETS)}) or not out:
        out.append(_pack(counted, part, key))
    return reduce(DataFrame.unionByName, out)


def _pack(counted: DataFrame, capacities: dict[int, int], key: str) -> DataFrame:
    table = F.explode(F.create_map(*[x for t, c in capacities.items() for x in (F.lit(t).cast("int"), F.lit(c).cast("bigint"))])) if capacities else F.explode(F.lit(None).cast("map<int, bigint>"))
    n = F.coalesce("n_tokens", F.lit(0).cast("bigint"))
    each = counted.select(key, n.alias("all"), table.alias("target_id", "capacity"))
    last = F.greatest(F.ceil(F.col("all") / F.col("capacity")) - 1, F.lit(0))
    pieces = each.select(key, "target_id", "capacity", "all", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(key, "target_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.least("capacity", F.col("all") - F.col("piece") * F.col("capacity")).alias("n_tokens"))
    salt = parallelism(counted.sparkSession)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(key, "piece"), F.lit(salt)).cast("int"))
    kinds = pieces.groupBy("target_id", "n_tokens", "part").count()
    # the counts by length: one row a length
    rows = kinds.groupBy("target_id", "n_tokens").agg(F.sum("count").alias("n")).filter("n_tokens > 0").limit(MOST_LENGTHS + 1).toPandas()
    if len(rows) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} distinct lengths of pieces")
    counts = {int(t): dict(zip(own["n_tokens"].tolist(), own["n"].tolist(), strict=True)) for t, own in rows.groupby("target_id")}
    plan = Plan({t: pack_counts(c, capacities[t]) for t, c in counts.items()})
    before = kinds.withColumn("before", F.sum("count").over(Window.partitionBy("target_id", "n_tokens").orderBy("part")) - F.col("count")).drop("count")
    own = Window.partitionBy("target_id", "n_tokens", "part").orderBy(key, "piece")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(before, ["target_id", "n_tokens", "part"]).withColumn("rank", F.col("before") + F.col("own"))
    kind = counted.schema[key].dataType.simpleString()
    return ranked.select("target_id", key, "piece", "token_start", "n_tokens", "rank").mapInArrow(_assign(plan, key), f"target_id int, container bigint, `{key}` {kind}, piece bigint, token_start bigint, n_tokens bigint")


def pack_documents(documents: DataFrame, targets: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Packing of whole texts; their token counts are stored once in the checkpoint folder."""
    return pack(checkpointed(token_counts(documents, ranks, pattern)), targets)


def fill_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Containers, tokens and share filled of each target, and the least number of containers possible."""
    per = packed.filter("n_tokens > 0").groupBy("target_id", "container").agg(F.sum("n_tokens").alias("held")).groupBy("target_id").agg(F.count("*").alias("n_containers"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
    capacity = F.col("capacity_tokens")
    return per.join(targets, "target_id").select("target_id", "n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("filled"))


def violations(packed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per target what every packing must keep: documents packed, and how many containers are too full, texts are
    cut though they fit, or have pieces missing, given twice or not adjoining (all 0)."""
    capacity = targets.filter("target_id is not null and capacity_tokens >= 1").groupBy("target_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    full = packed.filter("n_tokens > 0").groupBy("target_id", "container").agg(F.sum("n_tokens").alias("held")).join(capacity, "target_id")
    over = full.groupBy("target_id").agg(F.sum((F.col("held") > F.col("capacity")).cast("bigint")).alias("n_too_full"))
    texts = packed.groupBy("target_id", key).agg(F.count("*").alias("n"), F.countDistinct("piece").alias("d"), F.max("piece").alias("last"), F.sum("n_tokens").alias("all"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end")).join(capacity, "target_id")
    cut = (F.col("n") > 1) & (F.col("all") <= F.col("capacity"))
    apart = (F.col("n") != F.col("d")) | (F.col("last") + 1 != F.col("n")) | (F.col("end") != F.col("all"))
    per = texts.groupBy("target_id").agg(F.count("*").alias("n_documents"), F.sum(cut.cast("bigint")).alias("n_cut"), F.sum(apart.cast("bigint")).alias("n_broken"))
    return per.join(over, "target_id").select("target_id", "n_documents", "n_too_full", "n_cut", "n_broken")
