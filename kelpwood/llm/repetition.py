"""Repetition inside a single document, judged by weak supervision.

One pass over the texts measures each document's repetition: words in a run of ``RUN`` words that
occurred earlier in the document, repeated cues and lines, the commonest three-word run, distinct words. The
measures, a few numbers a document, are stored once. Rules turn them into votes (repetitive, not, or
abstain). Expectation-maximisation on the counts of vote patterns, of which there are at most 3 ** rules,
estimates how accurate each rule is, all rules alike; the posterior of its pattern is a document's
probability of being repetitive. The counts cover every document and only they go to the driver.

The posterior decides where it is sure (at most ``SURE`` from 0 or 1) and no vote contradicts it. The other
patterns are ``contested``; ``repetitive`` settles their documents by the exact share.

Defined cases: null and empty texts have 0 words, share 0 and abstain everywhere; documents given
twice are judged twice; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwood.llm.speech import speech, split_words
from kelpwood.session import checkpointed

RUN = 5
MEASURES = ("share", "cue_share", "line_share", "top_share", "distinct_share")
SHARE = 2, 5  # repeated words of all words from which a document is repetitive, 0.4
SURE = 0.02
#: Rule: measure, votes "repetitive" from here, votes "not" up to here (the last reads the other way). The
#: share of repeated words votes besides, from SHARE on "repetitive", else "not".
RULES = (("cue_share", 0.3, 0.05), ("line_share", 0.3, 0.1), ("top_share", 0.05, 0.02), ("distinct_share", 0.35, 0.6))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(codes: np.ndarray, rows: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words within one row, and where they start."""
    n = len(codes) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = (h ^ codes[k : k + n]) * _MIX
            h ^= h >> np.uint64(29)
        h = (h ^ rows[:n].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(rows[:n] == rows[run - 1 :])
    return h[at], at


def _later(keys: np.ndarray) -> np.ndarray:
    """Whether the same key occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def _repeated(words: pa.Array, rows: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Share of each row's pieces that occurred earlier in the row."""
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    keys, at = _keys(codes, rows, 1)
    weight = np.ones(len(rows)) if weight is None else weight
    total = np.bincount(rows, weight, n)
    return np.bincount(rows[at], _later(keys) * weight[at], n) / np.maximum(total, 1)


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """n_words, n_repeated and MEASURES of each text."""
    n = len(text)
    said = pc.utf8_lower(speech(text))
    words, rows = split_words(said)
    rows = rows.to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    total = np.bincount(rows, minlength=n)
    keys, at = _keys(codes, rows, RUN)
    steps = np.zeros(len(codes) + 1, np.int64)
    again = at[_later(keys)]
    np.add.at(steps, again, 1)
    np.add.at(steps, again + RUN, -1)
    repeated = np.bincount(rows, np.cumsum(steps[:-1]) > 0, n).astype(np.int64)
    triples, where = _keys(codes, rows, 3)
    _, first, count = np.unique(triples, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, rows[where[first]], np.where(count > 1, count, 0))
    single, at1 = _keys(codes, rows, 1)
    distinct = np.bincount(rows[at1], ~_later(single), n)
    out = {"n_words": total.astype(np.int64), "n_repeated": repeated, "share": repeated / np.maximum(total, 1)}
    for name, apart in (("cue_share", r"\x01"), ("line_share", r"[\x01\n]+")):
        pieces, own = split_words(said, apart)
        pieces = pc.replace_substring_regex(pieces, r"[^\pL\pN]+", " ")
        size = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(float)
        out[name] = _repeated(pieces, own.to_numpy(zero_copy_only=False).astype(np.int64), n, size)
    return out | {"top_share": 3 * top / np.maximum(total, 1), "distinct_share": distinct / np.maximum(total, 1)}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole[at : at + 1000]
            found = measure(batch["text"])
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(found[c]) for c in ("n_words", "n_repeated", *MEASURES))], names=[*kept, "n_words", "n_repeated", *MEASURES])


def measures(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_repeated and MEASURES. No shuffle."""
    kind = documents.schema[key].dataType.simpleString()
    ready = documents.select(F.col(key), F.col(text).alias("text"))
    return ready.mapInArrow(_measured, f"`{key}` {kind}, n_words bigint, n_repeated bigint, " + ", ".join(f"{m} double" for m in MEASURES))


def _repeats() -> Column:
    """Whether the exact share is at least SHARE, in whole numbers."""
    part, of = SHARE
    return (F.col("n_words") > 0) & (of * F.col("n_repeated") >= part * F.col("n_words"))


def with_votes(measured: DataFrame) -> DataFrame:
    """``pattern``: one digit a rule, 1 repetitive, 0 not, 2 abstains; the first is that of the share."""
    digits = [F.when(F.col("n_words") == 0, "2").when(_repeats(), "1").otherwise("0")]
    for name, high, low in RULES:
        m = F.col(name)
        yes, no = (m >= high, m <= low) if high > low else (m <= high, m >= low)
        digits.append(F.when(F.col("n_words") == 0, "2").when(yes, "1").when(no, "0").otherwise("2"))
    return measured.withColumn("pattern", F.concat(*digits))


def posteriors(counts: dict[str, int], rounds: int = 500) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of "repetitive" of each vote pattern, by expectation-maximisation, and the estimated chances
    [class, rule, vote] of each rule to vote 0, 1 or abstain in either class.

    All rules start alike, from the majority of the votes; no chance is ever 0 or 1.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((2, 0, 3))
    votes = np.array([[int(x) for x in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    one, zero = (votes == 1).sum(1), (votes == 0).sum(1)
    post = (one + 0.2) / (one + zero + 1)  # few documents are repetitive where nothing votes
    cast = (votes[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        chance = (np.einsum("yp,prv->yrv", weight, cast) + 0.1) / (weight.sum(1)[:, None, None] + 0.3)
        log = np.log(prior)[:, None] + np.einsum("prv,yrv->yp", cast, np.log(chance))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(patterns, post.tolist(), strict=True)), chance


def contested(pattern: str, posterior: float) -> bool:
    """Whether the posterior of a pattern is unsure, one of its votes contradicts it, or none supports it."""
    votes = set(pattern) - {"2"}
    return not (posterior <= SURE and votes == {"0"} or posterior >= 1 - SURE and votes == {"1"})


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_repeated, share, ``chance``, the posterior, ``contested``, and
    ``repetitive``, the judgement.

    The texts are read once, their measures kept in the checkpoint folder; nothing is shuffled but the
    counts of patterns.
    """
    voted = with_votes(checkpointed(measures(documents, key, text)))
    counts = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}  # at most 3 ** rules
    post, _ = posteriors(counts)
    judged = F.create_map(*[x for p, v in post.items() for x in (F.lit(p), F.struct(F.lit(v).alias("chance"), F.lit(contested(p, v)).alias("contested")))]) if post else F.lit(None).cast("map<string, struct<chance: double, contested: boolean>>")
    known = voted.withColumn("judged", F.element_at(judged, F.col("pattern")))
    decided = F.when(F.col("judged.contested"), _repeats()).otherwise(F.col("judged.chance") >= 0.5)
    return known.select(key, "n_words", "n_repeated", "share", "judged.chance", "judged.contested", decided.alias("repetitive"))
