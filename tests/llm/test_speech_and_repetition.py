from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpwood.llm.repetition import contested, measure, posteriors, repetition
from kelpwood.llm.speech import speech

CUES = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Hello</i> (door\r\nslams) there\r\n\r\n2\r\n00:00:03,000 -> 00:00:04,000 align:start\r\n{\\an8}ANNA: 42\r\n1999\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\n[music] * steps * ♪ la ♪"


def words(text):
    return re.findall(r"[^\W_]+", text)


def test_speech():
    got = speech(pa.array([CUES, None, "", "WEBVTT\n\n00:01.000 --> 00:02.000\nHi", "no cues at all", "﻿1\n00:00:01,000 --> 00:00:02,000\n- (open bracket\n\n2\n00:00:02,000 --> 00:00:03,000\nclosed) now"])).to_pylist()
    assert words(got[0]) == ["Hello", "there", "ANNA", "42", "1999", "la"] and words(got[1]) == words(got[2]) == []
    assert words(got[3]) == ["Hi"] and words(got[4]) == ["no", "cues", "at", "all"] and words(got[5]) == ["open", "bracket", "closed", "now"]


def naive(ws):
    seen, again = {}, set()
    for k in range(len(ws) - 4):
        run = tuple(ws[k : k + 5])
        if run in seen:
            again |= set(range(k, k + 5))
        seen.setdefault(run, k)
    return len(again)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "C", "c.", "d-e", "é"]), max_size=30).map(" ".join), max_size=6))
def test_share(texts):
    got = measure(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        ws = words(t.lower())
        assert got["n_words"][k] == len(ws) and got["n_repeated"][k] == naive(ws)


def test_documents(spark):
    same, fresh = "say it again my old friend. ", " ".join(f"w{k}" for k in range(300))
    rows = [(i, same * 20, 0.5, "x") for i in range(8)] + [(i, f"{fresh} {i}", 0.5, "x") for i in range(10, 40)] + [(50, None, None, None), (51, "", None, None), (52, "word " * 300_000, 0.1, ""), (None, "few words", 0.0, ""), (10, fresh, 0.5, "x")]
    got = repetition(spark.createDataFrame(rows, "doc_id long, text string, share double, pattern string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["repetitive"] and by[i]["chance"] > 0.5 and by[i]["share"] > 0.9 for i in (*range(8), 52)) and not any(by[i]["repetitive"] or by[i]["chance"] > 0.05 for i in range(11, 40))
    assert by[50]["n_words"] == by[51]["n_words"] == 0 and not by[50]["repetitive"]
    assert repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posteriors():
    generator = np.random.default_rng(3)
    truth = generator.random(20_000) < 0.04
    right = (0.99, 0.9, 0.85, 0.8, 0.7)
    counts, hits = {}, {}
    for yes in truth:
        pattern = "".join("2" if generator.random() < 0.2 else str(int(yes == (generator.random() < r))) for r in right)
        counts[pattern] = counts.get(pattern, 0) + 1
        hits[pattern] = hits.get(pattern, 0) + int(yes)
    got, chance = posteriors(counts)
    # the rules' accuracies are found from the votes alone
    for r, p in enumerate(right):
        assert abs(chance[0, r, 0] / chance[0, r, :2].sum() - p) < 0.03 and abs(chance[1, r, 1] / chance[1, r, :2].sum() - p) < 0.12
    wrong = sum(min(hits[p], counts[p] - hits[p]) if 0.4 < got[p] < 0.6 else (hits[p] if got[p] < 0.5 else counts[p] - hits[p]) for p in counts)
    assert wrong < 0.01 * len(truth) and posteriors({})[0] == {}
    # no rule has the last word: a lone vote is outvoted, and its pattern contested
    assert got["10000"] < 0.5 and contested("10000", got["10000"]) and not contested("00000", got["00000"]) and not contested("11111", got["11111"])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("012", min_size=5, max_size=5), st.integers(1, 10**9), max_size=30))
def test_any_counts(counts):
    got, _ = posteriors(counts)
    assert set(got) == set(counts) and all(0 <= x <= 1 for x in got.values())
    # what is decided without the share never contradicts it
    assert all(contested(p, x) or (x >= 0.5 and p[0] != "0") or (x < 0.5 and p[0] != "1") for p, x in got.items())
