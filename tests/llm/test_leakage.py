from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from kelpwood.llm.leakage import Index, Spellings, leak_report, leaks, longest_run, passages, repaired, tokens

WORDS = [f"{a}{b}{c}" for a in ("mar", "tel", "vos", "kin", "dro") for b in ("a", "él", "or", "ñu") for c in ("dif", "wim", "rol", "sab", "hex")]
ITEM = "item_id long, task string, split string, lang string, passage string, answer string, doc_id string"
RUSSIAN = "Старый мельник забыл про медный чайник возле узкой пристани когда холодный ветер унёс семнадцать синих писем"
ARABIC = "نسي الطحان العجوز إبريق النحاس قرب الرصيف الضيق عندما حملت الريح الباردة سبع عشرة رسالة زرقاء"
CHINESE = "老磨坊主把铜壶忘在狭窄的码头边，冷风吹走了十七封蓝色的信。"


def cue(text):
    ws = text.split(" ")
    return "\n\n".join(f"{k}\n00:00:01,000 --> 00:00:02,000\n{' '.join(ws[i : i + 4])}" for k, i in enumerate(range(0, len(ws), 4), 1))


def item(i, passage, answer=None):
    return (i, "t", "test", "x", passage, answer, "clash")


def found(spark, docs, items, **options):
    documents = spark.createDataFrame([(*d, "clash", 1.0) for d in docs], "doc_id long, text string, item_id string, score double")
    return {(r["doc_id"], r["item_id"]): r for r in leaks(documents, spark.createDataFrame(items, ITEM), **options).collect()}


def test_leaks(spark):
    random.seed(4)
    passage = [" ".join(random.choice(WORDS) for _ in range(24)) for _ in range(30)]
    items = [(i, "t", "test", "en", p.capitalize() + ".", p.split()[3], "clash") for i, p in enumerate(passage)]
    items += [(100, "t", "test", "en", passage[0].upper(), "x", ""), (101, None, None, None, None, None, ""), (102, "t", "test", "en", "?!", None, ""), (None, "t", "test", "en", passage[1], "", "")]
    filler = lambda n: " ".join(random.choice(["the", "old", "mill", "is", "late", "today"]) for _ in range(n))
    docs, want = [], set()
    for i, p in enumerate(passage):
        ws = p.split()
        half, less = " ".join(ws[5:17]), " ".join(ws[4:15])
        docs.append((i, cue(f"{filler(20)} {p if i % 3 == 0 else half} {filler(20)}")))
        docs.append((1000 + i, cue(f"{filler(9)} {less} {filler(9)}")))
        want |= {(i, i)} | ({(0, 100)} if i == 0 else set())
    damaged = passage[2].replace("é", "Ã©").replace("ñ", "�").replace("l", "I", 3).replace("o", "0", 2).replace("m", "rn", 1)
    docs += [(500, cue(damaged)), (501, cue(passage[3].upper())), (502, None), (503, ""), (504, cue(filler(200_000) + " " + passage[4]))]
    want |= {(500, 2), (501, 3), (504, 4)}
    documents = spark.createDataFrame([(*d, "clash", 1.0) for d in docs], "doc_id long, text string, item_id string, score double")
    questions = spark.createDataFrame(items, ITEM)
    got = leaks(documents, questions)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leaks(documents, questions, shard=7).collect()} == want
    report = {r["item_id"]: r for r in leak_report(got, questions).collect()}
    assert report[0]["n_documents"] == 1 and report[0]["longest_run"] == 24 and report[3]["n_documents"] == 2
    assert leaks(documents, questions.limit(0)).count() == 0 and leaks(documents.limit(0), questions).count() == 0


def test_every_script(spark):
    mixed = "The мельник forgot чайник near пристань while холодный wind took семнадцать blue письма away again"
    items = [item(1, RUSSIAN, "чайник"), item(2, ARABIC), item(3, CHINESE), item(4, mixed)]
    misread = RUSSIAN.encode().decode("cp1252", "replace") if False else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in RUSSIAN.encode())
    twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in misread.encode())
    half = " ".join(RUSSIAN.split()[4:12])
    lost = RUSSIAN.replace("медный", "??????").replace("узкой", "�зк�й").replace("семнадцать", "�")
    docs = [
        (1, cue(f"начало рассказа {RUSSIAN.upper()} и конец")), (2, cue(ARABIC)), (3, cue("前 " + CHINESE[:14] + "\n" + CHINESE[14:])), (4, cue(mixed)),
        (5, cue(misread)), (6, cue(twice)), (7, cue(f"вот {half} вот")), (8, cue(" ".join(RUSSIAN.split()[4:11]))), (9, cue(lost)), (10, cue("медный foo синих писем")),
    ]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 1), (7, 1), (9, 1)}
    assert got[1, 1]["run_words"] == 16 == got[9, 1]["run_words"] and got[7, 1]["run_words"] == 8 and got[1, 1]["answer_found"] and got[4, 4]["run_words"] == 15


def test_no_false_leaks(spark):
    items = [item(1, "старый мельник забыл foo медный чайник возле узкой пристани снова"), item(2, "the cat bat fan can ten man tab"), item(3, "été à là où ça né dû sûr")]
    docs = [(1, cue("some text with foo in it and foo again")), (2, cue("tne cot hot ton eon fen mon fob")), (3, cue("t t l o c n d s")), (4, cue("? ? ? ? ? ? ? ?")), (5, cue("the cot bot fan can ten man tob"))]
    assert set(found(spark, docs, items)) == {(5, 2)}


def test_runs_are_whole(spark):
    words = [f"zq{k}x" for k in range(60)]
    got = found(spark, [(1, cue(" ".join(words[:40] + words))), (2, cue(" ".join(words * 9)))], [item(1, " ".join(words), "zq3x zq4x"), item(2, " ".join(words[:30]), "zq4x zq3x")])
    assert got[1, 1]["run_words"] == 60 == got[2, 1]["run_words"] and got[1, 2]["run_words"] == 30
    assert got[1, 1]["answer_found"] and not got[1, 2]["answer_found"]


def test_encodings():
    for text in ("déjà vu, Größe, señor", "Старый мельник", "نسي الطحان", "老磨坊"):
        misread = text
        for _ in range(3):
            assert repaired(pa.array([misread, text, "plain"], pa.large_string())).to_pylist() == [text, text, "plain"]
            misread = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in misread.encode())
    assert repaired(pa.array(["CAFÉ» «È»"], pa.large_string())).to_pylist() == ["CAFÉ» «È»"]


def test_windows_keep_every_run_whole():
    codes, rows = np.arange(200) % 7, np.repeat([0, 1], 100)
    codes[50] = -2
    lo, hi, of = passages(codes, rows, 5, 12)
    for start in range(0, 189):
        end = start + 12
        if rows[start] == rows[end - 1] and not start <= 50 < end:
            assert any(a <= start and end <= b for a, b in zip(lo, hi, strict=True)), start
    assert sorted(set(of.tolist())) == [0, 1, 2]


def forms(text):
    words = tokens(pa.array([text], pa.large_string()))[0]
    s = Spellings.of(words)
    return list(zip(*(x.to_pylist() for x in (s.plain, s.coarse, s.rest)), s.mark.tolist(), strict=True))


@pytest.mark.parametrize(
    ("said", "passage", "run"),
    [("one two three", "one two three", 3), ("one x two three", "one two three", 2), ("a b a b c", "a b c", 3), ("voilà l'été", "VOILA L ETE", 3), ("c'est ? la vie", "c'est la vie", 4), ("c'est � la vie", "c'est à la vie", 5), ("tne cot hot", "the cat bat", 0), ("pr�f�r� encore plus", "préféré encore plus", 3)],
)
def test_longest_run(said, passage, run):
    own = forms(passage)
    assert longest_run(forms(said), tuple([x[k] for x in own] for k in range(3))) == run


def test_thresholds_hold():
    index = Index.build([(1, "alpha beta gamma delta epsilon zeta", "beta"), (2, "one two three four", None), (3, "", None)])
    assert index.need.tolist() == [3, 2, 1] and np.isfinite(index.threshold[:2]).all() and np.isinf(index.threshold[2])
    # no run of half an item or more scores less than the item's threshold
    generator = np.random.default_rng(1)
    texts = [" ".join(generator.choice(["été", "à", "b", "c", "d", "où", "мир"], size=9)) for _ in range(40)]
    index = Index.build([(k, t, None) for k, t in enumerate(texts)])
    number = dict(zip(index.words.to_pylist(), index.numbers.tolist(), strict=True))
    weight = {(int(w), int(i)): x for w in range(len(index.start) - 1) for i, x in zip(index.item[index.start[w] : index.start[w + 1]], index.impact[index.start[w] : index.start[w + 1]], strict=True)}
    for k in range(40):
        coarse = index.passage(k)[1]
        for a in range(5):
            assert sum(weight[w, k] for w in {number[x] for x in coarse[a : a + 5]}) >= index.threshold[k]


def test_very_long_items(spark):
    generator = np.random.default_rng(2)
    words = [f"w{k}" for k in generator.integers(0, 5000, 60_000)]
    passage = " ".join(words)
    whole, half, less = " ".join(words), " ".join(words[20_000:50_001]), " ".join(words[20_000:49_900])
    got = found(spark, [(1, whole), (2, half), (3, less)], [item(1, passage), item(2, "one two three four five six")])
    assert {k: r["run_words"] for k, r in got.items()} == {(1, 1): 60_000, (2, 1): 30_001}
