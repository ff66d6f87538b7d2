"""Evaluation texts leaking into training text: a BM25 index of the test items, pruned by block maxima.

The items' words form a small index: per word the items it stands in with its BM25 impact, and per word and
block of items the greatest impact. The corpus streams past it once, without a shuffle:

1. Each document's speech becomes words, whatever their script, and these become word numbers of the
   index. The numbers are those of a coarse spelling in which damaged and whole words read alike; it only
   proposes. Unbroken stretches of indexed words at least as long as the shortest possible leak are its
   passages; long ones are cut into overlapping windows that keep every shortest leak whole.
2. A passage is dropped if the sum of its words' greatest impacts stays below every item's threshold,
   then item block by item block by the block maxima; the rest is scored exactly. An item's threshold
   is the least score that any leak of it (an unbroken run of at least half its words) can have, so
   that nothing that must be found is pruned.
3. What remains is verified word by word on the words themselves, over all windows of a stretch together:
   the longest unbroken run common to document and item. Two words are the same if they agree
   but for case, accents and width. They also match where the document's word is damaged: letters lost or
   replaced by a mark, or look-alike letters mistaken for each other; but at least half of the words of a
   run must agree as they are. A mark alone can stand for a word without ASCII letters, nothing else is
   counted unseen. Last, it is looked up whether the answer's words stand unbroken in the document.

Text whose bytes were read in the wrong encoding is read again in the right one first. Scripts that
don't part their words by blanks (Han, Kana, Thai, Lao, Khmer, Myanmar) count every letter as a word.

The index goes to the executors whole while there are at most ``SHARD`` items; each further ``SHARD`` items
are a further pass over the corpus. Defined cases: null or empty texts and passages without words
have no leak; repeated item ids are treated as separate passages and reported once per id and
document; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwood.llm.speech import speech

SHARD = 250_000  # items an index holds at most
BLOCK = 16  # items a block of the index
K1, B = 1.2, 0.75
LOST = "�"
#: Pairs of a letter shape and the spelling that all its look-alikes are brought to.
LOOKALIKES = (("0", "o"), ("a", "o"), ("1", "i"), ("l", "i"), ("|", "i"), ("5", "s"), ("8", "b"), ("b", "h"), ("c", "e"), ("f", "t"), ("u", "ii"), ("w", "vv"), ("m", "rn"))
#: Letters that no normal form takes apart.
LETTERS = (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i"), ("ς", "σ"))
_ACCENTS = r"[\x{0300}-\x{036f}\x{0591}-\x{05c7}\x{064b}-\x{0652}]"
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
#: Characters that the bytes from 0x80 on become when they are read as one-byte text.
_BYTE = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0xA0)}
_LEADS, _TAILS = "".join(c for c, b in _BYTE.items() if 0xC2 <= b <= 0xF4), "".join(c for c, b in _BYTE.items() if b < 0xC0)
_MISREAD = re.compile(f"(?:[{re.escape(_LEADS)}][{re.escape(_TAILS)}]+)+")
_BROKEN = re.compile(f"[ÂÃÅâ][{re.escape(_TAILS)}]+")


def _reread(found: re.Match) -> str:
    try:
        text = bytes(_BYTE[c] for c in found.group()).decode("utf-8")
    except UnicodeDecodeError:
        return found.group()
    # single letters outside the alphabets in use are no text that was misread
    return found.group() if any(0x200 <= ord(c) < 0x370 for c in text) else text


def repaired(text: pa.Array) -> pa.Array:
    """Texts with what was read in the wrong encoding, once or more often, read again."""
    suspect = pc.match_substring_regex(text, f"[{re.escape(_LEADS)}][{re.escape(_TAILS)}]")
    if not pc.any(suspect).as_py():
        return text
    out = []
    for t in text.filter(suspect).to_pylist():
        for _ in range(3):
            new = _MISREAD.sub(_reread, t)
            if new == t:
                break
            t = new
        out.append(_BROKEN.sub(lambda m: " " if m.group()[0] == "â" else LOST, t))
    return pc.replace_with_mask(text, suspect, pa.array(out, text.type))


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, their row); a word may hold marks of lost letters or be nothing but such marks."""
    text = pc.replace_substring_regex(repaired(text), _UNSPACED, r" \1 ")
    lists = pc.split_pattern_regex(text, r"[^\pL\pN\pM\x{fffd}?]+")
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    return words.filter(some), rows.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Spellings:
    """Distinct words in all the spellings that are compared, as Arrow arrays of one length."""

    plain: pa.Array  # case, accents and width aside; lost letters as LOST
    coarse: pa.Array  # look-alike letters as one
    rest: pa.Array  # the same without letters beyond ASCII: what is left where they are lost
    mark: np.ndarray  # whether letters are lost

    @classmethod
    def of(cls, words: pa.Array) -> Spellings:
        t = pc.utf8_lower(words)
        apart = pc.match_substring_regex(t, r"\pM")
        if pc.any(apart).as_py():
            t = pc.replace_with_mask(t, apart, pa.array([unicodedata.normalize("NFC", w) for w in t.filter(apart).to_pylist()], t.type))
        rest = pc.replace_substring_regex(t, r"[^\x00-\x7f]|\?", "")
        t = pc.replace_substring_regex(pc.utf8_normalize(t, "NFKD"), _ACCENTS, "")
        for shape, common in LETTERS:
            t = pc.replace_substring(t, shape, common)
        trimmed = pc.utf8_trim(t, "?")
        t = pc.if_else(pc.equal(trimmed, ""), t, trimmed)
        t = pc.replace_substring(t, "?", LOST)
        coarse = t
        for shape, common in LOOKALIKES:
            coarse, rest = pc.replace_substring(coarse, shape, common), pc.replace_substring(rest, shape, common)
        return cls(t, coarse, rest, pc.match_substring(t, LOST).to_numpy(zero_copy_only=False))


@dataclass
class Index:
    """Inverted index of items; flat arrays with the offsets of the items or words."""

    items: np.ndarray  # ids
    words: pa.Array  # spellings, sorted
    numbers: np.ndarray  # word number of each spelling
    plain: pa.Array  # words of all passages one after the other
    coarse: pa.Array
    rest: pa.Array
    at: np.ndarray  # passage k has the words at[k]:at[k + 1]
    answers: pa.Array  # coarse spelling, joined by blanks
    need: np.ndarray  # words a leak has at least
    fewest: np.ndarray  # of them words that are known by their number
    threshold: np.ndarray
    start: np.ndarray  # postings of word w: start[w]:start[w + 1], sorted by item
    item: np.ndarray
    impact: np.ndarray
    greatest: np.ndarray  # per word
    block_start: np.ndarray  # the same per block of items
    block: np.ndarray
    block_max: np.ndarray
    block_least: np.ndarray  # least threshold of each block

    @classmethod
    def build(cls, items: list[tuple]) -> Index:
        """items: (id, passage, answer)."""
        words, rows = tokens(pa.array([p or "" for _, p, _ in items], pa.large_string()))
        letters = pc.match_substring_regex(words, r"[\pL\pN]")  # a question mark is no word of an item
        words, rows = words.filter(letters), rows[letters.to_numpy(zero_copy_only=False)]
        s = Spellings.of(words)
        n = len(items)
        at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)
        # spellings of one word are one number
        pairs = set(zip(s.coarse.to_pylist(), s.rest.to_pylist(), strict=True))
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in sorted(pairs):
            parent[root(b or a)] = root(a)
        names = sorted(parent)
        roots = {r: k for k, r in enumerate(sorted({root(x) for x in names}))}
        number = {x: roots[root(x)] for x in names}
        codes = np.array([number[x] for x in s.coarse.to_pylist()], np.int64)
        unsure = pc.equal(s.rest, "").to_numpy(zero_copy_only=False)  # may be lost without a trace
        size, length = len(roots), np.diff(at).astype(float)
        mean = max(1.0, length.mean()) if n else 1.0
        key, first, c = np.unique(codes * max(1, n) + rows, return_inverse=True, return_counts=True)
        w, i = key // max(1, n), key % max(1, n)
        df = np.bincount(w, minlength=size)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * length[i] / mean)) if len(key) else np.zeros(0)
        greatest = np.zeros(size)
        np.maximum.at(greatest, w, impact)
        blocks = n // BLOCK + 1
        pair, to = np.unique(w * blocks + i // BLOCK, return_inverse=True)
        block_max = np.zeros(len(pair))
        np.maximum.at(block_max, to, impact)
        need = np.maximum(1, -(-np.diff(at) // 2)).astype(np.int64)
        threshold = np.array([cls._least(codes[a:b], impact[first[a:b]], unsure[a:b], int(k)) for a, b, k in zip(at[:-1], at[1:], need, strict=True)], float)
        fewest = np.array([k - min(k // 2, int(unsure[a:b].sum())) for a, b, k in zip(at[:-1], at[1:], need, strict=True)], np.int64)
        least = np.full(blocks, np.inf)
        np.minimum.at(least, np.arange(n) // BLOCK, threshold)
        said, own = tokens(pa.array([a or "" for _, _, a in items], pa.large_string()))
        spelled = Spellings.of(said).coarse.to_pylist() if len(said) else []
        answers: list[list[str]] = [[] for _ in items]
        for k, x in zip(own.tolist(), spelled, strict=True):
            answers[k].append(x)
        return cls(
            np.array([x[0] for x in items], np.int64), pa.array(names, pa.large_string()), np.array([number[x] for x in names], np.int64), s.plain, s.coarse, s.rest, at, pa.array([" ".join(a) for a in answers], pa.large_string()), need, fewest, threshold,
            np.concatenate([[0], np.cumsum(df)]), i, impact, greatest, np.concatenate([[0], np.cumsum(np.bincount(pair // blocks, minlength=size))]), pair % blocks, block_max, least,
        )

    @staticmethod
    def _least(codes: np.ndarray, weight: np.ndarray, unsure: np.ndarray, need: int) -> float:
        """Least score that a run of ``need`` words can have, each word counted once; inf for an item without words.
        At most half of a run, of its unsure words, may be lost."""
        if not len(codes):
            return np.inf
        if need * (len(codes) - need + 1) > 4_000_000:
            return Index._least_of_long(codes, weight, unsure, need)
        _, code = np.unique(codes, return_inverse=True)
        before = np.full(len(code), -1)
        last: dict[int, int] = {}
        for k, c in enumerate(code.tolist()):
            before[k] = last.get(c, -1)
            last[c] = k
        at = np.arange(len(code) - need + 1)[:, None] + np.arange(need)[None]
        own = np.where(before[at] < at[:, :1], weight[at], 0.0)
        total = own.sum(1)
        if unsure.any():
            gone = np.sort(np.where(unsure[at], own, 0.0), axis=1)[:, need - need // 2 :]
            total = total - gone.sum(1)
        return float(total.min()) * (1 - 1e-9)

    @staticmethod
    def _least_of_long(codes: np.ndarray, weight: np.ndarray, unsure: np.ndarray, need: int) -> float:
        """A bound below the least score, word by word: all unsure words of a run are taken for lost."""
        least, total, held = np.inf, 0.0, {}
        for k, (c, w, lost) in enumerate(zip(codes.tolist(), weight.tolist(), unsure.tolist(), strict=True)):
            held[c] = held.get(c, 0) + 1
            if held[c] == 1 and not lost:
                total += w
            if k >= need:
                old = k - need
                c = int(codes[old])
                held[c] -= 1
                if held[c] == 0 and not unsure[old]:
                    total -= float(weight[old])
            if k >= need - 1:
                least = min(least, total)
        return max(0.0, least - 1e-6)

    def passage(self, k: int) -> tuple[list[str], list[str], list[str]]:
        a, n = int(self.at[k]), int(self.at[k + 1] - self.at[k])
        return tuple(x.slice(a, n).to_pylist() for x in (self.plain, self.coarse, self.rest))


def _ranges(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places start[w]:start[w + 1] of all w in ``which``, and which w each is of."""
    size = start[which + 1] - start[which]
    of = np.repeat(np.arange(len(which)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[which][of], of


def passages(codes: np.ndarray, rows: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of indexed words of one row, in windows of 2 * longest words, and
    which stretch each is of."""
    n = len(codes)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    known = codes >= 0
    new = np.ones(n, bool)
    new[1:] = (rows[1:] != rows[:-1]) | (known[1:] != known[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    fit = known[start] & (end - start >= shortest)
    start, end = start[fit], end[fit]
    pieces = np.maximum(1, -(-(end - start - longest) // longest))
    of = np.repeat(np.arange(len(start)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = start[of] + k * longest
    return lo, np.minimum(lo + 2 * longest, end[of]), of


def candidates(index: Index, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all passages and items whose score reaches the item's threshold."""
    n, blocks = len(index.items), len(index.block_least)
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of]
    once = np.unique(of * len(index.greatest) + codes[at])  # each word of a passage once
    of, word = np.divmod(once, max(1, len(index.greatest)))
    bound = np.bincount(of, index.greatest[word], len(lo))
    live = bound >= index.threshold.min()
    keep = live[of]
    of, word = of[keep], word[keep]
    place, k = _ranges(index.block_start, word)
    key, to = np.unique(of[k] * blocks + index.block[place], return_inverse=True)
    bound = np.bincount(to, index.block_max[place], len(key))
    key = key[bound >= index.block_least[key % blocks]]
    alive = np.zeros(0, np.int64) if not len(key) else np.unique(key // blocks)
    keep = np.isin(of, alive)
    of, word = of[keep], word[keep]
    place, k = _ranges(index.start, word)
    item, own = index.item[place], of[k]
    inside = np.isin(own * blocks + item // BLOCK, key)
    place, item, own = place[inside], item[inside], own[inside]
    pair, to = np.unique(own * n + item, return_inverse=True)
    score = np.bincount(to, index.impact[place], len(pair))
    good = score >= index.threshold[pair % n] if n else np.zeros(0, bool)
    return pair[good] // max(1, n), pair[good] % max(1, n), score[good]


@lru_cache(maxsize=65_536)
def _damaged(word: str) -> re.Pattern:
    """What a word with marks may have been: a mark stands for one to four letters."""
    return re.compile("".join(".{1,4}" if part.startswith(LOST) else re.escape(part) for part in re.findall(f"{LOST}+|[^{LOST}]+", word)), re.S)


def longest_run(said: list[tuple[str, str, str, bool]], passage: tuple[list[str], list[str], list[str]]) -> int:
    """Words of the passage in its longest unbroken run that also stands in ``said`` (plain, coarse, rest, mark),
    of which at least half agree in every letter that is there."""
    plain, coarse, rest = passage
    places: dict[tuple[int, str], list[int]] = {}
    for kind, words in enumerate((plain, coarse, rest)):
        for i, w in enumerate(words):
            if w:
                places.setdefault((kind, w), []).append(i)
    foreign = [i for i, w in enumerate(rest) if not w]
    best = 0
    runs: dict[int, list[tuple[int, int]]] = {}  # last word of the item: (words, of them in agreement) of runs that end there

    def keep(into: dict, i: int, found: list[tuple[int, int]]) -> None:
        """Of several ways to the same place those that aren't beaten in both numbers."""
        have = into.get(i, []) + found
        top = -1
        out = []
        for t, e in sorted(set(have), reverse=True):
            if e > top:
                out.append((t, e))
                top = e
        into[i] = out

    for word, look, left, mark in said:
        now: dict[int, list[tuple[int, int]]] = {}
        alone = mark and not word.strip(LOST)
        if alone:  # stands for a word or for nothing
            for i, have in runs.items():
                keep(now, i, have)
            hit = foreign
        elif mark:
            hit = places.get((2, left), []) if left else []
            hit = hit + [i for i, w in enumerate(plain) if i not in hit and _damaged(word).fullmatch(w)]
        else:
            hit = places.get((1, look), [])
            hit = hit + [i for i in places.get((2, look), []) if i not in hit]
        for i in hit:
            exact = int(left != "" and rest[i] == left if mark else plain[i] == word)
            keep(now, i, [(t + 1, e + exact) for t, e in runs.get(i - 1, [])] + [(1, exact)])
            for t, e in now[i]:
                if t > best and 2 * e >= t:
                    best = t
        runs = now
    return best


def _search(index: Index, kept: str):
    usable = np.flatnonzero(np.isfinite(index.threshold))
    shortest = int(index.fewest[usable].min()) if len(usable) else 1
    longest = int(index.need[usable].max()) if len(usable) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = lru_cache(maxsize=10_000)(index.passage)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole[at : at + 1000]
                words, rows = tokens(speech(batch["text"]))
                if not len(words) or not len(usable):
                    continue
                distinct = words.dictionary_encode()
                which = distinct.indices.to_numpy(zero_copy_only=False)
                s = Spellings.of(distinct.dictionary)
                number = pc.fill_null(pc.index_in(pc.if_else(pa.array(s.mark), s.rest, s.coarse), index.words), -1).to_numpy(zero_copy_only=False)
                number = np.where(number >= 0, index.numbers[number], np.where(s.mark, -1, -2))  # -1: lost, breaks nothing
                codes = number[which]
                place = np.flatnonzero(codes != -1)
                lo, hi, of = passages(codes[place], rows[place], shortest, longest)
                if not len(lo):
                    continue
                known = codes[place]
                found: dict[tuple[int, int], list] = {}
                for p, i, score in zip(*(x.tolist() for x in candidates(index, known, lo, hi)), strict=True):
                    own = found.setdefault((int(of[p]), i), [lo[p], hi[p], 0.0])
                    own[:] = [min(own[0], lo[p]), max(own[1], hi[p]), max(own[2], score)]
                forms = list(zip(*(x.to_pylist() for x in (s.plain, s.coarse, s.rest)), s.mark.tolist(), strict=True)) if found else []
                leaked: dict[tuple[int, int], list] = {}
                for (_, i), (a, b, score) in found.items():
                    row = int(rows[place[a]])
                    first, last = int(place[a]), int(place[b - 1]) + 1
                    while first and codes[first - 1] == -1 and rows[first - 1] == row:
                        first -= 1
                    while last < len(codes) and codes[last] == -1 and rows[last] == row:
                        last += 1
                    length = longest_run([forms[w] for w in which[first:last].tolist()], passage(i))
                    if length >= index.need[i]:
                        best = leaked.setdefault((row, i), [0, 0.0])
                        best[:] = [max(best[0], length), max(best[1], score)]
                if leaked:
                    keys = sorted(leaked)
                    bounds = {row: np.searchsorted(rows, [row, row + 1]) for row, _ in keys}
                    texts = {row: f" {' '.join(forms[w][1] for w in which[a:b].tolist())} " for row, (a, b) in bounds.items()}
                    answers = [bool(said := index.answers[i].as_py()) and f" {said} " in texts[row] for row, i in keys]
                    yield pa.RecordBatch.from_arrays(
                        [batch[kept].take(pa.array([r for r, _ in keys])), pa.array(index.items[[i for _, i in keys]]), pa.array([leaked[k][0] for k in keys], pa.int32()), pa.array([leaked[k][1] for k in keys], pa.float64()), pa.array(answers)],
                        names=[kept, "item_id", "run_words", "score", "answer_found"],
                    )

    return run


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(key, item_id, run_words, score, answer_found) of every document that holds half an item or more.

    score: the greatest BM25 score of the document's windows; answer_found: the answer's words stand unbroken in
    the document. Items above ``shard`` take a further pass over the documents each ``shard``.
    """
    known = items.filter("item_id is not null and passage is not null").select(F.col("item_id").cast("bigint"), "passage", "answer")
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id bigint, run_words int, score double, answer_found boolean"
    rows = known.orderBy("item_id", "passage", "answer").toLocalIterator()
    out = []
    while (part := [tuple(r) for r in islice(rows, shard)]) or not out:
        out.append(documents.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("text")).mapInArrow(_search(Index.build(part), key), schema))
    found = reduce(DataFrame.unionByName, out)
    return found.groupBy(key, "item_id").agg(F.max("run_words").alias("run_words"), F.max("score").alias("score"), F.max("answer_found").alias("answer_found"))


def leak_report(found: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaked items with the documents that hold them."""
    per = found.groupBy("item_id").agg(F.count(key).alias("n_documents"), F.max("run_words").alias("longest_run"), F.sum(F.col("answer_found").cast("int")).alias("n_with_answer"))
    return items.select("item_id", "task", "split", "lang").dropDuplicates(["item_id"]).join(per, "item_id")
