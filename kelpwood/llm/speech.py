"""Speech of subtitle texts, column-wise in Arrow: cue lines without cue numbers, times, markup and
sound descriptions (in round or square brackets or between stars); whole texts, never prefixes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc

CUE = "\x01"  # stands where a cue begins
HEADER = r"(?m)^(?:[^\nA-Za-z]*[0-9][ \t]*\n)?[^\nA-Za-z0-9]*[0-9][0-9:.,]*[ \t]*-{1,2}>[ \t]*[0-9][^\n]*$"
BEFORE = r"\A[^\x01]*\x01"
TITLE = r"\A[^\nA-Za-z]*WEBVTT[^\n]*"
NOTE = r"\n[ \t]*\nNOTE(?:[ \t][^\n]*)?(?:\n[^\n\x01]+)*"
MARKUP = r"<[^<>\n\x01]*>|\{[^{}\n\x01]*\}"
SOUND = r"\([^()\x01]*\)|\[[^\[\]\x01]*\]|\*[^*\x01]*\*"


def speech(text: pa.Array) -> pa.Array:
    """Speech of each text; a null text has an empty one. Cues are kept apart by CUE. A text without
    any time line counts as speech as a whole."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    text = pc.replace_substring_regex(text, r"\r\n?", "\n")
    text = pc.replace_substring_regex(text, HEADER, CUE)
    text = pc.replace_substring_regex(text, TITLE, "")
    text = pc.replace_substring_regex(text, BEFORE, "")
    text = pc.replace_substring_regex(text, NOTE, "\n")
    text = pc.replace_substring_regex(text, MARKUP, "")
    return pc.replace_substring_regex(text, SOUND, " ")


def split_words(text: pa.Array, apart: str = r"[^\pL\pN]+") -> tuple[pa.Array, pa.Array]:
    """(words, their row) of lower-case texts; empty pieces left out."""
    lists = pc.split_pattern_regex(text, apart)
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    return words.filter(some), rows.filter(some)
