"""Rows that fail to parse: load valid lines as instances, put the others aside with a reason.

Lines of one file are parsed block by block on a columnar path (Arrow compute, no Python per
entry), lines with well-formed quotes included. A block with lines the columnar path can't accept is halved
again and again until these stand alone; the halves without one are taken over as parsed. The lines
that remain are parsed one by one by a strict reader, which names the first of the reasons

``quoting``       a double quote that neither encloses an entry nor is doubled inside one
``column_count``  wrong number of channels or entries
``value``         (numeric files) an entry that is neither missing nor a finite decimal number
``unknown_file``  no settings for the file

Defined cases: a null line is read as an empty one; a header line (``has_header`` and line_no 1) is
neither valid nor failing and is dropped; settings given twice for a file count once; extra columns
of the input are kept unless they carry the name of an output column or begin with two underscores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # lines of a block
STAND_INS = ("\x1d", "\x1e", "\x1f")  # for an entry separator, an array separator and a quote inside quotes
NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_NUMBER = re.compile(NUMBER)
SETTINGS = ("entry_separator", "array_separator", "missing_strings", "is_2d", "is_numeric", "n_channels", "n_entries", "target_column", "has_header")
OUTPUT = "reason string, label string, series array<array<double>>, tokens array<array<string>>"


class BlockError(Exception):
    """The columnar path doesn't read a block."""


@dataclass(frozen=True)
class Settings:
    """Reader settings of one file."""

    entry: str
    array: str | None
    missing: frozenset[str]
    is_2d: bool
    numeric: bool
    channels: int | None
    entries: int | None
    target: str

    @classmethod
    def of(cls, row: dict) -> Settings:
        two = bool(row["is_2d"])
        target = (row["target_column"] or "none").lower()
        return cls(row["entry_separator"] or ",", row["array_separator"] if two else None, frozenset(x.upper() for x in row["missing_strings"] or [] if x is not None), two, row["is_numeric"] is not False, row["n_channels"], row["n_entries"], "none" if two else target)

    @property
    def labelled(self) -> int:
        return int(self.target in ("first", "last"))


def strict(line: str | None, s: Settings) -> tuple[str | None, str | None, list[list[str]]]:
    """(reason, label, channels of trimmed entries) of one line."""
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    channels, quoted, at, n = [[]], False, 0, len(line)
    blank_end = True  # whether the last channel so far is nothing but blanks

    def separator(i: int) -> str | None:
        if s.array and line.startswith(s.array, i):
            return s.array
        return s.entry if line.startswith(s.entry, i) else None

    while True:
        start = at
        while at < n and line[at] in " \t" and separator(at) is None:
            at += 1
        quoted = at < n and line[at] == '"' and separator(at) is None
        if quoted:
            parts, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return "quoting", None, []
                parts.append(line[at:end])
                at = end + 1
                if line[at : at + 1] != '"':
                    break
                parts.append('"')
                at += 1
            while at < n and line[at] in " \t" and separator(at) is None:
                at += 1
            if at < n and separator(at) is None:
                return "quoting", None, []
            text = "".join(parts)
        else:
            while at < n and separator(at) is None:
                if line[at] == '"':
                    return "quoting", None, []
                at += 1
            text = line[start:at]
        channels[-1].append(text.strip(" \t"))
        blank_end = not quoted and not channels[-1][-1] and len(channels[-1]) == 1
        if at >= n:
            break
        mark = separator(at)
        at += len(mark)
        if mark == s.array:
            channels.append([])
    if s.is_2d and blank_end:
        channels.pop()
    if s.channels is not None and len(channels) != s.channels:
        return "column_count", None, channels
    sizes = {len(c) for c in channels}
    if (sizes != {s.entries + s.labelled} and channels) if s.entries is not None else len(sizes) > 1:
        return "column_count", None, channels
    label = None
    if s.labelled and channels:
        first = channels[0]
        label = first.pop(0 if s.target == "first" else -1)
    if s.numeric:
        for entries in channels:
            for x in entries:
                if x.upper() not in s.missing and not (_NUMBER.fullmatch(x) and math.isfinite(float(x))):
                    return "value", label, channels
    return None, label, channels


def _unquoted(lines: pa.Array, s: Settings) -> tuple[pa.Array, pa.Array]:
    """(lines, whether they are well-formed) of lines with quotes: the quotes gone, and what they enclose spelled with
    stand-ins for separators and quotes."""
    marks = [s.entry, *([s.array] if s.array else [])]
    blank = "[" + "".join(c for c in " \t" if c not in marks) + "]*"
    outside = "".join(re.escape(m) for m in marks)
    entry = f'(?:{blank}"(?:[^"]|"")*"{blank}|[^"{outside}]*)'
    fine = pc.match_substring_regex(lines, f"(?s)\\A{entry}(?:[{outside}]{entry})*\\z")
    if s.is_2d:  # an empty entry in quotes at the end is no empty end
        fine = pc.and_(fine, pc.invert(pc.match_substring_regex(lines, '"[ \t]*"')))
    parts = pc.split_pattern(lines, '"')
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = parts.flatten(), np.cumsum(sizes)
    at = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    inside = flat
    for mark, stand_in in zip(marks, STAND_INS, strict=False):
        inside = pc.replace_substring(inside, mark, stand_in)
    # nothing between two quoted parts: a doubled quote
    doubled = (at % 2 == 0) & (at > 0) & (at < np.repeat(sizes, sizes) - 1) & pc.equal(flat, "").to_numpy(zero_copy_only=False)
    flat = pc.if_else(pa.array(at % 2 == 1), inside, pc.if_else(pa.array(doubled), STAND_INS[2], flat))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat), ""), fine


def columnar(lines: pa.Array, s: Settings) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(accepted, labels, series, tokens): which lines of a block are plainly valid, and the columns of these."""
    n = len(lines)
    simple = len(s.entry) == 1 and (not s.is_2d or s.array is not None and len(s.array) == 1 and s.array not in " \t")
    if not n or not simple or not s.is_2d and s.channels not in (None, 1):
        raise BlockError
    lines = pc.replace_substring_regex(lines, r"\r\z", "")
    odd = pc.match_substring_regex(lines, f"[{''.join(STAND_INS)}]")
    quoted = pc.match_substring(lines, '"')
    some = pc.any(quoted).as_py()
    if some:
        changed, fine = _unquoted(lines.filter(quoted), s)
        odd = pc.or_(odd, pc.replace_with_mask(pa.array(np.zeros(n, bool)), quoted, pc.invert(fine)))
        lines = pc.replace_with_mask(lines, quoted, changed)
    if s.is_2d:
        end = re.escape(s.array) + r"[ \t]*\z"
        lines = pc.replace_substring_regex(lines, end, "")
        odd = pc.or_(odd, pc.match_substring_regex(lines, rf"{end}|\A[ \t]*\z"))
    good = ~odd.to_numpy(zero_copy_only=False)
    channels = pc.split_pattern(lines, s.array) if s.is_2d else None
    per_line = pc.list_value_length(channels).to_numpy(zero_copy_only=False).astype(np.int64) if s.is_2d else np.ones(n, np.int64)
    entries = pc.split_pattern(channels.flatten() if s.is_2d else lines, s.entry)
    sizes = pc.list_value_length(entries).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.repeat(np.arange(n), per_line)  # line of each channel
    first = sizes[np.cumsum(per_line) - per_line]
    wanted = first[own] if s.entries is None else s.entries + s.labelled
    good &= np.bincount(own[(sizes != wanted) | (sizes < s.labelled)], minlength=n) == 0
    if s.channels is not None:
        good &= per_line == s.channels
    # on with the lines that fit
    kept = good[own]
    values = entries.flatten().filter(pa.array(np.repeat(kept, sizes)))
    own, sizes = own[kept], sizes[kept]
    if some:
        for mark, stand_in in zip((s.entry, s.array, '"'), STAND_INS if s.is_2d else (STAND_INS[0], None, STAND_INS[2]), strict=True):
            if stand_in:
                values = pc.replace_substring(values, stand_in, mark)
    values = pc.utf8_trim(values, " \t")
    labels = pa.nulls(len(own), pa.string())
    if s.labelled:
        ends = np.cumsum(sizes)
        at = ends - sizes if s.target == "first" else ends - 1
        labels = values.take(pa.array(at))
        rest = np.ones(len(values), bool)
        rest[at] = False
        values, sizes = values.filter(pa.array(rest)), sizes - 1
    gone = pc.is_in(pc.utf8_upper(values), pa.array(sorted(s.missing), pa.string()))
    if s.numeric:
        number = pc.and_not(pc.match_substring_regex(values, rf"\A(?:{NUMBER})\z"), gone)
        values = pc.if_else(number, pc.utf8_ltrim(values, "+"), pa.scalar(None, pa.string())).cast(pa.float64())
        fine = pc.or_(gone, pc.fill_null(pc.is_finite(values), False)).to_numpy(zero_copy_only=False)
        bad = np.zeros(n, bool)
        bad[np.repeat(own, sizes)[~fine]] = True
        if bad.any():
            good &= ~bad
            kept = good[own]
            values = values.filter(pa.array(np.repeat(kept, sizes)))
            labels = labels.filter(pa.array(kept)) if s.labelled else labels[: int(kept.sum())]
            own, sizes = own[kept], sizes[kept]
    else:
        values = pc.if_else(gone, pa.scalar(None, pa.string()), values)
    m = int(good.sum())
    labels = labels if s.labelled else pa.nulls(m, pa.string())
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
    nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_line[good])]), pa.int32()), inner)
    none = pa.nulls(m, pa.list_(pa.list_(pa.string() if s.numeric else pa.float64())))
    return good, labels, *((nested, none) if s.numeric else (none, nested))


def _strictly(lines: list[str | None], s: Settings) -> pa.RecordBatch:
    """Lines read one by one."""
    reasons, labels, series, tokens = [], [], [], []
    for line in lines:
        reason, label, channels = strict(line, s)
        reasons.append(reason)
        labels.append(label if reason is None else None)
        series.append([[None if x.upper() in s.missing else float(x) for x in c] for c in channels] if reason is None and s.numeric else None)
        tokens.append([[None if x.upper() in s.missing else x for x in c] for c in channels] if reason is None and not s.numeric else None)
    return _batch(pa.array(reasons, pa.string()), pa.array(labels, pa.string()), pa.array(series, pa.list_(pa.list_(pa.float64()))), pa.array(tokens, pa.list_(pa.list_(pa.string()))))


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["reason", "label", "series", "tokens"])


def isolate(bad: np.ndarray) -> list[int]:
    """Places of the bad records of a block, by halving every part that holds one. ``bad`` counts them up to each
    place, so that a half is judged, and a clean one accepted as it was parsed, without parsing it again."""
    found, open_ = [], [(0, len(bad) - 1)]
    while open_:
        lo, hi = open_.pop()
        if bad[hi] == bad[lo]:
            continue
        if hi - lo == 1:
            found.append(lo)
            continue
        middle = (lo + hi) // 2
        open_ += [(middle, hi), (lo, middle)]
    return found


def parse_block(lines: pa.Array, s: Settings) -> list[pa.RecordBatch]:
    """Parsed pieces of a block, in its order: column-wise, but for the bad records, which are isolated by halving and
    read strictly. A block that as a whole fails without a hint is parsed again by halves."""
    try:
        good, *columns = columnar(lines, s)
    except (BlockError, pa.ArrowInvalid):
        if len(lines) == 1 or len(s.entry) != 1:
            return [_strictly(lines.to_pylist(), s)]
        half = len(lines) // 2
        return parse_block(lines[:half], s) + parse_block(lines[half:], s)
    whole = _batch(pa.nulls(int(good.sum()), pa.string()), *columns)
    single = isolate(np.concatenate([[0], np.cumsum(~good)]))
    if not single:
        return [whole]
    both = pa.Table.from_batches([whole, _strictly(lines.take(pa.array(single)).to_pylist(), s)]).combine_chunks()
    place = np.where(good, np.cumsum(good) - 1, 0)
    place[single] = whole.num_rows + np.arange(len(single))
    return both.take(pa.array(place)).combine_chunks().to_batches()


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = pc.fill_null(batch["__line"].cast(pa.string()), "")
        codes = batch["__file"].dictionary_encode()
        files = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
        order = np.argsort(files, kind="stable")
        cuts = np.flatnonzero(np.diff(files[order])) + 1
        parts = []
        for rows in np.split(order, cuts):
            setting = batch["__settings"][int(rows[0])].as_py()
            if setting is None:
                parts.append(_batch(pa.array(["unknown_file"] * len(rows), pa.string()), pa.nulls(len(rows), pa.string()), pa.nulls(len(rows), pa.list_(pa.list_(pa.float64()))), pa.nulls(len(rows), pa.list_(pa.list_(pa.string())))))
                continue
            s, own = Settings.of(setting), lines.take(pa.array(rows))
            for at in range(0, len(rows), BLOCK):
                parts += parse_block(own[at : at + BLOCK], s)
        parsed = pa.Table.from_batches(parts).combine_chunks()
        kept = [c for c in batch.schema.names if not c.startswith("__")]
        taken = batch.select(kept).take(pa.array(order))
        yield from pa.Table.from_arrays([*taken.columns, *parsed.columns], names=[*kept, *parsed.column_names]).to_batches()


def parse_lines(lines: DataFrame, context: DataFrame) -> DataFrame:
    """Every data line with ``reason`` (null: valid), ``label``, ``series`` and ``tokens``.

    Numeric files fill ``series`` (channel-major, missing entries null), others ``tokens``. The
    settings are joined by file_id; Spark broadcasts them only when their size lets it, a skewed
    file is otherwise split by adaptive execution. No row is shuffled for the parsing itself.
    """
    settings = context.dropDuplicates(["file_id"]).select(F.col("file_id").alias("__key"), F.struct(*[c for c in SETTINGS]).alias("__settings"))
    joined = lines.join(settings, lines["file_id"] == F.col("__key"), "left")
    header = F.coalesce(F.col("__settings.has_header") & (F.col("line_no") == 1), F.lit(False))
    kept = [c for c in lines.columns if c not in ("reason", "label", "series", "tokens", "raw_line") and not c.startswith("__")]
    ready = joined.filter(~header).select(*kept, F.col("file_id").alias("__file"), F.col("raw_line").alias("__line"), "__settings")
    schema = ", ".join([*(f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in kept), OUTPUT])
    return ready.mapInArrow(_parse_batches, schema)


def load_valid(lines: DataFrame, context: DataFrame) -> DataFrame:
    """Instances of the valid lines."""
    return parse_lines(lines, context).filter("reason is null").drop("reason")


def failures(lines: DataFrame, context: DataFrame) -> DataFrame:
    """The failing lines with the reason for each."""
    return parse_lines(lines, context).filter("reason is not null").drop("label", "series", "tokens")
