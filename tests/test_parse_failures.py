from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpwood.operators import parse_failures as P

CONTEXT = "file_id int, file_name string, entry_separator string, array_separator string, missing_strings array<string>, is_2d boolean, is_numeric boolean, n_channels int, n_entries int, target_column string, has_header boolean"
ONE = P.Settings(",", None, frozenset({"", "NA"}), False, True, 1, 3, "first")
TWO = P.Settings(",", ":", frozenset({"NA"}), True, True, 2, None, "none")


def test_reasons():
    case = lambda line, s=ONE: P.strict(line, s)[0]
    assert case("a,1,2,3") is None and case("a,1,2,3\r") is None and case("a,na,, NA ") is None
    assert case('"x,y",1,2,3') is None and case('a, "1" ,2,3') is None and case('"a""b",1,2,3') is None
    assert case('a"b,1,2,3') == "quoting" and case('"a,1,2,3') == "quoting" and case('"a"b,1,2,3') == "quoting"
    assert case("a,1,2") == "column_count" and case("") == "column_count" and case(None) == "column_count"
    assert case("a,1,2,x") == "value" and case("a,1,2,inf") == "value" and case("a,1,2,1e999") == "value" and case("a,1,2,1_0") == "value"
    assert case("a,+1,.5,2.e-3") is None and case("a,1,2,.") == "value"
    assert case("1,2:3,4", TWO) is None and case("1,2:3,4:", TWO) is None and case("1,2:3", TWO) == "column_count" and case("1,2:3,4::", TWO) == "column_count"
    assert case("1,2:", TWO) == "column_count" and case('1,"2:3":4,5', TWO) == "value"
    assert case('a"b,1', ONE) == "quoting"  # the first reason that applies


LAYOUTS = [
    ONE, TWO, P.Settings("\t", None, frozenset({"", "?"}), False, True, 1, 3, "last"), P.Settings(";", None, frozenset({"-"}), False, False, 1, 3, "first"),
    P.Settings(",", ":", frozenset({""}), True, False, None, 2, "none"), P.Settings("|", "#", frozenset(), True, True, None, None, "none"), P.Settings(",", ":", frozenset({"NA"}), True, True, 1, 1, "none"),
    P.Settings(" ", None, frozenset({"NA"}), False, True, None, None, "none"), P.Settings("::", None, frozenset({"NA"}), False, True, 1, 2, "none"), P.Settings(",", None, frozenset(), False, True, 1, 1, "last"),
]
ENTRY = st.sampled_from(["1", "-2.5", "+.5", "3e2", "2.e-3", "NA", "na", "", " 4 ", "x", '"5"', '"a,b"', '"1:2"', '"x""y"', '""', '" "', ' "7" ', 'q"', '"', ":", "#", "inf", "nan", "1e999", "7\r", "\t8", "\x1d", "é", "1_0"])


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(LAYOUTS), st.data())
def test_blocks_agree_with_the_strict_reader(s, data):
    sep = st.sampled_from([s.entry] * 4 + ([s.array] * 2 if s.array else []))
    line = st.lists(st.tuples(ENTRY, sep), min_size=0, max_size=6).map(lambda parts: "".join(a + b for a, b in parts)[: None if len(parts) % 2 else -1])
    lines = data.draw(st.lists(line, min_size=1, max_size=40))
    got = pa.Table.from_batches(P.parse_block(pa.array(lines, pa.string()), s)).to_pylist()
    assert len(got) == len(lines)
    for line, row in zip(lines, got, strict=True):
        want = P._strictly([line], s).to_pylist()[0]
        assert row == want, line


def test_few_lines_are_read_one_by_one():
    lines = [f'l{k},{k},"{k}.5", NA' for k in range(500)] + ['"p,q",1,2,3', "x,1,2", "y,1,2,z", 'w"x,1,2,3'] * 5
    good, labels, series, _ = P.columnar(pa.array(lines), ONE)
    assert good.sum() == 505 and labels.to_pylist()[500] == "p,q" and series.to_pylist()[7] == [[7.0, 7.5, None]]
    bad = np.concatenate([[0], np.cumsum(~good)])
    assert P.isolate(bad) == np.flatnonzero(~good).tolist() and P.isolate(np.zeros(9, int)) == P.isolate(np.zeros(1, int)) == []


def test_whole_path(spark):
    context = spark.createDataFrame([(1, "f", ",", None, ["NA"], False, True, 1, 2, "first", True), (1, "f", ",", None, ["NA"], False, True, 1, 2, "first", True), (2, "g", "\t", None, None, False, False, 1, 2, None, False)], CONTEXT)
    rows = [(i, 1, i + 1, "a,1,2" if i % 7 else "a,1", "x") for i in range(50)]
    rows += [(100, 2, 1, "p\tq", "x"), (101, 2, 2, None, "x"), (102, 9, 1, "z", "x"), (103, None, 1, "z", "x"), (104, 1, None, "b,NA,3", None), (104, 1, None, "b,NA,3", None)]
    lines = spark.createDataFrame(rows, "line_id long, file_id int, line_no long, raw_line string, reason string").withColumnRenamed("reason", "entry_separator")
    got = {(r["line_id"]): r for r in P.parse_lines(lines, context).collect()}
    assert 0 not in got  # the header
    assert got[7]["reason"] == "column_count" and got[1]["series"] == [[1.0, 2.0]] and got[1]["label"] == "a" and got[1]["entry_separator"] == "x"
    assert got[100]["tokens"] == [["p", "q"]] and got[101]["reason"] == "column_count"
    assert got[102]["reason"] == got[103]["reason"] == "unknown_file" and got[104]["series"] == [[None, 3.0]]
    assert P.load_valid(lines, context).count() + P.failures(lines, context).count() == len(rows) - 1
    assert P.parse_lines(lines.limit(0), context).count() == 0 and P.failures(lines, context.limit(0)).filter("reason <> 'unknown_file'").count() == 0


def test_very_long_line(spark):
    context = spark.createDataFrame([(1, "f", ",", None, ["NA"], False, True, 1, None, "none", False)], CONTEXT)
    lines = spark.createDataFrame([(1, 1, 1, ",".join(["1.5"] * 200_000))], "line_id long, file_id int, line_no long, raw_line string")
    assert len(P.load_valid(lines, context).first()["series"][0]) == 200_000
