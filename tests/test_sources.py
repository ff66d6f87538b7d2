from __future__ import annotations

import pytest

from kelpwood.sources import delimited as S


def lines(tmp_path, name, *rows):
    (tmp_path / name).write_text("\n".join(rows) + "\n")
    return str(tmp_path / name)


def test_ragged_with_labels(spark, tmp_path):
    data = lines(tmp_path, "d.txt", "8.5,8.25,8.0,7.75:3.5,,3.0,2.5", "6.0,6.5,7.0:4.5,4.0,3.5", "8.0,8.5,8.25,8.75,9.0:3.0,3.5,,3.25,3.75", "6.25,6.75:4.0,4.25,4.5", "6.5,7.0:,4.75")
    labels = lines(tmp_path, "l.txt", " long", "short", "long", "short", "short")
    good, failed = S.read_delimited(spark, data, S.Layout(is_2d=True), labels)
    got = {r["idx"]: r for r in good.collect()}
    assert sorted(got) == [0, 1, 2, 4] and got[0]["series"][1] == [3.5, None, 3.0, 2.5] and [got[k]["label"] for k in sorted(got)] == ["long", "short", "long", "short"]
    assert failed.first()["reason"] == "column_count"
    S.write_series(good.select("idx", "series"), str(tmp_path / "out"), True)
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "8.5,8.25,8.0,7.75:3.5,,3.0,2.5:" in text
    again, _ = S.read_delimited(spark, str(tmp_path / "out"), S.Layout(is_2d=True))
    assert again.count() == 4


@pytest.mark.parametrize("target", ["first", "last"])
def test_inline_labels_and_header(spark, tmp_path, target):
    rows = ["h"] + [f"{'c' + str(i) + chr(9) if target == 'first' else ''}{i}\t{i + 1}{chr(9) + 'c' + str(i) if target == 'last' else ''}" for i in range(5)]
    good, _ = S.read_delimited(spark, lines(tmp_path, "t.tsv", *rows), S.Layout(entry_separator="\t", target_column=target, has_header=True))
    got = {r["idx"]: r for r in good.collect()}
    assert got[3]["label"] == "c3" and got[3]["series"] == [3.0, 4.0] and len(got) == 5


def test_mixed(spark, tmp_path):
    good, _ = S.read_delimited(spark, lines(tmp_path, "m.csv", "1.5,true,abc,NA"), S.Layout(is_numeric=False))
    a, b, c, d = good.first()["series"]
    assert (a["num"], b["bool"], c["str"], d) == (1.5, True, "abc", None)


def test_file_info(spark, tmp_path):
    path = lines(tmp_path, "i.csv", "h|e|a|d", "a|1|2|3", "b|1|2", "c|1|2|3|4")
    assert S.file_info(spark, path, S.Layout(entry_separator="|", has_header=True)).collect() == [(4, 3, 3, 5)]
    two = lines(tmp_path, "j.csv", "1,2:3,4", "1,2,3:4")
    assert S.file_info(spark, two, S.Layout(is_2d=True)).collect() == [(2, 2, 2, 3)]


def test_lines_keep_their_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("\n".join(f"{k}-{n}" for n in range(1000)) + "\n")
    got = S.read_lines(spark, str(folder)).orderBy("idx").collect()
    assert [r["raw_line"] for r in got] == [f"{k}-{n}" for k in range(3) for n in range(1000)] and [r["idx"] for r in got] == list(range(3000))
