from __future__ import annotations

import gzip
from urllib.parse import unquote

import pytest

from usagemill.sources import reports
from usagemill.sources.reports import read_reports


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))
    return path


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_cells(spark, tmp_path):
    write(
        tmp_path,
        "a/b/report.csv",
        "UserId,SessionId,Note\n"
        "  alice , s1 ,plain\n"
        ',"",x\n'
        'u,s2,"a\\"q, x"\n'
        'v,s3,"bo ""b"""\n',
    )
    found = read_reports(spark, str(tmp_path))
    assert found.columns == ["UserId", "SessionId", "Note"]
    assert {kind for _, kind in found.dtypes} == {"string"}
    assert rows(found) == sorted(
        [("alice", "s1", "plain"), (None, None, "x"), ("u", "s2", 'a"q, x'), ("v", "s3", '"bo ""b"""')], key=repr
    )


def test_files_with_other_headers_are_bound_by_name(spark, tmp_path):
    write(tmp_path, "day=1/a.csv", "UserId,SessionId\nalice,s1\n")
    write(tmp_path, "day=2/b.csv", "SessionId,UserId,Extra\ns2,bob,x\n")
    write(tmp_path, "day=2/c.csv", "UserId,SessionId\r\ncarol,s3\r\n")
    write(tmp_path, "day=3/empty.csv", "")
    write(tmp_path, "day=3/header only.csv", "Extra,Other\n")
    found = read_reports(spark, str(tmp_path)).select("UserId", "SessionId", "Extra", "Other")
    assert rows(found) == [("alice", "s1", None, None), ("bob", "s2", "x", None), ("carol", "s3", None, None)]


def test_headers_of_plain_and_compressed_files(spark, tmp_path):
    write(tmp_path, "a b%20c.csv", "\n  \nUserId,X\n1,2\n")
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"UserId,Y\n3,4\n"))
    write(tmp_path, "long.csv", ",".join(f"c{i}" for i in range(20_000)) + "\n")
    headers = {unquote(row["path"].rsplit("/", 1)[1]): row["names"] for row in reports.file_headers(spark, str(tmp_path)).collect()}
    assert headers["a b%20c.csv"] == ["UserId", "X"]
    assert headers["z.csv.gz"] == ["UserId", "Y"]
    assert headers["long.csv"][-1] == "c19999"


def test_column_names():
    assert reports.column_names(' "a, b",, c ,"x\\"y"') == ["a, b", "_c1", "c", 'x"y']
    assert reports.column_names("a,b,a") == ["a0", "b", "a2"]


def test_several_folders(spark, tmp_path):
    for name in ("x", "y"):
        write(tmp_path, f"{name}/a.csv", f"UserId\n{name}\n")
    found = read_reports(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    assert rows(found) == [("x",), ("y",)]


def test_one_file(spark, tmp_path):
    """A job may be given the new file alone in place of its folder."""
    write(tmp_path, "a.csv", "UserId\na\n")
    new = write(tmp_path, "b.csv", "UserId,Extra\nb,x\n")
    assert rows(read_reports(spark, str(new))) == [("b", "x")]


def test_no_header(spark, tmp_path):
    write(tmp_path, "a.csv", "  alice ,s1\nbob,s2\n")
    found = read_reports(spark, str(tmp_path), header=False)
    assert found.columns == ["_c0", "_c1"]
    assert rows(found) == [("  alice ", "s1"), ("bob", "s2")]


def test_no_header_and_files_of_several_widths(spark, tmp_path):
    write(tmp_path, "a.csv", "alice,s1\n")
    write(tmp_path, "b.csv", "bob,s2,2024-01-15\n")
    write(tmp_path, "c.csv", '"a,b,c,d",s3\n')
    found = read_reports(spark, str(tmp_path), header=False)
    assert rows(found) == [("a,b,c,d", "s3", None), ("alice", "s1", None), ("bob", "s2", "2024-01-15")]


def test_known_header(spark, tmp_path):
    write(tmp_path, "a.csv", "UserId,SessionId\n alice ,s1\n")
    assert rows(read_reports(spark, str(tmp_path), columns=["UserId", "SessionId"])) == [("alice", "s1")]
    write(tmp_path, "b.csv", "SessionId,UserId\ns2,bob\n")
    with pytest.raises(Exception, match="header|HEADER"):
        read_reports(spark, str(tmp_path), columns=["UserId", "SessionId"]).collect()


def test_many_headers_in_one_scan(spark, tmp_path, plan_of):
    for i in range(310):
        write(tmp_path, f"{i}.csv", f"UserId,c{i}\nu{i},{i}\n" if i % 2 else f"c{i},UserId\n{i},u{i}\n")
    found = read_reports(spark, str(tmp_path))
    assert len(found.columns) == 311 and plan_of(found).count("FileScan csv") == 1
    cells = [(row["UserId"], [value for name, value in row.asDict().items() if name != "UserId" and value]) for row in found.collect()]
    assert sorted(cells) == sorted((f"u{i}", [str(i)]) for i in range(310))


def test_headers_are_joined_without_a_broadcast_beyond_the_bound(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.csv", "UserId,X\na,1\n")
    write(tmp_path, "b.csv", "X,UserId\n2,b\n")
    monkeypatch.setattr(reports, "BROADCAST_CHARACTERS", 0)
    assert rows(read_reports(spark, str(tmp_path))) == [("a", "1"), ("b", "2")]


def test_lines_longer_than_their_header_are_rescued(spark, tmp_path):
    write(tmp_path, "a.csv", 'UserId,X\na,"1,1"\nb,2,more\nc\nd,3,,\n')
    found = read_reports(spark, str(tmp_path), rescued="line")
    expected = [("a", "1,1", None), ("b", "2", "b,2,more"), ("c", None, None), ("d", "3", None)]
    assert rows(found) == expected
    assert rows(read_reports(spark, str(tmp_path), columns=["UserId", "X"], rescued="line")) == expected
    write(tmp_path, "b.csv", "Y,UserId,X\n9,e,5\n8,f,6,7,8\n")
    write(tmp_path, "c.csv", "UserId\ng,h,i\n")
    found = read_reports(spark, str(tmp_path), rescued="line").select("UserId", "X", "Y", "line")
    more = [("e", "5", "9", None), ("f", "6", "8", "8,f,6,7,8"), ("g", None, None, "g,h,i")]
    assert rows(found) == [(user, x, None, line) for user, x, line in expected] + more


def test_headerless_lines_of_several_widths_in_one_file(spark, tmp_path):
    write(tmp_path, "a.csv", 'a,b\nc,d,e\n"f,g,h,i",j\nk\n')
    found = read_reports(spark, str(tmp_path), header=False)
    assert rows(found) == [("a", "b", None), ("c", "d", "e"), ("f,g,h,i", "j", None), ("k", None, None)]


def test_names_that_differ_in_case_are_not_merged(spark, tmp_path):
    write(tmp_path, "a.csv", "UserId,X\na,1\n")
    write(tmp_path, "b.csv", "userid,X\nb,2\n")
    with pytest.raises(ValueError, match="caseSensitive"):
        read_reports(spark, str(tmp_path))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        found = read_reports(spark, str(tmp_path))
        assert {tuple(row) for row in found.select("UserId", "userid", "X").collect()} == {("a", None, "1"), (None, "b", "2")}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_header_only(spark, tmp_path):
    write(tmp_path, "a.csv", "UserId,SessionId\n")
    found = read_reports(spark, str(tmp_path))
    assert found.columns == ["UserId", "SessionId"] and found.count() == 0


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_reports(spark, str(tmp_path / "none"))
