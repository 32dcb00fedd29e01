import sqlite3

import pytest

from flowloom.sources import sqlite


def test_tables_of_a_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "old.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE tags (id TEXT PRIMARY KEY, n INTEGER, "odd name" REAL, raw BLOB, whatever)')
        db.executemany("INSERT INTO tags VALUES (?,?,?,?,?)", [(f"t{k}", k if k % 3 else None, k / 2, bytes([k]), "x") for k in range(25)] + [("bad", "no number", "1.5", "text", 7)])
        db.execute("CREATE TABLE empty (a INT)")
    monkeypatch.setattr(sqlite, "ROWS_AT_ONCE", 10)
    df = sqlite.read_sqlite(spark, path, "tags")
    assert df.dtypes == [("id", "string"), ("n", "bigint"), ("odd name", "double"), ("raw", "binary"), ("whatever", "binary")]
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 26 and rows["t4"].n == 4 and rows["t3"].n is None and rows["t5"]["odd name"] == 2.5 and rows["t7"].raw == b"\x07"
    assert rows["bad"].n is None and rows["bad"]["odd name"] == 1.5 and rows["bad"].raw == b"text" and rows["bad"].whatever == b"7"
    assert sqlite.read_sqlite(spark, path, "empty").count() == 0
    with pytest.raises(ValueError):
        sqlite.columns_of(path, "nothing")
