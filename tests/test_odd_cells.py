import gzip
from pathlib import Path

import pytest

from tablewright import queries, source_queries  # noqa: F401  (registers its queries)
from tablewright.sources import readers, writers

TEXTS = ["plain", "", None, " both ", "\ttab", "\nline\n", "\r\nlines\r\n", "\r", "\0", 'a\0"b', '"', '""', '\\"', "\\", "null", "\ufeffmark", ' , "x" ,\n"']


def test_source_csv_quoted_keeps_all_texts(spark, tmp_path):
    rows = [(i, x, TEXTS[-i]) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["source_csv_quoted"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: int(r[0])) == [(str(i), x, y) for i, x, y in rows]


def test_source_csv_quoted_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["source_csv_quoted"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang"] and got.count() == 0


@pytest.mark.parametrize("crlf", [False, True])
def test_white_space_at_the_ends_of_cells(spark, tmp_path, crlf):
    rows = [("1", " a "), ("2", "\tb"), ("3", "c  ")]
    writers.csv(spark.createDataFrame(rows, "k string, v string"), f"{tmp_path}/t.csv", crlf=crlf)
    assert sorted(map(tuple, readers.csv(spark, f"{tmp_path}/t.csv").collect())) == rows


def test_white_space_in_files_of_split_and_partition(spark, tmp_path):
    df = spark.createDataFrame([("x", " a ")], "k string, v string")
    writers.split(df, f"{tmp_path}/split", size=10)
    writers.partition(df, f"{tmp_path}/part", "k")
    for folder in ("split", "part"):
        assert readers.csv(spark, f"{tmp_path}/{folder}").first().v == " a "


def test_quotes_in_read_cells(spark, tmp_path):
    text = 'k,v\n1,"say ""no"""\n2,5" wide\n3,""""\n4,""\n'
    Path(f"{tmp_path}/q.csv.gz").write_bytes(gzip.compress(text.encode()))
    assert [tuple(r) for r in readers.csv(spark, f"{tmp_path}/q.csv.gz").collect()] == [("1", 'say "no"'), ("2", '5" wide'), ("3", '"'), ("4", None)]
