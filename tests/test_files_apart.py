from pathlib import Path
from urllib.parse import urlsplit

import duckdb

from tablewright import queries, source_queries, storage
from tablewright.sources import readers, writers

PAGE = "<!DOCTYPE html><html><head><title>{}</title></head><body>ö\r\n</body></html>"


def test_files_of_all_rows_in_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FOLDER_FILES", 10)
    rows = [(k, f"text {k}\r\nö\n") for k in [*range(-5, 40), 7, 7, None]] + [(100, ""), (101, None)]
    folders = writers.apart(spark.createDataFrame(rows, "k long, t string"), f"file://{tmp_path}/a b")
    files = [list(Path(urlsplit(f).path).iterdir()) for f in folders]
    assert sum(map(len, files)) == len(rows) and max(map(len, files)) <= 10 and len(folders) <= 5 + spark.sparkContext.defaultParallelism
    got = readers.pages(spark, folders, by_tasks=True).collect()
    assert sorted((r.path.rsplit("k=")[-1], r.html) for r in got) == sorted((f"{'' if k is None else k}.txt", t or "") for k, t in rows)


def test_scrape_files_keeps_every_page_and_makes_no_folder_for_each(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(source_queries, "scratch", lambda s, name: made.append(storage.scratch(s, name)) or made[-1])
    rows = [(i, PAGE.format(f"page {i} &amp; &lt;")) for i in [*range(300), 5, 5, None, -3]]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.SQL["scrape_files"])
    got = queries.QUERIES["scrape_files"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    assert sum(p.is_dir() for p in Path(urlsplit(made[0]).path).iterdir()) <= 2 * spark.sparkContext.defaultParallelism


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.QUERIES["scrape_files"](spark, str(tmp_path)).collect() == []
