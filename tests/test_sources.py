import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright import streaming
from tablewright.sources import readers, writers


def got(df):
    return [tuple(r) for r in df.collect()]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t\n2\tb\n")
    assert got(readers.csv(spark, str(tmp_path / "a.tsv"))) == [("1", None), ("2", "b")]
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b'x,y\n"a ""q"", b",2\n3\n'))
    df = readers.csv(spark, str(tmp_path / "b.csv.gz"), path_column="file")
    assert [r[:2] for r in got(df)] == [('a "q", b', "2"), ("3", None)] and df.first().file.endswith("b.csv.gz")
    (tmp_path / "c.csv").write_text("1,2\n3,4\n")
    assert readers.csv(spark, str(tmp_path / "c.csv"), header=False).columns == ["0", "1"]
    (tmp_path / "d.csv").write_text("junk\nmore\na,b\n1,2\n")
    assert got(readers.skipped(spark, str(tmp_path / "d.csv"), until="^a,")) == [("1", "2")]
    (tmp_path / "e.bed").write_text("track x\nchr1\t5\t9\n")
    assert got(readers.preambled(spark, str(tmp_path / "e.bed"), "bed").select("chrom", "chrom_end", "name")) == [("chr1", "9", None)]
    (tmp_path / "f.vcf").write_text("##v\n#CHROM\tPOS\nchr1\t5\n")
    assert got(readers.preambled(spark, str(tmp_path / "f.vcf"), "vcf").select("CHROM", "POS")) == [("chr1", "5")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"a": 1, "b": {"c": "x"}}, {"a": 2}]}')
    assert got(readers.json(spark, str(tmp_path / "a.json"), "rows")) == [(1, "x"), (2, None)]
    (tmp_path / "b.ndjson").write_text('{"a": 1}\n{"a": 2}\n')
    assert got(readers.ndjson(spark, str(tmp_path / "b.ndjson"))) == [(1,), (2,)]
    (tmp_path / "c.toml").write_text('[[t]]\na = 1\n[[t]]\na = 2\n')
    assert got(readers.toml(spark, str(tmp_path / "c.toml"), "t")) == [(1,), (2,)]
    (tmp_path / "d.md").write_text("text\n\n| a | b |\n| - | - |\n| 1 | x |\n")
    assert got(readers.markdown(spark, str(tmp_path / "d.md"))) == [("1", "x")]
    np.save(tmp_path / "e.npy", np.arange(6).reshape(3, 2))
    assert got(readers.npy(spark, str(tmp_path / "e.npy"), 2)) == [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)]
    with tarfile.open(tmp_path / "f.tar", "w") as t:
        info = tarfile.TarInfo("m.txt")
        info.size = 5
        t.addfile(info, io.BytesIO(b"hello"))
    assert got(readers.tar(spark, str(tmp_path / "f.tar"))) == [("m.txt", "hello")]
    assert got(readers.integers(spark, 3, inclusive=True)) == [(0,), (1,), (2,), (3,)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b'), (2, None)], "n int, s string").coalesce(1)
    writers.csv(df, str(tmp_path / "csv"))
    assert got(readers.csv(spark, str(tmp_path / "csv"))) == [("1", 'a"b'), ("2", None)]
    writers.ndjson(df, str(tmp_path / "nd"), nulls=True)
    assert got(readers.ndjson(spark, str(tmp_path / "nd")).select("n", "s")) == [(1, 'a"b'), (2, None)]
    assert writers.json(df) == '[{"n":1,"s":"a\\"b"},\n{"n":2}]'
    assert writers.markdown(df, 1).splitlines() == ["| n   | s   |", "| --- | --- |", '| 1   | a"b |', "| …   | …   |"]
    assert "<td>a&quot;b</td>" in writers.html(df) and r"\hline" in writers.latex(df, "c")
    writers.partition(df, str(tmp_path / "part"), "s")
    assert any(p.name == "_part=a%22b" for p in (tmp_path / "part").iterdir())
    writers.split(spark.range(10), str(tmp_path / "split"), size=3)
    writers.npy(df.select("n"), str(tmp_path / "n.npy"))
    assert np.load(tmp_path / "n.npy").tolist() == [[1.0], [2.0]]


def test_streams(spark, tmp_path):
    rows = [(1, "a", 1.0), (2, "b", 2.0), (3, "a", 3.0)]
    spark.createDataFrame(rows, "n int, k string, v double").withColumn("ts", F.timestamp_seconds("n")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/t.parquet").schema).parquet(f"{tmp_path}/t.parquet")
    assert sorted(got(streaming.collected(streaming.groupby(stream, "k", "sum(v) as s"), "s1", "complete"))) == [("a", 4.0), ("b", 2.0)]
    assert sorted(got(streaming.collected(streaming.dedup(stream, "k", "ts").select("k"), "s2"))) == [("a",), ("b",)]
    assert sorted(got(streaming.collected(streaming.frequency(stream, "k"), "s3", "complete"))) == [("k", "a", 2), ("k", "b", 1)]
    assert sorted(got(streaming.collected(streaming.running_sum(stream, "k", "n", "v"), "s4").select("n", "cumsum"))) == [(1, 1.0), (2, 2.0), (3, 4.0)]


def test_reader_of_missing_extension(spark):
    assert readers.delimiter("x.PSV") == "|" and readers.delimiter("x.csv.gz") == "," and readers.delimiter("y") == ","
    with pytest.raises(KeyError):
        readers.preambled(spark, "x", "nothing")
