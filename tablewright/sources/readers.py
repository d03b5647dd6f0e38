"""Readers of the tabular formats, into DataFrames. Empty cells are null."""

from __future__ import annotations

import csv as _csv
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import durable, located

#: Delimiters by extension.
DELIMITERS = {"csv": ",", "tsv": "\t", "tab": "\t", "ssv": ";", "scsv": ";", "psv": "|", "cdx": " "}
#: Lines that come before the table, and the columns of tables without a header.
PREAMBLE = {"vcf": r"^##", "gtf": r"^#", "gff": r"^#", "sam": r"^@", "bed": r"^(#|track|browser)"}
HEADERLESS = {
    "gtf": "seqname source feature start end score strand frame attribute", "gff": "seqid source type start end score strand phase attributes", "bed": "chrom chrom_start chrom_end name score strand",
    "sam": "qname flag rname pos mapq cigar rnext pnext tlen seq qual",
}


def delimiter(path: str) -> str:
    name = re.sub(r"\.(gz|zst)$", "", path.lower())
    return DELIMITERS.get(name.rpartition(".")[2], ",")


def csv(spark: SparkSession, path: str | list[str], sep: str | None = None, header: bool = True, infer: bool = False, quote: str = '"', escape: str = '"', multiline: bool = False, comment: str | None = None, trim: bool = False, path_column: str | None = None, schema=None, ragged: bool = True, null: str = "") -> DataFrame:
    """Delimited text, compressed or not. Without line breaks in cells (the default) files are split among tasks.

    ragged: rows of fewer or more cells are padded or cut, else an error; null: the cells that are null (if not the empty ones, these are
    empty text where quoted).
    """
    first = path if isinstance(path, str) else path[0]
    reader = spark.read.option("sep", sep or delimiter(first)).option("header", header).option("quote", quote or "\u0000").option("escape", escape).option("multiLine", multiline)
    reader = reader.option("inferSchema", infer).option("mode", "PERMISSIVE" if ragged else "FAILFAST").option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim).option("nullValue", null)
    if quote == escape:
        reader = reader.option("charToEscapeQuoteEscaping", escape)  # by default NUL, which would be dropped from cells
    if comment:
        reader = reader.option("comment", comment)
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if not header and not schema:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    return df.withColumn(path_column, F.col("_metadata.file_path")) if path_column else df


def preambled(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """vcf, gtf, gff, sam, bed: tab-separated after lines that don't belong to the table."""
    preamble = PREAMBLE[kind]
    lines = spark.read.text(path).filter(~F.col("value").rlike(preamble))
    if kind == "vcf":
        top = spark.read.text(path).filter(F.col("value").rlike("^#[^#]")).first()
        names = top[0].lstrip("#").split("\t")
        lines = lines.filter(~F.col("value").rlike("^#"))
    else:
        names = HEADERLESS[kind].split()
    parts = F.split("value", "\t", len(names))
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def skipped(spark: SparkSession, path: str | list[str], lines: int = 0, until: str | None = None, while_: str | None = None, sep: str | None = None) -> DataFrame:
    """Delimited text after a number of lines, from the first line that matches `until`, or from the first that doesn't match `while_`,
    on: that line is the header. Every file is cut for itself, wherever in it the line is; the names are those of the first.

    A file without such a line has no rows.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    # a file's lines in order: by the place of their block, and by number within it
    at = F.struct("_block", "_id")
    if until or while_:
        hits = read.filter(F.col("value").rlike(until) if until else ~F.col("value").rlike(while_))
        starts = hits.groupBy("_file").agg(F.min_by(F.struct(at.alias("at"), "value"), at).alias("h"))
    else:
        near = Window.partitionBy("_file").orderBy(at)
        first = read.filter(F.col("_block") == 0).withColumn("_n", F.row_number().over(near))
        starts = first.filter(F.col("_n") == lines + 1).select("_file", F.struct(at.alias("at"), "value").alias("h"))
    starts = durable(starts)
    header = starts.orderBy("_file").first()
    if header is None:
        raise ValueError("no file has such a line")
    sep = sep or delimiter(path if isinstance(path, str) else path[0])
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in next(_csv.reader([header.h.value], delimiter=sep)))
    body = read.join(F.broadcast(starts), "_file").filter(at > F.col("h.at"))
    return body.select(F.from_csv("value", fields, {"sep": sep}).alias("r")).select("r.*")


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns whose names are joined by dots."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        df = df.select(*[F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}.{g.name}") if isinstance(f.dataType, T.StructType) else F.col(f"`{f.name}`").alias(f.name) for f in df.schema.fields for g in (f.dataType.fields if isinstance(f.dataType, T.StructType) else [f])])
    return df


def json(spark: SparkSession, path: str | list[str], root: str | None = None, lines: bool = False) -> DataFrame:
    df = spark.read.json(path, multiLine=not lines)
    if root:
        for step in root.split("."):
            field = df.schema[step].dataType
            df = df.select(F.explode(step).alias("r") if isinstance(field, T.ArrayType) else F.col(step).alias("r"))
            inner = df.schema["r"].dataType
            df = df.select("r.*") if isinstance(inner, T.StructType) else df.withColumnRenamed("r", "value")
    return flattened(df)


def entries(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A file that holds one JSON object, as a row for each of its entries; values that are no text as JSON."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def single(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that hold one JSON object each, as a row each, nested fields as columns joined by dots."""
    return json(spark, path)


#: Bytes of texts that `pages` gives at once.
PAGES_BYTES = 8 << 20


def pages(spark: SparkSession, path: str | list[str], name: str = "html", by_tasks: bool = False) -> DataFrame:
    """Files of a folder or pattern, a row each: path and the whole text.

    by_tasks: path are folders, each listed and read by a task through pyarrow, so that the driver knows none of their files, which may
    be too many for it.
    """
    if by_tasks:
        folders = [path] if isinstance(path, str) else path
        return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders))).mapInArrow(_read_folders, "path string, text string").withColumnRenamed("text", name)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(name))


def _read_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
        system, at = located(folder)
        paths, texts, held = [], [], 0
        for file in system.get_file_info(fs.FileSelector(at)):
            if file.is_file and not file.base_name.startswith((".", "_")):
                with system.open_input_stream(file.path) as f:
                    texts.append(str(f.read(), "utf-8", "replace"))
                paths.append(f"{folder}/{file.base_name}")
                held += file.size
                if held >= PAGES_BYTES:
                    yield _texts(paths, texts)
                    paths, texts, held = [], [], 0
        yield _texts(paths, texts)


def _texts(*columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "text"])


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    return json(spark, path, lines=True)


def toml(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """A TOML file, read by the driver."""
    data = tomllib.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    for step in (root or "").split(".") if root else []:
        data = data[step]
    rows = data if isinstance(data, list) else [data]
    flat = pd.json_normalize(rows)
    return spark.createDataFrame(flat.astype(object).where(flat.notna(), None))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet, read by the driver; needs pandas' optional engines."""
    frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


def txt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _files(spark: SparkSession, path: str, names: list[str], rows_of, shape: str) -> DataFrame:
    """Rows of whole binary files, read by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(rows_of(file, content), columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, shape)


def npy(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Arrays of two dimensions as columns c0, c1, .."""
    import io

    import numpy as np

    names = [f"c{i}" for i in range(columns)]
    return _files(spark, path, names, lambda f, c: np.load(io.BytesIO(c)).reshape(-1, columns).astype(float).tolist(), ", ".join(f"{n} double" for n in names))


def tar(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each text member."""
    import io
    import tarfile

    def rows(file, content):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            return [(m.name, t.extractfile(m).read().decode("utf-8", "replace")) for m in t if m.isfile()]

    return _files(spark, path, ["path", "content"], rows, "path string, content string")


def markdown(spark: SparkSession, path: str, nth: int = 0) -> DataFrame:
    """The nth table of a document, read by the driver."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    tables = re.findall(r"((?:^[ \t]*\|.*\n?)+)", text, re.M)
    cells = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))] for line in tables[nth].strip().splitlines()]
    rows = [r for r in cells[1:] if not all(re.fullmatch(r":?-+:?", c) for c in r)]
    return spark.createDataFrame([[c or None for c in r] for r in rows], ", ".join(f"`{n}` string" for n in cells[0]))


def integers(spark: SparkSession, end: int, start: int = 0, step: int = 1, name: str = "n", inclusive: bool = False) -> DataFrame:
    return spark.range(start, end + (1 if step > 0 else -1) * inclusive, step).withColumnRenamed("id", name)
