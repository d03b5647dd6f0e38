"""Writers: files by tasks where formats allow it, else texts rendered from rows that pass the driver one by one."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from urllib.parse import quote as quoted

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import located

#: Most files that `apart` puts into a folder.
FOLDER_FILES = 1000


def _cells(df: DataFrame, limit: int | None = None) -> Iterator[list[str]]:
    rows = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return (list(r) for r in (rows.limit(limit) if limit else rows).toLocalIterator())


#: Spark's writer would cut white space from both ends of cells, quoted ones too.
WHOLE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, quote: str = '"', quote_all: bool = False, escape_char: str = '"', crlf: bool = False, compression: str | None = None, null: str = "") -> None:
    """null: what is written for nulls; by default they are empty cells, as empty text is."""
    writer = df.write.options(**WHOLE).option("sep", sep).option("header", header).option("quote", quote).option("quoteAll", quote_all).option("escape", escape_char).option("emptyValue", "").option("nullValue", null)
    if compression:
        writer = writer.option("compression", compression)
    if not crlf:
        writer.option("lineSep", "\n").csv(path)
        return
    # Spark's writer of delimited text takes separators of one character, that of lines any
    shown = {"sep": sep, "quote": quote, "quoteAll": str(quote_all).lower(), "escape": escape_char, "emptyValue": "", "nullValue": null} | WHOLE
    rows = df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), shown).alias("value"))
    if header:
        names = F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)]), shown)
        rows = rows.withColumn("at", F.monotonically_increasing_id())
        first = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the first row of a file
        rows = rows.select(F.explode(F.when(first, F.array(names, F.col("value"))).otherwise(F.array("value"))).alias("value"))
    out = rows.write.option("lineSep", "\r\n")
    (out.option("compression", compression) if compression else out).text(path)


def ndjson(df: DataFrame, path: str, nulls: bool = False) -> None:
    df.write.option("ignoreNullFields", not nulls).json(path)


def json(df: DataFrame, nulls: bool = False) -> str:
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(not nulls).lower()}))
    return "[" + ",\n".join(r[0] for r in rows.toLocalIterator()) + "]"


def parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def txt(df: DataFrame, path: str) -> None:
    df.select(F.col(f"`{df.columns[0]}`").cast("string")).write.text(path)


def html(df: DataFrame) -> str:
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "\n".join(["<table>", "<thead>", line(df.columns, "th"), "</thead>", "<tbody>", *[line(r, "td") for r in _cells(df)], "</tbody>", "</table>"])


def latex(df: DataFrame, caption: str | None = None) -> str:
    clean = lambda s: "".join({"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}.get(c, c) for c in s)
    line = lambda cells: " & ".join(map(clean, cells)) + r" \\"
    out = [r"\begin{table}", r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", line(df.columns), r"\hline", *[line(r) for r in _cells(df)], r"\hline", r"\end{tabular}"]
    return "\n".join([*out, *([rf"\caption{{{clean(caption)}}}"] if caption else []), r"\end{table}"])


def markdown(df: DataFrame, limit: int | None = None) -> str:
    rows = list(_cells(df, limit + 1 if limit else None))
    more, rows = limit is not None and len(rows) > limit, rows[:limit]
    table = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in [df.columns, *rows, *([["…"] * len(df.columns)] if more else [])]]
    widths = [max(3, *(len(r[i]) for r in table)) for i in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |"
    return "\n".join([line(table[0]), "| " + " | ".join("-" * w for w in widths) + " |", *map(line, table[1:])])


def npy(df: DataFrame, path: str, dtype: str = "f64") -> None:
    """The numbers of a table that the driver holds."""
    import numpy as np

    table = df.toArrow()
    np.save(path, np.column_stack([c.to_numpy() for c in table.columns]).astype({"f64": "float64", "f32": "float32"}[dtype]))


def excel(df: DataFrame, path: str) -> None:
    df.toPandas().to_excel(path, index=False)


def split(df: DataFrame, path: str, size: int | None = None, chunks: int | None = None, sep: str = ",") -> None:
    """Files of at most `size` rows, or so many files."""
    writer = (df.repartition(chunks) if chunks else df).write.options(**WHOLE).option("header", True).option("sep", sep)
    (writer.option("maxRecordsPerFile", size or 4096) if not chunks else writer).csv(path)


def partition(df: DataFrame, path: str, column: str, fold: bool = True, prefix: int | None = None, drop: bool = False) -> None:
    """A folder for each value of a column, its letters' case folded, or for each of its prefixes."""
    key = F.col(f"`{column}`").cast("string")
    key = F.lower(key) if fold else key
    key = F.left(key, F.lit(prefix)) if prefix else key
    out = df.withColumn("_part", key)
    (out.drop(column) if drop else out).write.options(**WHOLE).partitionBy("_part").option("header", True).csv(path)


def apart(df: DataFrame, path: str) -> list[str]:
    """A file for each row of df(key, text), named by key, in folders below path -> the folders.

    The tasks write the files by pyarrow: Spark's writer would make a folder for each, and the driver move them one by one. Equal keys
    have files of their own; a null text is an empty file.
    """
    key, text = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, folder = TaskContext.get(), 0, ""
        system, at = located(path)
        for batch in batches:
            made = []
            for k, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if n % FOLDER_FILES == 0:
                    # an attempt has folders of its own, so what a lost one wrote is in none that is returned
                    folder = f"{task.partitionId():06d}-{task.taskAttemptId()}-{n // FOLDER_FILES:06d}"
                    system.create_dir(f"{at}/{folder}", recursive=True)
                    made.append(f"{path}/{folder}")
                with system.open_output_stream(f"{at}/{folder}/{n % FOLDER_FILES:03d}.{key}={quoted(k or '', safe='')}.txt") as out:
                    if cell.is_valid:
                        out.write(cell.as_buffer())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["folder"])

    cells = df.select(*[F.col(f"`{c}`").cast("string") for c in (key, text)])
    return [r.folder for r in cells.hint("rebalance").mapInArrow(run, "folder string").collect()]
