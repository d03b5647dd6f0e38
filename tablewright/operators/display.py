"""Texts for terminals, from aggregates that are small by nature: previews, histograms, sparklines, and the data of plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "▏▎▍▌▋▊▉█"


def view(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a table."""
    cells = [list(df.columns)] + [["" if x is None else str(x) for x in r] for r in df.limit(rows).collect()]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    line = lambda r: "│ " + " │ ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " │"
    rule = "├─" + "─┼─".join("─" * w for w in widths) + "─┤"
    return "\n".join([line(cells[0]), rule, *map(line, cells[1:])])


def bar(value: float, most: float, width: int = 40) -> str:
    eighths = round(8 * width * value / most) if most else 0
    return "█" * (eighths // 8) + (BLOCKS[eighths % 8 - 1] if eighths % 8 else "")


def hist(counts: DataFrame, width: int = 40, limit: int = 1000) -> str:
    """Bars of field, value, count rows, as `frequency` and `bins` give them, field by field."""
    out, rows = [], counts.select("field", "value", "count").limit(limit).collect()
    for field in dict.fromkeys(r.field for r in rows):
        own = [r for r in rows if r.field == field]
        most, total, label = max(r["count"] for r in own), sum(r["count"] for r in own), max(len(str(r.value)) for r in own)
        out.append(f"{field} ({total})")
        out += [f"{str(r.value).ljust(label)} {bar(r['count'], most, width)} {r['count']} {100 * r['count'] / total:.1f}%" for r in own]
    return "\n".join(out)


def plot_points(df: DataFrame, x: str, y: str | None = None, buckets: int = 60, how: str = "mean") -> DataFrame:
    """x bucketed into equal widths, with the count, sum or mean of y in each: what a line plot draws."""
    cell = F.col(f"`{x}`").cast("double")
    ends = df.agg(F.min(cell).alias("a"), F.max(cell).alias("b")).first()
    if ends.a is None:
        return df.sparkSession.createDataFrame([], "x double, y double")
    step = (ends.b - ends.a) / buckets or 1.0
    at = F.least(F.floor((cell - ends.a) / step), F.lit(buckets - 1))
    value: Column = F.count(F.lit(1)) if y is None else {"sum": F.sum, "mean": F.avg, "count": F.count}[how](F.col(f"`{y}`"))
    made = df.filter(cell.isNotNull()).groupBy(at.alias("_at")).agg(value.cast("double").alias("y"))
    return made.select((F.lit(float(ends.a)) + (F.col("_at") + 0.5) * step).alias("x"), "y").orderBy("x")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept and r2 of the least squares line."""
    a, b = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))
