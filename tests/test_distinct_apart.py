from pyspark.sql import functions as F

from tablewright.operators import aggregate


def test_distinct_counts_beside_objects(spark):
    df = spark.range(600).select((F.when(F.col("id") % 4 > 0, F.col("id") % 4)).alias("k"), (F.col("id") % 50).alias("u"), F.col("id").cast("double").alias("v"))
    out = aggregate.groupby(df, "k", "cardinality(u) as c, median(v) as m, approx_quantile(v, 0.5) as q, count() as n, approx_cardinality(u) as a")
    want = {}
    for i in range(600):
        want.setdefault(i % 4 or None, []).append(i)
    assert out.columns == ["k", "c", "m", "q", "n", "a"]
    got = {r.k: (r.c, r.m, r.n) for r in out.collect()}
    assert got == {k: (len({i % 50 for i in x}), (x[74] + x[75]) / 2, 150) for k, x in want.items()}
    assert all(abs(r.a - r.c) <= 2 for r in out.collect())
    parts = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert len(parts) == 3 and not any("count(distinct" in p and ("percentile" in p or "approx" in p) for p in parts)
    row = aggregate.agg(df, "median(v) as m, cardinality(u) as c").first()
    assert (row.m, row.c) == (299.5, 50)
    none = aggregate.agg(df.filter("u < 0"), "median(v) as m, cardinality(u) as c").first()
    assert (none.m, none.c) == (None, 0)
