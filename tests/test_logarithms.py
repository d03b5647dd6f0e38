import math

import duckdb
import pytest

from tablewright import language_queries, queries  # noqa: F401  (registers its queries)
from tablewright.operators import aggregate, rows

#: Spark's own ln has another last bit for 49 of these.
PRICES = [round(1000 + i * 97.31, 2) for i in range(5000)]


@pytest.mark.parametrize("name", ["scalar_math", "language_rounding"])
def test_to_the_last_bit_as_the_sql(spark, tmp_path, name):
    rows_ = [(i, i + 1, "F", p) for i, p in enumerate(PRICES)]
    spark.createDataFrame(rows_, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_edges_and_places(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (8.0,), (None,), (math.inf,)], "x double")
    for source in ("log(x) as l, log2(x) as m, log10(x) as n", "[x].map(y => log(y))[0] as l, [x].map(y => log2(y))[0] as m, [x].map(y => log10(y))[0] as n"):
        zero, below, eight, none, inf = rows.select(df, source, evaluate=True).collect()
        assert set(zero) == {-math.inf} and all(map(math.isnan, below)) and set(none) == {None} and set(inf) == {math.inf}
        assert tuple(eight) == pytest.approx((math.log(8), 3.0, math.log10(8)))
    some = df.filter("x = 8 or x is null")
    assert aggregate.groupby(some, "x", "sum(log2(x)) as s, log2(sum(x)) as t").filter("x = 8").first()[1:] == (3.0, 3.0)
    assert rows.filter_rows(some, "log2(x) == 3").count() == 1
    assert [r.l for r in aggregate.window(some.filter("x = 8"), "log2(lead(x)) as l, cumsum(log2(x)) as c", "x").collect()] == [None]


def test_prices_that_64_bits_do_not_hold(spark, tmp_path):
    odd = [0.0, -0.0, -1.5, 250.005, 9.3e18, -1e20, 1e300, math.inf, -math.inf, math.nan, None]
    spark.createDataFrame([(i, i + 1, p) for i, p in enumerate(odd)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(queries.SQL["scalar_math"])
    got = queries.QUERIES["scalar_math"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
