import pytest

from tablewright.operators import rows


def test_powers_of_whole_numbers_are_exact(spark):
    ns = [0, 1, -1, 3, 94_906_267, 590_149_999, None]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = rows.select(df, "n, n ** 0 as a, n ** 2 as b, n ** 1 as c", evaluate=True).collect()
    assert [tuple(r) for r in got] == [(n, *(None if n is None else n**e for e in (0, 2, 1))) for n in ns]
    small = spark.createDataFrame([(3,), (-2,), (0,), (1,)], "n int")
    assert [r[0] for r in rows.select(small, "n ** 39 as p", evaluate=True).collect()] == [3**39, -(2**39), 0, 1]
    unit = spark.createDataFrame([(-1,), (1,), (0,)], "n long")
    assert [tuple(r) for r in rows.select(unit, "n ** 1000001 as p, n ** 1000000 as q", evaluate=True).collect()] == [(-1, 1), (1, 1), (0, 0)]


def test_powers_beyond_64_bits(spark):
    df = spark.createDataFrame([(4_000_000_000,), (2,)], "n long")
    assert [tuple(r) for r in rows.select(df, "try(n ** 2) as p, try(n ** 64) as q", evaluate=True).collect()] == [(None, None), (4, None)]
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        rows.select(df, "n ** 2 as p", evaluate=True).collect()
