"""Exact quantiles by narrowing, with limits so small that every path is taken."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from earshot.operators import quality
from earshot.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0)


def columns():
    r = random.Random(4)
    n = 3000
    ties = [r.choice([1.0, 2.0, 2.0, 2.0, 7.5, None]) for _ in range(n)]
    return {
        "spread": [r.uniform(-1e6, 1e6) for _ in range(n)],
        "steep": [math.exp(r.uniform(-600, 600)) * r.choice([-1, 1]) for _ in range(n)],
        "ties": ties,
        "one": [4.0] * n,
        "none": [None] * n,
        "few": [3.0, 9.0] + [None] * (n - 2),
        "half": [0.0] * (n // 2) + [float(i) for i in range(n // 2)],
    }


@pytest.mark.parametrize("accuracy,limit", [(10_000, 100_000), (50, 10), (20, 1), (100, 400)])
def test_quantiles_match_sql(spark, accuracy, limit):
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data)).repartition(5)
    got = exact_quantiles(df, {c: SHARES for c in data}, accuracy, limit)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t ({', '.join(f'{c} DOUBLE' for c in data)})")
    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(data))})", list(zip(*data.values(), strict=True)))
    for c in data:
        want = [con.execute(f"SELECT quantile_cont({c}, {p}) FROM t").fetchone()[0] for p in SHARES]
        if want[0] is None:
            assert got[c] == want
        else:
            assert got[c] == pytest.approx(want, rel=1e-12, abs=1e-300), c


def test_no_step_gathers_a_column(spark):
    """With a small limit the largest list that a pass may collect is small, too."""
    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double").alias("x"))
    values = sorted(r.x for r in df.collect())
    got = exact_quantiles(df, {"x": (0.5, 0.123)}, accuracy=100, limit=50)["x"]
    for p, v in zip((0.5, 0.123), got, strict=True):
        place = p * (len(values) - 1)
        low = math.floor(place)
        assert v == pytest.approx(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low))


def test_empty_table_has_no_quantiles(spark):
    none = spark.createDataFrame([], "x double, `a b` int")
    assert exact_quantiles(none, {"x": (0.5,), "a b": (0.1, 0.2)}) == {"x": [None], "a b": [None, None]}
    assert quality.iqr_outliers(none, "x").first().n_outliers == 0
