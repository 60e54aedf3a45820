"""Property tests of the shared operators against brute-force Python."""

from __future__ import annotations

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions import decade, round_half_away
from marquee.operators import default_members, top_k_per_group

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

names = st.text(alphabet="abcde", min_size=1, max_size=3)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), names, st.integers(0, 5)), max_size=40), st.integers(1, 4))
def test_top_k_per_group_is_brute_force(spark, data, k):
    df = spark.createDataFrame(data, "g int, name string, n int") if data else \
        spark.createDataFrame([], "g int, name string, n int")
    got = sorted(tuple(r) for r in top_k_per_group(df, ["g"], [F.col("n").desc(), F.col("name").asc()], k)
                 .select("g", "name", "n").collect())
    want = []
    for g in {x[0] for x in data}:
        rows = sorted((x for x in data if x[0] == g), key=lambda x: (-x[2], x[1]))
        want += rows[:k]
    assert got == sorted(want)


@SETTINGS
@given(st.sets(names, max_size=8), st.lists(names, min_size=1, max_size=4, unique=True))
def test_default_members_rule(spark, members, preferred):
    df = spark.createDataFrame([(m,) for m in members], "m string") if members else \
        spark.createDataFrame([], "m string")
    got = [r["m"] for r in default_members(df, "m", preferred).orderBy("position").collect()]
    if all(p in members for p in preferred):
        want = list(preferred)
    else:
        want = sorted(members)[: len(preferred)]
    assert got == want


@SETTINGS
@given(st.lists(st.integers(-3000, 3000), min_size=1, max_size=30))
def test_decade_is_floor_division(spark, years):
    got = [r["d"] for r in spark.createDataFrame([(y,) for y in years], "y int")
           .select(decade("y").alias("d")).collect()]
    assert got == [(y // 10) * 10 for y in years]


@SETTINGS
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False), min_size=1, max_size=30),
       st.integers(0, 6))
def test_round_half_away_equals_sql_round(spark, xs, digits):
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in xs], "x double")
           .select(round_half_away("x", digits).alias("r")).collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute(f"SELECT round(x, {digits}) FROM (SELECT unnest(?) AS x)", [xs]).fetchall()]
    assert got == want  # exact; -0.0 == 0.0
