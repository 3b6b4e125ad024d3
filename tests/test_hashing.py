"""The portable row hash gives identical values in Spark and in SQL (DuckDB)."""

import duckdb
from pyspark.sql import functions as F

from tabloom.functions.hashing import mix32, mix32_sql, unit_uniform

KEYS = [0, 1, 2, 7, 123, 65535, 65536, 2**31 - 1, 2**31, 2**32 + 5, 2**40 + 3, 10**15, -1, -2**33]


def test_mix32_matches_sql(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "k long")
    for seed in (0, 5, 42, 123):
        got = [r[0] for r in df.select(mix32("k", seed)).collect()]
        con = duckdb.connect()
        exp = [con.execute(f"SELECT {mix32_sql(str(k) + '::BIGINT', seed)}").fetchone()[0] for k in KEYS]
        assert got == exp
        assert all(0 <= v < 2**32 for v in got)


def test_unit_uniform_open_interval(spark):
    df = spark.range(10000).select(unit_uniform(F.col("id"), 3).alias("u"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.02
