"""Plan properties: every registered query stays JVM-side (no Python in its physical
plan, of any kind) and scans are column-pruned."""

import re

import pytest

from tests.conftest import SMOKE


def _names():
    from tabloom.plans import registry as r
    r.load_all()
    return sorted(r.QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Operators and expressions that run Python; the bare word is also a value in the data.
PYTHON = r"\w+Python\b|Python[A-Z]|pythonU|InArrow|InPandas|Pandas"


@pytest.mark.parametrize("name", _names())
def test_no_python_udf(spark, registry, name):
    plan = _plan(registry.QUERIES[name](spark, SMOKE))
    assert not re.search(PYTHON, plan), name


def test_flagship_scans_are_pruned(spark, registry):
    from tabloom.plans.inputs import project_frame
    plan = project_frame(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    li = [s for s in schemas if "l_orderkey" in s]
    assert li and all(set(f.split(":")[0] for f in s.split(",")) == {"l_orderkey", "l_partkey"} for s in li)


def test_python_operators_are_recognised(spark):
    df = spark.range(3)
    assert re.search(PYTHON, _plan(df.mapInArrow(lambda it: it, "id long")))
    assert re.search(PYTHON, _plan(df.mapInPandas(lambda it: it, "id long")))
    from pyspark.sql import functions as F
    assert re.search(PYTHON, _plan(df.select(F.udf(lambda x: x, "long")("id"))))
    assert not re.search(PYTHON, _plan(df.select(F.when(F.col("id") > 1, "Python").otherwise("Java"))))
