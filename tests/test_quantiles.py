"""Exact quantiles against plain ones, ties and groups that no task may hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.plans import quantiles as module
from stratagrid.plans.quantiles import quantiles

AT = [0.0, 0.02, 0.1, 0.5, 0.98, 1.0]


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 1, 3_000), "b": rng.integers(0, 4, 2_000).astype(float), "c": np.array([7.0]), "d": np.array([1.0, 2.0]), None: rng.exponential(5, 50), "e": np.full(400, 3.5)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None)]
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], F.col("v"), AT).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k]["n"] == len(v) and got[k]["least"] == v.min() and np.allclose(got[k]["q"], np.quantile(v, AT), rtol=1e-12)


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(k % 97),) for k in range(5_000)], "v double")
    got = quantiles(df, [], F.col("v") * 2, AT).first()
    assert got["n"] == 5_000 and np.allclose(got["q"], np.quantile([k % 97 * 2.0 for k in range(5_000)], AT))
    none = quantiles(df.where("false"), [], F.col("v"), AT).collect()
    assert [tuple(r) for r in none] == [(0, None, None)]
    assert quantiles(df.where("false").withColumn("g", F.lit(1)), ["g"], F.col("v"), AT).count() == 0
    with pytest.raises(ValueError, match="between"):
        quantiles(df, [], F.col("v"), [1.5])


def test_no_task_holds_a_large_group(spark, monkeypatch):
    """A million distinct values of one group are spread over all ranges, and a value that a third of the rows have is one row."""
    made = {}
    real = module.written
    monkeypatch.setattr(module, "written", lambda df, name: made.setdefault(name, real(df, name)))
    df = spark.range(1_500_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(5)).alias("v"))
    got = quantiles(df, ["g"], F.col("v"), [0.02, 0.5]).first()
    pieces = [r["count"] for r in made["ranges"].groupBy("sg_p").count().collect()]
    assert sum(pieces) > 900_000 and max(pieces) < sum(pieces) / 3
    exact = df.agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.5)))).first()[0]
    assert np.allclose(got["q"], exact, rtol=1e-12)
