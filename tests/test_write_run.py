"""What a run's writer moves, and what it refuses where the price comes in."""

import os

import pytest
from pyspark.sql import functions as F

from test_runs import PRICES, predictions
from tracegauge.functions import text as X
from tracegauge.schemas import IntegrityError
from tracegauge.sources import traces as TR


@pytest.mark.parametrize("secret", ["2.3456785E7", '2.3456785E7,"never'])
def test_a_secret_in_a_cost_stops_the_write(spark, tmp_path, secret):
    prices = spark.createDataFrame([("m", 23456785.0, 0.0, True)], PRICES)
    secrets = X.secret_table(spark, [secret, "2.3456785E7"])
    with pytest.raises(IntegrityError):
        TR.write_run(predictions(spark), prices, secrets, f"{tmp_path}/run")
    assert not os.path.exists(f"{tmp_path}/run/predictions") and not os.path.exists(f"{tmp_path}/run/attempts")


def test_rows_of_a_model_with_two_prices_are_doubled_in_both_files(spark, tmp_path):
    prices = spark.createDataFrame([("m", 2.0, 0.0, True), ("m", 3.0, 0.0, True), (None, 1.0, 1.0, True)], PRICES)
    TR.write_run(predictions(spark, n=4), prices, X.secret_table(spark, ["correct-horse-battery"]), f"{tmp_path}/run")
    assert spark.read.parquet(f"{tmp_path}/run/predictions").count() == 8
    assert spark.read.parquet(f"{tmp_path}/run/attempts").count() == 12


def test_rows_are_joined_with_prices_once(spark, tmp_path, monkeypatch):
    """rows were shuffled by model for the check, for the rows and for the attempts."""
    frame = type(spark.range(1))
    plans, write, collect = [], frame.write, frame.collect
    kept = lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(frame, "write", property(lambda self: (kept(self), write.fget(self))[1]))
    monkeypatch.setattr(frame, "collect", lambda self: (kept(self), collect(self))[1])
    prices = spark.createDataFrame([("m", 2.0, 0.0, True)], PRICES)
    TR.write_run(predictions(spark), prices, X.secret_table(spark, ["correct-horse-battery"]), f"{tmp_path}/run")
    monkeypatch.undo()
    assert len(plans) >= 3 and sum("Join LeftOuter" in p for p in plans) == 1
    assert spark.read.parquet(f"{tmp_path}/run/predictions").where(F.col("cost_usd") == 2.0).count() == 3
