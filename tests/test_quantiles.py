"""Quantiles by counting passes against sorted values."""

import numpy as np
import pytest

from orderloom.operators import quantile
from tests.test_plans import plan_of

AT = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(4)


def check(spark, values, one_task):
    got = quantile.quantiles(frame(spark, values), "v", AT, one_task).first()
    assert tuple(got) == pytest.approx(tuple(np.quantile(np.array(values, float), list(AT.values()))), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("one_task", [0, 7, 100_000])
def test_equal_to_sorted_values(spark, one_task):
    rng = np.random.default_rng(11)
    check(spark, rng.normal(size=4001), one_task)
    check(spark, np.exp(rng.normal(size=3000) * 60), one_task)  # most values in the first bin of every pass
    check(spark, np.repeat([3.0, -1.0, 7.5], [500, 1, 2]), one_task)
    check(spark, [5.0], one_task)
    check(spark, [0.0, 5e-324, 1e-323, 1.0], one_task)
    # the width of all values passes the largest double
    got = quantile.quantiles(frame(spark, [-1.7e308, 2.0, 1.7e308]), "v", {"low": 0.0, "mid": 0.5, "high": 1.0}, one_task).first()
    assert tuple(got) == (-1.7e308, 2.0, 1.7e308)


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_odd_values(spark, one_task):
    at = {"low": 0.0, "mid": 0.5, "high": 1.0}
    inf = float("inf")
    assert tuple(quantile.quantiles(frame(spark, [None, float("nan"), 1.0, 3.0]), "v", at, one_task).first()) == (1.0, 2.0, 3.0)
    assert tuple(quantile.quantiles(frame(spark, [-inf, 1.0, inf]), "v", at, one_task).first()) == (-inf, 1.0, inf)
    assert tuple(quantile.quantiles(frame(spark, [inf, inf]), "v", at, one_task).first()) == (inf, inf, inf)
    assert tuple(quantile.quantiles(frame(spark, []), "v", at, one_task).first()) == (0.0, 0.0, 0.0)
    assert tuple(quantile.quantiles(frame(spark, [None]), "v", at, one_task).first()) == (0.0, 0.0, 0.0)


def test_crew_summary_lays_out_no_range(run):
    from orderloom.operators import fulfil

    text = plan_of(fulfil.crew_summary(run.log, run.per_day, run.params))
    assert "rangepartitioning" not in text.lower()
