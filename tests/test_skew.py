"""A third of all lines on one invoice, one day and one item, with every bounded-group limit set low."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracles
from orderloom.operators import delivery, fulfil, forecast, prefix, readout, reconcile
from orderloom.params import DEFAULTS
from orderloom.plans.run import Run
from orderloom.sources.tables import testdata_txn as raw_lines
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

HOT_DAY = dt.datetime(1998, 6, 3)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """The skewed lines as a table, and a run over them on the paths meant for large groups."""
    base = raw_lines(spark, SMALL)
    number = F.regexp_replace("invoice", "C", "").cast("bigint")
    one_invoice, one_day = F.col("_n") % 6 == 0, F.col("_n") % 6 <= 1
    skewed = (
        base.withColumn("_n", number)
        .withColumn("invoice", F.when(one_invoice & ~F.col("invoice").startswith("C"), "HOT").otherwise(F.col("invoice")))
        .withColumn("invoice_ts", F.when(one_day, F.lit(HOT_DAY).cast("timestamp_ntz")).otherwise(F.col("invoice_ts")))
        .withColumn("stock_code", F.when(F.col("_n") % 3 == 1, "HOT ITEM").otherwise(F.col("stock_code")))
        .drop("_n")
    )
    path = str(tmp_path_factory.mktemp("hot") / "txn")
    skewed.write.parquet(path)
    old = prefix.ONE_TASK_ROWS
    prefix.ONE_TASK_ROWS = 20
    run = Run(spark.read.parquet(path), DEFAULTS, forecast.CLOSED_FORM)
    yield run, path
    prefix.ONE_TASK_ROWS = old


@pytest.fixture(scope="module")
def check(hot):
    run, path = hot
    duck = connect(SMALL)
    txn = f"SELECT * FROM '{path}/*.parquet'"

    def same(df, sql, **digits):
        for c, d in digits.items():
            df = df.withColumn(c, F.round(c, d))
        difference, n = compare(df, duck, oracles.statement(sql, txn=txn))
        assert difference is None, difference
        assert n > 0

    return same


def test_the_lines_are_skewed(hot):
    lines = hot[0].lines
    total = lines.count()
    assert lines.filter("invoice = 'HOT'").count() > total / 8
    assert lines.filter("stock_code = 'HOT ITEM'").count() > total / 4
    assert hot[0].window_lines.filter(F.col("invoice_ts") == HOT_DAY).count() > total / 4


def test_demand_and_forecast(hot, check):
    check(hot[0].items, "SELECT * FROM items")
    check(hot[0].demand, "SELECT * FROM demand")
    check(hot[0].forecasts, "SELECT * REPLACE (round(units, 6) AS units, round(sigma, 6) AS sigma) FROM forecasts", units=6, sigma=6)


def test_tours_and_cartons(hot, check):
    check(hot[0].evaluated.select("variant", "invoice", "travel_m"), "SELECT variant, invoice, travel_m FROM tours")
    check(fulfil.cartons(hot[0].quantities), "SELECT * FROM packed")


def test_crew_log(hot, check):
    check(
        hot[0].log.select("invoice", "lane", "finish_of_day_min", "wait_min", "day"),
        "SELECT invoice, lane, round(finish_of_day_min, 6) AS finish_of_day_min, round(wait_min, 6) AS wait_min, day FROM flog",
        finish_of_day_min=6, wait_min=6,
    )


def test_routes_of_a_hot_day_are_the_whole_days_plan(hot, monkeypatch):
    run = hot[0]
    hottest = run.nodes.groupBy("day").count().orderBy(F.desc("count")).first()
    nodes = run.nodes.filter(F.col("day") == hottest.day).collect()
    nodes.sort(key=lambda r: r.k)
    plan = delivery.merge_by_savings(*(np.array([r[c] for r in nodes]) for c in ("x_km", "y_km", "load")), DEFAULTS.vehicle_cartons)
    found = {}
    for r in run.routes.filter(F.col("day") == hottest.day).orderBy("seq").collect():
        found.setdefault(r.route, []).append(r.invoice)
    assert sorted(found.values()) == sorted([nodes[k].invoice for k in (r if r[0] <= r[-1] else r[::-1])] for r in plan)
    monkeypatch.setattr(delivery, "DAY_IN_TASK", hottest["count"] - 1)
    again = {}
    for r in delivery.savings_routes(run.nodes).filter(F.col("day") == hottest.day).orderBy("seq").collect():
        again.setdefault(r.route, []).append(r.invoice)
    assert again == found


def test_routes_cover_every_order(hot):
    run = hot[0]
    assert sorted(r[0] for r in run.routes.select("invoice").collect()) == sorted(r[0] for r in run.nodes.select("invoice").collect())
    assert delivery.km_bounds(run.delivery_daily).filter("NOT inside").count() == 0


def test_identities_hold(hot):
    run = hot[0]
    assert run.checks.filter("NOT passed").count() == 0 and run.checks.count() == 12  # no published figure here
    assert reconcile.allocation(run.economics, run.per_item, run.ledger_lines, run.log).first().passed


def test_readouts_add_up(hot):
    run = hot[0]
    deciles = readout.decile_table(run.by_cost).agg(F.sum("orders"), F.sum("delivered_gbp")).first()
    total = run.economics.agg(F.count("*"), F.sum("delivered_cost")).first()
    assert deciles[0] == total[0] and deciles[1] == pytest.approx(total[1])
