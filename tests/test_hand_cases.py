"""Small cases worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.functions import provenance
from orderloom.operators import assign, clean, demand, forecast, fulfil, quantile, readout, slotting, stock
from orderloom.params import DEFAULTS
from orderloom.sources import transactions

TXN = (
    "invoice string, stock_code string, description string, quantity bigint, invoice_ts timestamp_ntz, "
    "price double, customer_id bigint, country string, source string"
)


def txn(spark, rows):
    full = [
        (r[0], r[1], r[2] if len(r) > 2 else "THING", r[3] if len(r) > 3 else 1,
         r[4] if len(r) > 4 else dt.datetime(2020, 1, 6), r[5] if len(r) > 5 else 2.0, r[6] if len(r) > 6 else 7,
         "France", "a")
        for r in rows
    ]
    return spark.createDataFrame(full, TXN)


def vectors(spark, **named):
    return spark.createDataFrame([(k, 1, [float(v) for v in y]) for k, y in named.items()],
                                 "stock_code string, fold int, y array<double>")


def pred(df, h=2):
    return {r.stock_code: r.pred for r in df.collect()}


# ---- cleaning
def test_code_list_is_case_sensitive_and_voucher_prefix_is_not(spark):
    codes = ["M", "m", "POST", "post", "GIFT_1", "gift_2", "85123A", "d", "D"]
    df = clean.sales_lines(txn(spark, [("1", c) for c in codes]))
    assert {r.stock_code for r in df.collect()} == {"post", "85123A", "d"}


def test_returns_keep_zero_price_and_any_quantity(spark):
    rows = [("C1", "A", "X", -3, dt.datetime(2020, 1, 6), 0.0), ("C2", "POST"), ("2", "A", "X", 0), ("3", "A", "X", 2, dt.datetime(2020, 1, 6), 0.0)]
    df = txn(spark, rows)
    assert [r.invoice for r in clean.return_lines(df).collect()] == ["C1"]
    assert clean.sales_lines(df).count() == 0


def test_duplicates_treat_null_as_equal_and_log_adds_up(spark):
    rows = [("1", "A", None, 1, dt.datetime(2020, 1, 6), 2.0, None)] * 3 + [("1", "K"), ("C1", "K"), ("2", "POST")]
    df = txn(spark, rows)
    assert clean.drop_exact_duplicates(df).count() == 4
    log = {r.step_no: r for r in clean.cleaning_log(df).collect()}
    assert [(log[i].rows_in, log[i].rows_out) for i in range(1, 7)] == [(6, 4), (4, 3), (3, 2), (2, 2), (2, 2), (2, 2)]
    assert log[6].note.startswith("1 lines without a customer")


def test_log_of_no_lines(spark):
    log = clean.cleaning_log(txn(spark, [("1", "A")]).limit(0)).collect()
    assert len(log) == 6 and all(r.rows_in == 0 and r.pct_removed == 0.0 for r in log)


def test_unreadable_quantity_fails_and_unreadable_date_is_null(spark):
    raw = spark.createDataFrame(
        [("1", "A", "x", "6", "not a date", "2.5", "12345.0", "UK")],
        "Invoice string, StockCode string, Description string, Quantity string, InvoiceDate string, Price string, "
        "`Customer ID` string, Country string",
    )
    row = transactions.type_cast(raw).first()
    assert (row.quantity, row.invoice_ts, row.customer_id) == (6, None, 12345)
    with pytest.raises(Exception, match="unreadable quantity"):
        transactions.type_cast(raw.withColumn("Quantity", F.lit("six"))).collect()
    with pytest.raises(Exception, match="unreadable quantity"):
        transactions.type_cast(raw.withColumn("Quantity", F.lit("six"))).select("invoice", "price").collect()


# ---- demand
def weeks_of(spark, *days):
    return demand.weekly_index(clean.sales_lines(txn(spark, [(str(i), "A", "X", 1, d) for i, d in enumerate(days)])))


def test_both_end_weeks_are_dropped_even_when_complete(spark):
    got = weeks_of(spark, dt.datetime(2020, 1, 6), dt.datetime(2020, 1, 26))
    assert [r.week for r in got.collect()] == [dt.date(2020, 1, 19)]
    assert weeks_of(spark, dt.datetime(2020, 1, 6), dt.datetime(2020, 1, 19)).count() == 0


def test_week_ends_on_sunday(spark):
    days = [(dt.datetime(2020, 1, d),) for d in range(5, 14)]
    from orderloom.functions.expr import week_end

    got = [r.w.day for r in spark.createDataFrame(days, "t timestamp_ntz").select(week_end(F.col("t")).alias("w")).collect()]
    assert got == [5, 12, 12, 12, 12, 12, 12, 12, 19]


def test_item_sold_only_in_dropped_weeks_keeps_zero_rows(spark):
    sales = clean.sales_lines(
        txn(spark, [("1", "EDGE", "X", 5, dt.datetime(2020, 1, 6)), ("2", "MID", "X", 1, dt.datetime(2020, 1, 21)),
                    ("3", "MID", "X", 1, dt.datetime(2020, 2, 3))])
    )
    items, weeks = demand.tracked_items(sales, 10), demand.weekly_index(sales)
    got = {(r.stock_code, str(r.week)): r.units for r in demand.weekly_demand(sales, items, weeks, 10).collect()}
    assert got == {
        ("EDGE", "2020-01-19"): 0.0, ("EDGE", "2020-01-26"): 0.0, ("EDGE", "2020-02-02"): 0.0,
        ("MID", "2020-01-26"): 1.0, ("MID", "2020-02-02"): 0.0,
    }


def test_busiest_window_tie_takes_earliest_and_short_calendar_is_whole(spark):
    weeks = spark.createDataFrame([(dt.date(2020, 1, 5) + dt.timedelta(7 * i), i) for i in range(5)], "week date, idx int")
    lines = spark.createDataFrame([(dt.date(2020, 1, 12),), (dt.date(2020, 1, 26),)], "week date")
    got = lambda n: sorted(r.week.day for r in demand.busiest_window(lines, weeks, n).collect())
    assert got(2) == [5, 12]
    assert len(got(5)) == 5 and len(got(9)) == 5


def test_modal_description_ties_and_nulls(spark):
    sales = clean.sales_lines(txn(spark, [("1", "A", "B"), ("2", "A", "A"), ("3", "N", None)]))
    got = {r.stock_code: r.description for r in demand.modal_description(sales, demand.tracked_items(sales, 5), 5).collect()}
    assert got == {"A": "A", "N": ""}


# ---- forecast
def test_classes(spark):
    rows = []
    for name, y in {
        "smooth": [5] * 40, "intermittent": [5 if i % 4 == 0 else 0 for i in range(40)],
        "lumpy": [(1 if i % 8 == 0 else 50) if i % 4 == 0 else 0 for i in range(40)], "no-demand": [0] * 40,
        "erratic": [1 if i % 2 else 50 for i in range(40)],
    }.items():
        rows += [(name, i, float(v)) for i, v in enumerate(y)]
    df = forecast.classify(spark.createDataFrame(rows, "stock_code string, idx int, units double"))
    got = {r.stock_code: (r["class"], r.eligible) for r in df.collect()}
    assert got == {c: (c, c != "no-demand") for c in ("smooth", "intermittent", "lumpy", "no-demand", "erratic")}


def test_folds_train_before_test(spark):
    classes = spark.createDataFrame([("long", 100), ("mid", 46), ("short", 20)], "stock_code string, n int")
    got = [(r.stock_code, r.fold, r.origin) for r in forecast.folds(classes).orderBy("stock_code", "fold").collect()]
    assert got == [("long", 1, 76), ("long", 2, 84), ("long", 3, 92), ("mid", 1, 30), ("mid", 2, 38)]


def test_naive_models(spark):
    v = vectors(spark, a=list(range(60)), b=[3, -2])
    assert pred(forecast.naive(v, 2)) == {"a": [59.0, 59.0], "b": [0.0, 0.0]}
    assert pred(forecast.seasonal_naive(v, 2)) == {"a": [8.0, 9.0], "b": [0.0, 0.0]}


def test_croston(spark):
    got = pred(forecast.croston_sba(vectors(spark, twos=[2] * 20, none=[0] * 10, late=[0, 0, 0, 6]), 2))
    assert got["twos"] == pytest.approx([1.9, 1.9]) and got["none"] == [0.0, 0.0]
    assert got["late"] == pytest.approx([0.95 * 6 / 4] * 2)


def test_scaled_error(spark):
    df = spark.createDataFrame(
        [("x", [1.0, 3.0, 5.0, 7.0], [9.0, 11.0], [8.0, 12.0]), ("flat", [4.0] * 4, [4.0, 4.0], [1.0, 1.0])],
        "k string, y array<double>, actual array<double>, pred array<double>",
    )
    got = {r.k: (r.m, r.s) for r in df.select(
        "k", forecast.mase(F.col("actual"), F.col("pred"), F.col("y")).alias("m"),
        forecast.mase(F.col("actual"), F.col("pred"), F.col("y"), 9).alias("s")).collect()}
    assert got == {"x": (0.5, 0.5), "flat": (None, None)}


def test_undefined_scores_are_skipped(spark):
    cv = spark.createDataFrame(
        [("c", "m1", None), ("c", "m1", 0.4), ("c", "m2", 0.5), ("d", "m1", None)], "class string, model string, mase double"
    )
    got = {(r["class"], r.model): (r.mean_mase, r.cells, r.winner) for r in forecast.class_winners(cv).collect()}
    assert got == {("c", "m1"): (0.4, 1, True), ("c", "m2"): (0.5, 1, False)}


def plain_regression(y, h):
    """Normal equations of the same columns, then one week after the other."""
    y, n = np.asarray(y, float), len(y)
    columns = [lambda t, p: np.ones_like(t), lambda t, p: t / n, lambda t, p: np.sin(2 * np.pi * t * 7 / 365.25), lambda t, p: np.cos(2 * np.pi * t * 7 / 365.25)]
    columns += [lambda t, p, k=k: p[t.astype(int) - k] for k in (1, 2, 3, 4)]
    t = np.arange(4.0, n)
    x = np.column_stack([c(t, y) for c in columns])
    beta = np.linalg.solve(x.T @ x, x.T @ y[4:])
    for step in range(n, n + h):
        y = np.append(y, sum(b * c(np.array([float(step)]), y)[0] for b, c in zip(beta, columns)))
    return np.maximum(y[n:], 0).tolist()


def test_regression_model(spark):
    rng = np.random.default_rng(1)
    series = {"noisy": rng.poisson(20, 90).astype(float).tolist(), "flat": [7.0] * 40, "short": [1.0, 2.0, 3.0]}
    got = pred(forecast.MODELS["lag_linear"](vectors(spark, **series), 8))
    assert got["short"] == [3.0] * 8
    assert got["noisy"] == pytest.approx(plain_regression(series["noisy"], 8), abs=1e-6)
    assert got["flat"] == pytest.approx([7.0] * 8, abs=1e-6)


def test_user_model(spark):
    double = forecast.vector_model(lambda y, h: np.full(h, 2 * y.mean()))
    assert pred(double(vectors(spark, a=[1, 3]), 2)) == {"a": [4.0, 4.0]}


# ---- stock
def plan_of(spark, mu, sigma, lead):
    fc = spark.createDataFrame([("A", dt.date(2020, 1, 5) + dt.timedelta(7 * i), mu, sigma, "naive", "smooth") for i in range(8)],
                               "stock_code string, week date, units double, sigma double, model string, class string")
    leads = spark.createDataFrame([("A" if lead else "B", lead or 1)], "stock_code string, lead_time_weeks int")
    return stock.plan(fc, leads)


def test_base_stock(spark):
    z = stock.z_score(0.95)
    row = plan_of(spark, 10.0, 2.0, 3).first()
    assert row.safety_stock == pytest.approx(4 * z) and row.order_up_to == pytest.approx(40 + 4 * z)
    assert row.reorder_point == pytest.approx(30 + 2 * z * math.sqrt(3)) and row.expected_stock == pytest.approx(5 + 4 * z)
    assert row.order_week == dt.date(2020, 1, 5)


def test_missing_lead_time_and_bad_level_fail(spark):
    with pytest.raises(Exception, match="no lead time for item A"):
        plan_of(spark, 10.0, 2.0, None).collect()
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            stock.z_score(bad)


# ---- assigned attributes
def test_large_words_win(spark):
    from orderloom.functions.expr import size_class

    df = spark.createDataFrame([("JUMBO MINI THING",), ("mini egg",), ("plain",), (None,)], "d string")
    assert [r.c for r in df.select(size_class(F.col("d")).alias("c")).collect()] == ["large", "small", "medium", "medium"]


def test_slots_and_bands(spark):
    slots = assign.make_slots(spark, 26).collect()
    assert len(slots) == 50 and (slots[25].x_m, slots[25].y_m, slots[25].distance_m) == (3.0, 4.0, 7.0)
    with pytest.raises(ValueError):
        assign.make_slots(spark, 0)
    keys = spark.range(300).select(F.concat(F.lit("cust:"), "id").alias("customer_key"),
                                   F.when(F.col("id") % 2 == 0, "United Kingdom").otherwise("Spain").alias("country"))
    for r in assign.with_customer_xy(keys).collect():
        radius = math.hypot(r.x_km, r.y_km)
        lo, hi = (5, 120) if r.country == "United Kingdom" else (150, 300)
        assert lo <= radius <= hi


def test_guests_and_first_known_values(spark):
    rows = [("1", "A", "X", 1, dt.datetime(2020, 1, 6, 9), 1.0, None), ("1", "K", "X", 1, dt.datetime(2020, 1, 6, 10), 1.0, 5),
            ("2", "A", "X", 1, dt.datetime(2020, 1, 6), 1.0, None)]
    got = {r.invoice: r.customer_key for r in assign.customer_lookup(clean.sales_lines(txn(spark, rows))).collect()}
    assert got == {"1": "cust:5", "2": "guest:2"}


# ---- provenance
def test_provenance_algebra():
    real, derived, assigned = provenance.REAL, provenance.DERIVED, provenance.ASSIGNED
    assert provenance.combine(real, derived) == derived and provenance.combine(real, assigned) == assigned
    assert provenance.derive(real) == derived and provenance.derive(real, assigned) == assigned
    with pytest.raises(ValueError):
        provenance.combine()
    with pytest.raises(ValueError):
        provenance.derive()


# ---- readouts
ECON = "invoice string, revenue double, labour_cost double, transport_cost double, facility_cost double"


def economics(spark):
    rows = [("A", 100.0, 1.0, 4.0, 10.0), ("B", 50.0, 2.0, 5.0, 10.0), ("C", 10.0, 3.0, 6.0, 10.0)]
    return readout.order_economics(spark.createDataFrame(rows, ECON))


def test_whale(spark):
    curve = readout.whale_curve(economics(spark))
    assert [r.cum_gap for r in curve.orderBy("rank").collect()] == [85.0, 118.0, 109.0]
    row = readout.whale_summary(curve).first()
    assert (row.peak_gbp, row.peak_orders, row.end_gbp, row.erosion_gbp) == (118.0, 2, 109.0, 9.0)


def test_deciles_and_stats(spark):
    ranked = readout.by_cost(economics(spark))
    rows = readout.decile_table(ranked, 3).orderBy("decile").collect()
    assert [r.delivered_gbp for r in rows] == [19.0, 17.0, 15.0] and [r.uncovered_orders for r in rows] == [1, 0, 0]
    assert rows[0].cost_share == pytest.approx(19 / 51) and rows[-1].cum_cost_share == pytest.approx(1.0)
    wide = readout.decile_table(ranked, 10).orderBy("decile").collect()
    assert [r.orders for r in wide] == [1, 1, 1] + [0] * 7
    stats = readout.distribution_stats(ranked).first()
    assert (stats.median_cost, stats.uncovered_orders, stats.uncovered_revenue) == (17.0, 1, 10.0)
    assert stats.p90_cost == pytest.approx(18.6) and stats.gini == pytest.approx(8 / 153)
    assert stats.top_decile_share == pytest.approx(19 / 51)


@pytest.mark.parametrize("values,expected", [([15, 17, 19], 8 / 153), ([0, 0, 10], 2 / 3), ([5, 5, 5], 0.0), ([], 0.0), ([0, 0], 0.0)])
def test_gini(spark, values, expected):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, k int")
    assert readout.gini(df, "v", "k").first().gini == pytest.approx(expected)


def test_empty_readouts(spark):
    empty = economics(spark).limit(0)
    ranked = readout.by_cost(empty)
    assert set(readout.distribution_stats(ranked).first()) == {0, 0.0}
    assert [r.orders for r in readout.decile_table(ranked).collect()] == [0] * 10
    assert tuple(readout.whale_summary(readout.whale_curve(empty)).first()) == (0, 0.0, 0, 0.0, 0.0, 0.0)


def test_quantiles_interpolate(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=101).round(1)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, k int")
    row = quantile.quantiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.123}).first()
    assert tuple(row) == pytest.approx(tuple(np.quantile(values, [0.5, 0.95, 0.123])))


def test_cached_copy_is_read_again_until_forced(spark, tmp_path):
    path, columns = str(tmp_path / "copy"), "invoice string, price double"
    first, second = (spark.createDataFrame([(k, 1.0)], columns) for k in "ab")
    assert transactions.cached_copy(first, path).first().invoice == "a"
    assert transactions.cached_copy(second, path).first().invoice == "a"
    assert transactions.cached_copy(second, path, force=True).first().invoice == "b"
    (tmp_path / "copy" / "_SUCCESS").unlink()  # a write that was cut short is no copy
    assert transactions.cached_copy(first, path).first().invoice == "a"
