
from __future__ import annotations

import os
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))  # this folder may not be the working folder

import oracles as O
import orderloom
from orderloom.functions import provenance
from orderloom.functions.expr import keyed_uniform, week_end
from orderloom.operators import (
    assign, clean, costs, delivery, demand, forecast, fulfil, readout, reconcile, slotting, stock, whatif,
)
from orderloom.params import DEFAULTS, SERVICE_LEVELS
from orderloom.plans.run import Run
from orderloom.plans.summary import stage_summary
from orderloom.sources import receipts, sample, transactions
from orderloom.sources.stage import StageTables
from orderloom.sources.tables import published_revenue, testdata_txn

# the few functions that run inside Arrow batches travel with the plan, wherever the workers start
cloudpickle.register_pickle_by_value(orderloom)

SMOKE_DIR = "/root/testdata/sf0.001"
_RUNS: dict[tuple[str, ...], Run] = {}


def run_for(spark: SparkSession, folder: str, grain: str = "name", models: str = "closed") -> Run:
    """The run over ``folder``, shared by all queries of one session.

    ``closed`` leaves out the regression, the one model plain SQL cannot recompute.
    """
    key = (spark.sparkContext.applicationId, folder, grain, models)
    if key not in _RUNS:
        if models == "all":
            _RUNS[key] = run_for(spark, folder, grain).with_models(forecast.MODELS)
        else:
            _RUNS[key] = Run(
                testdata_txn(spark, folder, grain), DEFAULTS, forecast.CLOSED_FORM,
                published_revenue(spark, folder, grain),
            )
    return _RUNS[key]


def reset_runs() -> None:
    """Drop every shared run and its cached frames (used between timings)."""
    for run in _RUNS.values():
        run.close()
    _RUNS.clear()


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named double columns; both engines compare the rounded values."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOLD: dict[str, str] = {}  # statements before their parts are put in


def query(name: str, sql: str | None = None, grain: str = "name", models: str = "closed"):
    """Register ``fn(run)`` as a query, with its DuckDB statement if there is one."""

    def add(fn):
        Q[name] = lambda spark, folder: fn(run_for(spark, folder, grain, models))
        if sql is not None:
            TOLD[name] = sql
            SQL[name] = O.statement(sql, grain, **({"preds": O.ALL_PREDS} if models == "all" else {}))
        return fn

    return add


# ---- sources and cleaning
query("testdata_txn", "SELECT * FROM txn")(lambda r: r.txn)
query("testdata_txn_brand_type", "SELECT * FROM txn", "brand_type")(lambda r: r.txn)
query(
    "drop_exact_duplicates",
    f"SELECT {O.EIGHT}, count(*) AS copies FROM txn GROUP BY ALL",
)(lambda r: r.classified.drop("step_no"))
query("drop_duplicates_by_digest", f"SELECT {O.EIGHT}, count(*) AS copies FROM txn GROUP BY ALL")(
    lambda r: clean.distinct_by_digest(r.txn, StageTables(r.spark))
)
query("clean_sales", "SELECT * EXCLUDE (week) FROM sales")(lambda r: r.sales)
query("clean_returns", "SELECT * FROM returned")(lambda r: r.returns)
query(
    "cleaning_log",
    """
SELECT u.step_no, u.step, u.rows_in, u.rows_out, u.rows_in - u.rows_out AS rows_removed,
       CASE WHEN u.rows_in > 0 THEN (u.rows_in - u.rows_out) / u.rows_in ELSE 0 END AS pct_removed, u.note
FROM log_counts, LATERAL (VALUES
  (1, 'collapse repeated lines', n0, n1, 'every input field the same'),
  (2, 'set returns apart', n1, n2, 'a table of their own, no sales'),
  (3, 'leave out codes that are no goods', n2, n3, 'listed service codes and gift vouchers'),
  (4, 'leave out lines without a price', n3, n4, 'nothing was charged'),
  (5, 'leave out lines without units', n4, n5, 'stock corrections that are no returns'),
  (6, 'count unnamed customers', n5, n5, format('{:,}', unknown) || ' lines without a customer stay in sales')
) u(step_no, step, rows_in, rows_out, note)""",
)(lambda r: r.cleaning_log)

# ---- demand and lines
for _grain in ("name", "part"):
    query(f"tracked_items_{_grain}", "SELECT * FROM items", _grain)(lambda r: r.items)
query("week_end", "SELECT date, week, count(*) AS lines FROM sales GROUP BY 1, 2")(
    lambda r: r.sales.groupBy("date", week_end(F.col("invoice_ts")).alias("week")).agg(F.count(F.lit(1)).alias("lines"))
)
query("weekly_index", "SELECT * FROM weeks")(lambda r: r.weeks)
query(
    "sales_in_window",
    "SELECT stock_code, week, count(*) AS lines, sum(quantity)::BIGINT AS units, sum(revenue) AS revenue "
    "FROM window_sales GROUP BY 1, 2",
)(
    lambda r: demand.sales_in_window(r.sales, r.items, r.weeks, r.params.n_items)
    .groupBy("stock_code", "week")
    .agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum("revenue").alias("revenue"))
)
for _grain in ("name", "brand_type", "part"):
    query(f"weekly_demand_{_grain}", "SELECT * FROM demand", _grain)(lambda r: r.demand)
query(
    "demand_series",
    "SELECT stock_code, list(units ORDER BY week) AS y, max(week) AS last_week FROM demand GROUP BY 1",
)(lambda r: r.series)
query("invoice_lines", "SELECT * FROM lines")(lambda r: r.lines)
query(
    "line_counts",
    """
SELECT count(*) AS lines, count(DISTINCT invoice) AS invoices,
       round((SELECT sum(revenue)::DOUBLE FROM items) / (SELECT sum(revenue)::DOUBLE FROM sales), 9) AS tracked_share
FROM lines""",
    "part",
)(lambda r: rounded(demand.line_counts(r.sales, r.lines, r.items), tracked_share=9))
query("busiest_window", "SELECT * FROM win")(lambda r: r.window)
query("window_lines", "SELECT * FROM win_lines")(lambda r: r.window_lines)
query("modal_description", "SELECT * FROM described", "brand_type")(lambda r: r.descriptions)

# ---- forecast
for _grain in ("name", "brand_type"):
    query(
        f"classify_{_grain}",
        "SELECT * REPLACE (round(adi, 9) AS adi, round(cv2, 9) AS cv2) FROM classes",
        _grain,
    )(lambda r: rounded(r.classes, adi=9, cv2=9))
    query(f"rolling_origin_folds_{_grain}", "SELECT * FROM foldrows", _grain)(lambda r: r.folds)
for _model in forecast.CLOSED_FORM:
    query(
        f"model_{_model}",
        "SELECT stock_code, fold, i + 1 AS step, round(pred, 6) AS pred FROM preds "
        f"WHERE model = '{_model}' AND fold > 0",
        "brand_type",
    )(
        lambda r, m=_model: rounded(
            r.models[m](r.fold_frames, r.params.horizon)
            .select("stock_code", "fold", F.posexplode("pred").alias("_i", "pred"))
            .select("stock_code", "fold", (F.col("_i") + 1).alias("step"), "pred"),
            pred=6,
        )
    )
query("model_lag_linear", "SELECT stock_code, fold, i + 1 AS step, round(pred, 4) AS pred FROM lag_paths WHERE fold > 0", "name", "all")(
    lambda r: rounded(
        r.models["lag_linear"](r.fold_frames, r.params.horizon)
        .select("stock_code", "fold", F.posexplode("pred").alias("_i", "pred"))
        .select("stock_code", "fold", (F.col("_i") + 1).alias("step"), "pred"),
        pred=4,
    )
)
query(
    "model_user_supplied",
    """
SELECT f.stock_code, f.fold, round(avg(d.units), 6) AS pred
FROM foldrows f JOIN demand d ON d.stock_code = f.stock_code AND d.idx < f.origin GROUP BY 1, 2""",
    "brand_type",
)(
    lambda r: rounded(
        forecast.vector_model(lambda y, h: np.full(h, y.mean()))(r.fold_frames, 1)
        .select("stock_code", "fold", F.element_at("pred", 1).alias("pred")),
        pred=6,
    )
)
_CV = "SELECT stock_code, class, model, fold, train_weeks, round(mase, 6) AS mase, round(mae, 6) AS mae, [round(e, 6) + 0.0 for e in errors] AS errors"
for _grain in ("name", "brand_type"):
    query(f"cross_validate_{_grain}", _CV + " FROM cv", _grain)(
        # adding zero leaves one zero in place of two
        lambda r: rounded(r.cv, mase=6, mae=6).withColumn("errors", F.transform("errors", lambda e: F.round(e, 6) + 0.0))
    )
    query(
        f"class_winners_{_grain}", "SELECT * REPLACE (round(mean_mase, 6) AS mean_mase) FROM winners", _grain
    )(lambda r: rounded(r.class_winners, mean_mase=6))
    query(f"forecast_sigma_{_grain}", "SELECT stock_code, round(sigma, 6) AS sigma FROM sigmas", _grain)(
        lambda r: rounded(forecast.sigma(r.cv, r.choices), sigma=6)
    )
    query(
        f"final_forecast_{_grain}",
        "SELECT * REPLACE (round(units, 6) AS units, round(sigma, 6) AS sigma) FROM forecasts",
        _grain,
    )(lambda r: rounded(r.forecasts, units=6, sigma=6))
query(
    "forecast_all_models", "SELECT * REPLACE (round(units, 4) AS units, round(sigma, 4) AS sigma) FROM forecasts", "brand_type", "all",
)(lambda r: rounded(r.forecasts, units=4, sigma=4))
query(
    "class_winners_all_models", "SELECT * REPLACE (round(mean_mase, 6) AS mean_mase) FROM winners", "brand_type", "all",
)(lambda r: rounded(r.class_winners, mean_mase=6))

# ---- replenishment
_PLAN_DOUBLES = ("mu_weekly", "sigma", "safety_stock", "reorder_point", "order_up_to", "order_qty", "expected_stock")
_PLAN_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _PLAN_DOUBLES)
for _grain in ("name", "brand_type"):
    query(f"replenishment_plan_{_grain}", f"SELECT * REPLACE ({_PLAN_ROUND}) FROM plan", _grain)(
        lambda r: rounded(r.plan, **dict.fromkeys(_PLAN_DOUBLES, 6))
    )
    query(
        f"stock_class_summary_{_grain}",
        """
SELECT class, count(*) AS items, round(sum(mu_weekly), 4) AS mu_weekly, round(sum(safety_stock), 4) AS safety_stock,
       round(sum(order_up_to), 4) AS order_up_to, round(avg(lead_time_weeks), 6) AS mean_lead,
       round(sum(sigma) / greatest(sum(mu_weekly), 1e-9), 6) AS sigma_over_mu,
       round(sum(safety_stock) / greatest(sum(mu_weekly), 1e-9), 6) AS ss_weeks
FROM plan GROUP BY 1""",
        _grain,
    )(
        lambda r: rounded(
            stock.class_summary(r.plan), mu_weekly=4, safety_stock=4, order_up_to=4, mean_lead=6,
            sigma_over_mu=6, ss_weeks=6,
        )
    )
query(
    "plan_by_service_level",
    " UNION ALL ".join(
        f"SELECT {level}::DOUBLE AS service_level, * REPLACE ({_PLAN_ROUND}) FROM ({O.plan_sql(z)})"
        for level, z in O.Z.items()
    ),
)(lambda r: rounded(stock.plan_by_level(r.plan, SERVICE_LEVELS, r.params), **dict.fromkeys(_PLAN_DOUBLES, 6)))

# ---- assigned attributes
for _grain in ("name", "brand_type"):
    query(f"item_physical_{_grain}", "SELECT * FROM physical", _grain)(lambda r: r.physical)
query("lead_times", "SELECT * FROM leads", "part")(lambda r: r.lead_times)
for _grain in ("name", "brand_type"):
    query(f"rack_slots_{_grain}", "SELECT * FROM slots", _grain)(lambda r: r.slots)
query(
    "keyed_uniform",
    f"SELECT stock_code, round({O.u(42, 'length_cm', 'stock_code')}, 12) AS draw FROM (SELECT DISTINCT stock_code FROM sales)",
    "part",
)(
    lambda r: r.sales.select("stock_code").distinct().withColumn(
        "draw", F.round(keyed_uniform(42, "length_cm", F.col("stock_code")), 12)
    )
)
query("customer_lookup", "SELECT * FROM lookup")(lambda r: r.customers)
query(
    "customer_xy",
    "SELECT invoice, customer_key, country, round(x_km, 6) AS x_km, round(y_km, 6) AS y_km FROM placed",
)(lambda r: rounded(assign.with_customer_xy(r.customers, r.params), x_km=6, y_km=6))


# ---- slotting and picks
query("pick_velocity", "SELECT * FROM vel", "part")(lambda r: r.velocity)
for _variant in ("random", "abc", "optimal"):
    query(
        f"slot_{_variant}", f"SELECT stock_code, slot_id FROM slotting WHERE variant = '{_variant}'", "brand_type"
    )(lambda r, v=_variant: r.slotting.filter(F.col("variant") == v).select("stock_code", "slot_id"))
query(
    "slotting_objective",
    "SELECT variant, round(sum(velocity * distance_m), 4) AS weighted_m "
    "FROM slotting JOIN slots USING (slot_id) JOIN vel USING (stock_code) GROUP BY 1",
    "brand_type",
)(lambda r: rounded(slotting.objective(r.slotting, r.slots, r.velocity), weighted_m=4))
query(
    "slotting_table",
    "SELECT stock_code, slot_id, distance_m, velocity AS velocity_lines "
    "FROM slotting JOIN slots USING (slot_id) JOIN vel USING (stock_code) WHERE variant = 'optimal'",
)(lambda r: slotting.slotting_table(r.slotting, r.slots, r.velocity, "optimal"))
query(
    "slot_distance",
    """
SELECT a.slot_id AS from_slot, b.slot_id AS to_slot,
       round(CASE WHEN a.x_m = b.x_m THEN abs(a.y_m - b.y_m) ELSE abs(a.x_m - b.x_m) + a.y_m + b.y_m END, 6) AS metres
FROM slotting p JOIN slotting q ON q.stock_code = p.stock_code AND q.variant = 'abc'
JOIN slots a ON a.slot_id = p.slot_id JOIN slots b ON b.slot_id = q.slot_id WHERE p.variant = 'random'""",
)(
    lambda r: r.slotting.filter("variant = 'random'").select("stock_code", F.col("slot_id").alias("from_slot"))
    .join(r.slotting.filter("variant = 'abc'").select("stock_code", F.col("slot_id").alias("to_slot")), "stock_code")
    .join(r.slots.select(F.col("slot_id").alias("from_slot"), F.col("x_m").alias("x1"), F.col("y_m").alias("y1")), "from_slot")
    .join(r.slots.select(F.col("slot_id").alias("to_slot"), F.col("x_m").alias("x2"), F.col("y_m").alias("y2")), "to_slot")
    .select(
        "from_slot", "to_slot",
        F.round(slotting.slot_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 6).alias("metres"),
    )
)
for _grain in ("name", "brand_type"):
    query(f"pick_tours_{_grain}", "SELECT variant, invoice, travel_m FROM tours", _grain)(
        lambda r: r.evaluated.select("variant", "invoice", "travel_m")
    )
query("evaluate_slotting", "SELECT * REPLACE (round(time_min, 6) AS time_min) FROM evaluated")(
    lambda r: rounded(r.evaluated, time_min=6)
)
query(
    "slotting_summary",
    """
SELECT variant, invoices, lines, round(mean_travel_m, 6) AS mean_travel_m, round(total_travel_m, 3) AS total_travel_m,
       round(100 * (mean_travel_m / (SELECT mean_travel_m FROM layout_totals WHERE variant = 'random') - 1), 6)
         AS delta_vs_random_pct
FROM layout_totals""",
)(lambda r: rounded(slotting.summary(r.evaluated), mean_travel_m=6, total_travel_m=3, delta_vs_random_pct=6))

# ---- fulfilment
query("cartons", "SELECT * FROM packed", "brand_type")(lambda r: fulfil.cartons(r.quantities, r.params))
query("carton_lower_bound", "SELECT * FROM least_boxes", "brand_type")(
    lambda r: fulfil.carton_lower_bound(r.quantities, r.params)
)
query(
    "order_frame",
    "SELECT * REPLACE (round(pick_minutes, 6) AS pick_minutes, round(weight_kg, 6) AS weight_kg) FROM ord",
)(lambda r: rounded(r.orders, pick_minutes=6, weight_kg=6))
_LOG = ("start_of_day_min", "finish_of_day_min", "start_min", "finish_min", "wait_min", "pick_minutes", "weight_kg")
_LOG_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _LOG)
query("fulfilment_log_lanes", f"SELECT * REPLACE ({_LOG_ROUND}) FROM flog")(
    lambda r: rounded(r.log, **dict.fromkeys(_LOG, 6))
)
query(
    "fulfilment_log_ample",
    """
SELECT invoice, round(epoch(arrival - (SELECT min(arrival) FROM ord)) / 60.0, 6) AS start_min,
       round(epoch(arrival - (SELECT min(arrival) FROM ord)) / 60.0 + pick_minutes, 6) AS finish_min,
       0.0 AS wait_min, (arrival + to_microseconds((pick_minutes * 60000000)::BIGINT))::DATE AS day
FROM ord""",
)(
    lambda r: rounded(
        fulfil.fulfilment_log(r.orders, r.params, "ample").select("invoice", "start_min", "finish_min", "wait_min", "day"),
        start_min=6, finish_min=6, wait_min=6,
    ).withColumn("wait_min", F.abs("wait_min"))
)
query(
    "concurrency_profile",
    """
SELECT arrival_day, sum(started)::BIGINT AS orders, max(doing) AS peak_in_progress,
       round(sum(greatest(0, least(started, doing - 4))) / sum(started), 6) AS share_above_crew
FROM busy GROUP BY 1""",
)(lambda r: rounded(fulfil.concurrency_profile(r.log, r.params), share_above_crew=6))
query(
    "fulfilment_per_day",
    "SELECT * REPLACE (round(labour_hours, 6) AS labour_hours, round(weight_kg, 4) AS weight_kg) FROM fday",
)(lambda r: rounded(r.per_day, labour_hours=6, weight_kg=4))
query(
    "crew_summary",
    """
SELECT (SELECT count(*) FROM fday) AS days, round(sum(pick_minutes) / 60.0, 6) AS labour_hours,
       round(sum(pick_minutes) / 60.0 / ((SELECT count(*) FROM fday) * 32.0), 6) AS utilisation,
       round(avg(wait_min), 6) AS mean_wait_min, round(quantile_cont(wait_min, 0.95), 6) AS p95_wait_min
FROM flog""",
)(
    lambda r: rounded(
        fulfil.crew_summary(r.log, r.per_day, r.params), labour_hours=6, utilisation=6, mean_wait_min=6, p95_wait_min=6
    )
)

# ---- delivery
_KM = {"x_km": 6, "y_km": 6, "direct_km": 6}
query(
    "shipments",
    "SELECT * EXCLUDE (away) REPLACE (round(x_km, 6) AS x_km, round(y_km, 6) AS y_km, round(direct_km, 6) AS direct_km) FROM ship",
)(lambda r: rounded(r.shipments, **_KM))
query(
    "savings_best_partner",
    """
SELECT day, invoice, arg_max(partner, (s, partner)) AS partner, max(s) AS saving_km
FROM (
  SELECT day, invoice_i AS invoice, invoice_j AS partner, round(saving, 6) AS s FROM pairs
  UNION ALL SELECT day, invoice_j, invoice_i, round(saving, 6) FROM pairs
) WHERE s > 0 GROUP BY 1, 2""",
)(lambda r: delivery.best_savings(r.nodes))
query(
    "savings_routes",
    "SELECT day, stops, array_to_string(visits, ' ') AS visits, round(km, 6) AS km FROM route_sums",
)(
    lambda r: rounded(
        r.routes.groupBy("day", "route")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "invoice")))["invoice"], " ").alias("visits"))
        .join(r.route_lengths, ["day", "route"])
        .select("day", "stops", "visits", "km"),
        km=6,
    )
)
_DAILY = {"km": 4, "lo_km": 4, "hi_km": 4}
query(
    "delivery_per_day",
    "SELECT * REPLACE (round(km, 4) AS km, round(lo_km, 4) AS lo_km, round(hi_km, 4) AS hi_km) FROM dday",
)(lambda r: rounded(r.delivery_daily, **_DAILY))
query(
    "routed_drops",
    "SELECT (SELECT count(*) FROM tour_rows) + (SELECT count(*) FROM ship WHERE NOT is_node) AS routed_drops",
)(lambda r: delivery.routed_drops(r.route_lengths, r.shipments))
query(
    "method_record",
    """
SELECT count(*) FILTER (km < hi_km - 1e-6) AS wins, count(*) FILTER (abs(km - hi_km) <= 1e-6) AS ties,
       count(*) FILTER (km > hi_km + 1e-6) AS losses, round(100 * sum(km - hi_km) / sum(hi_km), 6) AS delta_pct
FROM dday""",
)(lambda r: rounded(delivery.method_record(r.delivery_daily), delta_pct=6))
query(
    "km_bounds",
    "SELECT day, round(lo_km, 4) AS lo_km, round(km, 4) AS km, round(hi_km, 4) AS hi_km, true AS inside FROM dday",
)(lambda r: rounded(delivery.km_bounds(r.delivery_daily), **_DAILY))

query(
    "sweep_routes",
    "SELECT day, stops, array_to_string(visits, ' ') AS visits, round(km, 6) AS km FROM sweep_sums",
)(
    lambda r: rounded(
        r.sweep.groupBy("day", "route")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "invoice")))["invoice"], " ").alias("visits"))
        .join(r.sweep_lengths, ["day", "route"])
        .select("day", "stops", "visits", "km"),
        km=6,
    )
)
query(
    "plans_per_day", "SELECT * REPLACE (round(km, 4) AS km, round(sweep_km, 4) AS sweep_km) FROM plans",
)(lambda r: rounded(r.plans_daily, km=4, sweep_km=4))
query(
    "method_record_sweep",
    """
SELECT count(*) FILTER (km < sweep_km - 1e-6) AS wins, count(*) FILTER (abs(km - sweep_km) <= 1e-6) AS ties,
       count(*) FILTER (km > sweep_km + 1e-6) AS losses, round(100 * sum(km - sweep_km) / sum(sweep_km), 6) AS delta_pct
FROM plans""",
)(lambda r: rounded(delivery.method_record(r.plans_daily, "km", "sweep_km"), delta_pct=6))

# ---- costs
query(
    "window_revenue",
    "SELECT stock_code, sum(revenue) AS revenue, sum(quantity)::BIGINT AS units, count(*) AS lines FROM rev_lines GROUP BY 1",
)(
    lambda r: r.revenue_lines.groupBy("stock_code").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("lines")
    )
)
_INV = {"revenue": 4, "labour_cost": 6, "transport_cost": 6, "facility_cost": 6}
query(
    "cost_per_invoice",
    "SELECT invoice, day, round(revenue, 4) AS revenue, round(labour_cost, 6) AS labour_cost, "
    "round(transport_cost, 6) AS transport_cost, round(facility_cost, 6) AS facility_cost FROM inv_cost",
)(lambda r: rounded(r.per_invoice, **_INV))
query(
    "cost_per_item",
    "SELECT stock_code, round(revenue, 4) AS revenue, units, round(safety_stock, 6) AS safety_stock, "
    "round(holding_cost, 6) AS holding_cost FROM item_cost",
)(lambda r: rounded(r.per_item, revenue=4, safety_stock=6, holding_cost=6))
query("ledger_lines", "SELECT * REPLACE (round(gbp, 3) AS gbp) FROM cost_lines")(
    lambda r: rounded(r.ledger_lines, gbp=3)
)
query(
    "cost_share_of_revenue",
    "SELECT round(total, 3) AS total_cost, round(revenue, 3) AS window_revenue, round(100 * total / revenue, 6) AS cost_pct FROM booked",
)(lambda r: rounded(costs.cost_share_of_revenue(r.ledger_lines), total_cost=3, window_revenue=3, cost_pct=6))

# ---- ledger and identities
query("ledger", "SELECT key, round(value, 3) AS value, unit, provenance FROM ledger")(
    lambda r: rounded(r.ledger.select("key", "value", "unit", "provenance"), value=3)
)
query(
    "ledger_table",
    """
SELECT key, round(value, 3) AS value, unit, '[' || provenance || ']' AS provenance,
       CASE WHEN key SIMILAR TO 'warehouse/(invoices|lines|travel_mean)_.*' THEN split_part(key, '_', -1) || ' layout'
            ELSE told.note END AS note
FROM ledger LEFT JOIN (VALUES
  ('costing/component_sum', 'four lines added again'), ('costing/facility', 'ledger line'), ('costing/holding', 'ledger line'),
  ('costing/labour', 'ledger line'), ('costing/total_cost', 'ledger line'), ('costing/transport', 'ledger line'),
  ('costing/window_revenue', 'ledger line'), ('forecast/items', 'items with a forecast'), ('forecast/rows', 'item x future week'),
  ('fulfil/cartons_packed', 'per order'), ('fulfil/cartons_shipped', 'per day'), ('fulfil/labour_hours', 'picking labour'),
  ('fulfil/orders', 'orders shipped'), ('fulfil/picked_lines', 'order log'), ('ingest/demand_units', 'sum of weekly demand'),
  ('ingest/line_count', 'sales lines of tracked items'), ('ingest/line_units', 'sum of line quantities'),
  ('ingest/revenue_gbp', 'cleaned revenue'), ('ingest/window_revenue', 'range filter'), ('inventory/plan_items', 'items with a plan'),
  ('inventory/safety_stock_units', 'stands on assigned lead times'), ('invoice_stream/line_count', 'lines to pick'),
  ('published/revenue_gbp', 'stated elsewhere'), ('transport/out_and_back_km', 'one trip per drop'),
  ('transport/routed_drops', 'counted from routes'), ('transport/savings_km', 'savings routes'),
  ('warehouse/picked_lines_total', 'lines over all tours'), ('warehouse/velocity_lines', 'lines per item, summed'),
  ('window/stream_lines', 'recount of the window'), ('window/weeks', 'weeks of the window')
) told(named, note) ON told.named = ledger.key""",
)(lambda r: rounded(reconcile.ledger_table(r.ledger), value=3))
query(
    "provenance_combine",
    """
SELECT split_part(key, '/', 1) AS stage,
       CASE min(s) WHEN 3 THEN 'real' WHEN 2 THEN 'derived' ELSE 'synthetic-assigned' END AS combined,
       CASE least(min(s), 2) WHEN 2 THEN 'derived' ELSE 'synthetic-assigned' END AS derived
FROM (SELECT key, CASE provenance WHEN 'real' THEN 3 WHEN 'derived' THEN 2 ELSE 1 END AS s FROM ledger) GROUP BY 1""",
)(
    lambda r: r.ledger.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("stage")).agg(
        provenance.combine_agg(F.col("provenance")).alias("combined"),
        provenance.derive_agg(F.col("provenance")).alias("derived"),
    )
)


_SHOWN = ("name", "lhs_label", "lhs", "rhs_label", "rhs", "tolerance", "passed", "unit")


def shown(checks: DataFrame) -> DataFrame:
    return rounded(checks.select(*_SHOWN), lhs=3, rhs=3)


query(
    "identity_pairs",
    "SELECT name, lhs_label, round(lhs, 3) AS lhs, rhs_label, round(rhs, 3) AS rhs, tolerance, passed, unit FROM compared",
)(
    lambda r: shown(reconcile.check(r.ledger, reconcile.literal_table(r.spark, reconcile.IDENTITIES)))
)


def identity(letter: str, fn, lhs: str, rhs: str, passed: str, tolerance: float = 0.0) -> None:
    """Register one identity with its own SQL for both sides."""

    name, lhs_label, rhs_label, unit = {
        "d": ("(d) forecast coverage", "forecast items known to demand", "forecast items", "items"),
        "e": ("(e) replenishment coverage", "planned items", "forecast items", "items"),
        "g": ("(g) same-invoice evaluation", "lines of the shortest layout", "lines of the longest layout", "lines"),
        "h": ("(h) provenance audit", "entries with their own tag", "entries looked up", "entries"),
        "n": ("(n) cost-driver reconstruction", "drivers x rates", "ledger total cost", "GBP"),
        "o": ("(o) forecast-error containment", "total cost at the top factor", "base total plus surge on holding", "GBP"),
        "p": ("(p) order-level allocation", "orders plus items", "ledger total cost", "GBP"),
    }[letter]
    sql = f"""
SELECT '{name}' AS name, '{lhs_label}' AS lhs_label, round(({lhs})::DOUBLE, 3) AS lhs,
       '{rhs_label}' AS rhs_label, round(({rhs})::DOUBLE, 3) AS rhs,
       {tolerance}::DOUBLE AS tolerance, ({passed}) AS passed, '{unit}' AS unit"""
    query(f"identity_{letter}", sql)(lambda r: shown(fn(r)))


identity(
    "d", lambda r: reconcile.forecast_coverage(r.forecasts, r.items),
    "SELECT count(DISTINCT stock_code) FROM forecasts WHERE stock_code IN (SELECT stock_code FROM items)",
    "SELECT count(DISTINCT stock_code) FROM forecasts",
    "SELECT count(*) = 0 FROM forecasts WHERE stock_code NOT IN (SELECT stock_code FROM items)",
)
identity(
    "e", lambda r: reconcile.replenishment_coverage(r.plan, r.forecasts),
    "SELECT count(DISTINCT stock_code) FROM plan", "SELECT count(DISTINCT stock_code) FROM forecasts",
    "SELECT count(*) = 0 FROM ((SELECT stock_code FROM plan EXCEPT SELECT stock_code FROM forecasts) UNION ALL "
    "(SELECT stock_code FROM forecasts EXCEPT SELECT stock_code FROM plan))",
)
identity(
    "g", lambda r: reconcile.same_invoices(r.evaluated),
    "SELECT min(lines) FROM layout_totals", "SELECT max(lines) FROM layout_totals",
    "SELECT min(lines) = max(lines) AND min(invoices) = max(invoices) FROM layout_totals",
)
identity(
    "h", lambda r: reconcile.provenance_audit(r.ledger),
    "SELECT count(*) FROM ledger WHERE (key IN ('ingest/demand_units', 'warehouse/velocity_lines') AND provenance = 'real') "
    "OR ((key LIKE 'warehouse/travel_mean_%' OR key = 'inventory/safety_stock_units') AND provenance = 'synthetic-assigned')",
    "SELECT count(*) FROM ledger WHERE key IN ('ingest/demand_units', 'warehouse/velocity_lines', 'inventory/safety_stock_units') "
    "OR key LIKE 'warehouse/travel_mean_%'",
    "SELECT count(*) = 6 AND bool_and(provenance = CASE WHEN key IN ('ingest/demand_units', 'warehouse/velocity_lines') THEN 'real' "
    "ELSE 'synthetic-assigned' END) FROM ledger WHERE key IN ('ingest/demand_units', 'warehouse/velocity_lines', "
    "'inventory/safety_stock_units') OR key LIKE 'warehouse/travel_mean_%'",
)
identity(
    "n", lambda r: readout.driver_reconstruction(r.drivers),
    "SELECT hours * 14.5 + km * 0.85 + stock * 0.02 * weeks + weeks * 2500 FROM cost_parts",
    "SELECT total FROM booked",
    "SELECT abs(p.hours * 14.5 + p.km * 0.85 + p.stock * 0.02 * p.weeks + p.weeks * 2500 - b.total) <= 0.005 FROM cost_parts p, booked b", 0.005,
)
identity(
    "o", lambda r: whatif.forecast_containment(r.grid),
    "SELECT total_cost FROM scen WHERE scenario_id = 'book x1.20'", "SELECT total + 0.2 * holding FROM booked",
    "SELECT bool_and(abs(s.total_cost - b.total - (s.demand_factor - 1) * b.holding) <= 0.005) FROM scen s, booked b "
    "WHERE s.scenario_id LIKE 'book%'", 0.005,
)
identity(
    "p", lambda r: reconcile.allocation(r.economics, r.per_item, r.ledger_lines, r.log),
    "SELECT sum(delivered_cost) + (SELECT sum(holding_cost) FROM item_cost) FROM econ", "SELECT total FROM booked",
    "SELECT count(*) = count(DISTINCT invoice) AND count(*) = (SELECT count(*) FROM flog) AND count(revenue) = count(*) FROM econ",
    0.005,
)
query(
    "verdict",
    "SELECT 'base' AS scenario_id, count(*) FILTER (passed) AS passed, count(*) AS total, bool_and(passed) AS all_passed FROM held",
)(
    lambda r: reconcile.verdict(r.checks)
)

# ---- what-ifs
query("most_populous_class", "SELECT class, count(DISTINCT stock_code) AS items FROM forecasts WHERE class = (SELECT class FROM top_class) GROUP BY 1")(
    lambda r: whatif.most_populous_class(r.forecasts)
)
query(
    "class_surge",
    "SELECT stock_code, week, round(units * f, 6) AS units, round(sigma * f, 6) AS sigma, model, class FROM "
    "(SELECT *, CASE WHEN class = 'smooth' THEN 1.2 ELSE 1 END::DOUBLE AS f FROM forecasts)",
)(lambda r: rounded(whatif.surge(r.forecasts, "smooth", 1.2), units=6, sigma=6))
query(
    "book_surge",
    "SELECT * REPLACE (round(units * 1.1::DOUBLE, 6) AS units, round(sigma * 1.1::DOUBLE, 6) AS sigma) FROM forecasts",
    "brand_type",
)(lambda r: rounded(whatif.book_surge(r.forecasts, 1.1), units=6, sigma=6))
query(
    "rate_shock",
    "SELECT scenario_id, round(labour, 3) AS labour, round(transport, 3) AS transport, round(holding, 3) AS holding, "
    "round(facility, 3) AS facility, round(total_cost, 3) AS total_cost FROM scen WHERE scenario_id LIKE '% rate'",
)(
    lambda r: rounded(
        r.rate_shocks.costs.select("scenario_id", "labour", "transport", "holding", "facility", "total_cost"),
        labour=3, transport=3, holding=3, facility=3, total_cost=3,
    )
)
_DELTAS = {"baseline": 3, "perturbed": 3, "delta": 3, "pct": 6}
query(
    "scenario_deltas",
    """
SELECT * FROM (
WITH long AS (
  SELECT scenario_id, u.* FROM scen, LATERAL (VALUES
    ('demand outlook', 'forecast units', 'units', 'derived', forecast_units),
    ('stock', 'safety stock', 'units', 'synthetic-assigned', ss_units),
    ('stock', 'order-up-to', 'units', 'synthetic-assigned', order_up_to_units),
    ('delivery', 'route km', 'km', 'synthetic-assigned', km),
    ('cost lines', 'holding cost', 'GBP', 'synthetic-assigned', holding),
    ('cost lines', 'transport cost', 'GBP', 'synthetic-assigned', transport),
    ('cost lines', 'labour cost', 'GBP', 'synthetic-assigned', labour),
    ('cost lines', 'facility cost', 'GBP', 'synthetic-assigned', facility),
    ('cost lines', 'total cost', 'GBP', 'synthetic-assigned', total_cost),
    ('sales', 'window revenue', 'GBP', 'real', window_revenue)) u(stage, metric, unit, provenance, v)
)
SELECT p.scenario_id, p.stage, p.metric, p.unit, p.provenance, round(b.v, 3) AS baseline, round(p.v, 3) AS perturbed,
       round(p.v - b.v, 3) AS delta, round(100 * (p.v - b.v) / nullif(b.v, 0), 6) AS pct
FROM long p JOIN long b ON b.metric = p.metric AND b.scenario_id = 'base'
WHERE p.scenario_id IN ('class surge', 'transport rate'))""",
)(
    lambda r: rounded(
        whatif.deltas(r.shocks.costs, r.shocks.forecasts), **_DELTAS
    )
)
_GRID = {"ss_units": 4, "holding": 3, "labour": 3, "transport": 3, "facility": 3, "total_cost": 3, "window_revenue": 3,
         "holding_elasticity": 6, "total_elasticity": 6, "holding_share": 9}
query(
    "sensitivity_grid",
    """
SELECT s.scenario_id, s.demand_factor AS factor, round(s.ss_units, 4) AS ss_units, round(s.holding, 3) AS holding,
       round(s.labour, 3) AS labour, round(s.transport, 3) AS transport, round(s.facility, 3) AS facility,
       round(s.total_cost, 3) AS total_cost, round(s.window_revenue, 3) AS window_revenue,
       (SELECT count(*) FROM held WHERE passed AND name NOT LIKE '(l)%')
         + (abs(s.total_cost - s.labour - s.transport - s.holding - s.facility) <= 0.005)::INT AS identities_passed,
       (SELECT count(*) FROM held) AS identities_total,
       CASE WHEN s.demand_factor <> 1 THEN round((s.holding / b.holding - 1) / (s.demand_factor - 1), 6) END AS holding_elasticity,
       CASE WHEN s.demand_factor <> 1 THEN round((s.total_cost / b.total - 1) / (s.demand_factor - 1), 6) END AS total_elasticity,
       round(s.holding / s.total_cost, 9) AS holding_share
FROM scen s, booked b WHERE s.scenario_id LIKE 'book%'""",
)(lambda r: rounded(r.grid, **_GRID))
query(
    "class_containment",
    """
SELECT (SELECT class FROM top_class) AS target_class, 1.2::DOUBLE AS factor, round(c.class_ss, 4) AS class_ss, round(b.stock, 4) AS total_ss,
       round(b.holding / b.total, 9) AS holding_share,
       round((s.total_cost / b.total - 1) / 0.2, 6) AS measured_elasticity,
       round(b.holding / b.total * c.class_ss / b.stock, 6) AS predicted_elasticity, true AS holds
FROM booked b, scen s, (SELECT sum(safety_stock) AS class_ss FROM plan WHERE class = (SELECT class FROM top_class)) c
WHERE s.scenario_id = 'class surge'""",
)(
    lambda r: rounded(
        whatif.class_containment(r.shocks.costs, r.shocks.plans, r.shocks.checks), class_ss=4, total_ss=4,
        holding_share=9, measured_elasticity=6, predicted_elasticity=6,
    )
)

query(
    "named_class_surge",
    """
SELECT 'erratic' AS target_class, 1.2::DOUBLE AS factor, round(coalesce(c.class_ss, 0), 4) AS class_ss, round(b.stock, 4) AS total_ss,
       round(b.holding / b.total, 9) AS holding_share, round((s.total_cost / b.total - 1) / 0.2, 6) AS measured_elasticity,
       round(b.holding / b.total * coalesce(c.class_ss, 0) / b.stock, 6) AS predicted_elasticity, true AS holds
FROM booked b, scen s, (SELECT sum(safety_stock) AS class_ss FROM plan WHERE class = 'erratic') c
WHERE s.scenario_id = 'erratic surge'""",
)(
    lambda r: rounded(
        whatif.class_containment(r.named_surge.costs, r.named_surge.plans, r.named_surge.checks, whatif.class_scenario("erratic"), r.expected_checks)
        .withColumn("class_ss", F.coalesce("class_ss", F.lit(0.0))),
        class_ss=4, total_ss=4, holding_share=9, measured_elasticity=6, predicted_elasticity=6,
    )
)

# ---- readouts
def _breakdown(drivers: DataFrame) -> DataFrame:
    return rounded(
        drivers.withColumn("agrees", F.abs("residual_gbp") <= 0.005).select(
            "line", "grows_with", "quantity", "quantity_unit", "rate", "weekly", "rebuilt_gbp", "registered_gbp", "agrees", "share"
        ),
        quantity=4, rebuilt_gbp=3, registered_gbp=3, share=9,
    )


query(
    "driver_breakdown",
    """
SELECT line, grows_with, round(quantity, 4) AS quantity, quantity_unit, rate::DOUBLE AS rate, line = 'holding' AS weekly, round(rebuilt_gbp, 3) AS rebuilt_gbp, round(registered, 3) AS registered_gbp,
       abs(rebuilt_gbp - registered) <= 0.005 AS agrees, round(registered / total, 9) AS share
FROM booked, LATERAL (VALUES
  ('labour', 'fulfil/labour_hours', hours, 'hours', 14.5, hours * 14.5, labour),
  ('transport', 'transport/savings_km', km, 'km', 0.85, km * 0.85, transport),
  ('holding', 'inventory/safety_stock_units', stock, 'units', 0.02, stock * 0.02 * weeks, holding),
  ('facility', 'window/weeks', weeks, 'weeks', 2500, weeks * 2500, facility)
) u(line, grows_with, quantity, quantity_unit, rate, rebuilt_gbp, registered)""",
)(
    lambda r: _breakdown(r.drivers)
)
query(
    "verify_elasticity",
    """
SELECT split_part(s.scenario_id, ' ', 1) AS line, round(CASE split_part(s.scenario_id, ' ', 1)
         WHEN 'labour' THEN b.labour WHEN 'transport' THEN b.transport WHEN 'holding' THEN b.holding ELSE b.facility END / b.total, 6) AS share,
       round((s.total_cost / b.total - 1) / 0.1, 6) AS measured, true AS agrees
FROM scen s, booked b WHERE s.scenario_id LIKE '% rate'""",
)(
    lambda r: rounded(
        readout.elasticity_check(r.drivers, r.rate_shocks.costs).select("line", "share", "measured", "agrees"),
        share=6, measured=6,
    )
)
query(
    "order_economics",
    "SELECT invoice, round(revenue, 4) AS revenue, round(delivered_cost, 6) AS delivered_cost, round(gap, 4) AS gap FROM econ",
)(
    lambda r: rounded(r.economics.select("invoice", "revenue", "delivered_cost", "gap"), revenue=4, delivered_cost=6, gap=4)
)
query(
    "distribution_stats",
    """
SELECT count(*) AS n_orders, round(sum(delivered_cost), 3) AS delivered_total, round(sum(revenue), 3) AS revenue_total,
       round(avg(delivered_cost), 6) AS mean_cost, round(median(delivered_cost), 6) AS median_cost,
       round(quantile_cont(delivered_cost, 0.9), 6) AS p90_cost, round(min(delivered_cost), 6) AS min_cost,
       round(max(delivered_cost), 6) AS max_cost,
       round(sum(delivered_cost) FILTER (down <= greatest(1, n // 10)) / sum(delivered_cost), 6) AS top_decile_share,
       round(2 * sum(up * delivered_cost) / (count(*) * sum(delivered_cost)) - (count(*) + 1) / count(*), 6) AS gini,
       count(*) FILTER (delivered_cost > revenue) AS uncovered_orders,
       round(count(*) FILTER (delivered_cost > revenue) / count(*), 9) AS uncovered_share,
       coalesce(sum(revenue) FILTER (delivered_cost > revenue), 0) AS uncovered_revenue,
       coalesce(sum(delivered_cost) FILTER (delivered_cost > revenue), 0) AS uncovered_delivered
FROM cost_rank""",
)(
    lambda r: rounded(
        readout.distribution_stats(r.by_cost), delivered_total=3, revenue_total=3, mean_cost=6, median_cost=6, p90_cost=6,
        min_cost=6, max_cost=6, top_decile_share=6, gini=6, uncovered_share=9,
    )
)
query(
    "gini_revenue",
    """
SELECT round(2 * sum(r * revenue) / (count(*) * sum(revenue)) - (count(*) + 1) / count(*), 6) AS gini
FROM (SELECT revenue, row_number() OVER (ORDER BY revenue, invoice) AS r FROM econ)""",
)(lambda r: rounded(readout.gini(r.economics, "revenue", "invoice"), gini=6))
query(
    "whale_curve",
    "SELECT invoice, round(gap, 4) AS gap, rank, n_rows, round(cum_gap, 3) AS cum_gap FROM curve",
)(lambda r: rounded(readout.whale_curve(r.economics), gap=4, cum_gap=3))
query(
    "whale_summary",
    """
SELECT any_value(n_rows) AS n_orders, round(max(cum_gap), 3) AS peak_gbp, arg_max(rank, (cum_gap, -rank)) AS peak_orders,
       round(arg_max(rank, (cum_gap, -rank)) / any_value(n_rows), 9) AS peak_orders_share,
       round(arg_max(cum_gap, rank), 3) AS end_gbp, round(max(cum_gap) - arg_max(cum_gap, rank), 3) AS erosion_gbp FROM curve""",
)(lambda r: rounded(readout.whale_summary(readout.whale_curve(r.economics)), peak_gbp=3, end_gbp=3, erosion_gbp=3, peak_orders_share=9))
_DECILES = {"delivered_gbp": 3, "revenue_gbp": 3, "gap_gbp": 3, "cost_share": 6, "cum_cost_share": 6, "mean_delivered_gbp": 6}
query(
    "decile_table",
    """
SELECT decile::INT AS decile, orders, round(delivered, 3) AS delivered_gbp, round(revenue, 3) AS revenue_gbp, round(gap, 3) AS gap_gbp, uncovered_orders,
       round(delivered / sum(delivered) OVER (), 6) AS cost_share, round(delivered / orders, 6) AS mean_delivered_gbp,
       round(sum(delivered) OVER (ORDER BY decile) / sum(delivered) OVER (), 6) AS cum_cost_share
FROM (SELECT decile, count(*) AS orders, sum(delivered_cost) AS delivered, sum(revenue) AS revenue, sum(gap) AS gap,
             count(*) FILTER (delivered_cost > revenue) AS uncovered_orders FROM cost_rank GROUP BY 1)""",
)(
    lambda r: rounded(
        readout.decile_table(r.by_cost), **_DECILES
    )
)
query(
    "boundary_map",
    """
SELECT stage, provenance, unit, count(*) AS ledger_entries, CASE any_value(w) WHEN 3 THEN 'real' WHEN 2 THEN 'derived' ELSE 'synthetic-assigned' END AS weakest
FROM (SELECT *, min(CASE provenance WHEN 'real' THEN 3 WHEN 'derived' THEN 2 ELSE 1 END) OVER (PARTITION BY stage) AS w
      FROM (SELECT split_part(key, '/', 1) AS stage, provenance, unit FROM ledger))
GROUP BY 1, 2, 3""",
)(lambda r: readout.boundary_map(r.ledger))
query(
    "stage_summary",
    """
SELECT u.* FROM booked b, layout_pivot l, LATERAL (VALUES
  (0, 'headline', (SELECT sum(revenue)::DOUBLE FROM sales)), (0, 'raw_rows', (SELECT n0 FROM log_counts)),
  (0, 'sales_rows', (SELECT n5 FROM log_counts)), (0, 'returns_rows', (SELECT count(*) FROM returned)),
  (0, 'tracked_items', (SELECT count(*) FROM items)), (0, 'tracked_lines', (SELECT count(*) FROM window_sales)),
  (0, 'weeks', (SELECT count(*) FROM weeks)), (0, 'invoices', (SELECT count(DISTINCT invoice) FROM lines)),
  (0, 'stream_lines', (SELECT count(*) FROM lines)),
  (1, 'headline', (SELECT count(DISTINCT stock_code) FROM forecasts)), (1, 'rows', (SELECT count(*) FROM forecasts)),
  (1, 'horizon_weeks', 8), (1, 'classes_with_winner', (SELECT count(*) FROM winners WHERE winner)),
  (2, 'headline', stock), (2, 'items_planned', (SELECT count(*) FROM plan)),
  (2, 'order_up_to_units', (SELECT sum(order_up_to) FROM plan)), (2, 'service_level', 0.95),
  (3, 'headline', optimal_m), (3, 'abc_m', abc_m), (3, 'random_m', random_m),
  (4, 'headline', (SELECT count(*) FROM flog)), (4, 'window_weeks', b.weeks), (4, 'crew', 4),
  (4, 'lines_picked', (SELECT sum(lines) FROM flog)), (4, 'cartons_shipped', (SELECT sum(cartons) FROM flog)),
  (4, 'days', (SELECT count(*) FROM fday)), (4, 'labour_hours', b.hours),
  (4, 'mean_wait_min', (SELECT avg(wait_min) FROM flog)), (4, 'p95_wait_min', (SELECT quantile_cont(wait_min, 0.95) FROM flog)),
  (5, 'headline', b.km), (5, 'out_and_back_km', (SELECT sum(hi_km) FROM dday)), (5, 'delivery_days', (SELECT count(*) FROM dday)),
  (5, 'vehicle_days', (SELECT sum(vehicles) FROM dday)), (5, 'drops_routed', (SELECT count(*) FROM ship)),
  (5, 'wins', (SELECT count(*) FROM dday WHERE km < hi_km - 1e-6)), (5, 'ties', (SELECT count(*) FROM dday WHERE abs(km - hi_km) <= 1e-6)),
  (5, 'losses', (SELECT count(*) FROM dday WHERE km > hi_km + 1e-6)),
  (5, 'delta_pct', (SELECT 100 * sum(km - hi_km) / sum(hi_km) FROM dday)),
  (6, 'headline', b.total), (6, 'window_revenue', b.revenue), (6, 'labour', b.labour), (6, 'transport', b.transport),
  (6, 'holding', b.holding), (6, 'facility', b.facility), (6, 'cost_pct', 100 * b.total / b.revenue)
) u(stage_id, detail, value)""".replace("SELECT u.* FROM", "SELECT u.stage_id, u.detail, round(u.value::DOUBLE, 3) AS value FROM"),
)(
    lambda r: rounded(
        stage_summary(r).select(
            "stage_id", F.explode(F.map_concat("detail", F.create_map(F.lit("headline"), "value"))).alias("detail", "value")
        ),
        value=3,
    )
)

# ---- sources and receipts on the run's own tables
def _reread(r: Run, fmt: str) -> DataFrame:
    """Write the lines under the source's own headings, then read them as a source."""
    names = {v: k for k, v in transactions.HEADINGS.items() if k != "CustomerID"}
    path = f"{r.stages.folder}/source-{fmt}"
    getattr(r.txn.select(*transactions.COLUMNS).withColumnsRenamed(names).write.mode("overwrite"), fmt)(
        path, **({"header": True} if fmt == "csv" else {})
    )
    return transactions.read_transactions(r.spark, path, fmt)


for _fmt in ("csv", "parquet"):
    # the writer names its files; of each line's source the kind of file is known
    query(f"read_transactions_{_fmt}", f"SELECT {O.EIGHT}, '{_fmt}' AS source FROM txn")(
        lambda r, f=_fmt: _reread(r, f).withColumn("source", F.regexp_extract("source", r"^part-.*\.(\w+)$", 1))
    )
query("type_cast", f"SELECT {O.EIGHT} FROM txn")(
    lambda r: transactions.type_cast(r.txn.select(*[F.col(c).cast("string").alias(c) for c in transactions.COLUMNS]))
)
query("cached_copy", f"SELECT {O.EIGHT} FROM txn")(
    lambda r: transactions.cached_copy(r.txn.select(*transactions.COLUMNS), f"{r.stages.folder}/cache")
)
query("stratified_sample", "SELECT * FROM sampled")(lambda r: sample.stratified_sample(r.classified))


def _receipt(r: Run, run_id: str, ledger: DataFrame, **more: DataFrame) -> DataFrame:
    folder = f"{r.stages.folder}/receipts"
    receipts.write_run(folder, run_id, {"ledger": ledger, **more})
    return receipts.read_run(r.spark, folder, "ledger", run_id)


def _saved(r: Run, name: str, table: DataFrame) -> DataFrame:
    """One table of a run as its receipt holds it; nothing is worked out again."""
    folder = f"{r.stages.folder}/receipts"
    receipts.write_run(folder, "saved", {name: table})
    return receipts.read_run(r.spark, folder, name, "saved").select(*table.columns)


query("receipt_drivers", TOLD["driver_breakdown"])(lambda r: _breakdown(_saved(r, "drivers", r.drivers)))
query("receipt_boundary", TOLD["boundary_map"])(lambda r: _saved(r, "boundary", readout.boundary_map(r.ledger)))


def _reloaded(r: Run) -> Run:
    """The run as its receipt holds it: later stages read saved tables only."""
    folder = f"{r.stages.folder}/receipts"
    if not receipts.run_tables(r.spark, folder, "whole"):
        r.save(folder, "whole")
    return Run.load(r.txn, folder, "whole", r.params, r.models, r.published)


query("receipt_run_verdict", TOLD["verdict"])(lambda r: reconcile.verdict(_reloaded(r).checks))
query("receipt_run_economics", TOLD["order_economics"])(
    lambda r: rounded(_reloaded(r).economics.select("invoice", "revenue", "delivered_cost", "gap"), revenue=4, delivered_cost=6, gap=4)
)
query("receipt_ledger", "SELECT key, round(value, 3) AS value, unit FROM ledger")(
    lambda r: rounded(_receipt(r, "first", r.ledger, checks=r.checks, stages=stage_summary(r)).select("key", "value", "unit"), value=3)
)
query(
    "run_diff",
    "SELECT key, 'changed' AS difference FROM ledger WHERE key IN "
    "('inventory/safety_stock_units', 'costing/holding', 'costing/total_cost', 'costing/component_sum')",
)(
    lambda r: receipts.run_diff(
        _receipt(r, "base", r.ledger).select("key", F.round("value", 3).alias("value")),
        _receipt(r, "surged", r.shocks.ledger.filter("scenario_id = 'class surge'")).select("key", F.round("value", 3).alias("value")),
        ["key"],
    ).select("key", "difference")
)


def _sink(r: Run, name: str, table: DataFrame, order: list[str]) -> DataFrame:
    """A small result written as CSV and read back, all columns."""
    path = f"{r.stages.folder}/{name}-csv"
    receipts.write_sorted_csv(table, path, order)
    return r.spark.read.option("header", True).schema(table.schema).csv(path)


query("decile_csv", TOLD["decile_table"])(lambda r: rounded(_sink(r, "deciles", readout.decile_table(r.by_cost), ["decile"]), **_DECILES))
query("grid_csv", TOLD["sensitivity_grid"])(lambda r: rounded(_sink(r, "grid", r.grid, ["factor"]), **_GRID))
query("deltas_csv", TOLD["scenario_deltas"])(
    lambda r: rounded(_sink(r, "deltas", whatif.deltas(r.shocks.costs, r.shocks.forecasts), ["scenario_id", "metric"]), **_DELTAS)
)


try:  # the text operators are an optional part: without their files the rest works as before
    import corpus_pipeline
    from orderloom.llm import queries as texts
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "orderloom.llm"):
        raise
else:
    Q.update(texts.QUERIES)
    SQL.update(texts.SQL)
    Q["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Zero-filled weekly demand of the tracked items."""
    return run_for(spark, SMOKE_DIR).demand


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
