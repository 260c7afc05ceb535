"""What-if scenarios. A scenario is a row: forecasts and rates fan out by id, nothing is patched.

Only the forecast-fed stages (a few rows per item) are worked out again; orders, tours and routes
stand on the sales lines, which no scenario changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.provenance import ASSIGNED, DERIVED, REAL
from orderloom.operators import reconcile, stock
from orderloom.operators.costs import COST_LINES, charges
from orderloom.params import DEFAULTS, FACTORS, PENNY, RATE_SHOCK_FACTOR, SURGE_FACTOR, Params


class Scenario(NamedTuple):
    scenario_id: str
    scope: str = "none"  # none, book (every item) or class (the named one, else the most populous)
    demand_factor: float = 1.0
    labour_factor: float = 1.0
    transport_factor: float = 1.0
    holding_factor: float = 1.0
    facility_factor: float = 1.0
    target_class: str = ""


BASE = Scenario(reconcile.BASE)
CLASS_SURGE = Scenario("class surge", "class", SURGE_FACTOR)
TRANSPORT_SHOCK = Scenario("transport rate", transport_factor=RATE_SHOCK_FACTOR)


def class_scenario(target_class: str, factor: float = SURGE_FACTOR) -> Scenario:
    """A surge of the class the caller names."""
    return Scenario(f"{target_class} surge", "class", factor, target_class=target_class)


def book_scenarios(factors: Sequence[float] = FACTORS) -> list[Scenario]:
    return [Scenario(f"book x{f:.2f}", "book", f) for f in factors]


def rate_scenarios(factor: float = RATE_SHOCK_FACTOR) -> list[Scenario]:
    return [Scenario(f"{line} rate", **{f"{line}_factor": factor}) for line in COST_LINES]


def most_populous_class(forecasts: DataFrame) -> DataFrame:
    """The class with most forecast items, ties by name; one row."""
    counts = forecasts.groupBy("class").agg(F.count_distinct("stock_code").alias("items"))
    return counts.orderBy(F.col("items").desc(), "class").limit(1)


def _scaled(forecasts: DataFrame, applies: Column, factor: Column) -> DataFrame:
    by = F.when(applies, factor).otherwise(1.0)
    return forecasts.withColumns({"units": F.col("units") * by, "sigma": F.col("sigma") * by})


def surge(forecasts: DataFrame, target_class: Column | str, factor: float) -> DataFrame:
    """Forecast and uncertainty of one class times ``factor``; the input frame is left as it is."""
    wanted = F.lit(target_class) if isinstance(target_class, str) else target_class
    return _scaled(forecasts, F.col("class") == wanted, F.lit(factor))


def book_surge(forecasts: DataFrame, factor: float) -> DataFrame:
    return _scaled(forecasts, F.lit(True), F.lit(factor))


def scenario_table(forecasts: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    return reconcile.literal_table(forecasts.sparkSession, list(scenarios))


def scenario_forecasts(forecasts: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Every forecast row once per scenario, scaled where the scenario reaches it."""
    options = F.array(
        *[
            F.struct(
                F.lit(s.scenario_id).alias("scenario_id"), F.lit(s.scope).alias("scope"),
                F.lit(s.demand_factor).alias("demand_factor"), F.lit(s.target_class).alias("target_class"),
            )
            for s in scenarios
        ]
    )
    top = most_populous_class(forecasts).select("class").scalar()
    fanned = forecasts.withColumn("_top", top).select("*", F.inline(options))
    target = F.when(F.col("target_class") == "", F.col("_top")).otherwise(F.col("target_class"))
    reached = (F.col("scope") == "book") | ((F.col("scope") == "class") & (F.col("class") == target))
    return _scaled(fanned, reached, F.col("demand_factor")).drop("_top", "scope", "demand_factor", "target_class")


def scenario_plan(forecasts: DataFrame, lead_times: DataFrame, scenarios: Sequence[Scenario], p: Params) -> DataFrame:
    return stock.plan(scenario_forecasts(forecasts, scenarios), lead_times, p, by=["scenario_id"])


def scenario_costs(
    plans: DataFrame, drivers: DataFrame, scenarios: Sequence[Scenario], p: Params = DEFAULTS
) -> DataFrame:
    """All ledger lines of each scenario from the one-row ``drivers`` and the scenario's own plan."""
    stocks = plans.groupBy("scenario_id").agg(
        F.sum("safety_stock").alias("ss_units"), F.sum("order_up_to").alias("order_up_to_units")
    )
    rates = F.broadcast(scenario_table(plans, scenarios))  # one row per scenario
    one = drivers.select(F.struct("*").alias("d")).scalar()
    joined = rates.join(stocks, "scenario_id", "left").withColumn("_d", one).select("*", "_d.*")
    quantity = {"labour": F.col("labour_hours"), "transport": F.col("km"), "holding": F.col("ss_units"), "facility": F.col("weeks")}
    factor = {line: F.col(f"{line}_factor") for line in COST_LINES}
    priced = joined.fillna(0.0, ["ss_units", "order_up_to_units"]).withColumns(charges(quantity, F.col("weeks"), p, factor))
    total = F.col("labour") + F.col("transport") + F.col("holding") + F.col("facility")
    return priced.select(
        "scenario_id", "demand_factor", "ss_units", "order_up_to_units", "km", "labour", "transport", "holding",
        "facility", total.alias("total_cost"), "window_revenue",
    )


def scenario_ledger(ledger: DataFrame, costs: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """The base ledger under each scenario, with the entries a scenario can move worked out again."""
    parts = F.col("labour") + F.col("transport") + F.col("holding") + F.col("facility")
    moved = [("inventory/safety_stock_units", F.col("ss_units"), "units", ASSIGNED)]
    moved += [(f"costing/{c}", F.col(c), "GBP", ASSIGNED) for c in ("labour", "transport", "holding", "facility", "total_cost")]
    moved += [("costing/component_sum", parts, "GBP", ASSIGNED), ("costing/window_revenue", F.col("window_revenue"), "GBP", REAL)]
    changed = reconcile.entries(
        costs, [reconcile.Entry(k, F.sum(v), u, t, "scenario") for k, v, u, t in moved]
    )
    return reconcile.replace_entries(ledger, changed, [s.scenario_id for s in scenarios])


class _Metric(NamedTuple):
    stage: str
    metric: str
    column: str
    unit: str
    provenance: str


METRICS = (
    _Metric("demand outlook", "forecast units", "forecast_units", "units", DERIVED),
    _Metric("stock", "safety stock", "ss_units", "units", ASSIGNED),
    _Metric("stock", "order-up-to", "order_up_to_units", "units", ASSIGNED),
    _Metric("delivery", "route km", "km", "km", ASSIGNED),
    _Metric("cost lines", "holding cost", "holding", "GBP", ASSIGNED),
    _Metric("cost lines", "transport cost", "transport", "GBP", ASSIGNED),
    _Metric("cost lines", "labour cost", "labour", "GBP", ASSIGNED),
    _Metric("cost lines", "facility cost", "facility", "GBP", ASSIGNED),
    _Metric("cost lines", "total cost", "total_cost", "GBP", ASSIGNED),
    _Metric("sales", "window revenue", "window_revenue", "GBP", REAL),
)


def deltas(costs: DataFrame, forecasts_by_scenario: DataFrame, target_class: str = "") -> DataFrame:
    """Each traced quantity under base and scenario; the percentage is NULL where the base is 0.

    Forecast units are those of ``target_class``, else of the most populous class: the one a class surge scales.
    """
    top = F.lit(target_class) if target_class else most_populous_class(forecasts_by_scenario).select("class").scalar()
    units = forecasts_by_scenario.filter(F.col("class") == top).groupBy("scenario_id").agg(
        F.sum("units").alias("forecast_units")
    )
    wide = costs.join(units, "scenario_id", "left").fillna(0.0, ["forecast_units"])
    long = wide.select(
        "scenario_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m.stage).alias("stage"), F.lit(m.metric).alias("metric"), F.lit(m.unit).alias("unit"),
                        F.lit(m.provenance).alias("provenance"), F.col(m.column).alias("value"),
                    )
                    for m in METRICS
                ]
            )
        ),
    )
    base = long.filter(F.col("scenario_id") == reconcile.BASE).select("metric", F.col("value").alias("baseline"))
    change = F.col("value") - F.col("baseline")
    return (
        long.filter(F.col("scenario_id") != reconcile.BASE)
        .join(F.broadcast(base), "metric")  # one row per metric
        .select(
            "scenario_id", "stage", "metric", "unit", "provenance", "baseline", F.col("value").alias("perturbed"),
            change.alias("delta"),
            F.when(F.col("baseline") != 0, 100.0 * F.try_divide(change, F.col("baseline"))).alias("pct"),
        )
    )


def arc_elasticity(base: Column, value: Column, factor: Column) -> Column:
    """Relative change of the value per relative change of the factor; NULL at the base point."""
    return F.when(
        (factor != 1.0) & (base != 0.0), F.try_divide(F.try_divide(value - base, base), factor - 1.0)
    )


def grid(
    costs: DataFrame, checks: DataFrame, expected: Sequence[str] = reconcile.CHECKED, factors: Sequence[float] = FACTORS
) -> DataFrame:
    """One row per book factor: ledger lines, elasticity of holding and total, identities that hold."""
    passed = reconcile.verdict(checks, expected, [s.scenario_id for s in book_scenarios(factors)]).select(
        "scenario_id", F.col("passed").alias("identities_passed"), F.col("total").alias("identities_total")
    )
    everything = Window.partitionBy()  # one row per factor
    at_base = {
        c: F.max(F.when(F.col("demand_factor") == 1.0, F.col(c))).over(everything) for c in ("holding", "total_cost")
    }
    return costs.join(passed, "scenario_id").select(
        "scenario_id", F.col("demand_factor").alias("factor"), "ss_units", "holding", "labour", "transport", "facility",
        "total_cost", "window_revenue", "identities_passed", "identities_total",
        arc_elasticity(at_base["holding"], F.col("holding"), F.col("demand_factor")).alias("holding_elasticity"),
        arc_elasticity(at_base["total_cost"], F.col("total_cost"), F.col("demand_factor")).alias("total_elasticity"),
        F.coalesce(F.try_divide(F.col("holding"), F.col("total_cost")), F.lit(0.0)).alias("holding_share"),
    )


def forecast_containment(grid_df: DataFrame, tol: float = PENNY) -> DataFrame:
    """(o) a surge of the whole book moves the holding line and nothing else, at every factor."""
    still = ("labour", "transport", "facility", "window_revenue")
    base_row = grid_df.filter(F.col("factor") == 1.0).select(
        F.struct("holding", "total_cost", *still).alias("b")
    ).limit(1).scalar()
    seen = grid_df.withColumn("b", base_row)
    predicted = F.col("b.total_cost") + (F.col("factor") - 1.0) * F.col("b.holding")
    faults = F.array_compact(
        F.array(
            F.when(F.abs(F.col("total_cost") - predicted) > tol, F.format_string("total at x%.2f", F.col("factor"))),
            *[
                F.when(F.abs(F.col(c) - F.col(f"b.{c}")) > tol, F.format_string(f"{c} at x%.2f", F.col("factor")))
                for c in still
            ],
            F.when(
                F.coalesce(F.col("identities_passed") != F.col("identities_total"), F.lit(True)),
                F.format_string("identities at x%.2f", F.col("factor")),
            ),
        )
    )
    off = seen.filter(F.col("factor") != 1.0).select("factor", "total_cost", predicted.alias("predicted"), faults.alias("f"))
    one = off.agg(
        F.max_by("total_cost", "factor").alias("top"), F.max_by("predicted", "factor").alias("expected"),
        F.array_sort(F.flatten(F.collect_list("f"))).alias("faults"),  # a handful of factors
    )
    clean = F.size("faults") == 0
    note = F.when(clean, F.lit("only holding moves; identities hold at every factor")).otherwise(F.array_join("faults", "; "))
    return reconcile.identity_row(
        one, "(o) forecast-error containment", ("total cost at the top factor", F.col("top")),
        ("base total plus surge on holding", F.col("expected")), clean, "GBP", note, tol,
    )


def class_containment(
    costs: DataFrame, plans: DataFrame, checks: DataFrame, surge: Scenario = CLASS_SURGE,
    expected: Sequence[str] = reconcile.CHECKED,
) -> DataFrame:
    """A surge of one class moves the total by holding share x the class's share of safety stock."""
    base_plan, factor = plans.filter(F.col("scenario_id") == reconcile.BASE), surge.demand_factor
    top = F.lit(surge.target_class) if surge.target_class else most_populous_class(base_plan).select("class").scalar()
    stocks = base_plan.withColumn("_top", top).agg(
        F.max("_top").alias("target_class"),
        F.sum(F.when(F.col("class") == F.col("_top"), F.col("safety_stock"))).alias("class_ss"),
        F.sum("safety_stock").alias("total_ss"),
    )
    lines = costs.agg(
        F.max(F.when(F.col("scenario_id") == reconcile.BASE, F.col("total_cost"))).alias("base_total"),
        F.max(F.when(F.col("scenario_id") == reconcile.BASE, F.col("holding"))).alias("base_holding"),
        F.max(F.when(F.col("scenario_id") == surge.scenario_id, F.col("total_cost"))).alias("surged_total"),
    ).select(F.struct("*").alias("c")).scalar()
    held = reconcile.verdict(checks, expected, [surge.scenario_id]).select("all_passed").scalar()
    one = stocks.withColumn("_c", lines).withColumn("identities_hold", held).select("*", "_c.*")
    share = F.coalesce(F.try_divide(F.col("base_holding"), F.col("base_total")), F.lit(0.0))
    fraction = F.coalesce(F.try_divide(F.col("class_ss"), F.col("total_ss")), F.lit(0.0))
    measured = F.try_divide(F.col("surged_total") - F.col("base_total"), F.col("base_total")) / (factor - 1.0)
    return one.select(
        "target_class", F.lit(factor).alias("factor"), "class_ss", "total_ss", share.alias("holding_share"),
        measured.alias("measured_elasticity"), (share * fraction).alias("predicted_elasticity"),
        (F.col("identities_hold") & (F.abs(measured - share * fraction) <= 1e-9)).alias("holds"),
    )
