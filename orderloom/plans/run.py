"""One run of the whole chain, built stage by stage on first use.

Operators stay lazy. Frames that several later stages read are written once as stage tables;
everything else is planned into the query that asks for it.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.provenance import ASSIGNED, DERIVED, REAL
from orderloom.operators import (
    assign, clean, costs, delivery, demand, forecast, fulfil, readout, reconcile, slotting, stock, whatif,
)
from orderloom.operators.reconcile import Entry
from orderloom.params import DEFAULTS, VARIANTS, Params
from orderloom.sources import receipts
from orderloom.sources.stage import StageTables

# The stage tables of a receipt: what later stages and readers need, without the raw lines.
SAVED = (
    "items", "weeks", "demand", "lines", "window", "window_lines", "cv", "forecasts", "plan", "velocity", "slotting", "evaluated",
    "orders", "log", "shipments", "delivery_daily", "per_invoice", "per_item", "ledger_lines", "ledger", "checks",
)


class Run:
    """``published`` is the revenue another source states for the same lines: a one-row frame."""

    def __init__(
        self,
        txn: DataFrame,
        params: Params = DEFAULTS,
        models: dict[str, forecast.Model] | None = None,
        published: DataFrame | None = None,
    ):
        self.txn = txn
        self.published = published
        self.params = params
        self.models = forecast.MODELS if models is None else models
        self.spark = txn.sparkSession
        self.stages = StageTables(self.spark)

    def _keep(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        return self.stages.keep(name, df, by)

    def with_models(self, models: dict[str, forecast.Model]) -> Run:
        """A run with another model registry that shares this run's model-free stages."""
        other = Run(self.txn, self.params, models, self.published)
        for name in ("classified", "sales", "items", "weeks", "demand", "lines", "window", "window_lines", "descriptions", "physical"):
            other.__dict__[name] = getattr(self, name)
        return other

    def save(self, folder: str, run_id: str) -> None:
        """Write the run's stage tables as one receipt."""
        receipts.write_run(folder, run_id, {name: getattr(self, name) for name in SAVED})

    @classmethod
    def load(
        cls, txn: DataFrame, folder: str, run_id: str, params: Params = DEFAULTS,
        models: dict[str, forecast.Model] | None = None, published: DataFrame | None = None,
    ) -> Run:
        """A run whose saved stage tables are read; ``params`` and ``models`` are those it was saved with, and ``txn`` serves the rest."""
        run = cls(txn, params, models, published)
        for name in receipts.run_tables(run.spark, folder, run_id):
            if name in SAVED:
                run.__dict__[name] = receipts.read_run(run.spark, folder, name, run_id).drop("run_id", "schema_version")
        return run

    def close(self) -> None:
        self.stages.drop()

    # stage 0: clean, demand, lines
    @cached_property
    def classified(self) -> DataFrame:
        """Distinct lines; sales, returns and the log each read only the folders of their own steps."""
        if self.params.mostly_unique:
            distinct = clean.distinct_by_digest(self.txn, self.stages)
        else:
            distinct = clean.drop_exact_duplicates(self.txn)
        return self._keep("classified", clean.with_step(distinct), by="step_no")

    @cached_property
    def sales(self) -> DataFrame:
        return clean.sales_of(self.classified)

    @cached_property
    def returns(self) -> DataFrame:
        return clean.returns_of(self.classified)

    @cached_property
    def cleaning_log(self) -> DataFrame:
        return clean.log_of(self.classified)

    @cached_property
    def items(self) -> DataFrame:
        return self._keep("items", demand.tracked_items(self.sales, self.params.n_items))

    @cached_property
    def weeks(self) -> DataFrame:
        return self._keep("weeks", demand.weekly_index(self.sales))

    @cached_property
    def demand(self) -> DataFrame:
        return self._keep("demand", demand.weekly_demand(self.sales, self.items, self.weeks, self.params.n_items))

    @cached_property
    def series(self) -> DataFrame:
        return demand.series(self.demand)

    @cached_property
    def lines(self) -> DataFrame:
        return self._keep("lines", demand.invoice_lines(self.sales, self.items, self.weeks, self.params.n_items))

    @cached_property
    def window(self) -> DataFrame:
        return self._keep("window", demand.busiest_window(self.lines, self.weeks, self.params.window_weeks))

    @cached_property
    def window_lines(self) -> DataFrame:
        return self._keep("window_lines", demand.window_lines(self.lines, self.window))

    @cached_property
    def descriptions(self) -> DataFrame:
        return demand.modal_description(self.sales, self.items, self.params.n_items)

    # stage 1: forecast
    @cached_property
    def classes(self) -> DataFrame:
        return forecast.classify(self.demand, self.params)

    @cached_property
    def folds(self) -> DataFrame:
        return forecast.folds(self.classes.filter("eligible"), self.params)

    @cached_property
    def fold_frames(self) -> DataFrame:
        return forecast.fold_frames(self.series, self.folds, self.params.horizon)

    @cached_property
    def cv(self) -> DataFrame:
        return self._keep(
            "cv",
            forecast.cross_validate(self.fold_frames, self.classes, self.models, self.params.horizon)
        )

    @cached_property
    def class_winners(self) -> DataFrame:
        return forecast.class_winners(self.cv)

    @cached_property
    def choices(self) -> DataFrame:
        return forecast.choices(self.classes, self.class_winners)

    @cached_property
    def forecasts(self) -> DataFrame:
        return self._keep(
            "forecasts",
            forecast.final_forecast(self.series, self.choices, self.cv, self.models, self.params.horizon)
        )

    # assigned attributes
    @cached_property
    def physical(self) -> DataFrame:
        return self._keep("physical", assign.item_physical(self.descriptions, self.params.seed))

    @cached_property
    def lead_times(self) -> DataFrame:
        return assign.lead_times(self.items, self.forecasts, self.params.seed)

    @cached_property
    def slots(self) -> DataFrame:
        return self._keep("slots", assign.slots_for(self.items))

    @cached_property
    def customers(self) -> DataFrame:
        return assign.customer_lookup(self.sales)

    # stage 2: replenishment
    @cached_property
    def plan(self) -> DataFrame:
        return self._keep("plan", stock.plan(self.forecasts, self.lead_times, self.params))

    # stage 3: slotting and picks
    @cached_property
    def velocity(self) -> DataFrame:
        return self._keep("velocity", slotting.velocity(self.lines, self.items))

    @cached_property
    def slotting(self) -> DataFrame:
        return self._keep(
            "slotting", slotting.slot(self.velocity, self.slots, self.params.n_items, self.params.seed)
        )

    @cached_property
    def evaluated(self) -> DataFrame:
        return self._keep(
            "evaluated", slotting.evaluate(self.lines, self.slotting, self.slots, self.params), by="variant"
        )

    @cached_property
    def picks(self) -> DataFrame:
        """Pick work under the deployed layout."""
        return self.evaluated.filter("variant = 'optimal'").drop("variant")

    # stage 4a: fulfilment
    @cached_property
    def quantities(self) -> DataFrame:
        return fulfil.item_quantities(self.window_lines, self.physical, self.params)

    @cached_property
    def orders(self) -> DataFrame:
        return self._keep("orders", fulfil.orders(self.quantities, self.picks, self.params))

    @cached_property
    def log(self) -> DataFrame:
        return self._keep("log", fulfil.fulfilment_log(self.orders, self.params))

    @cached_property
    def per_day(self) -> DataFrame:
        return fulfil.per_day(self.log)

    # stage 4b: delivery
    @cached_property
    def shipments(self) -> DataFrame:
        # only the invoices of the window need a customer
        shipped = self.sales.join(self.log.select("invoice"), "invoice", "left_semi")
        return self._keep("shipments", delivery.shipments(self.log, assign.customer_lookup(shipped), self.params))

    @cached_property
    def nodes(self) -> DataFrame:
        return self._keep("nodes", delivery.drops(self.shipments))

    @cached_property
    def routes(self) -> DataFrame:
        return self._keep("routes", delivery.savings_routes(self.nodes, self.params))

    @cached_property
    def route_lengths(self) -> DataFrame:
        return delivery.route_km(self.routes, self.shipments)

    @cached_property
    def delivery_daily(self) -> DataFrame:
        return self._keep(
            "delivery_daily", delivery.per_day(self.route_lengths, self.shipments, self.params)
        )

    @cached_property
    def sweep_lengths(self) -> DataFrame:
        return delivery.route_km(self.sweep, self.shipments)

    @cached_property
    def sweep(self) -> DataFrame:
        return self._keep("sweep", delivery.sweep_routes(self.nodes, self.params))

    @cached_property
    def plans_daily(self) -> DataFrame:
        other = delivery.per_day(self.sweep_lengths, self.shipments, self.params)
        return self._keep("plans_daily", delivery.plans_by_day(self.delivery_daily, other, "sweep"))

    # stage 5: costs
    @cached_property
    def revenue_lines(self) -> DataFrame:
        return costs.window_revenue_lines(self.sales, self.items, self.window, self.params)

    @cached_property
    def per_invoice(self) -> DataFrame:
        return self._keep(
            "per_invoice",
            costs.per_invoice(self.log, self.revenue_lines, self.delivery_daily, self.window, self.params),
        )

    @cached_property
    def per_item(self) -> DataFrame:
        return self._keep(
            "per_item", costs.per_item(self.items, self.revenue_lines, self.plan, self.window, self.params)
        )

    @cached_property
    def ledger_lines(self) -> DataFrame:
        return self._keep(
            "ledger_lines",
            costs.ledger_lines(
                self.per_day, self.delivery_daily, self.per_item, self.revenue_lines, self.window, self.params
            ),
        )

    # stage 6: ledger and identities; both sides of an identity come from different frames
    def _ledger_sources(self) -> list[DataFrame]:
        one, distinct = F.count(F.lit(1)), F.count_distinct
        # one scan of the sales serves all three sums over ranges
        flagged = demand.range_flags(self.sales, self.items, self.params.n_items, in_range=self.weeks, in_window=self.window)
        made = reconcile.entries

        def of_variant(column: str, variant: str):
            return F.when(F.col("variant") == variant, F.col(column))

        travel = [
            entry
            for v in VARIANTS
            for entry in (
                Entry(f"warehouse/travel_mean_{v}", F.avg(of_variant("travel_m", v)), "m/invoice", ASSIGNED, f"{v} layout"),
                Entry(f"warehouse/invoices_{v}", F.count(of_variant("invoice", v)), "invoices", ASSIGNED, f"{v} layout"),
                Entry(f"warehouse/lines_{v}", F.sum(of_variant("lines", v)), "lines", ASSIGNED, f"{v} layout"),
            )
        ]
        booked = [
            Entry(
                "costing/" + item.replace(" ", "_"), F.sum(F.when(F.col("item") == item, F.col("gbp"))), "GBP", tag,
                "ledger line",
            )
            for item, tag in (
                ("labour", ASSIGNED), ("transport", ASSIGNED), ("holding", ASSIGNED), ("facility", ASSIGNED),
                ("total cost", ASSIGNED), ("window revenue", REAL),
            )
        ]
        parts = F.sum(F.when(F.col("item").isin(*costs.COST_LINES), F.col("gbp")))
        sources = [
            made(flagged, [
                Entry("ingest/revenue_gbp", F.sum("revenue"), "GBP", REAL, "cleaned revenue"),
                Entry("ingest/line_units", F.sum(F.when(F.col("in_range"), F.col("quantity"))), "units", REAL, "sum of line quantities"),
                Entry("ingest/line_count", F.count_if("in_range"), "lines", REAL, "sales lines of tracked items"),
                Entry("ingest/window_revenue", F.sum(F.when(F.col("in_window"), F.col("revenue"))), "GBP", REAL, "range filter"),
            ]),
            made(self.demand, [Entry("ingest/demand_units", F.sum("units"), "units", REAL, "sum of weekly demand")]),
            made(self.lines, [Entry("invoice_stream/line_count", one, "lines", REAL, "lines to pick")]),
            made(self.forecasts, [
                Entry("forecast/rows", one, "rows", DERIVED, "item x future week"),
                Entry("forecast/items", distinct("stock_code"), "items", DERIVED, "items with a forecast"),
            ]),
            made(self.plan, [
                Entry("inventory/plan_items", distinct("stock_code"), "items", ASSIGNED, "items with a plan"),
                Entry("inventory/safety_stock_units", F.sum("safety_stock"), "units", ASSIGNED, "stands on assigned lead times"),
            ]),
            made(self.velocity, [Entry("warehouse/velocity_lines", F.sum("velocity"), "lines", REAL, "lines per item, summed")]),
            made(self.picks, [Entry("warehouse/picked_lines_total", F.sum("lines"), "lines", ASSIGNED, "lines over all tours")]),
            made(self.evaluated, travel),
            made(self.window, [Entry("window/weeks", one, "weeks", REAL, "weeks of the window")]),
            made(self.window_lines, [Entry("window/stream_lines", one, "lines", REAL, "recount of the window")]),
            made(self.log, [
                Entry("fulfil/picked_lines", F.sum("lines"), "lines", ASSIGNED, "order log"),
                Entry("fulfil/orders", one, "orders", ASSIGNED, "orders shipped"),
                Entry("fulfil/cartons_packed", F.sum("cartons"), "cartons", ASSIGNED, "per order"),
            ]),
            made(self.per_day, [
                Entry("fulfil/cartons_shipped", F.sum("cartons"), "cartons", ASSIGNED, "per day"),
                Entry("fulfil/labour_hours", F.sum("labour_hours"), "hours", ASSIGNED, "picking labour"),
            ]),
            made(
                delivery.routed_drops(self.route_lengths, self.shipments),
                [Entry("transport/routed_drops", F.sum("routed_drops"), "orders", ASSIGNED, "counted from routes")],
            ),
            made(self.delivery_daily, [
                Entry("transport/savings_km", F.sum("km"), "km", ASSIGNED, "savings routes"),
                Entry("transport/out_and_back_km", F.sum("hi_km"), "km", ASSIGNED, "one trip per drop"),
            ]),
            made(self.ledger_lines, [*booked, Entry("costing/component_sum", parts, "GBP", ASSIGNED, "four lines added again")]),
        ]
        if self.published is not None:
            value = F.sum(self.published.columns[0])
            sources.append(made(self.published, [Entry("published/revenue_gbp", value, "GBP", REAL, "stated elsewhere")]))
        return sources

    @cached_property
    def ledger(self) -> DataFrame:
        return self._keep("ledger", reconcile.register(*self._ledger_sources()))

    @property
    def expected_checks(self) -> list[str]:
        """Names of the identities that this run can check."""
        return [n for n in reconcile.CHECKED if self.published is not None or not n.startswith("(a)")]

    def checks_for(
        self, ledger: DataFrame, forecasts: DataFrame, plan: DataFrame, layouts: DataFrame, scenario_ids: list[str]
    ) -> DataFrame:
        """The cross-stage identities for every scenario; ``layouts`` is the one row of (g), which none moves."""
        spec = [i for i in reconcile.IDENTITIES if i.name in self.expected_checks]
        parts = [
            reconcile.check(ledger, reconcile.literal_table(self.spark, spec), scenario_ids),
            reconcile.forecast_coverage(forecasts, self.items, scenario_ids),
            reconcile.replenishment_coverage(plan, forecasts, scenario_ids),
            reconcile.fan_out(layouts.drop("scenario_id"), scenario_ids),
            reconcile.provenance_audit(ledger, scenario_ids=scenario_ids),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def checks(self) -> DataFrame:
        layouts = reconcile.same_invoices(self.evaluated)
        return self._keep("checks", self.checks_for(self.ledger, self.forecasts, self.plan, layouts, [reconcile.BASE]))

    # readouts
    @cached_property
    def economics(self) -> DataFrame:
        return readout.order_economics(self.per_invoice)

    @cached_property
    def by_cost(self) -> DataFrame:
        return self._keep("by_cost", readout.by_cost(self.economics))

    @cached_property
    def drivers(self) -> DataFrame:
        return readout.drivers(self.ledger, self.params)

    # what-ifs
    @property
    def scenario_drivers(self) -> DataFrame:
        """The one-row quantities that no scenario moves."""
        base = self.ledger.filter(F.col("scenario_id") == reconcile.BASE)

        def value(key: str):
            return F.max(F.when(F.col("key") == key, F.col("value")))

        return base.agg(
            value("fulfil/labour_hours").alias("labour_hours"), value("transport/savings_km").alias("km"),
            value("window/weeks").alias("weeks"), value("costing/window_revenue").alias("window_revenue"),
        )

    def what_if(self, scenarios: list[whatif.Scenario]) -> WhatIf:
        return WhatIf(self, scenarios)

    @cached_property
    def shocks(self) -> WhatIf:
        """The base, a surge of the most populous class and a transport rate shock."""
        return self.what_if([whatif.BASE, whatif.CLASS_SURGE, whatif.TRANSPORT_SHOCK])

    @cached_property
    def named_surge(self) -> WhatIf:
        """The base and a surge of a class that the caller names: here the erratic one."""
        return self.what_if([whatif.BASE, whatif.class_scenario("erratic")])

    @cached_property
    def book_factors(self) -> WhatIf:
        return self.what_if(whatif.book_scenarios())

    @cached_property
    def rate_shocks(self) -> WhatIf:
        return self.what_if(whatif.rate_scenarios())

    @cached_property
    def grid(self) -> DataFrame:
        return self._keep("grid", whatif.grid(self.book_factors.costs, self.book_factors.checks, self.expected_checks))


class WhatIf:
    """Plans, costs, ledger and identities of several scenarios, each table keyed by ``scenario_id``."""

    def __init__(self, run: Run, scenarios: list[whatif.Scenario]):
        self.run = run
        self.scenarios = scenarios
        self.tag = f"whatif-{uuid.uuid4().hex[:8]}"

    @cached_property
    def forecasts(self) -> DataFrame:
        return whatif.scenario_forecasts(self.run.forecasts, self.scenarios)

    @cached_property
    def plans(self) -> DataFrame:
        return self.run._keep(
            f"{self.tag}-plans",
            whatif.scenario_plan(self.run.forecasts, self.run.lead_times, self.scenarios, self.run.params),
        )

    @cached_property
    def costs(self) -> DataFrame:
        return self.run._keep(
            f"{self.tag}-costs",
            whatif.scenario_costs(self.plans, self.run.scenario_drivers, self.scenarios, self.run.params),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        return whatif.scenario_ledger(self.run.ledger, self.costs, self.scenarios)

    @cached_property
    def checks(self) -> DataFrame:
        kept = self.run._keep(f"{self.tag}-ledger", self.ledger)
        layouts = self.run.checks.filter(F.col("name").startswith("(g)"))  # no scenario moves the tours
        ids = [s.scenario_id for s in self.scenarios]
        return self.run._keep(f"{self.tag}-checks", self.run.checks_for(kept, self.forecasts, self.plans, layouts, ids))
