"""Stage 6: the ledger of registered numbers and the identities that tie the stages together.

Every table carries ``scenario_id``, so the identities of many what-ifs are checked in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.expr import require
from orderloom.functions.provenance import ASSIGNED, REAL
from orderloom.params import PENNY, VARIANTS

BASE = "base"
ENTRY = ("scenario_id", "key", "value", "unit", "provenance", "note")
CHECK = ("scenario_id", "name", "lhs_label", "lhs", "rhs_label", "rhs", "tolerance", "passed", "unit", "note")


class Entry(NamedTuple):
    key: str
    value: Column
    unit: str
    provenance: str
    note: str


class Identity(NamedTuple):
    name: str
    lhs: str
    rhs: str
    tolerance: float
    note: str


def literal_table(spark: SparkSession, rows: Sequence[NamedTuple]) -> DataFrame:
    """A small table of constants as a plan literal."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(r._fields, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def entries(source: DataFrame, wanted: Sequence[Entry], scenario: Column | None = None) -> DataFrame:
    """Aggregate ``source`` once and turn the aggregates into ledger rows."""
    keys = ["scenario_id"] if scenario is None and "scenario_id" in source.columns else []
    named = [e.value.cast("double").alias(f"v{i}") for i, e in enumerate(wanted)]
    one = source.groupBy(*keys).agg(*named)
    structs = [
        F.struct(
            F.lit(e.key).alias("key"), F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("value"),
            F.lit(e.unit).alias("unit"), F.lit(e.provenance).alias("provenance"), F.lit(e.note).alias("note"),
        )
        for i, e in enumerate(wanted)
    ]
    label = F.col("scenario_id") if keys else F.lit(BASE)
    return one.select(label.alias("scenario_id"), F.inline(F.array(*structs)))


def register(*sources: DataFrame) -> DataFrame:
    """One ledger from all sources; a key that appears twice in a scenario fails the job."""
    combined = reduce(DataFrame.unionByName, sources)
    twice = F.concat(F.lit("ledger key registered twice: "), F.col("key"))
    once = combined.groupBy("scenario_id", "key").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in ENTRY[2:]]
    )
    return require(once, F.col("_n") == 1, twice).select(*ENTRY)


def per_scenario(df: DataFrame, scenario_ids: Sequence[str]) -> DataFrame:
    """Repeat a small base table under each scenario id."""
    ids = F.array(*[F.lit(s) for s in scenario_ids])
    return df.drop("scenario_id").withColumn("scenario_id", F.explode(ids))


def replace_entries(ledger: DataFrame, changed: DataFrame, scenario_ids: Sequence[str]) -> DataFrame:
    """The ledger of each scenario: the entries in ``changed``, all others as in the base ledger."""
    copied = per_scenario(ledger, scenario_ids).select(*ENTRY)
    untouched = copied.join(changed.select("scenario_id", "key"), ["scenario_id", "key"], "left_anti")
    return register(untouched.select(*ENTRY), changed.select(*ENTRY))


def ledger_table(ledger: DataFrame) -> DataFrame:
    tag = F.concat(F.lit("["), F.col("provenance"), F.lit("]"))
    return ledger.select("key", "value", "unit", tag.alias("provenance"), "note")


IDENTITIES = (
    Identity("(a) published revenue", "ingest/revenue_gbp", "published/revenue_gbp", PENNY, "same lines, same number"),
    Identity("(b) demand conservation", "ingest/demand_units", "ingest/line_units", 1e-6, "weekly sum against line sum"),
    Identity("(c) line conservation", "invoice_stream/line_count", "ingest/line_count", 0.0, "pick source against sales lines"),
    Identity("(f) pick conservation", "warehouse/picked_lines_total", "invoice_stream/line_count", 0.0, "toured lines against pick source"),
    Identity("(i) window pick conservation", "fulfil/picked_lines", "window/stream_lines", 0.0, "order log against recount"),
    Identity("(j) carton conservation", "fulfil/cartons_shipped", "fulfil/cartons_packed", 0.0, "per day against per order"),
    Identity("(k) drop conservation", "transport/routed_drops", "fulfil/orders", 0.0, "routes against orders"),
    Identity("(l) ledger additivity", "costing/total_cost", "costing/component_sum", PENNY, "total against its four lines"),
    Identity("(m) window revenue", "costing/window_revenue", "ingest/window_revenue", PENNY, "membership filter against range filter"),
)

# The entries whose tag is audited, and the tag each must carry.
AUDITED_TAGS = {
    "ingest/demand_units": REAL,
    "warehouse/velocity_lines": REAL,
    "warehouse/travel_mean_random": ASSIGNED,
    "warehouse/travel_mean_abc": ASSIGNED,
    "warehouse/travel_mean_optimal": ASSIGNED,
    "inventory/safety_stock_units": ASSIGNED,
}


def fan_out(small: DataFrame, scenario_ids: Sequence[str]) -> DataFrame:
    """Every row of a small table once per scenario id."""
    return small.withColumn("scenario_id", F.explode(F.array(*[F.lit(s) for s in scenario_ids])))


def check(ledger: DataFrame, spec: DataFrame, scenario_ids: Sequence[str] = (BASE,)) -> DataFrame:
    """Compare two registered numbers per identity; different units fail at any tolerance.

    ``spec`` is a table of identities, so it and both ledger lookups are a few dozen rows. Each identity has a row in
    each scenario: one whose left or right number is not registered fails.
    """
    wanted = fan_out(spec.withColumnsRenamed({"lhs": "lhs_label", "rhs": "rhs_label", "note": "_note"}), scenario_ids)
    left = ledger.select(
        "scenario_id", F.col("key").alias("lhs_label"), F.col("value").alias("lhs"), F.col("unit").alias("_lu")
    )
    right = ledger.select(
        "scenario_id", F.col("key").alias("rhs_label"), F.col("value").alias("rhs"), F.col("unit").alias("_ru")
    )
    both = wanted.join(left, ["scenario_id", "lhs_label"], "left").join(right, ["scenario_id", "rhs_label"], "left")
    same = F.coalesce(F.col("_lu") == F.col("_ru"), F.lit(False))
    close = F.coalesce(F.abs(F.col("lhs") - F.col("rhs")) <= F.col("tolerance"), F.lit(False))
    absent = F.lit("not registered")
    mismatch = F.concat(F.lit("units differ: "), F.coalesce("_lu", absent), F.lit(" / "), F.coalesce("_ru", absent))
    return both.select(
        "scenario_id", "name", "lhs_label", "lhs", "rhs_label", "rhs", "tolerance",
        (same & close).alias("passed"), F.when(same, F.col("_lu")).otherwise(mismatch).alias("unit"),
        F.col("_note").alias("note"),
    )


def identity_row(
    df: DataFrame, name: str, lhs: tuple[str, Column], rhs: tuple[str, Column], passed: Column, unit: str,
    note: Column, tolerance: float = 0.0,
) -> DataFrame:
    scenario = F.col("scenario_id") if "scenario_id" in df.columns else F.lit(BASE)
    return df.select(
        scenario.alias("scenario_id"), F.lit(name).alias("name"),
        F.lit(lhs[0]).alias("lhs_label"), lhs[1].cast("double").alias("lhs"),
        F.lit(rhs[0]).alias("rhs_label"), rhs[1].cast("double").alias("rhs"),
        F.lit(tolerance).alias("tolerance"), F.coalesce(passed, F.lit(False)).alias("passed"),
        F.lit(unit).alias("unit"), note.alias("note"),
    )


def _with_scenario(df: DataFrame) -> DataFrame:
    return df if "scenario_id" in df.columns else df.withColumn("scenario_id", F.lit(BASE))


def _for_each(counts: DataFrame, scenario_ids: Sequence[str]) -> DataFrame:
    """The counts of each scenario, zero where there is nothing to count."""
    ids = fan_out(counts.sparkSession.range(1).select(), scenario_ids)
    return ids.join(counts, "scenario_id", "left").fillna(0)


def forecast_coverage(forecasts: DataFrame, items: DataFrame, scenario_ids: Sequence[str] = (BASE,)) -> DataFrame:
    """(d) every forecast item is a demand item."""
    have = _with_scenario(forecasts).select("scenario_id", "stock_code").distinct()
    known = items.select("stock_code", F.lit(True).alias("known"))
    counts = have.join(known, "stock_code", "left").groupBy("scenario_id").agg(
        F.count("known").alias("known"), F.count(F.lit(1)).alias("total")
    )
    counts = _for_each(counts, scenario_ids)
    note = F.concat(F.lit("orphans: "), (F.col("total") - F.col("known")).cast("string"))
    return identity_row(
        counts, "(d) forecast coverage", ("forecast items known to demand", F.col("known")),
        ("forecast items", F.col("total")), F.col("known") == F.col("total"), "items", note,
    )


def replenishment_coverage(plan: DataFrame, forecasts: DataFrame, scenario_ids: Sequence[str] = (BASE,)) -> DataFrame:
    """(e) planned items and forecast items are the same set."""
    planned = _with_scenario(plan).select("scenario_id", "stock_code").distinct().withColumn("p", F.lit(1))
    wanted = _with_scenario(forecasts).select("scenario_id", "stock_code").distinct().withColumn("f", F.lit(1))
    counts = planned.join(wanted, ["scenario_id", "stock_code"], "full_outer").groupBy("scenario_id").agg(
        F.count("p").alias("planned"), F.count("f").alias("wanted"),
        F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("f").isNull()).alias("orphans"),
    )
    counts = _for_each(counts, scenario_ids)
    note = F.concat(F.lit("missing: "), F.col("missing").cast("string"), F.lit("; orphans: "), F.col("orphans").cast("string"))
    return identity_row(
        counts, "(e) replenishment coverage", ("planned items", F.col("planned")), ("forecast items", F.col("wanted")),
        (F.col("missing") == 0) & (F.col("orphans") == 0), "items", note,
    )


def same_invoices(evaluated: DataFrame) -> DataFrame:
    """(g) all layouts were measured on the same invoices and lines.

    Beyond equal totals, each invoice must occur once in every variant with the same line count.
    """
    totals = evaluated.groupBy("variant").agg(
        F.count(F.lit(1)).alias("invoices"), F.sum("lines").alias("lines")
    )
    spread = totals.agg(
        F.min("invoices").alias("ilo"), F.max("invoices").alias("ihi"),
        F.min("lines").alias("lo"), F.max("lines").alias("hi"),
    )
    # one bit per variant: an invoice is even when every bit is set by exactly one row
    bit = F.coalesce(*[F.when(F.col("variant") == v, F.lit(1 << k)) for k, v in enumerate(VARIANTS)])
    odd = evaluated.groupBy("invoice").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("v"), F.min("lines").alias("a"), F.max("lines").alias("b")
    ).filter(
        (F.col("n") != len(VARIANTS)) | (F.col("v") != (1 << len(VARIANTS)) - 1) | (F.col("a") != F.col("b"))
    )
    uneven = odd.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = spread.withColumn("uneven", uneven)
    passed = (F.col("ilo") == F.col("ihi")) & (F.col("lo") == F.col("hi")) & (F.col("uneven") == 0)
    note = F.format_string("invoices per variant %d to %d; uneven invoices: %d", "ilo", "ihi", "uneven")
    return identity_row(
        one, "(g) same-invoice evaluation", ("lines of the shortest layout", F.col("lo")),
        ("lines of the longest layout", F.col("hi")), passed, "lines", note,
    )


class _Tag(NamedTuple):
    key: str
    required: str


def provenance_audit(
    ledger: DataFrame, tags: dict[str, str] | None = None, scenario_ids: Sequence[str] = (BASE,)
) -> DataFrame:
    """(h) audited entries carry the tag they must carry; a missing entry counts as wrong."""
    spec = literal_table(ledger.sparkSession, [_Tag(k, v) for k, v in (tags or AUDITED_TAGS).items()])
    n = len(tags or AUDITED_TAGS)
    found = ledger.join(F.broadcast(spec), "key")  # one row per audited entry
    right = F.count_if(F.col("provenance") == F.col("required"))
    counts = _for_each(found.groupBy("scenario_id").agg(right.alias("right")), scenario_ids)
    note = F.format_string("%d of %d entries lack their tag", F.lit(n) - F.col("right"), F.lit(n))
    return identity_row(
        counts, "(h) provenance audit", ("entries with their own tag", F.col("right")),
        ("entries looked up", F.lit(n)), F.col("right") == n, "entries", note,
    )


def allocation(
    economics: DataFrame, items_cost: DataFrame, lines: DataFrame, shipped: DataFrame, tol: float = PENNY
) -> DataFrame:
    """(p) costs spread over orders and items add up to the ledger again, order by order and line by line."""
    audited = ("revenue", "labour_cost", "transport_cost", "facility_cost")

    def undefined(name: str) -> Column:
        return F.col(name).isNull() | F.isnan(name)

    grouped = economics.groupBy("invoice").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(F.when(undefined(c), 0.0).otherwise(F.col(c))).alias(c) for c in audited],
        *[F.count_if(undefined(c)).alias(f"_bad_{c}") for c in audited],
    )
    both = grouped.join(
        shipped.select("invoice").distinct().withColumn("_shipped", F.lit(True)), "invoice", "full_outer"
    )
    sums = both.agg(
        F.count_if(F.col("_rows").isNull()).alias("lost"),
        F.count_if(F.col("_shipped").isNull()).alias("phantom"),
        F.coalesce(F.sum(F.greatest(F.col("_rows") - 1, F.lit(0))), F.lit(0)).alias("repeated"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in audited],
        *[F.coalesce(F.sum(f"_bad_{c}"), F.lit(0)).alias(f"bad_{c}") for c in audited],
    )
    held = items_cost.agg(F.coalesce(F.sum("holding_cost"), F.lit(0.0)).alias("h")).scalar()
    booked = lines.agg(
        *[
            F.sum(F.when(F.col("item") == item, F.col("gbp"))).alias("b_" + item.replace(" ", "_"))
            for item in ("labour", "transport", "holding", "facility", "total cost", "window revenue")
        ]
    )
    packed = booked.select(F.struct("*").alias("b")).scalar()
    one = sums.withColumn("holding_cost", held).withColumn("_b", packed).select("*", "_b.*")
    rebuilt = F.col("labour_cost") + F.col("transport_cost") + F.col("facility_cost") + F.col("holding_cost")
    pairs = [
        ("labour", F.col("labour_cost"), F.col("b_labour")),
        ("transport", F.col("transport_cost"), F.col("b_transport")),
        ("facility", F.col("facility_cost"), F.col("b_facility")),
        ("holding", F.col("holding_cost"), F.col("b_holding")),
        ("total", rebuilt, F.col("b_total_cost")),
        ("revenue", F.col("revenue"), F.col("b_window_revenue")),
    ]

    def when_bad(bad: Column, text: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), text)

    found = F.array(
        *[when_bad(F.col(c) > 0, F.concat(F.lit(f"{c} orders: "), F.col(c).cast("string")))
          for c in ("lost", "phantom", "repeated")],
        *[when_bad(F.col(f"bad_{c}") > 0, F.concat(F.lit(f"undefined {c}: "), F.col(f"bad_{c}").cast("string")))
          for c in audited],
        *[when_bad(F.abs(a - b) > tol, F.format_string(f"{n}: spread %.4f, ledger %.4f", a, b)) for n, a, b in pairs],
    )
    one = one.withColumn("_found", F.array_compact(found))
    clean = F.size("_found") == 0
    note = F.when(clean, F.lit("one row per shipped order; every line adds up again")).otherwise(
        F.array_join("_found", "; ")
    )
    return identity_row(
        one, "(p) order-level allocation", ("orders plus items", rebuilt), ("ledger total cost", F.col("b_total_cost")),
        clean, "GBP", note, tol,
    )


class _Name(NamedTuple):
    name: str


# Every identity that a run checks at each scenario.
CHECKED = (*[i.name for i in IDENTITIES], "(d) forecast coverage", "(e) replenishment coverage", "(g) same-invoice evaluation", "(h) provenance audit")


def verdict(checks: DataFrame, expected: Sequence[str] = CHECKED, scenario_ids: Sequence[str] = (BASE,)) -> DataFrame:
    """Passed and total identities per scenario; an expected one that is absent counts as failed."""
    names = fan_out(literal_table(checks.sparkSession, [_Name(n) for n in expected]), scenario_ids)
    held = checks.groupBy("scenario_id", "name").agg(F.bool_and("passed").alias("held"))
    found = names.join(held, ["scenario_id", "name"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    return found.groupBy("scenario_id").agg(
        F.count_if("held").alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_and("held").alias("all_passed")
    )
