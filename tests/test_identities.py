"""Identities hold on a clean run and fail when one input is corrupted."""

import pytest
from pyspark.sql import functions as F

from orderloom.functions.provenance import REAL
from orderloom.operators import readout, reconcile, whatif
from orderloom.sources import receipts


def passed(df):
    return {r.name[:3]: r.passed for r in df.collect()}


def checks_on(run, ledger):
    return passed(reconcile.check(ledger, reconcile.literal_table(run.spark, reconcile.IDENTITIES)))


def change(df, key, by=0.0, **columns):
    """The ledger with one entry shifted by ``by`` or with other column values."""
    hit = F.col("key") == key
    out = df.withColumn("value", F.when(hit, F.col("value") + by).otherwise(F.col("value")))
    for name, value in columns.items():
        out = out.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
    return out


def test_all_identities_pass(run):
    rows = run.checks.collect()
    assert len(rows) == 13 and all(r.passed for r in rows)
    assert {r.name[1] for r in rows} == set("abcdefghijklm")
    assert reconcile.verdict(run.checks).first().all_passed


@pytest.mark.parametrize(
    "key,by,letter",
    [
        ("ingest/revenue_gbp", 0.01, "a"), ("ingest/demand_units", 1.0, "b"), ("invoice_stream/line_count", -1.0, "c"),
        ("warehouse/picked_lines_total", -1.0, "f"), ("fulfil/picked_lines", 1.0, "i"), ("fulfil/cartons_shipped", 1.0, "j"),
        ("transport/routed_drops", -1.0, "k"), ("costing/total_cost", 0.01, "l"), ("ingest/window_revenue", 0.01, "m"),
    ],
)
def test_a_small_drift_fails(run, key, by, letter):
    assert not checks_on(run, change(run.ledger, key, by))[f"({letter})"]


def test_unit_clash_fails_at_any_tolerance(run):
    spec = reconcile.literal_table(run.spark, [reconcile.Identity("(a) x", "ingest/revenue_gbp", "ingest/demand_units", 1e12, "")])
    row = reconcile.check(run.ledger, spec).first()
    assert not row.passed and row.unit == "units differ: GBP / units"


def test_missing_side_fails(run):
    lost = run.ledger.filter("key <> 'published/revenue_gbp'")
    assert checks_on(run, lost)["(a)"] is False


@pytest.mark.parametrize("identity", reconcile.IDENTITIES, ids=lambda i: i.name[:3])
def test_a_lost_entry_fails_its_identity(run, identity):
    for key in (identity.lhs, identity.rhs):
        held = checks_on(run, run.ledger.filter(F.col("key") != key))
        assert len(held) == len(reconcile.IDENTITIES) and held[identity.name[:3]] is False


def test_nothing_to_check_fails(run):
    none = run.ledger.limit(0)
    assert set(checks_on(run, none).values()) == {False} and len(checks_on(run, none)) == len(reconcile.IDENTITIES)
    assert passed(reconcile.forecast_coverage(run.forecasts.limit(0), run.items)) == {"(d)": True}
    row = reconcile.replenishment_coverage(run.plan.limit(0), run.forecasts.limit(0)).first()
    assert (row.lhs, row.rhs, row.passed) == (0.0, 0.0, True)
    assert not passed(reconcile.replenishment_coverage(run.plan.limit(0), run.forecasts))["(e)"]
    untagged = run.ledger.filter(~F.col("key").isin(*reconcile.AUDITED_TAGS))
    for ledger in (none, untagged):
        assert passed(reconcile.provenance_audit(ledger)) == {"(h)": False}


def test_verdict_counts_absent_identities(run):
    row = reconcile.verdict(run.checks.filter("name NOT LIKE '(k)%'")).first()
    assert (row.passed, row.total, row.all_passed) == (12, 13, False)
    row = reconcile.verdict(run.checks.limit(0)).first()
    assert (row.passed, row.total, row.all_passed) == (0, 13, False)


def test_duplicate_key_fails(run):
    twice = reconcile.register(run.ledger, run.ledger.limit(1))
    for read in (twice.collect, twice.select("key").collect, twice.count):
        with pytest.raises(Exception, match="registered twice"):
            read()


def test_orphan_forecast_and_lost_plan_fail(run):
    orphan = run.forecasts.union(run.forecasts.limit(1).withColumn("stock_code", F.lit("ORPHAN")))
    assert not passed(reconcile.forecast_coverage(orphan, run.items))["(d)"]
    one = run.plan.select("stock_code").orderBy("stock_code").first()[0]
    assert not passed(reconcile.replenishment_coverage(run.plan.filter(F.col("stock_code") != one), run.forecasts))["(e)"]
    assert not passed(reconcile.replenishment_coverage(run.plan, run.forecasts.filter(F.col("stock_code") != one)))["(e)"]


def test_uneven_layouts_fail(run):
    one = run.evaluated.select("invoice").orderBy("invoice").first()[0]
    hit = (F.col("invoice") == one) & (F.col("variant") == "abc")
    lost = run.evaluated.filter(~hit)
    swapped = run.evaluated.withColumn("invoice", F.when(hit, "PHANTOM").otherwise(F.col("invoice")))
    for bad in (lost, swapped):
        assert not passed(reconcile.same_invoices(bad))["(g)"]


def test_wrong_or_missing_tag_fails(run):
    key = "warehouse/travel_mean_abc"
    assert not passed(reconcile.provenance_audit(change(run.ledger, key, provenance=REAL)))["(h)"]
    assert not passed(reconcile.provenance_audit(run.ledger.filter(F.col("key") != key)))["(h)"]


def test_wrong_rate_breaks_reconstruction(run):
    assert passed(readout.driver_reconstruction(run.drivers))["(n)"]
    drifted = readout.drivers(change(run.ledger, "costing/labour", 0.01), run.params)
    assert not passed(readout.driver_reconstruction(drifted))["(n)"]
    dropped = readout.drivers(run.ledger.filter("key <> 'costing/labour'"), run.params)
    assert not passed(readout.driver_reconstruction(dropped))["(n)"]


def test_containment_and_its_failures(run):
    grid = run.grid
    assert passed(whatif.forecast_containment(grid))["(o)"]
    off = F.col("factor") == 1.2
    for column, value in (("labour", F.col("labour") + 0.01), ("total_cost", F.col("total_cost") + 0.01), ("identities_passed", F.lit(12))):
        bad = grid.withColumn(column, F.when(off, value).otherwise(F.col(column)))
        row = whatif.forecast_containment(bad).first()
        assert not row.passed and "x1.20" in row.note


def allocation(run, frame=None, per_item=None):
    return reconcile.allocation(run.economics if frame is None else frame, run.per_item if per_item is None else per_item,
                                run.ledger_lines, run.log).first()


def test_allocation_and_its_failures(run):
    frame = run.economics
    assert allocation(run).passed
    first = frame.select("invoice").orderBy("invoice").first()[0]
    hit = F.col("invoice") == first
    cases = {
        "lost": frame.filter(~hit),
        "phantom": frame.union(frame.filter(hit).withColumn("invoice", F.lit("PHANTOM-1"))),
        "repeated": frame.union(frame.filter(hit)),
        "transport": frame.withColumn("transport_cost", F.col("transport_cost") + F.when(hit, 0.02).otherwise(0.0)),
        "undefined revenue": frame.withColumn("revenue", F.when(~hit, F.col("revenue"))),
    }
    for word, bad in cases.items():
        row = allocation(run, bad)
        assert not row.passed and word in row.note, word
    nan = frame.withColumn("revenue", F.when(hit, float("nan")).otherwise(F.col("revenue")))
    assert "undefined revenue" in allocation(run, nan).note
    more = run.per_item.withColumn("holding_cost", F.col("holding_cost") + 1.0)
    assert "holding" in allocation(run, per_item=more).note


def test_allocations_add_up_to_the_lines(run):
    lines = {r.item: r.gbp for r in run.ledger_lines.collect()}
    sums = run.per_invoice.agg(*[F.sum(c).alias(c) for c in ("revenue", "labour_cost", "transport_cost", "facility_cost")]).first()
    assert sums.labour_cost == pytest.approx(lines["labour"], abs=0.005)
    assert sums.transport_cost == pytest.approx(lines["transport"], abs=0.005)
    assert sums.facility_cost == pytest.approx(lines["facility"], abs=0.005)
    assert sums.revenue == pytest.approx(lines["window revenue"], abs=0.005)


def test_surge_moves_only_holding_and_leaves_inputs_alone(run):
    before = sorted(map(tuple, run.forecasts.collect()))
    deltas = {(r.scenario_id, r.metric): r for r in whatif.deltas(run.shocks.costs, run.shocks.forecasts).collect()}
    assert deltas["class surge", "holding cost"].delta > 0
    for still in ("labour cost", "transport cost", "facility cost", "window revenue", "route km"):
        assert deltas["class surge", still].delta == 0
    assert deltas["transport rate", "transport cost"].pct == pytest.approx(10.0)
    assert deltas["transport rate", "holding cost"].delta == 0
    assert sorted(map(tuple, run.forecasts.collect())) == before
    assert reconcile.verdict(run.shocks.checks).filter("NOT all_passed").count() == 0


# ---- receipts
def test_receipt_round_trip_and_difference(run, tmp_path):
    folder = str(tmp_path)
    receipts.write_run(folder, "a", {"ledger": run.ledger})
    receipts.write_run(folder, "b", {"ledger": change(run.ledger, "costing/labour", 1.0)})
    receipts.write_run(folder, "a", {"ledger": run.ledger})  # a repeat replaces only its own partition
    a, b = (receipts.read_run(run.spark, folder, "ledger", k) for k in "ab")
    assert a.count() == run.ledger.count() == b.count()
    assert receipts.run_diff(a, run.ledger, ["scenario_id", "key"]).count() == 0
    diff = receipts.run_diff(a, b, ["scenario_id", "key"]).collect()
    assert [(r.key, r.difference) for r in diff] == [("costing/labour", "changed")]


def test_unknown_receipt_version_is_rejected(run, tmp_path, monkeypatch):
    monkeypatch.setattr(receipts, "SCHEMA_VERSION", "2.0")
    receipts.write_run(str(tmp_path), "a", {"ledger": run.ledger})
    monkeypatch.setattr(receipts, "SCHEMA_VERSION", "1.0")
    with pytest.raises(Exception, match="unknown receipt version 2.0"):
        receipts.read_run(run.spark, str(tmp_path), "ledger", "a").collect()
    for read in (lambda df: df.select("key", "value").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="unknown receipt version 2.0"):
            read(receipts.read_run(run.spark, str(tmp_path), "ledger", "a"))


def test_run_ids_stay_text(run, tmp_path):
    receipts.write_run(str(tmp_path), "20260101", {"checks": run.checks})
    stored = receipts.read_run(run.spark, str(tmp_path), "checks", "20260101")
    assert dict(stored.dtypes)["run_id"] == "string" and stored.first().run_id == "20260101"


def test_a_run_cut_short_is_not_seen(run, tmp_path):
    folder, spark = str(tmp_path), run.spark
    receipts.write_run(folder, "a", {"ledger": run.ledger, "checks": run.checks})
    broken = run.checks.withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        receipts.write_run(folder, "a", {"ledger": change(run.ledger, "costing/labour", 1.0), "checks": broken})
    seen = receipts.read_run(spark, folder, "ledger", "a")
    assert receipts.run_diff(seen, run.ledger, ["scenario_id", "key"]).count() == 0
    with pytest.raises(LookupError):
        receipts.read_run(spark, folder, "ledger", "b")
    assert receipts.run_tables(spark, folder, "a") == ["checks", "ledger"]


def test_equal_receipts_are_read_once(run, tmp_path):
    folder, spark = str(tmp_path), run.spark
    for k in "ab":
        receipts.write_run(folder, k, {"demand": run.demand})
    a, b = (receipts.read_run(spark, folder, "demand", k) for k in "ab")
    same = receipts.run_diff(a, b, ["stock_code", "week"])
    assert "FileScan" not in same._jdf.queryExecution().executedPlan().toString() and same.count() == 0
    item = run.demand.first()
    moved = b.withColumn("units", F.when((F.col("stock_code") == item.stock_code) & (F.col("week") == item.week), -1).otherwise(F.col("units")))
    buckets = receipts.differing(a, moved, ["stock_code", "week"], ["units"])
    assert len(buckets) == 1
    (row,) = receipts.run_diff(a, moved, ["stock_code", "week"]).collect()
    assert (row.stock_code, row.week, row.difference) == (item.stock_code, item.week, "changed")


def test_nulls_differ_from_values_and_repeats_count(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, x int, y int")
    diff = lambda a, b: sorted(r.difference for r in receipts.run_diff(a, b, ["k"]).collect())
    assert diff(rows((1, None, 5)), rows((1, 5, None))) == ["changed"]
    assert diff(rows((1, None, None)), rows((1, None, None))) == []
    assert diff(rows((1, 2, 3), (2, 2, 3)), rows((2, 2, 3), (3, 1, 1))) == ["only left", "only right"]
    assert diff(rows(), rows()) == [] and diff(rows(), rows((1, 1, 1))) == ["only right"]


def test_saved_run_is_read_and_not_worked_out(run, tmp_path):
    run.save(str(tmp_path), "day")
    again = type(run).load(run.txn.limit(0), str(tmp_path), "day", run.params, run.models)
    assert sorted(map(tuple, again.checks.collect()), key=str) == sorted(map(tuple, run.checks.collect()), key=str)
    assert sorted(map(tuple, again.plan.collect())) == sorted(map(tuple, run.plan.collect()))
