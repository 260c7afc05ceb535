"""Exact duplicates by digests: the same rows as grouping whole lines, and only repeated lines shuffled whole."""

from collections import Counter

import pytest

from orderloom.operators import clean
from orderloom.params import Params
from orderloom.plans.run import Run
from orderloom.sources.stage import StageTables
from orderloom.sources.transactions import COLUMNS

TXN = (
    "invoice string, stock_code string, description string, quantity bigint, invoice_ts timestamp_ntz, "
    "price double, customer_id bigint, country string, source string"
)


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS, "copies").collect())


def lines(spark, n=400):
    made = [(f"i{k}", "a", None if k % 5 else "d", k % 3, None, float(k % 7), None if k % 2 else k, "x", f"f{k % 4}") for k in range(n)]
    made += made[:30] * 3 + [made[0]] * 200  # repeats, a third of the rows of one line
    made += [(None,) * 9, (None,) * 9, ("z", "a", None, 1, None, 0.0, 1, "x", "f"), ("z", "a", None, 1, None, -0.0, 1, "x", "f")]
    # a hash passes nulls over, so these two share a digest and are no copies
    made += [("w", None, "v", 1, None, 1.0, 1, "x", "f"), ("w", "v", None, 1, None, 1.0, 1, "x", "f")]
    return spark.createDataFrame(made, TXN).repartition(7)


@pytest.mark.parametrize("most", [0, 1, clean.MOST_DIGESTS])
def test_same_rows_as_grouping(spark, most):
    txn = lines(spark)
    got = rows(clean.distinct_by_digest(txn, StageTables(spark), most))
    assert got == rows(clean.drop_exact_duplicates(txn)) and max(got.values()) == 1
    assert rows(clean.distinct_by_digest(txn.limit(0), StageTables(spark), most)) == Counter()


def test_single_lines_are_not_shuffled(spark):
    txn = StageTables(spark).keep("lines", lines(spark))
    df = clean.distinct_by_digest(txn, StageTables(spark))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    once, again = plan.split("LeftAnti")[0], plan.split("LeftAnti")[1]
    assert "Exchange hashpartitioning" not in once and "hashpartitioning" in again


def test_a_run_cleans_alike(run):
    other = Run(run.txn, Params(mostly_unique=True), run.models)
    assert rows(other.classified) == rows(run.classified)
    other.close()
