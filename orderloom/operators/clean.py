"""Stage 0a: cleaning of invoice lines, with one log row per step."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.expr import is_cancelled, is_non_product, money
from orderloom.sources.stage import StageTables
from orderloom.sources.transactions import COLUMNS

MOST_DIGESTS = 500_000  # digests of repeated lines, 8 bytes each, that are broadcast


class Cleaned(NamedTuple):
    sales: DataFrame
    returns: DataFrame
    log: DataFrame


CANCELLED, NON_PRODUCT, NO_PRICE, NO_QUANTITY, KEPT = 2, 3, 4, 5, 6


def drop_exact_duplicates(txn: DataFrame) -> DataFrame:
    """One row per distinct line (NULLs equal) with its number of copies.

    Copies collapse on the map side before the shuffle. The source file is not carried along: a line
    may come from several files, and a minimum over text would make Spark sort instead of hash.
    """
    return txn.groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("copies"))


def distinct_by_digest(txn: DataFrame, stage: StageTables, most: int = MOST_DIGESTS) -> DataFrame:
    """The rows of :func:`drop_exact_duplicates` for lines that mostly occur once: only repeated lines are shuffled whole.

    A 64-bit digest per line is counted first. Lines whose digest occurs once pass where they are; the others, among them
    different lines that share a digest, are grouped by all their columns. With more than ``most`` repeated digests, too many
    to broadcast, all lines are. The lines are read three times, so their source should be stored.
    """
    digest = F.xxhash64(*COLUMNS)
    counted = txn.select(digest.alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    repeated = stage.keep("repeated_digests", counted.filter("_n > 1").select("_digest"))
    if repeated.count() > most:
        return drop_exact_duplicates(txn)
    marked, again = txn.select(*COLUMNS, digest.alias("_digest")), F.broadcast(repeated)
    once = marked.join(again, "_digest", "left_anti").select(*COLUMNS, F.lit(1).cast("long").alias("copies"))
    return once.unionByName(drop_exact_duplicates(marked.join(again, "_digest", "left_semi")))


def with_derived(df: DataFrame) -> DataFrame:
    revenue = money(F.col("quantity") * F.col("price"))
    return (
        df.withColumn("revenue", revenue)
        .withColumn("date", F.to_date("invoice_ts"))
        .withColumn("iso_year", F.extract(F.lit("YEAROFWEEK"), F.col("invoice_ts")).cast("int"))
        .withColumn("iso_week", F.weekofyear("invoice_ts"))
    )


def classified(txn: DataFrame) -> DataFrame:
    return with_step(drop_exact_duplicates(txn))


def with_step(distinct: DataFrame) -> DataFrame:
    """Distinct lines with ``copies`` and ``step_no``: the first cleaning step that takes the line out of sales.

    Sales, returns and the log are all read from this one frame, so the lines are shuffled once.
    """
    step = (
        F.when(is_cancelled(F.col("invoice")), CANCELLED)
        .when(is_non_product(F.col("stock_code")), NON_PRODUCT)
        .when(~F.coalesce(F.col("price") > 0, F.lit(False)), NO_PRICE)
        .when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), NO_QUANTITY)
        .otherwise(KEPT)
    )
    return distinct.withColumn("step_no", step)


def sales_of(lines: DataFrame) -> DataFrame:
    """Product sales with a price and a quantity; unknown customers are flagged and kept."""
    kept = lines.filter(F.col("step_no") == KEPT).drop("copies", "step_no")
    return with_derived(kept.withColumn("known_customer", F.col("customer_id").isNotNull()))


def returns_of(lines: DataFrame) -> DataFrame:
    """Cancelled product lines; price and quantity are deliberately not filtered."""
    kept = lines.filter(F.col("step_no") == CANCELLED).filter(~is_non_product(F.col("stock_code")))
    return with_derived(kept.drop("copies", "step_no"))


def log_of(lines: DataFrame) -> DataFrame:
    """Rows in, out and removed per cleaning step, from one aggregate."""
    counts = lines.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n0"),
        F.count(F.lit(1)).alias("n1"),
        *[F.count_if(F.col("step_no") > k).alias(f"n{k}") for k in (CANCELLED, NON_PRODUCT, NO_PRICE, NO_QUANTITY)],
        F.count_if((F.col("step_no") == KEPT) & F.col("customer_id").isNull()).alias("unknown"),
    )
    flagged = F.concat(F.format_number("unknown", 0), F.lit(" lines without a customer stay in sales"))
    steps = [
        ("collapse repeated lines", "n0", "n1", F.lit("every input field the same")),
        ("set returns apart", "n1", "n2", F.lit("a table of their own, no sales")),
        ("leave out codes that are no goods", "n2", "n3", F.lit("listed service codes and gift vouchers")),
        ("leave out lines without a price", "n3", "n4", F.lit("nothing was charged")),
        ("leave out lines without units", "n4", "n5", F.lit("stock corrections that are no returns")),
        ("count unnamed customers", "n5", "n5", flagged),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_no"),
                F.lit(name).alias("step"),
                F.col(before).alias("rows_in"),
                F.col(after).alias("rows_out"),
                (F.col(before) - F.col(after)).alias("rows_removed"),
                F.when(F.col(before) > 0, (F.col(before) - F.col(after)) / F.col(before))
                .otherwise(0.0)
                .alias("pct_removed"),
                note.alias("note"),
            )
            for i, (name, before, after, note) in enumerate(steps, start=1)
        ]
    )
    return counts.select(F.inline(rows))


def sales_lines(txn: DataFrame) -> DataFrame:
    return sales_of(classified(txn))


def return_lines(txn: DataFrame) -> DataFrame:
    return returns_of(classified(txn))


def cleaning_log(txn: DataFrame) -> DataFrame:
    return log_of(classified(txn))


def clean(txn: DataFrame) -> Cleaned:
    return Cleaned(sales_lines(txn), return_lines(txn), cleaning_log(txn))
