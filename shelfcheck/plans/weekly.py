"""Weekly rejection analytics over exported decision reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcheck.constants import WEEK_DAYS
from shelfcheck.session import materialize
from shelfcheck.sources.rules import small_table

STATUS_NAMES = ["Status", "STATUS", "status", "LISTING_STATUS"]
SELLER_NAMES = ["SellerName", "SELLER_NAME", "seller_name", "Seller"]
FLAG_NAMES = ["FLAG", "Flag", "flag", "Reason"]
CATEGORY_NAMES = ["CATEGORY", "Category", "category"]


def pick(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def statuses_of(df: DataFrame, status: str) -> list[str]:
    """Distinct statuses, the columns of a pivot."""
    return sorted(r[0] for r in df.select(status).filter(F.col(status).isNotNull()).distinct().collect())


def _counted(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows by the given columns as a table: several branches read it, the rows themselves are read once."""
    return materialize(df.groupBy(*cols).agg(F.count("*").alias("_n")), "counted")


def daily_summary(df: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Week day x status with all seven days, a daily total, and a weekly total row."""
    status = pick(df, STATUS_NAMES)
    counted = _counted(df, ["Day", status])
    statuses = statuses or statuses_of(counted, status)
    counts = [F.sum(F.when(F.col(status) == s, F.col("_n"))).alias(s) for s in statuses]
    days = small_table(df.sparkSession, list(enumerate(WEEK_DAYS)), "pos int, Day string")
    per_day = counted.groupBy("Day").agg(*counts)
    full = days.join(per_day, "Day", "left").select(
        "pos", "Day", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in statuses]
    )
    total = sum((F.col(s) for s in statuses), F.lit(0))
    rows = full.withColumn("Daily Total", total)
    week = rows.agg(*[F.sum(c).alias(c) for c in [*statuses, "Daily Total"]]).select(
        F.lit(7).alias("pos"), F.lit("Weekly Total").alias("Day"), *statuses, "Daily Total"
    )
    return rows.unionByName(week).orderBy("pos").drop("pos")


def seller_stats(df: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Seller x status, total submitted, rejection rate to one decimal."""
    status, seller = pick(df, STATUS_NAMES), pick(df, SELLER_NAMES)
    statuses = statuses or statuses_of(df, status)
    shown = statuses if "Rejected" in statuses else [*statuses, "Rejected"]
    rows = df.filter(F.col(seller).isNotNull() & F.col(status).isNotNull()).groupBy(
        F.col(seller).alias("Seller")
    ).agg(*[F.count_if(F.col(status) == s).alias(s) for s in shown], F.count("*").alias("Total Submitted"))
    return rows.withColumn(
        "Rejection Rate (%)", F.bround(F.col("Rejected") / F.col("Total Submitted") * 100, 1)
    )


def trend(df: DataFrame) -> DataFrame:
    status = pick(df, STATUS_NAMES)
    return df.groupBy("Date", F.col(status).alias("Status")).agg(F.count("*").alias("Count"))


def rejected_counts(df: DataFrame, names: list[str], label: str, counted: bool = False) -> DataFrame:
    """Value counts among rejected rows, or among ``_counted`` ones."""
    status, column = pick(df, STATUS_NAMES), pick(df, names)
    return df.filter((F.col(status) == "Rejected") & F.col(column).isNotNull()).groupBy(
        F.col(column).alias(label)
    ).agg((F.sum("_n") if counted else F.count("*")).alias("Rejected Count"))


def reason_counts(df: DataFrame) -> DataFrame:
    return rejected_counts(df, FLAG_NAMES, "Reason")


def category_counts(df: DataFrame) -> DataFrame:
    return rejected_counts(df, CATEGORY_NAMES, "Category")


def top_rejected(counts: DataFrame, label: str, k: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("Rejected Count"), F.asc(label)).limit(k)


def top_sellers(stats: DataFrame, k: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("Rejected"), F.asc("Seller")).limit(k)


def insights(df: DataFrame) -> DataFrame:
    """One row: totals, rate, verdict, leading reason and share, worst seller, busiest day."""
    status, seller, flag = pick(df, STATUS_NAMES), pick(df, SELLER_NAMES), pick(df, FLAG_NAMES)
    rows = _counted(df, list(dict.fromkeys(["Day", *[c for c in (status, flag, seller) if c]])))
    sized = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0))
    totals = rows.agg(
        sized(F.col(status).isNotNull()).alias("total"), sized(F.col(status) == "Approved").alias("approved"),
        sized(F.col(status) == "Rejected").alias("rejected"),
    ).withColumn("rejection_rate", F.coalesce(F.try_divide(F.col("rejected") * 100.0, F.col("total")), F.lit(0.0)))
    totals = totals.withColumn(
        "verdict", F.when(F.col("rejection_rate") > 20, "action required").when(F.col("rejection_rate") > 0, "healthy")
    )
    days = small_table(df.sparkSession, list(enumerate(WEEK_DAYS)), "pos int, Day string")
    busiest = rows.filter(F.col(status).isNotNull()).groupBy("Day").agg(F.sum("_n").alias("n")).join(days, "Day").agg(
        F.max_by("Day", F.struct("n", -F.col("pos"))).alias("busiest_day")
    )
    # Each side below is a single row; the constant key only lines them up.
    one = lambda side: side.withColumn("_one", F.lit(1))
    out = one(totals).join(one(busiest), "_one")
    if flag:
        first = top_rejected(rejected_counts(rows, [flag], "Reason", True), "Reason", 1).select(
            F.col("Reason").alias("top_reason"), F.col("Rejected Count").alias("top_reason_count")
        )
        out = out.join(one(first), "_one", "left").withColumn(
            "top_reason_share", F.try_divide(F.col("top_reason_count") * 100.0, F.col("rejected"))
        )
    if seller:
        worst = top_rejected(rejected_counts(rows, [seller], "Seller", True), "Seller", 1).select(
            F.col("Seller").alias("worst_seller"), F.col("Rejected Count").alias("worst_seller_rejected")
        )
        out = out.join(one(worst), "_one", "left")
    return out.drop("_one")


def cover_metrics(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cover sheet (metric, value): country and week of the first file, totals, rate."""
    status = pick(df, STATUS_NAMES)
    row = df.agg(
        F.min_by("Country", "Date").alias("country"), F.weekofyear(F.min("Date")).alias("week"),
        F.count(status).alias("total"), F.count_if(F.col(status) == "Approved").alias("approved"),
        F.count_if(F.col(status) == "Rejected").alias("rejected"),
        (F.lit(files) if files is not None else F.count_distinct("Date")).cast("long").alias("files"),
    )
    rate = F.coalesce(F.try_divide(F.col("rejected") * 100.0, F.col("total")), F.lit(0.0))
    pairs = [
        ("Country / Region", F.col("country")), ("Reporting Week", F.concat(F.lit("Week "), F.col("week").cast("string"))),
        ("Total Files/Parts Merged", F.col("files").cast("string")), ("Total Products Processed", F.col("total").cast("string")),
        ("Total Approved", F.col("approved").cast("string")), ("Total Rejected", F.col("rejected").cast("string")),
        ("Overall Rejection Rate", F.concat(F.format_number(rate, 1), F.lit("%"))),
    ]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("Metric"), v.alias("Value")) for n, v in pairs
    ])))


def weekly_report(df: DataFrame) -> dict[str, DataFrame]:
    """The five tables of the executive report."""
    statuses = statuses_of(df, pick(df, STATUS_NAMES))
    return {
        "cover": cover_metrics(df),
        "daily_summary": daily_summary(df, statuses),
        "seller_stats": seller_stats(df, statuses),
        "reasons": reason_counts(df),
        "top_categories": top_rejected(category_counts(df), "Category"),
    }
