"""Business-day calendar (C1), day counts (C2) and dates outside the calendar.

The calendar has one row per day between the first and the last date of the
data or of the holiday table (about 11 k rows for 30 years) and is broadcast to
every join: a century is 36,525 rows. The cumulative count turns "business days
in (a, b]" into one subtraction. Holidays are a table (``data``); without one,
the rows that the source application is seeded with. As the calendar covers all
holidays, days outside it are business days by weekday alone, and their count
has a closed form: no day list is made for any row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K


def build_calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """(data, dia_util, du_acumulado, ultimo_du) for every day in [start, end], widened to the first and last holiday.

    ``ultimo_du`` is the last business day on or before ``data``.
    """
    if holidays is None:
        holidays = spark.createDataFrame([(x,) for x in K.SEEDED_HOLIDAYS], "d string").select(F.col("d").cast("date").alias("data"))
    off = holidays.select(F.col("data").cast("date").alias("_off")).distinct()
    ends = off.agg(F.least(F.lit(start).cast("date"), F.min("_off")).alias("a"), F.greatest(F.lit(end).cast("date"), F.max("_off")).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("data"))
    # single ordered pass over a bounded day range (not over the data)
    w = Window.orderBy("data").rowsBetween(Window.unboundedPreceding, 0)
    return (
        days.join(off, F.col("data") == F.col("_off"), "left")
        .withColumn("dia_util", ~F.dayofweek("data").isin(1, 7) & F.col("_off").isNull()).drop("_off")
        .withColumn("du_acumulado", F.sum(F.col("dia_util").cast("int")).over(w).cast("int"))
        .withColumn("ultimo_du", F.max(F.when(F.col("dia_util"), F.col("data"))).over(w))
    )


def date_range(*columns: tuple[DataFrame, str]) -> tuple[str, str]:
    """First and last date of several columns, as text: what a calendar has to cover (one row reaches the driver)."""
    ends = [df.agg(F.min(c).cast("date").alias("a"), F.max(c).cast("date").alias("b")).first() for df, c in columns]
    first, last = [r["a"] for r in ends if r["a"]], [r["b"] for r in ends if r["b"]]
    if not first:
        return "1970-01-01", "1970-01-31"  # no dates: any month will do
    return min(first).isoformat(), max(last).isoformat()


MONDAY = "1969-12-29"


def weekdays_until(d: Column) -> Column:
    """Weekdays (Monday to Friday) since a Monday in 1969, ``d`` included; negative before it."""
    n = F.datediff(d, F.lit(MONDAY).cast("date")) + 1
    return F.floor(n / 7) * 5 + F.least(F.lit(5), F.pmod(n, F.lit(7)))


def calendar_ends(calendar: DataFrame) -> Column:
    """First and last day of the calendar and its last cumulative count: a scalar subquery, computed once a query."""
    return calendar.agg(F.struct(F.min("data").alias("first"), F.max("data").alias("last"), F.max("du_acumulado").alias("total")).alias("ends")).scalar()


def business_day_number(d: Column, du: Column, ends: Column) -> Column:
    """The cumulative count at any day: the calendar's (``du``), or beyond its ends carried on by weekdays."""
    after = ends["total"] + weekdays_until(d) - weekdays_until(ends["last"])
    before = weekdays_until(d) - weekdays_until(F.date_sub(ends["first"], 1))
    return F.coalesce(du.cast("long"), F.when(d > ends["last"], after).otherwise(before))


def with_business_days(df: DataFrame, d_ini: str, d_fim: str, out: str, calendar: DataFrame,
                       floor_zero: bool = True) -> DataFrame:
    """Add ``out`` = business days in (d_ini, d_fim] via two calendar lookups; null where a date is null."""
    a = F.broadcast(calendar.select(F.col("data").alias("_ci_d"), F.col("du_acumulado").alias("_ci_c")))
    b = F.broadcast(calendar.select(F.col("data").alias("_cf_d"), F.col("du_acumulado").alias("_cf_c")))
    ends = calendar_ends(calendar)
    diff = business_day_number(F.col(d_fim), F.col("_cf_c"), ends) - business_day_number(F.col(d_ini), F.col("_ci_c"), ends)
    if floor_zero:
        diff = F.when(diff.isNotNull(), F.greatest(diff, F.lit(0)))  # greatest() skips nulls
    return (
        df.join(a, F.col(d_ini) == F.col("_ci_d"), "left")
        .join(b, F.col(d_fim) == F.col("_cf_d"), "left")
        .withColumn(out, diff.cast("int"))
        .drop("_ci_d", "_ci_c", "_cf_d", "_cf_c")
    )
