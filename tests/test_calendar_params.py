import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from recvfund import constants as K
from recvfund.functions.calendar import build_calendar, with_business_days
from recvfund.functions.params import param_asof, pdd_pct_expr, with_pdd_pct
from recvfund.sources.fixtures import faixas_pdd

HOL = {date.fromisoformat(d) for d in K.SEEDED_HOLIDAYS}


def py_business_days(a: date, b: date) -> int:
    n, d = 0, a + timedelta(days=1)
    while d <= b:
        if d.weekday() < 5 and d not in HOL:
            n += 1
        d += timedelta(days=1)
    return n


def test_business_days_match_enumeration(spark):
    cal = build_calendar(spark, "2025-01-01", "2027-12-31")
    pairs = [("2026-07-23", "2026-08-22"), ("2026-07-24", "2026-07-24"), ("2026-07-25", "2026-07-27"),
             ("2026-04-02", "2026-04-06"), ("2026-12-24", "2027-01-04"), ("2026-08-01", "2026-07-01")]
    df = spark.createDataFrame([(date.fromisoformat(a), date.fromisoformat(b)) for a, b in pairs], "a date, b date")
    got = {(r.a, r.b): r.n for r in with_business_days(df, "a", "b", "n", cal).collect()}
    for (a, b), n in got.items():
        assert n == max(py_business_days(a, b), 0), (a, b)


def test_fallback_outside_calendar(spark):
    cal = build_calendar(spark, "2026-01-01", "2026-01-31")
    df = spark.createDataFrame([(date(2026, 7, 23), date(2026, 8, 22))], "a date, b date")
    assert with_business_days(df, "a", "b", "n", cal).first().n == py_business_days(date(2026, 7, 23), date(2026, 8, 22))


def test_pdd_bands(spark):
    days = [0, 14, 15, 30, 31, 60, 61, 90, 91, 120, 121, 150, 151, 180, 181, 999]
    expect = ["0", "0", "0.01", "0.01", "0.03", "0.03", "0.10", "0.10", "0.30", "0.30", "0.50", "0.50", "0.70",
              "0.70", "1.00", "1.00"]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    joined = {r.d: r.p for r in with_pdd_pct(df, "d", faixas_pdd(spark), "p").collect()}
    unrolled = {r.d: r.p for r in df.select("d", pdd_pct_expr(F.col("d")).alias("p")).collect()}
    for d, e in zip(days, expect):
        assert joined[d] == Decimal(e) and unrolled[d] == Decimal(e), d


def test_param_asof_latest_open_period(spark):
    params = spark.createDataFrame(
        [("c", date(2020, 1, 1), date(2020, 12, 31), Decimal("1.5")), ("c", date(2021, 1, 1), None, Decimal("2.0")),
         ("c", date(2021, 6, 1), date(2021, 6, 30), Decimal("3.0"))],
        "classe_id string, vigencia_inicio date, vigencia_fim date, taxa_administracao_aa decimal(9,6)")
    keys = spark.createDataFrame([("c", date(2019, 5, 1)), ("c", date(2020, 5, 1)), ("c", date(2021, 6, 15)),
                                  ("c", date(2021, 7, 15)), ("x", date(2021, 1, 1))], "classe_id string, data date")
    got = {(r.classe_id, r.data): r.taxa_administracao_aa for r in param_asof(keys, params).collect()}
    assert got[("c", date(2019, 5, 1))] == 0
    assert got[("c", date(2020, 5, 1))] == Decimal("1.5")
    assert got[("c", date(2021, 6, 15))] == Decimal("3.0")
    assert got[("c", date(2021, 7, 15))] == Decimal("2.0")
    assert got[("x", date(2021, 1, 1))] == 0


def test_days_outside_the_calendar_keep_its_holidays(spark):
    table = spark.createDataFrame([(date(2026, 6, 10),), (date(2026, 6, 13),), (date(2027, 1, 4),)], "data date")  # the second is a Saturday
    off = {date(2026, 6, 10), date(2027, 1, 4)}
    cal = build_calendar(spark, "2026-01-01", "2026-01-31", table)
    rng = random.Random(9)
    pairs = [(date(2026, 6, 9), date(2026, 7, 1)), (date(2026, 1, 1), date(2026, 1, 2)), (date(1968, 3, 1), date(1970, 1, 5)), (date(2025, 12, 31), date(2027, 1, 5))]
    pairs += [(a := date(1995, 1, 1) + timedelta(rng.randint(0, 15000)), a + timedelta(rng.randint(-20, 900))) for _ in range(150)]
    df = spark.createDataFrame([(a, b) for a, b in pairs] + [(None, date(2026, 1, 5))], "a date, b date")
    got = {(r.a, r.b): r.n for r in with_business_days(df, "a", "b", "n", cal).collect()}
    for a, b in pairs:
        days = (a + timedelta(k) for k in range(1, (b - a).days + 1))
        assert got[a, b] == sum(d.weekday() < 5 and d not in off for d in days), (a, b)
    assert got[pairs[0]] == 15 and got[None, date(2026, 1, 5)] is None
