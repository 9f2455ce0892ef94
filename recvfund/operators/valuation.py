"""Receivable valuation: accrual mark, arrears, provision, class totals.

Two shapes:

* ``mark_titles_at``: every eligible title at one date (title-level report).
* ``class_marking``: class totals for a whole grid of (class, date) closes in
  one job. Exploding titles x dates is avoided: a title's present value only
  varies while it is performing (acquisition <= d < last business day up to
  maturity), so only those (title, date) pairs are generated; after that every
  quantity is a step function of the date (face value, overdue face value,
  7 provision thresholds). Steps are emitted as ~10 delta rows per title,
  pre-aggregated per (class, date) and turned into balances by one running sum
  per class over at most one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import business_day_number, calendar_ends, with_business_days
from ..functions.params import PCT, band_list, band_rows, with_pdd_pct

MONEY = T.DecimalType(20, 2)


def accrual_value(vf: Column, va: Column, du_rem: Column, du_total: Column) -> Column:
    """M3: VF / (VF/VA)^(du_rem/du_total), rounded to cents; VF once nothing remains."""
    vfd, vad = vf.cast("double"), va.cast("double")
    curve = (vfd / F.pow(vfd / vad, du_rem.cast("double") / du_total.cast("double"))).cast(MONEY)
    return F.when((du_rem <= 0) | (du_total <= 0), vf.cast(MONEY)).otherwise(curve)


def eligible(titles: DataFrame) -> DataFrame:
    """M1: titles whose current status is ATIVO (status is current, not as-of)."""
    if "situacao" in titles.columns:
        return titles.where(F.col("situacao") == "ATIVO")
    return titles


def _mark(t: DataFrame, calendar: DataFrame, bands: DataFrame) -> DataFrame:
    """M2-M6 for titles carrying their own ``data_referencia``."""
    d = F.col("data_referencia")
    t = with_business_days(t, "data_aquisicao", "data_vencimento", "du_total", calendar, floor_zero=False)
    t = with_business_days(t, "data_referencia", "data_vencimento", "du_rem", calendar, floor_zero=False)
    t = t.withColumn("dias_atraso", F.greatest(F.datediff(d, F.col("data_vencimento")), F.lit(0)))
    t = with_pdd_pct(t, "dias_atraso", bands, "pct_pdd")
    overdue = F.col("dias_atraso") > 0
    return (
        t.withColumn("valor_presente", accrual_value(F.col("valor_face"), F.col("valor_aquisicao"),
                                                     F.col("du_rem"), F.col("du_total")))
        .withColumn("pdd", F.when(overdue, F.round(F.col("valor_face") * F.col("pct_pdd"), 2))
                    .otherwise(F.lit(0)).cast(MONEY))
        .withColumn("a_receber", F.when(overdue, F.col("valor_face")).otherwise(F.lit(0)).cast(MONEY))
    )


def mark_titles_at(titles: DataFrame, ref_date: str, calendar: DataFrame, bands: DataFrame) -> DataFrame:
    """M1-M6 at one date for every eligible title acquired on or before it."""
    d = F.lit(ref_date).cast("date")
    t = eligible(titles).where(F.col("data_aquisicao") <= d).withColumn("data_referencia", d)
    return _mark(t, calendar, bands)


def mark_titles_for(titles: DataFrame, class_dates: DataFrame, calendar: DataFrame, bands: DataFrame) -> DataFrame:
    """M1-M6 with one reference date per class (``class_dates``: classe_id, data_referencia;
    one row per class; Spark broadcasts it only below its own size limit)."""
    t = (
        eligible(titles).join(class_dates.select("classe_id", "data_referencia"), "classe_id")
        .where(F.col("data_aquisicao") <= F.col("data_referencia"))
    )
    return _mark(t, calendar, bands)


def _grid_index(grid_dates: DataFrame, calendar: DataFrame):
    """Number the close dates and, for every calendar day, count close dates before it."""
    # both windows run over bounded inputs: close dates and calendar days
    gi = grid_dates.distinct().withColumn("gidx", F.row_number().over(Window.orderBy("data")) - 1)
    before = Window.orderBy("data").rowsBetween(Window.unboundedPreceding, -1)
    cal = (
        calendar.join(F.broadcast(gi), "data", "left")
        .withColumn("g_before", F.coalesce(F.count("gidx").over(before), F.lit(0)))
        .select("data", "du_acumulado", "ultimo_du", "g_before", "gidx")
    )
    # close dates with their cumulative business-day count: one lookup per exploded row
    gi = cal.where(F.col("gidx").isNotNull()).select("gidx", "data", F.col("du_acumulado").alias("_cd"))
    return gi, cal.drop("gidx")


def class_marking(titles: DataFrame, grid: DataFrame, calendar: DataFrame, bands: DataFrame | None = None,
                  leaving: str | None = None) -> DataFrame:
    """M7 over a grid: (classe_id, data) -> qtd_ativos, valor_presente, pdd, a_receber.

    ``grid`` holds the (classe_id, data) pairs to close (classes x close dates,
    small; within the calendar). Titles acquired after the last close date are
    not read further; dates of titles outside the calendar count as C3 does.
    ``bands``: the provision bands table (7 rows, read once).

    Status is current, unless ``leaving`` names the column with the day from
    which a title is no longer active (null: it stays; see
    ``ledger.title_leaving``). Then a title counts at a close date before that
    day: its steps that start earlier are taken back on that day, and its curve
    ends there.
    """
    steps_of = band_list(None if bands is None else band_rows(bands))
    last = grid.agg(F.max("data").alias("d")).first()["d"]
    gi, cal = _grid_index(grid.select("data"), calendar)
    cal_b = F.broadcast(cal)
    leaves = F.lit(None).cast("date") if leaving is None else F.col(leaving).cast("date")
    t = (eligible(titles) if leaving is None else titles).select("classe_id", "data_aquisicao", "data_vencimento", "valor_face", "valor_aquisicao", leaves.alias("_l"))
    t = t.where((F.col("data_aquisicao") <= F.lit(last)) & (F.col("_l").isNull() | (F.col("_l") > F.col("data_aquisicao"))))
    ends = calendar_ends(calendar)
    n_closes = grid.agg(F.countDistinct("data")).scalar()

    def closes_before(looked_up: Column, day: Column) -> Column:
        return F.coalesce(looked_up, F.when(day > ends["last"], n_closes).otherwise(F.lit(0)))

    ca = cal_b.select(F.col("data").alias("_a"), F.col("du_acumulado").alias("_ca"), F.col("g_before").alias("_lo"))
    cv = cal_b.select(F.col("data").alias("_v"), F.col("du_acumulado").alias("_cv"), F.col("ultimo_du").alias("_b"))
    cb = cal_b.select(F.col("data").alias("_bd"), F.col("g_before").alias("_hi"))
    t = (
        t.join(ca, F.col("data_aquisicao") == F.col("_a"), "left")
        .join(cv, F.col("data_vencimento") == F.col("_v"), "left")
        .join(cb, F.col("_b") == F.col("_bd"), "left")
        .withColumns({
            "_lo": closes_before(F.col("_lo"), F.col("data_aquisicao")), "_hi": closes_before(F.col("_hi"), F.col("data_vencimento")),
            "_cv": business_day_number(F.col("data_vencimento"), F.col("_cv"), ends), "_b": F.coalesce("_b", "data_vencimento")})
        .withColumn("du_total", F.col("_cv") - business_day_number(F.col("data_aquisicao"), F.col("_ca"), ends))
    )  # map-side only (broadcast lookups): cheaper to rescan than to pin in memory
    if leaving is not None:
        cl = cal_b.select(F.col("data").alias("_ld"), F.col("g_before").alias("_lg"))
        t = t.join(cl, F.col("_l") == F.col("_ld"), "left").withColumn(
            "_hi", F.when(F.col("_l").isNull(), F.col("_hi")).otherwise(F.least("_hi", closes_before(F.col("_lg"), F.col("_l")))))

    # performing part: one row per close date in [acquisition, last business day <= maturity)
    curve = (
        t.where((F.col("du_total") > 0) & (F.col("_hi") > F.col("_lo")))
        .select("classe_id", "valor_face", "valor_aquisicao", "du_total", "_cv",
                F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("gidx"))
        .join(F.broadcast(gi), "gidx")
        .withColumn("_vp", accrual_value(F.col("valor_face"), F.col("valor_aquisicao"),
                                         F.col("_cv") - F.col("_cd"), F.col("du_total")))
        .groupBy("classe_id", "data")
        .agg(F.sum("_vp").alias("vp_curve"))
    )

    # step part: deltas on the day each step starts
    zero = F.lit(0).cast(MONEY)
    vf = F.col("valor_face")

    def step(day: Column, dq, dvp, drec, dpdd) -> Column:
        return F.struct(day.alias("data"), F.lit(dq).cast("long").alias("dq"), dvp.cast(MONEY).alias("dvp"),
                        drec.cast(MONEY).alias("drec"), dpdd.cast(MONEY).alias("dpdd"))

    const_start = F.when(F.col("du_total") > 0, F.col("_b")).otherwise(F.col("data_aquisicao"))
    steps = [
        step(F.col("data_aquisicao"), 1, zero, zero, zero),
        step(const_start, 0, vf, zero, zero),
        step(F.date_add(F.col("data_vencimento"), 1), 0, zero, vf, zero),
    ]
    prev = F.lit(0).cast(MONEY)
    for days, pct in steps_of:
        amount = F.round(vf * F.lit(pct).cast(PCT), 2)
        steps.append(step(F.date_add(F.col("data_vencimento"), days), 0, zero, zero, amount - prev))
        prev = amount
    every = F.array(*steps)
    if leaving is not None:  # of the steps before the title leaves, and of them once more, taken back on that day
        begun = F.filter(every, lambda s: F.col("_l").isNull() | (s["data"] < F.col("_l")))
        back = F.transform(begun, lambda s: F.struct(F.col("_l").alias("data"), (-s["dq"]).alias("dq"), *[(-s[c]).cast(MONEY).alias(c) for c in ("dvp", "drec", "dpdd")]))
        every = F.concat(begun, F.when(F.col("_l").isNotNull(), back).otherwise(F.filter(every, lambda _: F.lit(False))))
    deltas = (
        t.select("classe_id", F.inline(every))
        .groupBy("classe_id", "data")
        .agg(F.sum("dq").alias("dq"), F.sum("dvp").alias("dvp"), F.sum("drec").alias("drec"),
             F.sum("dpdd").alias("dpdd"))
        .withColumn("_g", F.lit(0))
    )
    g = grid.select("classe_id", "data").distinct().select(
        "classe_id", "data", F.lit(0).cast("long").alias("dq"), zero.alias("dvp"), zero.alias("drec"),
        zero.alias("dpdd"), F.lit(1).alias("_g"))
    w = Window.partitionBy("classe_id").orderBy("data", "_g").rowsBetween(Window.unboundedPreceding, 0)
    balances = (
        deltas.unionByName(g)
        .select("classe_id", "data", "_g",
                F.sum("dq").over(w).alias("qtd_ativos"), F.sum("dvp").over(w).alias("vp_const"),
                F.sum("drec").over(w).alias("a_receber"), F.sum("dpdd").over(w).alias("pdd"))
        .where(F.col("_g") == 1)
        .drop("_g")
    )
    return (
        balances.join(curve, ["classe_id", "data"], "left")
        .select(
            "classe_id", "data",
            F.col("qtd_ativos").cast("long").alias("qtd_ativos"),
            (F.col("vp_const") + F.coalesce(F.col("vp_curve"), F.lit(0))).cast(MONEY).alias("valor_presente"),
            F.col("pdd").cast(MONEY).alias("pdd"),
            F.col("a_receber").cast(MONEY).alias("a_receber"),
        )
    )


def stock_detail(marked: DataFrame, top: int = 100) -> DataFrame:
    """M8/M9: per class, the top ``top`` titles by present value (ties by id),
    with the class total over *all* titles. Spark plans ``row_number() <= k`` with
    a map-side group limit, so a hot class ships at most k rows per partition."""
    w = Window.partitionBy("classe_id").orderBy(F.col("valor_presente").desc(), F.col("identificador_externo"))
    totals = marked.groupBy("classe_id").agg(
        F.count(F.lit(1)).alias("estoque_qtd_titulos"), F.sum("valor_presente").cast(MONEY).alias("estoque_valorizado"))
    topk = marked.withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= top)
    return topk.join(totals, "classe_id")


def receivable_list(titles: DataFrame, situacao: str | None = None, limit: int = 200) -> DataFrame:
    """Per class, titles by maturity (ties by id, acquisition date), first ``limit``."""
    t = titles if situacao is None else titles.where(F.col("situacao") == situacao)
    w = Window.partitionBy("classe_id").orderBy("data_vencimento", "identificador_externo", "data_aquisicao")
    return t.withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= limit)


def implied_rate(vf: Column, va: Column, du_total: Column) -> Column:
    """Annual cession rate (%) implied by face/acquisition value over du_total days."""
    rate = (F.pow(vf.cast("double") / va.cast("double"), F.lit(252.0) / du_total.cast("double")) - 1) * 100
    # terms of a few days give huge rates: a wide type holds them, to whole percent from a million on
    rate = F.when(F.abs(rate) < 1e6, F.round(rate, 6)).otherwise(F.round(rate))
    return F.when(du_total > 0, rate.try_cast(T.DecimalType(38, 6)))
