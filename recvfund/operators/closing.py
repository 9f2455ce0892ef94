"""Daily closing on a grid of (class, date): NAV, provision, unit price, return.

The source computes one (class, date) per call, reading the previous close.
Here every close of every class is computed in one plan: the inputs (marking,
cash, units, fee) are per-(class, date) balances, and the previous-close
dependencies are window functions over the grid ordered by date. The gross NAV
does not depend on the accumulated provision, so the provision is a plain
running sum and no sequential fold is needed.

Decimal arithmetic relies on ``spark.sql.decimalOperations.allowPrecisionLoss``
being false (see ``session.exact_decimals``); rounding is HALF_EVEN (``bround``)
where the source uses ``quantize(ROUND_HALF_EVEN)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.calendar import with_business_days
from ..functions.params import param_asof
from . import ledger, valuation

MONEY = T.DecimalType(20, 2)
UNITS = T.DecimalType(28, 12)
RET = T.DecimalType(18, 10)
DAYS_FEE_DIVISOR = 100 * K.DU_ANO  # fee is % p.a. over 252 business days


def close_inputs(grid: DataFrame, titles: DataFrame, cash: DataFrame, units: DataFrame, params: DataFrame,
                 calendar: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Per (class, date): marking totals, cash, units and the fee in force."""
    keys = grid.select("classe_id", "fundo_id", "data")
    mark = valuation.class_marking(titles, keys, calendar, bands)
    bal = ledger.ledger_balances(keys.select("classe_id", "data"), cash, units)
    fee = param_asof(keys.select("classe_id", "data"), params)
    return (
        keys.join(mark, ["classe_id", "data"], "left")
        .join(bal, ["classe_id", "data"], "left")
        .join(fee.select("classe_id", "data", "taxa_administracao_aa"), ["classe_id", "data"], "left")
    )


def gross_nav(present_value: Column, cash: Column) -> Column:
    """F1, cents."""
    return F.bround(present_value + cash, 2).cast(MONEY)


def fee_expense(gross: Column, rate: Column, days: Column) -> Column:
    """gross x fee% / 252 x days, as one exact quotient, then HALF_EVEN to cents."""
    whole = T.DecimalType(5, 0)
    return F.bround(gross * rate * days.cast(whole) / F.lit(DAYS_FEE_DIVISOR).cast(whole), 2).cast(MONEY)


def net_nav(gross: Column, pdd: Column, provision: Column) -> Column:
    """F6."""
    return (gross - pdd - provision).cast(MONEY)


def unit_price(net: Column, units: Column) -> Column:
    """null without units."""
    return F.when(units > 0, F.bround(net / units, 12)).cast(UNITS)


def _stored_versions(prior_closes: DataFrame) -> DataFrame:
    """Per stored (class, date): its highest version, and price and provision of the highest one that counts as a close."""
    counts = F.col("status").isin(*K.CLOSED_STATUS) if "status" in prior_closes.columns else F.lit(True)
    pin = F.struct(F.col("valor_cota").cast(UNITS).alias("valor_cota"), F.col("provisao_adm_acumulada").cast(MONEY).alias("provisao_adm_acumulada"))
    return prior_closes.groupBy("classe_id", F.col("data_referencia").alias("data")).agg(
        F.max_by(pin, F.when(counts, F.col("versao"))).alias("_pin"), F.max("versao").cast("long").alias("_stored"))


def close_grid(inputs: DataFrame, calendar: DataFrame, prior_closes: DataFrame | None = None) -> DataFrame:
    """F1-F8, F10 for every (class, date) of ``inputs``, as if closed one after the other by date.

    Each class has one timeline of the run's dates and the stored dates (highest version each) that the run does not close
    again. The previous close is the row before on that timeline: a stored one gives its price and accumulated
    provision as they are, also where it lies between two dates of the run or came after the run's first date. A
    stored row thus starts a segment, inside which the provision is a running sum. A date that is stored already gets the next
    version. Stored and new rows meet by a union, so ``inputs`` is computed once and everything is one shuffle by class.
    """
    zero = F.lit(0).cast(MONEY)
    d = (
        inputs
        .withColumn("valor_presente_ativos", F.coalesce(F.col("valor_presente"), zero))
        .withColumn("pdd_total", F.coalesce(F.col("pdd"), zero))
        .withColumn("contas_receber", F.coalesce(F.col("a_receber"), zero))
        .withColumn("qtd_ativos", F.coalesce(F.col("qtd_ativos"), F.lit(0)).cast("long"))
        .withColumn("caixa", F.coalesce(F.col("caixa"), zero).cast(MONEY))
        .withColumn("quantidade_cotas", F.coalesce(F.col("quantidade_cotas"), F.lit(0)).cast(UNITS))
        .withColumn("_new", F.lit(True))
        .withColumn("_pin", F.lit(None).cast("struct<valor_cota:decimal(28,12), provisao_adm_acumulada:decimal(20,2)>"))
        .withColumn("_stored", F.lit(None).cast("long"))
    )
    w = Window.partitionBy("classe_id").orderBy("data", "_new")
    if prior_closes is not None:
        stored = _stored_versions(prior_closes).withColumn("_new", F.lit(False))
        d = d.unionByName(stored, allowMissingColumns=True)
        same_before, same_after = F.lag("data").over(w) == F.col("data"), F.lead("data").over(w) == F.col("data")
        d = d.withColumns({"_again": F.when(same_before, F.lag("_stored").over(w)), "_closed_again": same_after})
        # a stored date that the run closes again, or that no version closed, is nobody's previous close
        d = d.where(F.col("_new") | (F.col("_pin").isNotNull() & ~F.coalesce("_closed_again", F.lit(False))))
    else:
        d = d.withColumn("_again", F.lit(None).cast("long"))
    # business days since the previous close; 1 for the first close
    d = with_business_days(d.withColumn("_prev", F.lag("data").over(w)), "_prev", "data", "_n", calendar)
    d = d.withColumn("n_du", F.when(F.col("_prev").isNull(), F.lit(1)).otherwise(F.col("_n")))
    d = d.withColumn("pl_bruto", gross_nav(F.col("valor_presente_ativos"), F.col("caixa")))
    d = d.withColumn("despesa_adm_dia", fee_expense(F.col("pl_bruto"), F.col("taxa_administracao_aa"), F.col("n_du")))
    d = d.withColumn("_segment", F.sum((~F.col("_new")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("classe_id", "_segment").orderBy("data").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("classe_id").orderBy("data")
    d = (
        d.withColumn("provisao_adm_acumulada", F.sum(F.coalesce("_pin.provisao_adm_acumulada", "despesa_adm_dia")).over(inside).cast(MONEY))  # F5
        .withColumn("pl_liquido", net_nav(F.col("pl_bruto"), F.col("pdd_total"), F.col("provisao_adm_acumulada")))
        .withColumn("valor_cota", F.when(F.col("_new"), unit_price(F.col("pl_liquido"), F.col("quantidade_cotas"))).otherwise(F.col("_pin.valor_cota")))
        .withColumn("cota_anterior", F.lag("valor_cota").over(last))                          # F2
        .where("_new")
    )
    base = F.coalesce(F.col("cota_anterior"), F.lit(K.PAR).cast(UNITS))
    d = d.withColumn("rentabilidade_dia", F.when(F.col("valor_cota").isNotNull() & (base > 0),   # F8
                                                 F.bround(F.col("valor_cota") / base - 1, 10)).cast(RET))
    versao = F.coalesce(F.col("_again"), F.lit(0)) + 1                                          # F10
    return d.select(
        "fundo_id", "classe_id", F.col("data").alias("data_referencia"), versao.cast("long").alias("versao"),
        F.lit("PROCESSADO").alias("status"), "valor_presente_ativos", "pdd_total", "caixa", "contas_receber",
        zero.alias("contas_pagar"), "pl_bruto", "despesa_adm_dia", "provisao_adm_acumulada", "pl_liquido",
        "quantidade_cotas", "valor_cota", "cota_anterior", "rentabilidade_dia", "qtd_ativos",
        F.col("n_du").cast("long").alias("n_du"),
    )


def orders_by_close(grid: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders summed per (class, close date): those after the previous close and up to this one.

    ``aplicado``: value subscribed; ``resgatado``: value redeemed by value; ``cotas_resgatadas``: units redeemed by units.
    Orders are summed per class and day first, so the window holds a row a day; orders after a class's last close wait.
    """
    by_units = F.col("quantidade_solicitada").isNotNull()
    redeem = F.col("tipo") == "RESGATE"
    daily = orders.groupBy("classe_id", "data").agg(
        F.sum(F.when(~redeem, F.col("valor"))).alias("aplicado"),
        F.sum(F.when(redeem & ~by_units, F.col("valor"))).alias("resgatado"),
        F.sum(F.when(redeem & by_units, F.col("quantidade_solicitada"))).alias("cotas_resgatadas"))
    sums = ["aplicado", "resgatado", "cotas_resgatadas"]
    marks = grid.select("classe_id", "data", *[F.lit(None).cast(daily.schema[c].dataType).alias(c) for c in sums]).withColumn("_close", F.col("data"))
    ahead = Window.partitionBy("classe_id").orderBy("data", F.col("_close").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    dated = daily.withColumn("_close", F.lit(None).cast("date")).unionByName(marks).withColumn("_at", F.first("_close", ignorenulls=True).over(ahead))
    return dated.where(F.col("_close").isNull() & F.col("_at").isNotNull()).groupBy("classe_id", F.col("_at").alias("data")).agg(*[F.sum(c).alias(c) for c in sums])


def close_id(closes: DataFrame) -> F.Column:
    return F.sha2(F.concat_ws("|", "classe_id", "data_referencia", "versao"), 256)


def seal(closes: DataFrame, requests: DataFrame, sealed_log: DataFrame | None = None) -> DataFrame:
    """seal requests (``fechamento_id``, ``ordem``) -> outcome per request.

    Missing id -> 404 message; already sealed (earlier log entry or an earlier
    accepted request for the same id) -> 409 message; else SELADO.
    """
    ids = closes.select(close_id(closes).alias("fechamento_id")).withColumn("_exists", F.lit(True))
    r = requests.join(ids, "fechamento_id", "left")
    if sealed_log is not None:
        r = r.join(sealed_log.select("fechamento_id").distinct().withColumn("_pre", F.lit(True)), "fechamento_id", "left")
    else:
        r = r.withColumn("_pre", F.lit(None).cast("boolean"))
    first = requests.groupBy("fechamento_id").agg(F.min("ordem").alias("_first"))
    r = r.join(first, "fechamento_id")
    return r.select(
        "fechamento_id", "ordem",
        F.when(F.col("_exists").isNull(), F.lit(K.MSG_SEAL_MISSING))
        .when(F.col("_pre") | (F.col("ordem") > F.col("_first")), F.lit(K.MSG_SEAL_SEALED))
        .otherwise(F.lit("SELADO")).alias("resultado"),
    )


def with_status(closes: DataFrame, seal_log: DataFrame) -> DataFrame:
    """F11 as state: ``status`` and ``selado_em`` of every close from the log of accepted seals (fechamento_id, selado_em)."""
    log = seal_log.groupBy(F.col("fechamento_id").alias("_id")).agg(F.min("selado_em").alias("selado_em"))
    d = closes.withColumn("_cid", close_id(closes)).join(log, F.col("_cid") == F.col("_id"), "left")
    return d.withColumn("status", F.when(F.col("_id").isNotNull(), "SELADO").otherwise(F.col("status"))).drop("_cid", "_id")


def latest_versions(closes: DataFrame) -> DataFrame:
    """Highest version per (class, date)."""
    w = Window.partitionBy("classe_id", "data_referencia").orderBy(F.col("versao").desc())
    return closes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def list_closes(closes: DataFrame, classe_id: str | None = None, n: int = 200) -> DataFrame:
    """newest closes (date desc, version desc), first ``n``."""
    c = closes if classe_id is None else closes.where(F.col("classe_id") == classe_id)
    return c.orderBy(F.col("data_referencia").desc(), F.col("versao").desc(), F.col("classe_id")).limit(n).select(
        "fundo_id", "classe_id", "data_referencia", "versao", "status", "pl_liquido", "quantidade_cotas",
        "valor_cota", "rentabilidade_dia", "qtd_ativos")


def price_series(closes: DataFrame) -> DataFrame:
    """per class, the highest version per date among closes with a price."""
    return latest_versions(closes.where(F.col("valor_cota").isNotNull())).select(
        "classe_id", "data_referencia", "valor_cota")


def overview(closes: DataFrame, fundos: DataFrame, classes: DataFrame) -> DataFrame:
    """per class, the latest close KPIs, the last-8-closes window and the fund count."""
    last = Window.partitionBy("classe_id").orderBy(F.col("data_referencia").desc(), F.col("versao").desc())
    ranked = closes.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= 8)
    kpi = ranked.groupBy("classe_id").agg(
        F.max_by(F.struct("data_referencia", "pl_liquido", "valor_cota", "rentabilidade_dia", "qtd_ativos"),
                 F.struct("data_referencia", "versao")).alias("k"),
        F.count(F.lit(1)).alias("n_fechamentos_recentes"),
        F.min("data_referencia").alias("inicio_janela"),
    )
    # one row per fund: the count runs over the fund dimension only
    nf = fundos.select("fundo_id", F.count(F.lit(1)).over(Window.partitionBy()).alias("n_fundos"))
    return (
        classes.select("classe_id", "fundo_id").join(nf, "fundo_id").join(kpi, "classe_id")
        .select("classe_id", "fundo_id", F.col("n_fundos").cast("long").alias("n_fundos"),
                F.col("k.data_referencia").alias("data_referencia"), F.col("k.pl_liquido").alias("pl_liquido"),
                F.col("k.valor_cota").alias("valor_cota"), F.col("k.rentabilidade_dia").alias("rentabilidade_dia"),
                F.col("k.qtd_ativos").alias("qtd_ativos"), "n_fechamentos_recentes", "inicio_janela")
    )


def recent_closes(closes: DataFrame, n: int = 8) -> DataFrame:
    """per class its newest ``n`` closes with their status (a group limit: k rows a partition are shuffled)."""
    newest = Window.partitionBy("classe_id").orderBy(F.col("data_referencia").desc(), F.col("versao").desc())
    return closes.withColumn("posicao", F.row_number().over(newest)).where(F.col("posicao") <= n).select(
        "classe_id", F.col("posicao").cast("long").alias("posicao"), "data_referencia", "versao", "status", "pl_liquido",
        "quantidade_cotas", "valor_cota", "rentabilidade_dia")


def get_close(closes: DataFrame, fechamento_id: str) -> DataFrame:
    """one close by id (empty when missing)."""
    return closes.where(close_id(closes) == F.lit(fechamento_id))
