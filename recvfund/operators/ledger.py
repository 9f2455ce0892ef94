"""Cash and unit ledgers, title events, investor positions.

Balances for many (class, date) pairs are computed from per-(class, day)
pre-aggregated movements and one running sum per class, so the window never
holds more than one row per day per class, however many movements there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.rows import dealt

MONEY = T.DecimalType(20, 2)
UNITS = T.DecimalType(28, 12)
PRICE = T.DecimalType(28, 12)


def signed_units(units: DataFrame) -> DataFrame:
    """Units ledger with EMISSAO positive and RESGATE negative."""
    q = F.col("quantidade")
    return units.withColumn("delta", F.when(F.col("tipo") == "EMISSAO", q).otherwise(-q))


def balances_asof(grid: DataFrame, movements: DataFrame, value: str, out: str, key: str = "classe_id",
                  date: str = "data", out_type=None) -> DataFrame:
    """For each (key, date) of ``grid``: sum of ``value`` over movements with date <= grid date."""
    daily = movements.groupBy(key, date).agg(F.sum(value).alias("_v")).withColumn("_g", F.lit(0))
    g = grid.select(key, date).distinct().withColumn("_v", F.lit(None).cast(daily.schema["_v"].dataType)) \
        .withColumn("_g", F.lit(1))
    w = Window.partitionBy(key).orderBy(date, "_g").rowsBetween(Window.unboundedPreceding, 0)
    res = (
        daily.unionByName(g)
        .withColumn(out, F.coalesce(F.sum("_v").over(w), F.lit(0)))
        .where(F.col("_g") == 1)
        .select(key, date, out)
    )
    if out_type is not None:
        res = res.withColumn(out, F.col(out).cast(out_type))
    return grid.join(res, [key, date], "left")


def cash_balance(grid: DataFrame, cash: DataFrame) -> DataFrame:
    """L1: cash of each class as of each grid date."""
    return balances_asof(grid, cash, "valor", "caixa", out_type=MONEY)


def unit_balance(grid: DataFrame, units: DataFrame) -> DataFrame:
    """L2: units outstanding (EMISSAO - RESGATE) as of each grid date."""
    return balances_asof(grid, signed_units(units), "delta", "quantidade_cotas", out_type=UNITS)


def ledger_balances(grid: DataFrame, cash: DataFrame, units: DataFrame) -> DataFrame:
    """L1 + L2 in one pass: cash and units outstanding as of each grid date
    (one shuffle and one running window for both ledgers)."""
    c = cash.select("classe_id", "data", F.col("valor").cast(MONEY).alias("_c"), F.lit(None).cast(UNITS).alias("_u"))
    u = signed_units(units).select("classe_id", "data", F.lit(None).cast(MONEY).alias("_c"),
                                   F.col("delta").cast(UNITS).alias("_u"))
    daily = c.unionByName(u).groupBy("classe_id", "data").agg(F.sum("_c").alias("_c"), F.sum("_u").alias("_u")) \
        .withColumn("_g", F.lit(0))
    g = grid.select("classe_id", "data").distinct().select(
        "classe_id", "data", F.lit(None).cast(daily.schema["_c"].dataType).alias("_c"),
        F.lit(None).cast(daily.schema["_u"].dataType).alias("_u"), F.lit(1).alias("_g"))
    w = Window.partitionBy("classe_id").orderBy("data", "_g").rowsBetween(Window.unboundedPreceding, 0)
    res = (
        daily.unionByName(g)
        .select("classe_id", "data", "_g",
                F.coalesce(F.sum("_c").over(w), F.lit(0)).cast(MONEY).alias("caixa"),
                F.coalesce(F.sum("_u").over(w), F.lit(0)).cast(UNITS).alias("quantidade_cotas"))
        .where(F.col("_g") == 1)
        .drop("_g")
    )
    return grid.join(res, ["classe_id", "data"], "left")


def investor_positions(units: DataFrame, as_of: str) -> DataFrame:
    """Per (class, investor) signed units with date <= as_of, kept when > 0.

    Units without an investor belong to no position. A hot investor or class is
    combined map-side by the partial aggregate.
    """
    d = F.lit(as_of).cast("date")
    return (
        signed_units(units).where((F.col("data") <= d) & F.col("cotista_id").isNotNull())
        .groupBy("classe_id", "cotista_id")
        .agg(F.sum("delta").cast(UNITS).alias("cotas"))
        .where(F.col("cotas") > 0)
    )


def investor_balance(units: DataFrame, as_of: str) -> DataFrame:
    """Signed units per (class, investor) with date <= as_of, whatever the sign
    (the balance the redemption guard reads)."""
    d = F.lit(as_of).cast("date")
    return (
        signed_units(units).where((F.col("data") <= d) & F.col("cotista_id").isNotNull())
        .groupBy("classe_id", "cotista_id")
        .agg(F.sum("delta").cast(UNITS).alias("saldo_cotas"))
    )


def latest_price_per_date(closes: DataFrame) -> DataFrame:
    """Closes with a price: highest version per (class, date)."""
    return (
        closes.where(F.col("valor_cota").isNotNull())
        .groupBy("classe_id", "data_referencia")
        .agg(F.max_by("valor_cota", "versao").alias("valor_cota"))
    )


def price_asof(keys: DataFrame, closes: DataFrame, date: str = "data") -> DataFrame:
    """L4: unit price of the last close on or before each key date, else par.

    The as-of runs on the distinct (class, date) keys (bounded by classes x days),
    then joins back on equality, so a hot class never sorts its raw rows.
    """
    return keys.join(applicable_prices(keys, closes, date), ["classe_id", date], "left")


def applicable_prices(keys: DataFrame, closes: DataFrame, date: str = "data") -> DataFrame:
    """L4 for the distinct (class, date) of ``keys``: a row each with ``valor_cota_aplicavel``."""
    priced = latest_price_per_date(closes).select(
        "classe_id", F.col("data_referencia").alias(date), "valor_cota", F.lit(0).alias("_k"))
    kd = keys.select("classe_id", date).distinct().select(
        "classe_id", date, F.lit(None).cast(PRICE).alias("valor_cota"), F.lit(1).alias("_k"))
    w = Window.partitionBy("classe_id").orderBy(date, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        priced.unionByName(kd)
        .withColumn("_p", F.last("valor_cota", ignorenulls=True).over(w))
        .where(F.col("_k") == 1)
        .select("classe_id", date, F.coalesce(F.col("_p"), F.lit(K.PAR).cast(PRICE)).alias("valor_cota_aplicavel"))
    )


EVENT_KEY = ["fundo_id", "identificador_externo"]


def apply_title_events(titles: DataFrame, events: DataFrame, as_of: str | None = None, partitions: int | None = None):
    """Resolve events to titles by (fundo_id, identificador_externo) and derive status.

    Returns (titles with ``situacao`` and ``n_eventos``, resolved events with
    ``resultado``: OK, or the not-found / ambiguous / unknown-kind message). Events
    apply in posting order (``ordem``); the class is that of the title they resolve
    to. With ``as_of`` only events dated on or before that day count. ``partitions``:
    how many both are dealt into (see ``rows.partitions_for``).
    """
    resolved = resolve_events(titles, events, as_of, partitions)
    return title_status(titles, resolved, partitions), resolved


def resolve_events(titles: DataFrame, events: DataFrame, as_of: str | None = None, partitions: int | None = None) -> DataFrame:
    """The second result of ``apply_title_events``."""
    key = EVENT_KEY
    events = events.drop("classe_id")
    ev = events if as_of is None else events.where(F.col("data_evento") <= F.lit(as_of).cast("date"))
    matches = dealt(titles, partitions, *key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("data_aquisicao", "classe_id", "valor_face")).alias("_t"),
    )
    return (
        dealt(ev, partitions, *key).join(matches, key, "left")
        .withColumn("resultado", F.when(F.col("_n").isNull(), F.lit(K.MSG_EVENTO_NAO_ENCONTRADO))
                    .when(F.col("_n") > 1, F.lit(K.MSG_EVENTO_AMBIGUO))
                    .when(~F.col("tipo").isin(*K.TITLE_EVENT_KINDS), F.lit(K.MSG_EVENTO_TIPO)).otherwise(F.lit("OK")))
        .withColumn("classe_id", F.col("_t.classe_id"))
        .withColumn("data_aquisicao", F.col("_t.data_aquisicao"))
        .withColumn("valor", F.coalesce(F.col("valor"), F.col("_t.valor_face")).cast(MONEY))
        .drop("_n", "_t")
    )


def title_status(titles: DataFrame, resolved: DataFrame, partitions: int | None = None) -> DataFrame:
    """The first result of ``apply_title_events``, from its second."""
    key = EVENT_KEY
    status_map = F.create_map(*[x for k, v in K.EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    changes = (
        resolved.where(F.col("resultado") == "OK")
        .groupBy(*key, "data_aquisicao")
        .agg(F.max_by(status_map[F.col("tipo")], F.when(F.col("tipo").isin(*K.EVENT_STATUS), F.col("ordem"))).alias("_s"),
             F.count(F.lit(1)).alias("n_eventos"))
    )
    # an event that counts names a key of one title, so the key alone finds it (dates that are null match nothing)
    changes = changes.where(F.col("data_aquisicao").isNotNull()).drop("data_aquisicao")
    return (
        dealt(titles, partitions, *key).join(changes, key, "left")
        .withColumn("situacao", F.coalesce(F.col("_s"), F.lit("ATIVO")))
        .withColumn("n_eventos", F.coalesce(F.col("n_eventos"), F.lit(0)).cast("long"))
        .drop("_s")
    )


def title_leaving(titles: DataFrame, resolved_events: DataFrame) -> DataFrame:
    """M1/L8 as of any day: ``titles`` with ``data_saida``, the day of the first event that ends the active status.

    No kind of event makes a title active again, so the first one by date decides, whatever the posting order.
    """
    key = ["fundo_id", "identificador_externo", "data_aquisicao"]
    ends = resolved_events.where((F.col("resultado") == "OK") & F.col("tipo").isin(*K.EVENT_STATUS))
    return titles.join(ends.groupBy(*key).agg(F.min("data_evento").alias("data_saida")), key, "left")


def event_cash(resolved_events: DataFrame) -> DataFrame:
    """Receipts (RECEBIMENTO_DC) for PAGAMENTO and RECOMPRA only."""
    return (
        resolved_events.where((F.col("resultado") == "OK") & F.col("tipo").isin(*K.EVENT_CASH_KINDS))
        .select("fundo_id", "classe_id", F.col("data_evento").alias("data"),
                F.lit("RECEBIMENTO_DC").alias("tipo"), F.col("valor").cast(MONEY).alias("valor"),
                "identificador_externo")
    )


def position_view(units: DataFrame, closes: DataFrame, as_of: str) -> DataFrame:
    """Positions with the applicable price, value (2 dp HALF_EVEN) and share of
    the attributed units (6 dp HALF_EVEN; divisor 1 when nothing is attributed)."""
    pos = investor_positions(units, as_of).withColumn("data", F.lit(as_of).cast("date"))
    pos = price_asof(pos, closes)
    total = pos.groupBy("classe_id").agg(F.sum("cotas").alias("_tot"))
    return (
        pos.join(total, "classe_id")
        .withColumn("valor", F.bround(F.col("cotas") * F.col("valor_cota_aplicavel"), 2).cast(MONEY))
        .withColumn("participacao", F.bround(F.col("cotas") / F.when(F.col("_tot") > 0, F.col("_tot"))
                                             .otherwise(F.lit(1)), 6).cast(T.DecimalType(20, 6)))
        .drop("_tot")
    )
