"""Investor subscriptions and redemptions.

Units = value / applicable price (HALF_EVEN, 12 dp); the price lookup and the
unit arithmetic are JVM-side. The redemption guard is order-dependent: a
redemption is accepted only if it does not exceed the investor's balance, and
a rejected one must not reduce it. That is a sequential fold per
(class, investor), which no associative aggregate expresses.

But it only matters where some redemption is too large. A running sum in the
JVM first assumes that all orders are accepted: prefix sums and prefix minima
inside each day of an investor, so that the rows of a hot investor are spread
over as many tasks as there are days, and over the days (one row each) the
offset that each day starts from. Until the first day on which an investor's
balance would fall below zero, that is the answer. Only rows from that day on
enter the fold, with the balance before it.

The fold runs as ``mapInPandas`` over rows hash-partitioned by (class,
investor) and sorted by (class, investor, date, kind, order): state is one
balance carried across Arrow batches, so memory stays bounded by the batch
size even for an investor holding a third of all orders (from a refused order
on, that investor's rows are one task: the guard is inherently serial). Opening
balances come from the unit ledger, pre-aggregated per (class, investor, day),
and are merged into the same sorted stream.

Orders are read, priced and screened once: known orders, the prices that apply (a
row a class and day, so that Spark knows their size), priced and screened orders are
each written to the shared folder, as several later steps read them.

Replay order: by date, then order id (orders of a day are priced at the last
close on or before that day).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.rows import dealt, partitions_for
from ..session import staged
from . import ledger

MONEY = T.DecimalType(20, 2)
UNITS = T.DecimalType(28, 12)
SUMS = T.DecimalType(38, 12)

def _out_schema(stream: DataFrame) -> T.StructType:
    f = {x.name: x.dataType for x in stream.schema.fields}
    return T.StructType([
        T.StructField("_k", T.IntegerType()),
        T.StructField("ordem", f["ordem"]),
        T.StructField("classe_id", f["classe_id"]),
        T.StructField("cotista_id", f["cotista_id"]),
        T.StructField("aceito", T.BooleanType()),
        T.StructField("saldo_cotas", UNITS),
    ])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Carry (key, balance) across batches; ledger rows (_k=0) always apply."""
    key, bal = None, Decimal(0)
    for pdf in batches:
        acc, after = [], []
        for cls, inv, k, redeem, q in zip(pdf["classe_id"], pdf["cotista_id"], pdf["_k"], pdf["_redeem"], pdf["_q"]):
            if (cls, inv) != key:
                key, bal = (cls, inv), Decimal(0)
            q = Decimal(0) if q is None else q
            if k == 0:
                bal += q
                ok = True
            elif redeem:
                ok = q <= bal
                if ok:
                    bal -= q
            else:
                bal += q
                ok = True
            acc.append(ok)
            after.append(bal)
        yield pd.DataFrame({"_k": pdf["_k"], "ordem": pdf["ordem"], "classe_id": pdf["classe_id"],
                            "cotista_id": pdf["cotista_id"], "aceito": acc, "saldo_cotas": after})


def price_orders(orders: DataFrame, closes: DataFrame, same_day: bool = True) -> DataFrame:
    """L6/L7 arithmetic: applicable price and units of every order (before the guard).

    ``same_day``: the close of an order's own day prices it; else orders come before that close.
    """
    at = orders.withColumn("_priced_on", F.col("data") if same_day else F.date_sub("data", 1))
    prices = staged(ledger.applicable_prices(at, closes, "_priced_on"), "precos")
    priced = at.join(prices, ["classe_id", "_priced_on"], "left").drop("_priced_on")
    price = F.col("valor_cota_aplicavel")
    by_units = F.col("quantidade_solicitada") if "quantidade_solicitada" in orders.columns else F.lit(None)
    qtd = F.coalesce(F.bround(by_units.cast(UNITS), 12), F.bround(F.col("valor") / price, 12)).cast(UNITS)
    return priced.withColumn("quantidade", qtd)


def _screened(stream: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders that pass whatever comes later, with the balance after each; and what the fold has to decide, with an opening
    row for each investor. ``stream`` is read once; both parts read the written result."""
    who = ["classe_id", "cotista_id"]
    stream = dealt(stream, partitions, *who, "data")
    day = Window.partitionBy(*who, "data").orderBy("_k", "ordem").rowsBetween(Window.unboundedPreceding, 0)
    sums = stream.withColumn("_in", F.sum(F.when(F.col("_redeem"), -F.col("_q")).otherwise(F.col("_q"))).over(day))
    days = sums.groupBy(*who, "data").agg(F.sum(F.when(F.col("_redeem"), -F.col("_q")).otherwise(F.col("_q"))).alias("_total"), F.min("_in").alias("_least"))
    before = Window.partitionBy(*who).orderBy("data")
    days = days.withColumn("_offset", F.coalesce(F.sum("_total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(SUMS))
    short = F.min(F.when(F.col("_offset") + F.col("_least") < 0, F.col("data"))).over(before.rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn("_short", short)  # the first day that falls short, on that day and after it
    at = staged(sums.join(days.select(*who, "data", "_offset", "_short"), [*who, "data"]), "triagem")
    clear = at.where(F.col("_short").isNull() & (F.col("_k") == 1)).select(
        "ordem", *who, F.lit(True).alias("aceito"), (F.col("_offset") + F.col("_in")).cast(UNITS).alias("saldo_cotas"))
    # all rows of a day have its offset
    opening = at.where(F.col("data") == F.col("_short")).groupBy(*who, "data").agg(F.min("_offset").alias("_offset")).select(
        *who, "data", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("ordem"), F.lit(False).alias("_redeem"), F.col("_offset").cast(UNITS).alias("_q"))
    return clear, at.where(F.col("_short").isNotNull()).select(*stream.columns).unionByName(opening)


def process_orders(orders: DataFrame, closes: DataFrame, unit_ledger: DataFrame | None = None,
                   classes: DataFrame | None = None, cotistas: DataFrame | None = None, same_day: bool = True) -> DataFrame:
    """Replay orders (ordem, data, classe_id, cotista_id, tipo APLICACAO|RESGATE, valor
    [, quantidade_solicitada]) -> per order: units, price, financial value, accepted, balance after.

    With ``classes`` and ``cotistas``, an order for an unknown one is refused and changes no balance.
    """
    opening = None if unit_ledger is None else opening_units(unit_ledger)
    return guard_orders(staged(with_refusals(orders, classes, cotistas), "ordens"), closes, opening, same_day)


def with_refusals(orders: DataFrame, classes: DataFrame | None = None, cotistas: DataFrame | None = None) -> DataFrame:
    """``_refused``: why an order is refused whatever its price, as its class or investor is unknown; else null."""
    known = orders.withColumn("_refused", F.lit(None).cast("string"))
    for table, key, message in ((cotistas, "cotista_id", K.MSG_ORDEM_COTISTA), (classes, "classe_id", K.MSG_ORDEM_CLASSE)):
        if table is not None:
            ids = table.select(F.col(key).alias("_id")).distinct()
            known = known.join(ids, F.col(key) == F.col("_id"), "left").withColumn(
                "_refused", F.when(F.col("_id").isNull(), F.lit(message)).otherwise(F.col("_refused"))).drop("_id")
    return known


def opening_units(unit_ledger: DataFrame) -> DataFrame:
    """The unit ledger as rows of the guard's stream: one an investor and day."""
    return (
        ledger.signed_units(unit_ledger).where(F.col("cotista_id").isNotNull())
        .groupBy("classe_id", "cotista_id", "data").agg(F.sum("delta").cast(UNITS).alias("_q"))
        .select("classe_id", "cotista_id", "data", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("ordem"),
                F.lit(False).alias("_redeem"), "_q")
    )


def guard_orders(known: DataFrame, closes: DataFrame, opening: DataFrame | None = None, same_day: bool = True) -> DataFrame:
    """The part of ``process_orders`` that depends on the closes: orders ``with_refusals`` and ``opening_units`` stay as they are."""
    priced = staged(price_orders(known, closes, same_day), "ordens-preco")
    n_parts = partitions_for(priced)
    stream = priced.where(F.col("_refused").isNull()).select(
        "classe_id", "cotista_id", "data", F.lit(1).alias("_k"), "ordem",
        (F.col("tipo") == "RESGATE").alias("_redeem"), F.col("quantidade").alias("_q"))
    if opening is not None:
        stream = opening.unionByName(stream)
    clear, rest = _screened(stream, n_parts)
    folded = clear.unionByName(
        rest.repartition("classe_id", "cotista_id")
        .sortWithinPartitions("classe_id", "cotista_id", "data", "_k", "ordem")
        .mapInPandas(_fold, _out_schema(stream))
        .where(F.col("_k") == 1)
        .drop("_k")
    )
    valor = F.when(F.col("tipo") == "RESGATE", F.bround(F.col("quantidade") * F.col("valor_cota_aplicavel"), 2)) \
        .otherwise(F.col("valor"))
    return (
        dealt(priced, n_parts, "ordem", "classe_id", "cotista_id").join(folded, ["ordem", "classe_id", "cotista_id"], "left")
        .withColumn("aceito", F.coalesce("aceito", F.lit(False)))
        .select("ordem", "classe_id", "cotista_id", "data", "tipo", "quantidade",
                F.col("valor_cota_aplicavel").alias("valor_cota"), valor.cast(MONEY).alias("valor_financeiro"),
                "aceito", F.coalesce("_refused", F.when(~F.col("aceito"), F.lit(K.MSG_SALDO_INSUFICIENTE))).alias("motivo"),
                "saldo_cotas")
    )


def order_movements(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted orders as unit-ledger rows and cash-ledger rows."""
    ok = processed.where(F.col("aceito"))
    units = ok.select("classe_id", "cotista_id", "data",
                      F.when(F.col("tipo") == "RESGATE", "RESGATE").otherwise("EMISSAO").alias("tipo"),
                      "quantidade", "valor_cota", "valor_financeiro")
    cash = ok.select("classe_id", "data", F.when(F.col("tipo") == "RESGATE", "RESGATE").otherwise("APORTE").alias("tipo"),
                     F.when(F.col("tipo") == "RESGATE", -F.col("valor_financeiro")).otherwise(F.col("valor_financeiro"))
                     .cast(MONEY).alias("valor"))
    return units, cash
