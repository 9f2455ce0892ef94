"""Closes and orders that feed each other (F9, with L6 and L7): the price of a close decides the units of the orders after it
and which redemptions pass, and those are part of the next close.

One call after another, that is a chain over all orders of a class. Here it is a fixed point of two steps that Spark
spreads: price and screen all orders at a given path of prices (``orders.guard_orders``: balances live per class and
investor, never in a class's row), and close all dates with the accepted orders' units and cash (``closing.close_grid``:
one row a class and date). When the closes give the same path that the orders were priced at, both are what replaying one by
one gives: prices before a class's first close are known, so its first interval is right, so its first close is, and so on.

The same argument bounds the rounds: with the prices right up to one close, the next close comes out right. To need far
fewer, the next path to try is not the last closes' prices as they are but these, moved along each class's dates by what
a changed price does to units and cash of the following dates (``_next_path``; a few numbers a date, no arithmetic of the
close, and no change where the path before a date has not changed). The closes and orders of the last round are the result.

Policy: orders of a day come before that day's close, and are priced at the last close before it that has a price (stored
ones included, par if there is none). Every order is converted by itself, rounded as ``price_orders`` rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import closing, ledger
from .orders import guard_orders, opening_units, order_movements, with_refusals

PRICE_PLACES = Decimal("1e-12")
PATH = ["classe_id", "data_referencia", "versao", "valor_cota"]


@dataclass
class Replay:
    closes: DataFrame  # new closes with their versions
    orders: DataFrame  # every order with price, units, verdict and balance
    rounds: int


def _with_movements(inputs: DataFrame, processed: DataFrame) -> DataFrame:
    """``inputs`` with the accepted orders' units and cash up to each date on top."""
    units, cash = order_movements(processed)
    more = ledger.ledger_balances(inputs.select("classe_id", "data"), cash, units).select(
        "classe_id", "data", F.col("caixa").alias("_cash"), F.col("quantidade_cotas").alias("_units"))
    sums = {"caixa": (F.coalesce("caixa", F.lit(0)) + F.col("_cash")).cast(closing.MONEY), "quantidade_cotas": (F.coalesce("quantidade_cotas", F.lit(0)) + F.col("_units")).cast(closing.UNITS)}
    return inputs.join(more, ["classe_id", "data"]).withColumns(sums).drop("_cash", "_units")


def _moved(rows: pd.DataFrame) -> pd.DataFrame:
    """One class's dates in order: the closes' prices, moved by how its own new path changes units and cash."""
    def price(net: Decimal, units: Decimal) -> Decimal | None:
        return net / units if units > 0 else None

    old, new = [Decimal(1), Decimal(0), Decimal(0)], [Decimal(1), Decimal(0), Decimal(0)]  # applied price, units, cash
    out = []
    with localcontext() as ctx:
        ctx.prec = 50
        for r in rows.sort_values("data").itertuples(index=False):
            at = []
            for way in (old, new):
                way[1] += (r.aplicado - r.resgatado) / way[0] - r.cotas_resgatadas
                way[2] += r.aplicado - r.resgatado - r.cotas_resgatadas * way[0]
                at.append(price(r.liquido + way[2], r.cotas + way[1]))
            path = r.fechado
            if path is not None and at[0] is not None and at[1] is not None:
                path = (path + at[1] - at[0]).quantize(PRICE_PLACES, ROUND_HALF_EVEN)
            out.append((r.classe_id, r.data, r.versao, path))
            old[0], new[0] = r.usado or old[0], path or new[0]
    return pd.DataFrame(out, columns=PATH)


def _next_path(inputs: DataFrame, orders: DataFrame, processed: DataFrame, used: DataFrame, closes: DataFrame) -> DataFrame:
    """The path of prices to try next. One row a class and date, whatever the number of orders."""
    taken = orders.join(processed.where("aceito").select("ordem"), "ordem", "left_semi")
    flows = closing.orders_by_close(inputs.select("classe_id", "data"), taken)
    key = ["classe_id", "data"]
    sums = {c: F.coalesce(c, F.lit(0)).cast(closing.UNITS) for c in ("aplicado", "resgatado", "cotas_resgatadas")}
    base = inputs.select(*key, (F.coalesce("valor_presente", F.lit(0)) + F.coalesce("caixa", F.lit(0)) - F.coalesce("pdd", F.lit(0))).cast(closing.UNITS).alias("liquido"),
                         F.coalesce("quantidade_cotas", F.lit(0)).cast(closing.UNITS).alias("cotas"))
    now = closes.select("classe_id", F.col("data_referencia").alias("data"), "versao", F.col("valor_cota").alias("fechado"))
    before = used.select("classe_id", F.col("data_referencia").alias("data"), F.col("valor_cota").alias("usado"))
    rows = base.join(flows, key, "left").withColumns(sums).join(now, key).join(before, key)
    return rows.groupBy("classe_id").applyInPandas(_moved, closes.select(*PATH).schema)


def _differs(a: DataFrame, b: DataFrame) -> bool:
    right = b.select("classe_id", "data_referencia", F.col("valor_cota").alias("_other"))
    return not a.join(right, ["classe_id", "data_referencia"]).where(~F.col("valor_cota").eqNullSafe(F.col("_other"))).isEmpty()


def replay_orders(inputs: DataFrame, calendar: DataFrame, orders: DataFrame, unit_ledger: DataFrame | None = None,
                  prior_closes: DataFrame | None = None, classes: DataFrame | None = None, cotistas: DataFrame | None = None) -> Replay:
    """``orders`` replayed against closes of the dates of ``inputs`` on top of ``prior_closes``.

    ``inputs`` (see ``closing.close_inputs``) holds what the ledgers have without these orders; ``unit_ledger`` gives the
    investors' balances before them.
    """
    inputs = staged(inputs, "replay-inputs")
    # what no price changes is computed once, not in every round
    known_orders = staged(with_refusals(orders, classes, cotistas), "replay-known")
    opening = None if unit_ledger is None else staged(opening_units(unit_ledger), "replay-opening")
    orders = known_orders.drop("_refused")
    closes = staged(closing.close_grid(inputs, calendar, prior_closes), "replay-closes")
    path, rounds = closes.select(*PATH), 0
    while True:
        rounds += 1
        known = path if prior_closes is None else prior_closes.select(*PATH).unionByName(path)
        processed = staged(guard_orders(known_orders, known, opening, same_day=False), "replay-orders")
        closes = staged(closing.close_grid(_with_movements(inputs, processed), calendar, prior_closes), "replay-closes")
        if not _differs(path, closes):
            return Replay(closes, processed, rounds)
        path = staged(_next_path(inputs, orders, processed, path, closes), "replay-path")
