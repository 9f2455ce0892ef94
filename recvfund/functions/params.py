"""Effective-dated parameter lookup (C4) and provision bands."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

FEE = T.DecimalType(9, 6)
PCT = T.DecimalType(6, 4)


def param_asof(keys: DataFrame, params: DataFrame, key: str = "classe_id", date: str = "data") -> DataFrame:
    """C4: for each (key, date) the row with the latest start <= date whose end is open or >= date.

    The parameter table has one row per class and effective period. Adds ``vigencia_inicio`` and ``taxa_administracao_aa``
    (0 when no row applies).
    """
    p = params.select(
        F.col("classe_id").alias("_p_key"), F.col("vigencia_inicio").alias("_p_ini"),
        F.col("vigencia_fim").alias("_p_fim"), F.col("taxa_administracao_aa").alias("_p_taxa"),
    )
    cond = (
        (F.col(key) == F.col("_p_key")) & (F.col("_p_ini") <= F.col(date))
        & (F.col("_p_fim").isNull() | (F.col("_p_fim") >= F.col(date)))
    )
    kd = keys.select(key, date).distinct()
    best = (
        kd.join(p, cond, "inner")
        .groupBy(key, date)
        .agg(F.max_by(F.struct("_p_ini", "_p_taxa"), F.col("_p_ini")).alias("_p"))
        .select(key, date, F.col("_p._p_ini").alias("vigencia_inicio"), F.col("_p._p_taxa").alias("taxa_administracao_aa"))
    )
    return (
        keys.join(best, [key, date], "left")
        .withColumn("taxa_administracao_aa", F.coalesce(F.col("taxa_administracao_aa"), F.lit(0).cast(FEE)))
    )


def with_pdd_pct(df: DataFrame, days_col: str, bands: DataFrame, out: str = "pct_pdd") -> DataFrame:
    """Percentage of the highest band whose minimum <= days, else 0.

    The band table (7 rows of configuration) is read once and becomes one CASE
    expression, so no title is joined with anything.
    """
    return df.withColumn(out, pdd_pct_expr(F.col(days_col), band_rows(bands)))


def band_rows(bands: DataFrame) -> list[tuple[int, Decimal]]:
    """The band table on the driver, by minimum."""
    return [(r["dias_atraso_min"], r["percentual"]) for r in bands.orderBy("dias_atraso_min").collect()]


def band_list(bands=None) -> list[tuple[int, Decimal]]:
    """The bands as Python values, for expressions that unroll them."""
    src = bands if bands is not None else K.PDD_BANDS
    return [(int(d), Decimal(str(p))) for d, p, *_ in src]


def pdd_pct_expr(days: Column, bands=None) -> Column:
    """C5 as a CASE expression over bands in ascending order."""
    expr = F.lit(0).cast(PCT)
    for d, p in band_list(bands):
        expr = F.when(days >= d, F.lit(p).cast(PCT)).otherwise(expr)
    return expr
