"""Bulk registration of funds, classes and investors.

Each request gets the message of its first failing check, in the source's
order (format, then existence, then uniqueness). A request duplicates another
when an earlier *valid* request has the same key (the earlier one would have
been inserted first), found by a partial min aggregate joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def _digits(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\D", "")


def _strip(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")


def _dedupe(df: DataFrame, key: list[str], msg: str) -> DataFrame:
    """Reject a valid request whose key already had an earlier valid request."""
    firsts = df.where(F.col("resultado").isNull()).groupBy(*key).agg(F.min("ordem").alias("_first"))
    return (
        df.join(firsts, key, "left")
        .withColumn("resultado", F.when(F.col("resultado").isNull() & (F.col("ordem") > F.col("_first")), F.lit(msg))
                    .otherwise(F.col("resultado")))
        .drop("_first")
    )


def register_investors(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests (ordem, documento, nome) -> + resultado ('OK' or message), id."""
    r = requests.withColumn("documento", _digits("documento")).withColumn("nome", _strip("nome"))
    known = existing.select(F.col("documento").alias("_known")).distinct().withColumn("_e", F.lit(True))
    r = r.join(known, F.col("documento") == F.col("_known"), "left")
    r = r.withColumn("resultado",
                     F.when(~F.length("documento").isin(11, 14), F.lit(K.MSG_COTISTA_DOC))
                     .when(F.col("nome") == "", F.lit(K.MSG_COTISTA_NOME))
                     .when(F.col("_e").isNotNull(), F.lit(K.MSG_COTISTA_DUP)))
    r = _dedupe(r.drop("_known", "_e"), ["documento"], K.MSG_COTISTA_DUP)
    return r.withColumn("resultado", F.coalesce(F.col("resultado"), F.lit("OK"))).withColumn(
        "id", F.when(F.col("resultado") == "OK", F.sha2(F.concat_ws("|", F.lit("cotista"), "documento"), 256)))


def register_funds(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Requests (ordem, cnpj, nome) -> + resultado, id."""
    r = requests.withColumn("cnpj", _digits("cnpj")).withColumn("nome", _strip("nome"))
    known = existing.select(F.col("cnpj").alias("_known")).distinct().withColumn("_e", F.lit(True))
    r = r.join(known, F.col("cnpj") == F.col("_known"), "left")
    r = r.withColumn("resultado",
                     F.when(F.length("cnpj") != 14, F.lit(K.MSG_FUNDO_CNPJ))
                     .when(F.col("nome") == "", F.lit(K.MSG_FUNDO_NOME))
                     .when(F.col("_e").isNotNull(), F.lit(K.MSG_FUNDO_DUP)))
    r = _dedupe(r.drop("_known", "_e"), ["cnpj"], K.MSG_FUNDO_DUP)
    return r.withColumn("resultado", F.coalesce(F.col("resultado"), F.lit("OK"))).withColumn(
        "id", F.when(F.col("resultado") == "OK", F.sha2(F.concat_ws("|", F.lit("fundo"), "cnpj"), 256)))


def register_classes(requests: DataFrame, funds: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (ordem, fundo_id, codigo, nome, tipo, vigencia_inicio, taxa_administracao_aa)
    -> (requests + resultado, first parameter rows of the accepted classes)."""
    r = requests.withColumn("codigo", F.upper(_strip("codigo")))
    f = funds.select(F.col("fundo_id").alias("_fid")).distinct()
    e = existing.select(F.col("fundo_id").alias("_efid"), F.col("codigo").alias("_ecod")).distinct()
    r = (
        r.join(f, F.col("fundo_id") == F.col("_fid"), "left")
        .join(e, (F.col("fundo_id") == F.col("_efid")) & (F.col("codigo") == F.col("_ecod")), "left")
        .withColumn("resultado",
                    F.when(F.col("codigo") == "", F.lit(K.MSG_CLASSE_COD))
                    .when(~F.coalesce(F.col("tipo"), F.lit("")).isin(*K.TIPOS_CLASSE), F.lit(K.MSG_CLASSE_TIPO))
                    .when(F.col("_fid").isNull(), F.lit(K.MSG_CLASSE_FUNDO))
                    .when(F.col("_efid").isNotNull(), F.lit(K.MSG_CLASSE_DUP)))
        .drop("_fid", "_efid", "_ecod")
    )
    r = _dedupe(r, ["fundo_id", "codigo"], K.MSG_CLASSE_DUP)
    r = r.withColumn("resultado", F.coalesce(F.col("resultado"), F.lit("OK"))).withColumn(
        "classe_id", F.when(F.col("resultado") == "OK", F.sha2(F.concat_ws("|", "fundo_id", "codigo"), 256)))
    params = r.where(F.col("resultado") == "OK").select(
        "classe_id", "vigencia_inicio", F.lit(None).cast("date").alias("vigencia_fim"), "taxa_administracao_aa")
    return r, params
