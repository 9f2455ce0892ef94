"""Set-based persistence of a validated batch.

Surrogate ids are deterministic hashes of business keys, so a retried task
or a re-run batch produces the same ids (never ``uuid()``). The idempotency
anti-join takes whatever part of the store the caller hands in: the stream
reads the batch's acquisition months and key ranges only (``sources.store``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .validation import day

MONEY = T.DecimalType(20, 2)
TITLE_KEY = ["fundo_id", "identificador_externo", "data_aquisicao"]


def surrogate(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def month_of(d: Column) -> Column:
    return F.date_format(d, "yyyyMM")


def _place(rows: DataFrame) -> Column:
    """A line's place in its batch: by file, if there are several, then by line."""
    return F.struct(*[F.col(c) for c in ("arquivo", "linha_numero") if c in rows.columns])


def new_counterparties(valid: DataFrame, existing: DataFrame, role: str) -> DataFrame:
    """Documents of valid rows not yet registered; the name of the first line (of the first file) wins."""
    doc, name = f"{role}_documento", f"{role}_nome"
    firsts = valid.groupBy(F.col(doc).alias("documento")).agg(F.min_by(F.col(name), _place(valid)).alias("nome"))
    return (
        firsts.join(existing.select("documento"), "documento", "left_anti")
        .select(F.lit(role.upper()).alias("papel"), "documento", "nome",
                surrogate(F.lit(role), "documento").alias("id"))
    )


#: Columns of ``typed_titles``, with the surrogate ids that come from others.
TITLE_COLUMNS = [
    "_place", "data_aquisicao", "fundo_id", "classe_id", "lote_id", "cedente_id", "sacado_id", "identificador_externo", "tipo_ativo",
    "numero_titulo", "numero_parcela", "total_parcelas", "data_emissao", "data_vencimento", "valor_face", "valor_aquisicao",
    "taxa_desconto_aa", "indexador", "percentual_indexador", "coobrigacao", "conta_liquidacao", "situacao", "id", "mes_aquisicao"]


def typed_titles(valid: DataFrame, fundos: DataFrame, classes: DataFrame) -> DataFrame:
    """Resolve fund and class and cast text to typed columns; ``_place`` is the line's place in the batch.

    Casts are tried, not forced: validation has cleared what does not fit, and one odd line never ends a batch.
    """
    return with_ids(_typed(valid, fundos, classes)).select(*TITLE_COLUMNS)


def with_ids(typed: DataFrame) -> DataFrame:
    """Surrogate ids of titles and their counterparties. Hashes do not compress, so they come after the shuffles."""
    return typed.withColumns({
        "cedente_id": surrogate(F.lit("cedente"), "cedente_documento"),
        "sacado_id": surrogate(F.lit("sacado"), "sacado_documento"),
        "id": surrogate("fundo_id", "identificador_externo", "data_aquisicao"),
        "mes_aquisicao": month_of(F.col("data_aquisicao")),
    }).drop("cedente_documento", "sacado_documento")


def _typed(valid: DataFrame, fundos: DataFrame, classes: DataFrame) -> DataFrame:
    f = fundos.select(F.col("fundo_id"), F.col("cnpj").alias("_fcnpj"))
    c = classes.select(F.col("classe_id"), F.col("fundo_id").alias("_cfundo"), F.col("codigo").alias("_ccod"))

    def blank_null(name: str) -> Column:
        return F.when(F.col(name) == "", None).otherwise(F.col(name))

    return (
        valid.join(f, F.col("fundo_cnpj") == F.col("_fcnpj"))
        .join(c, (F.col("_cfundo") == F.col("fundo_id")) & (F.col("_ccod") == F.col("classe_codigo")))
        .select(
            _place(valid).alias("_place"),
            day("data_aquisicao").alias("data_aquisicao"),
            "fundo_id", "classe_id", "lote_id",
            "cedente_documento", "sacado_documento",
            "identificador_externo", "tipo_ativo", "numero_titulo",
            F.coalesce(F.expr("try_cast(nullif(numero_parcela, '') as smallint)"), F.lit(1).cast("smallint"))
            .alias("numero_parcela"),
            F.coalesce(F.expr("try_cast(nullif(total_parcelas, '') as smallint)"), F.lit(1).cast("smallint"))
            .alias("total_parcelas"),
            day("data_emissao").alias("data_emissao"),
            day("data_vencimento").alias("data_vencimento"),
            F.col("valor_face").try_cast(MONEY).alias("valor_face"),
            F.col("valor_aquisicao").try_cast(MONEY).alias("valor_aquisicao"),
            blank_null("taxa_desconto_aa").try_cast(T.DecimalType(12, 6)).alias("taxa_desconto_aa"),
            F.coalesce(blank_null("indexador"), F.lit("PRE")).alias("indexador"),
            blank_null("percentual_indexador").try_cast(T.DecimalType(9, 4)).alias("percentual_indexador"),
            F.upper(F.coalesce(blank_null("coobrigacao"), F.lit("N"))).isin(*K.COOBRIGACAO_TRUE).alias("coobrigacao"),
            blank_null("conta_liquidacao").alias("conta_liquidacao"),
            F.lit("ATIVO").alias("situacao"),
        )
    )


def insert_new(typed: DataFrame, store_keys: DataFrame) -> DataFrame:
    """I4: rows whose (fund, id, acquisition date) is not in the store yet; of a key that comes more than once in the
    batch (in several files), the first line. Keys that repeat are found by a partial aggregate and joined back alone.
    """
    firsts = typed.groupBy(*TITLE_KEY).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_times"))
    firsts = firsts.where(F.col("_times") > 1).drop("_times")
    one = typed.join(firsts, TITLE_KEY, "left").where(F.col("_first").isNull() | (F.col("_place") == F.col("_first")))
    return one.join(store_keys.select(*TITLE_KEY), TITLE_KEY, "left_anti").drop("_place", "_first")


def acquisition_cash(inserted: DataFrame) -> DataFrame:
    """One debit per (fund, class, date) of the inserted rows; nothing when none."""
    return (
        inserted.groupBy("fundo_id", "classe_id", "data_aquisicao", "lote_id")
        .agg((-F.sum("valor_aquisicao")).cast(MONEY).alias("valor"))
        .select("fundo_id", "classe_id", F.col("data_aquisicao").alias("data"), F.lit("AQUISICAO_DC").alias("tipo"),
                "valor", F.lit("Aquisição de recebíveis (lote)").alias("descricao"), "lote_id")
    )


@dataclass
class IngestResult:
    titles: DataFrame        # inserted titles
    cash: DataFrame          # acquisition debits
    cedentes: DataFrame      # new sellers
    sacados: DataFrame       # new debtors
    staging: DataFrame       # every line with its verdict


def ingest(validated: DataFrame, fundos: DataFrame, classes: DataFrame, store_keys: DataFrame,
           cedentes: DataFrame, sacados: DataFrame, rebalance: tuple[str, ...] = ()) -> IngestResult:
    """I1-I5 for a validated batch (lazy; write with ``sinks.write_ingest``). Titles that are to be written by some columns
    are rebalanced by them here, before their ids are hashed."""
    valid = validated.where(F.col("valido"))
    new = insert_new(_typed(valid, fundos, classes), store_keys)
    if rebalance:
        new = new.withColumn("mes_aquisicao", month_of(F.col("data_aquisicao"))).hint("rebalance", *rebalance)
    inserted = with_ids(new)
    inserted = inserted.select(*TITLE_KEY, *[c for c in TITLE_COLUMNS[1:] if c not in TITLE_KEY])
    return IngestResult(
        titles=inserted,
        cash=acquisition_cash(inserted),
        cedentes=new_counterparties(valid, cedentes, "cedente"),
        sacados=new_counterparties(valid, sacados, "sacado"),
        staging=validated,
    )


def batch_result(validated: DataFrame, inserted: DataFrame) -> DataFrame:
    """Totals plus inserted rows and ignored duplicates (accepted - inserted)."""
    # one aggregate over both inputs (no join between single-row results)
    v = validated.select(F.lit(1).alias("_t"), F.col("valido").cast("long").alias("_a"), F.lit(0).alias("_i"))
    i = inserted.select(F.lit(0).alias("_t"), F.lit(0).cast("long").alias("_a"), F.lit(1).alias("_i"))
    return (
        v.unionByName(i)
        .agg(F.sum("_t").cast("long").alias("linhas_total"), F.sum("_a").cast("long").alias("linhas_aceitas"),
             F.sum("_i").cast("long").alias("registros_inseridos"))
        .withColumn("linhas_rejeitadas", F.col("linhas_total") - F.col("linhas_aceitas"))
        .withColumn("duplicados_ignorados", F.col("linhas_aceitas") - F.col("registros_inseridos"))
    )


def batch_log(validated: DataFrame, inserted: DataFrame, by: str = "lote_id") -> DataFrame:
    """One row a batch: the summary with inserted rows and ignored duplicates."""
    from .validation import batch_summary

    n = inserted.groupBy(F.col("lote_id").alias("_lote")).agg(F.count(F.lit(1)).alias("_n"))
    log = batch_summary(validated, [by]).join(n, F.col(by) == F.col("_lote"), "left")
    done = F.coalesce("_n", F.lit(0))
    return log.withColumns({"registros_inseridos": done, "duplicados_ignorados": F.col("linhas_aceitas") - done}).drop("_lote", "_n")


def with_names(titles: DataFrame, cedentes: DataFrame, sacados: DataFrame) -> DataFrame:
    """M8: ``cedente`` and ``sacado`` names of ingested titles, from the counterparty tables (id, nome)."""
    ced = cedentes.select(F.col("id").alias("_ced"), F.col("nome").alias("cedente"))
    sac = sacados.select(F.col("id").alias("_sac"), F.col("nome").alias("sacado"))
    return titles.join(ced, F.col("cedente_id") == F.col("_ced"), "left").join(sac, F.col("sacado_id") == F.col("_sac"), "left").drop("_ced", "_sac")


def latest_batches(lotes: DataFrame, n: int = 100, newest_first: str = "iniciado_em", tie: str = "lote_id") -> DataFrame:
    """Newest ``n`` batches (top-n, TakeOrderedAndProject)."""
    return lotes.orderBy(F.col(newest_first).desc(), F.col(tie)).limit(n)
