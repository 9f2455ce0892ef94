"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame.

Column names and types match the oracle SQL in ``oracle.py`` (integers as
BIGINT, money as DECIMAL(20,2), units/prices as DECIMAL(28,12)).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import build_calendar, with_business_days
from ..functions.params import param_asof, with_pdd_pct
from .. import constants as K
from ..operators import access, closing, ingest, ledger, orders, registry, report, valuation, validation
from ..session import staged, work_dir
from ..sources import fixtures as fx
from ..sources.boleta_files import file_headers, read_boletas
from ..sources.store import Store
from .context import MARK_DATE, POSITION_DATE, REPORT_DATE, Ctx

MONEY = T.DecimalType(20, 2)


def _longs(df: DataFrame) -> DataFrame:
    """Widen small integer columns to BIGINT so both engines agree on types."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --- calendar and lookups -----------------------------------------------------------------

def q_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business days from acquisition to maturity of every receivable."""
    c = Ctx(spark, sf_dir)
    t = with_business_days(c.titulos, "data_aquisicao", "data_vencimento", "du_total", c.calendar)
    return _longs(t.select("identificador_externo", "data_aquisicao", "data_vencimento", "du_total"))


def q_pdd_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provision percentage for the arrears of every receivable at the mark date."""
    c = Ctx(spark, sf_dir)
    d = F.lit(MARK_DATE).cast("date")
    t = c.titulos.withColumn("dias_atraso", F.greatest(F.datediff(d, F.col("data_vencimento")), F.lit(0)))
    t = with_pdd_pct(t, "dias_atraso", c.bands, "pct_pdd")
    return _longs(t.select("identificador_externo", "dias_atraso", "pct_pdd"))


def q_param_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: fee parameter in force for every class at every close date."""
    c = Ctx(spark, sf_dir)
    return param_asof(c.grid.select("classe_id", "data"), c.params) \
        .select("classe_id", "data", "vigencia_inicio", "taxa_administracao_aa")


# --- valuation -----------------------------------------------------------------------------

def q_title_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6: every eligible receivable marked at the mark date."""
    c = Ctx(spark, sf_dir)
    m = valuation.mark_titles_at(c.titulos_status, MARK_DATE, c.calendar, c.bands)
    return _longs(m.select(
        "identificador_externo", "classe_id", "data_aquisicao", "data_vencimento", "valor_face",
        "valor_aquisicao", "du_total", "du_rem", "dias_atraso", "pct_pdd", "valor_presente", "pdd", "a_receber"))


def q_class_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: class totals at every close date of the grid, in one job."""
    c = Ctx(spark, sf_dir)
    return valuation.class_marking(c.titulos_status, c.grid, c.calendar, c.bands)


# --- boleta validation and ingest -------------------------------------------------------------

def q_boleta_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the batch with its verdict."""
    c = Ctx(spark, sf_dir)
    return c.validated.select("linha_numero", *K.BOLETA_COLUMNS, "valido", "motivo_rejeicao")


def q_boleta_rejection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines of the batch."""
    return validation.rejections(Ctx(spark, sf_dir).staging)


def q_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, uniform date and fund of the batch."""
    return validation.batch_summary(Ctx(spark, sf_dir).staging)


def q_rejection_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 20 rejections by line."""
    return validation.rejection_sample(Ctx(spark, sf_dir).staging, 20)


def q_counterparty_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers and debtors to register (documents not yet known)."""
    r = Ctx(spark, sf_dir).ingest
    return r.cedentes.unionByName(r.sacados)


def q_title_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed receivables inserted by the batch (existing keys skipped)."""
    return _longs(Ctx(spark, sf_dir).ingest.titles)


def q_acquisition_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition debits per (fund, class, date) of the inserted rows."""
    return Ctx(spark, sf_dir).ingest.cash


def q_batch_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch counters including inserted rows and ignored duplicates."""
    c = Ctx(spark, sf_dir)
    return ingest.batch_result(c.staging, c.ingest.titles)


# --- ledgers, events, investors -------------------------------------------------------------------

def q_cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: cash of every class at every close date."""
    c = Ctx(spark, sf_dir)
    return ledger.cash_balance(c.grid.select("classe_id", "data"), c.movimento_caixa)


def q_unit_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: units outstanding of every class at every close date."""
    c = Ctx(spark, sf_dir)
    return ledger.unit_balance(c.grid.select("classe_id", "data"), c.cota_movimento)


def q_investor_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: positive unit positions per (class, investor) at the position date."""
    return ledger.investor_positions(Ctx(spark, sf_dir).cota_movimento, POSITION_DATE)


def q_price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: unit price applicable to every unit movement (last priced close on or before it, else par)."""
    c = Ctx(spark, sf_dir)
    keys = c.cota_movimento.select("mov_id", "classe_id", "data")
    return ledger.price_asof(keys, c.closes).select("mov_id", "classe_id", "data", "valor_cota_aplicavel")


def q_title_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current status of every receivable after its events."""
    c = Ctx(spark, sf_dir)
    status, _ = ledger.apply_title_events(c.titulos, c.eventos, partitions=c.title_partitions)
    return status.select("identificador_externo", "fundo_id", "classe_id", "data_aquisicao",
                                   "situacao", "n_eventos")


def q_event_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash receipts posted by payment and repurchase events."""
    c = Ctx(spark, sf_dir)
    _, resolved = ledger.apply_title_events(c.titulos, c.eventos, partitions=c.title_partitions)
    return ledger.event_cash(resolved)


def q_position_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investor positions valued at the applicable price, with shares of attributed units."""
    c = Ctx(spark, sf_dir)
    return ledger.position_view(c.cota_movimento, c.closes, POSITION_DATE).select(
        "classe_id", "cotista_id", "cotas", "valor_cota_aplicavel", "valor", "participacao")


# --- closing ---------------------------------------------------------------------------------

def q_close_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV, provision, unit price and return of every class at every close date."""
    return Ctx(spark, sf_dir).computed_closes


def q_close_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2-F8: the closes after the report date, computed on top of the stored ones up to it."""
    c = Ctx(spark, sf_dir)
    day = F.lit(REPORT_DATE).cast("date")
    inputs = closing.close_inputs(c.grid.where(F.col("data") > day), c.titulos_status, c.movimento_caixa,
                                  c.cota_movimento, c.params, c.calendar, c.bands)
    return closing.close_grid(inputs, c.calendar, c.closes.where(F.col("data_referencia") <= day))


def q_close_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every December closed again on top of the stored closes; the highest version of every close."""
    c = Ctx(spark, sf_dir)
    again = c.grid.where(F.month("data") == 12)
    inputs = closing.close_inputs(again, c.titulos_status, c.movimento_caixa, c.cota_movimento, c.params, c.calendar, c.bands)
    return closing.latest_versions(c.closes.unionByName(closing.close_grid(inputs, c.calendar, c.closes)))


def q_close_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of every four months closed again over a store with a missing month and corrected versions
    between the run's dates."""
    c = Ctx(spark, sf_dir)
    run = c.grid.where((F.month("data") % 4).isin(1, 2))
    inputs = closing.close_inputs(run, c.titulos_status, c.movimento_caixa, c.cota_movimento, c.params, c.calendar, c.bands)
    return closing.close_grid(inputs, c.calendar, fx.corrected_closes(c.closes))


def q_seal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 as state: status of every close after the accepted seals of the closes up to the report date."""
    c = Ctx(spark, sf_dir)
    old = c.closes.where(F.col("data_referencia") <= F.lit(REPORT_DATE).cast("date"))
    reqs = old.select(closing.close_id(old).alias("fechamento_id"), F.lit(1).alias("ordem"))
    log = closing.seal(c.closes, reqs).where(F.col("resultado") == "SELADO").select(
        "fechamento_id", F.lit(REPORT_DATE).cast("timestamp").alias("selado_em"))
    return closing.with_status(c.closes, log).select("classe_id", "data_referencia", "versao", "status",
                                                     F.col("selado_em").cast("date").alias("selado_em"))


def q_close_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the 200 newest closes."""
    return closing.list_closes(Ctx(spark, sf_dir).closes)


def q_price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit price series per class."""
    return closing.price_series(Ctx(spark, sf_dir).closes)


def q_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """latest close KPIs per class with the fund count."""
    c = Ctx(spark, sf_dir)
    return closing.overview(c.closes, c.fundos, c.classes)


# --- daily report --------------------------------------------------------------------------------

def q_report_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and NAV composition of every class at the report date."""
    c = Ctx(spark, sf_dir)
    return report.composition(c.closes, REPORT_DATE, c.titulos_status, c.calendar, c.bands, c.fundos, c.classes)


def q_report_investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investor section with the unattributed residual row."""
    c = Ctx(spark, sf_dir)
    return report.investors(c.closes, REPORT_DATE, c.cota_movimento, c.cotistas)


def q_stock_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-100 receivables by present value per class, with class totals."""
    c = Ctx(spark, sf_dir)
    s = report.stock(c.closes, REPORT_DATE, c.titulos_status, c.calendar, c.bands, 100)
    return s.select("classe_id", "data_referencia", F.col("posicao").cast("long").alias("posicao"),
                    "identificador_externo", "numero_titulo", "tipo_ativo", "data_vencimento", "valor_face", "sacado",
                    "cedente", "valor_presente", "estoque_qtd_titulos", "estoque_valorizado")


def q_receivable_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 200 receivables by maturity per class (any status)."""
    c = Ctx(spark, sf_dir)
    r = valuation.receivable_list(c.titulos_status, None, 200)
    return r.select("classe_id", F.col("posicao").cast("long").alias("posicao"), "identificador_externo",
                    "data_aquisicao", "data_vencimento", "valor_face", "valor_aquisicao", "situacao")


# --- orders, seal, registry, access -------------------------------------------------------------

def q_order_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investor orders replayed with price lookup and the redemption guard."""
    c = Ctx(spark, sf_dir)
    return orders.process_orders(fx.ordens(c.t), c.closes, c.cota_movimento, c.classes, c.cotistas)


def q_order_close_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """closes over stored ones, fed by the orders that pass the guard at these closes' own prices; new versions."""
    return Ctx(spark, sf_dir).replay.closes


def q_order_guard_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of that replay, each with the price, units and verdict that the closes before it gave."""
    return Ctx(spark, sf_dir).replay.orders


def q_seal_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seal every close twice (second is refused) and a missing version."""
    c = Ctx(spark, sf_dir)
    dec = c.closes
    cid = closing.close_id(dec)
    missing = F.sha2(F.concat_ws("|", "classe_id", "data_referencia", F.lit(2)), 256)
    reqs = (dec.select(cid.alias("fechamento_id"), F.lit(1).alias("ordem"))
            .unionByName(dec.select(cid.alias("fechamento_id"), F.lit(2).alias("ordem")))
            .unionByName(dec.select(missing.alias("fechamento_id"), F.lit(1).alias("ordem"))))
    return closing.seal(c.closes, reqs).withColumn("ordem", F.col("ordem").cast("long"))


def q_investor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register every debtor of the boleta file as an investor (bulk, with rejects)."""
    c = Ctx(spark, sf_dir)
    reqs = c.boleta_raw.select(F.col("linha_numero").alias("ordem"), F.col("sacado_documento").alias("documento"),
                               F.col("sacado_nome").alias("nome"))
    existing = fx.prior_investors(c.t)
    return registry.register_investors(reqs, existing).select("ordem", "documento", "nome", "resultado", "id")


def q_effective_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective (user, permission) pairs through the role hierarchy."""
    c = Ctx(spark, sf_dir)
    return _longs(access.effective_permissions(c.usuario_perfil, c.perfis.select("perfil_id", "perfil_pai_id"),
                                               c.perfis.select("perfil_id", "permissao")))


def q_permission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each user hold the permission of its own supplier region?"""
    c = Ctx(spark, sf_dir)
    eff = access.effective_permissions(c.usuario_perfil, c.perfis.select("perfil_id", "perfil_pai_id"),
                                       c.perfis.select("perfil_id", "permissao"))
    reqs = c.t.supplier.select(F.col("s_suppkey").alias("usuario_id"),
                               F.concat(F.lit("perm_"), (F.col("s_suppkey") % 5).cast("string")).alias("permissao"))
    return _longs(access.has_permission(reqs, eff))


# --- files and streams ------------------------------------------------------------------------------

def _lote_from_path() -> F.Column:
    return F.regexp_extract(F.col("arquivo"), r"lote=([^/]+)/", 1)


def q_boleta_csv_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1/S2/S6 + V1-V20: read many CSV files, number lines per file, validate each file."""
    c = Ctx(spark, sf_dir)
    df = read_boletas(spark, c.boleta_files)
    v = validation.validate(validation.normalize(df), c.fundos, c.classes, file_key="arquivo")
    return v.withColumn("lote", _lote_from_path()).select(
        "lote", "linha_numero", *K.BOLETA_COLUMNS, "valido", "motivo_rejeicao")


def q_boleta_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of every received file against the contract."""
    h = file_headers(spark, Ctx(spark, sf_dir).boleta_files).withColumn("lote", _lote_from_path())
    return h.select("lote", F.size("colunas").cast("long").alias("n_colunas"), F.coalesce("falha", F.lit("OK")).alias("resultado"))


def q_stream_title_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly files ingested by a file stream (availableNow); the titles of its logged batches."""
    c = Ctx(spark, sf_dir)
    store = Store(spark, f"{work_dir(spark, 'stream')}/saida")
    c.import_files(store.root)
    files = store.log().select("lote_id", "arquivo")
    return _longs(store.titles().join(files, "lote_id").withColumn("lote", _lote_from_path()).select(
        "lote", "id", "data_aquisicao", "fundo_id", "classe_id", "cedente_id", "sacado_id", "identificador_externo",
        "tipo_ativo", "numero_titulo", "numero_parcela", "total_parcelas", "data_emissao", "data_vencimento",
        "valor_face", "valor_aquisicao", "taxa_desconto_aa", "indexador", "percentual_indexador", "coobrigacao",
        "conta_liquidacao", "situacao", "mes_aquisicao"))


def q_latest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored batch log of the imported files (one batch per file), newest 100 by file; whether each row has its
    file's hash and times in order (their values are this run's own)."""
    log = Ctx(spark, sf_dir).importacao.log().withColumn("lote", _lote_from_path())
    done = (F.length("arquivo_hash") == 64) & (F.col("iniciado_em") <= F.col("concluido_em"))
    return ingest.latest_batches(log, 100, newest_first="lote", tie="lote").select(
        "lote", "linhas_total", "linhas_aceitas", "linhas_rejeitadas", "data_referencia", "fundo_cnpj", "registros_inseridos", "duplicados_ignorados", done.alias("completo"))


def q_overview_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the five newest batches of the stored log."""
    return ingest.latest_batches(q_latest_batches(spark, sf_dir), 5, newest_first="lote", tie="lote").select(
        "lote", "data_referencia", "linhas_aceitas", "linhas_rejeitadas")


def q_compacted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imported titles after their first half of months was compacted (the first quarter twice), read for two years."""
    store = Ctx(spark, sf_dir).importacao
    months = sorted(r["m"] for r in store.titles().select(F.col("mes_aquisicao").alias("m")).distinct().collect())  # a row a month
    store.compact(months[: len(months) // 2])
    store.compact(months[: len(months) // 4])
    rows = store.titles(months=[f"{y}{m:02d}" for y in (1996, 1998) for m in range(1, 13)])
    return rows.select("mes_aquisicao", "identificador_externo", "fundo_id", "classe_id", "data_aquisicao", "valor_face", "id")


def q_chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to report in one chain: the titles and acquisition debits that the import stored (titles acquired by the report
    date are read by month), with the investors' money, closed at every month end, and the report on top of these closes."""
    c = Ctx(spark, sf_dir)
    titles = c.importacao.titles(until=REPORT_DATE)
    money = c.movimento_caixa.where(F.col("tipo").isin("APORTE", "RESGATE")).select("classe_id", "data", "valor")
    cash = money.unionByName(c.importacao.cash().select("classe_id", "data", "valor"))
    grid = c.grid.where(F.col("data") <= F.lit(REPORT_DATE).cast("date"))
    inputs = closing.close_inputs(grid, titles, cash, c.cota_movimento, c.params, c.calendar, c.bands)
    closes = staged(closing.close_grid(inputs, c.calendar), "chain-closes")  # read three times by the report
    return report.composition(closes, REPORT_DATE, titles, c.calendar, c.bands, c.fundos, c.classes)


def q_receivable_status_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 200 settled receivables by maturity per class."""
    r = valuation.receivable_list(Ctx(spark, sf_dir).titulos_status, "LIQUIDADO", 200)
    return r.select("classe_id", F.col("posicao").cast("long").alias("posicao"), "identificador_externo", "data_vencimento", "valor_face", "situacao")


def q_close_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one close, asked for by its id."""
    c = Ctx(spark, sf_dir)
    asked = hashlib.sha256(f"{fx.CNPJ_BASE}|AUTOMOBILE|1998-06-30|1".encode()).hexdigest()
    return closing.get_close(c.closes, asked)


def q_overview_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the eight newest closes of every class."""
    return closing.recent_closes(Ctx(spark, sf_dir).closes)


def q_report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every class as lines of its export file."""
    c = Ctx(spark, sf_dir)
    top = report.stock(c.closes, REPORT_DATE, c.titulos_status, c.calendar, c.bands, 100)
    return report.export_lines(
        report.composition(c.closes, REPORT_DATE, c.titulos_status, c.calendar, c.bands, c.fundos, c.classes),
        report.investors(c.closes, REPORT_DATE, c.cota_movimento, c.cotistas), top)


def q_chain_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File to report in one chain: the batch is ingested, its titles get their counterparties' names from the tables
    (registered before or by this batch), are marked at the mark date, and the largest 100 of every class are listed."""
    c = Ctx(spark, sf_dir)
    r = c.ingest

    def known(role: str, new: DataFrame) -> DataFrame:
        old = c.counterparties(role).select(ingest.surrogate(F.lit(role), "documento").alias("id"), "nome")
        return old.unionByName(new.select("id", "nome"))

    named = ingest.with_names(r.titles, known("cedente", r.cedentes), known("sacado", r.sacados))
    top = valuation.stock_detail(valuation.mark_titles_at(named, MARK_DATE, c.calendar, c.bands), 100)
    return top.select("classe_id", F.col("posicao").cast("long").alias("posicao"), "identificador_externo", "numero_titulo",
                      "tipo_ativo", "data_vencimento", "sacado", "cedente", "valor_face", "valor_presente",
                      "estoque_qtd_titulos", "estoque_valorizado")


def q_implied_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual cession rate implied by face value, acquisition value and business days."""
    c = Ctx(spark, sf_dir)
    t = with_business_days(c.titulos, "data_aquisicao", "data_vencimento", "du_total", c.calendar)
    return _longs(t.select("identificador_externo", "du_total",
                           valuation.implied_rate(F.col("valor_face"), F.col("valor_aquisicao"), F.col("du_total"))
                           .alias("taxa_implicita_aa")))


def q_close_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run changed in the closes: the latest versions before it (the corrected store) against those after two of
    every four months were closed again and the closes up to the report date sealed; changed fields only."""
    c = Ctx(spark, sf_dir)
    store = fx.corrected_closes(c.closes)
    again = closing.latest_versions(store.unionByName(q_close_gap(spark, sf_dir).select(*store.columns)))
    sealed = again.where(F.col("data_referencia") <= F.lit(REPORT_DATE).cast("date")).select(
        closing.close_id(again).alias("fechamento_id"), F.lit(REPORT_DATE).cast("timestamp").alias("selado_em"))
    after = closing.with_status(again, sealed).drop("selado_em")
    key = ["classe_id", "data_referencia"]
    acao = F.when(F.array_contains("campos", "versao"), "FECHAMENTO_EXECUTADO").otherwise("FECHAMENTO_SELADO")
    cid = F.sha2(F.concat_ws("|", *key, "d.versao"), 256)
    return access.audit_changes(closing.latest_versions(store), after, key, ["versao", "status", "pl_liquido", "valor_cota", "provisao_adm_acumulada"],
                                acao, "apuracao.fechamento", cid, F.col("data_referencia")).withColumn("campos", F.concat_ws(",", "campos"))


def q_class_marking_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class totals at every close date, each title with the status that it had on that date."""
    c = Ctx(spark, sf_dir)
    _, resolved = ledger.apply_title_events(c.titulos, c.eventos, partitions=c.title_partitions)
    return valuation.class_marking(ledger.title_leaving(c.titulos, resolved), c.grid, c.calendar, c.bands, leaving="data_saida")


def q_business_days_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business days from 25 years before acquisition to 25 years after maturity, with a holiday table that ends inside."""
    c = Ctx(spark, sf_dir)
    t = c.titulos.select("identificador_externo", F.add_months("data_aquisicao", -300).alias("de"), F.add_months("data_vencimento", 300).alias("ate"))
    narrow = build_calendar(spark, "1997-01-01", "1997-12-31", fx.feriados(spark, "1990-01-01", "1999-12-31"))
    return _longs(with_business_days(t, "de", "ate", "du", narrow))


def q_investor_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every investor's unit balance at the position date (any sign)."""
    return ledger.investor_balance(Ctx(spark, sf_dir).cota_movimento, POSITION_DATE)


def q_fund_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register one fund per nation (formatted CNPJ, name); the regions' funds already exist."""
    c = Ctx(spark, sf_dir)
    n = c.t.nation
    cnpj = (F.lit(fx.CNPJ_BASE) + F.col("n_nationkey") % 7).cast("string")
    reqs = n.select(F.col("n_nationkey").cast("long").alias("ordem"),
                    F.concat(F.substring(cnpj, 1, 8), F.lit("/"), F.substring(cnpj, 9, 6)).alias("cnpj"),
                    F.when(F.col("n_nationkey") % 6 == 5, F.lit(" ")).otherwise(F.col("n_name")).alias("nome"))
    return registry.register_funds(reqs, c.fundos).select("ordem", "cnpj", "nome", "resultado", "id")


def q_class_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register each known class again under its lower-case code, plus one new code per fund."""
    c = Ctx(spark, sf_dir)
    tipo = F.when(F.col("codigo") == "AUTOMOBILE", "SENIOR").when(F.col("codigo") == "BUILDING", "MEZANINO") \
        .when(F.col("codigo") == "MACHINERY", "OUTRO").otherwise("SUBORDINADA")
    again = c.classes.select(F.col("fundo_id"), F.lower("codigo").alias("codigo"), tipo.alias("tipo"))
    new = c.fundos.select(F.col("fundo_id"), F.concat(F.lit(" nova"), F.col("fundo_id").cast("string")).alias("codigo"),
                          F.lit("SENIOR").alias("tipo"))
    # request order over the class dimension (one row per class: bounded)
    reqs = again.unionByName(new).withColumn("ordem", F.dense_rank().over(Window.orderBy("fundo_id", "codigo")).cast("long")) \
        .withColumn("nome", F.col("codigo")).withColumn("vigencia_inicio", F.lit("2026-01-01").cast("date")) \
        .withColumn("taxa_administracao_aa", F.lit("1.5").cast("decimal(9,6)"))
    res, _ = registry.register_classes(reqs, c.fundos, c.classes)
    return _longs(res.select("ordem", "fundo_id", "codigo", "tipo", "resultado", "classe_id"))


def q_title_status_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/L8 as-of variant: status of every receivable from the events on or before the mark date."""
    c = Ctx(spark, sf_dir)
    status, _ = ledger.apply_title_events(c.titulos, c.eventos, as_of=MARK_DATE, partitions=c.title_partitions)
    return status.select("identificador_externo", "fundo_id", "classe_id", "data_aquisicao", "situacao", "n_eventos")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "business_days": q_business_days,
    "pdd_band": q_pdd_band,
    "param_asof": q_param_asof,
    "title_marking": q_title_marking,
    "class_marking": q_class_marking,
    "boleta_validation": q_boleta_validation,
    "boleta_rejection_lines": q_boleta_rejection_lines,
    "batch_summary": q_batch_summary,
    "rejection_sample": q_rejection_sample,
    "counterparty_upsert": q_counterparty_upsert,
    "title_insert": q_title_insert,
    "acquisition_cash": q_acquisition_cash,
    "batch_result": q_batch_result,
    "cash_balance": q_cash_balance,
    "unit_balance": q_unit_balance,
    "investor_position": q_investor_position,
    "price_asof": q_price_asof,
    "title_status": q_title_status,
    "event_cash": q_event_cash,
    "position_view": q_position_view,
    "close_grid": q_close_grid,
    "close_incremental": q_close_incremental,
    "close_reprocess": q_close_reprocess,
    "close_gap": q_close_gap,
    "seal_status": q_seal_status,
    "close_list": q_close_list,
    "price_series": q_price_series,
    "overview": q_overview,
    "report_composition": q_report_composition,
    "report_investors": q_report_investors,
    "stock_top100": q_stock_top100,
    "receivable_list": q_receivable_list,
    "order_replay": q_order_replay,
    "order_close_replay": q_order_close_replay,
    "order_guard_replay": q_order_guard_replay,
    "seal_closes": q_seal_closes,
    "investor_registry": q_investor_registry,
    "effective_permissions": q_effective_permissions,
    "permission_check": q_permission_check,
    "boleta_csv_validation": q_boleta_csv_validation,
    "boleta_headers": q_boleta_headers,
    "stream_title_insert": q_stream_title_insert,
    "latest_batches": q_latest_batches,
    "overview_batches": q_overview_batches,
    "compacted_titles": q_compacted_titles,
    "chain_report": q_chain_report,
    "receivable_status_list": q_receivable_status_list,
    "close_by_id": q_close_by_id,
    "overview_closes": q_overview_closes,
    "report_export": q_report_export,
    "chain_stock": q_chain_stock,
    "implied_rate": q_implied_rate,
    "close_audit": q_close_audit,
    "class_marking_asof": q_class_marking_asof,
    "business_days_outside": q_business_days_outside,
    "investor_balance": q_investor_balance,
    "fund_registry": q_fund_registry,
    "class_registry": q_class_registry,
    "title_status_asof": q_title_status_asof,
}
