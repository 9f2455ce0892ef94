"""Shared inputs for the registered queries: fixtures, dimensions and the close grid."""

from __future__ import annotations

import hashlib
import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import build_calendar, date_range
from ..functions.rows import dealt, partitions_for
from ..operators import closing, ingest, ledger, replay, validation
from ..session import STORED, checkpoint_dir, exact_decimals
from ..sources import fixtures as fx
from ..sources.boleta_files import write_boleta_files
from ..sources.store import Store
from ..sources.tables import Tables
from ..streaming.ingest_stream import StreamRefs, stream_ingest

# query parameters (one place, shared with the oracle SQL)
MARK_DATE = "1998-06-30"       # single-date marking / stock report
REPORT_DATE = "1998-07-15"     # daily report: resolves to the last close on or before it
POSITION_DATE = "1999-03-31"   # investor positions / price as-of
LOTE_ID = "lote-fx-0001"       # batch id of the derived boleta file


# Stored state: the domain tables (receivables, events, ledgers, staging, closes) are
# derived from the given tables once per application and written as parquet under
# the shared checkpoint folder, the way the source keeps them as database tables.
# Queries read them; each query still computes its own result from them.
_STORE: dict[tuple[str, str, str], str] = {}
_REPLAYS: dict[tuple[str, str], replay.Replay] = {}
_LOCK = threading.RLock()  # builds nest (status reads titles)


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        exact_decimals(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.t = Tables(spark, sf_dir)

    def stored_path(self, name: str, write) -> str:
        """Folder of the stored files ``name``, written by ``write(path)`` on first use."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "files:" + name)
        with _LOCK:
            path = _STORE.get(key)
            if path is None:
                tag = hashlib.sha1(f"{key[0]}|{key[1]}".encode()).hexdigest()[:12]
                path = f"{checkpoint_dir(self.spark).rstrip('/')}/recvfund-store-{tag}/{name}"
                write(path)
                _STORE[key] = path
        return path

    def stored(self, name: str, build) -> DataFrame:
        """Read the stored table ``name``, writing it from ``build()`` on first use."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        with _LOCK:
            path = _STORE.get(key)
            if path is None:
                tag = hashlib.sha1(f"{key[0]}|{key[1]}".encode()).hexdigest()[:12]
                path = f"{checkpoint_dir(self.spark).rstrip('/')}/recvfund-store-{tag}/{name}"
                build().write.mode("overwrite").options(**STORED).parquet(path)
                _STORE[key] = path
        return self.spark.read.parquet(path)

    @cached_property
    def calendar(self) -> DataFrame:
        """Every day from the first to the last date of titles, closes and the query dates."""
        def build() -> DataFrame:
            ends = date_range((self.titulos, "data_aquisicao"), (self.titulos, "data_vencimento"), (self.grid, "data"))
            start, end = min(ends[0], MARK_DATE), max(ends[1], MARK_DATE, POSITION_DATE)
            return build_calendar(self.spark, start, end, fx.feriados(self.spark, start, end))

        return self.stored("calendario", build)

    @cached_property
    def fundos(self) -> DataFrame:
        return fx.fundos(self.t)

    @cached_property
    def classes(self) -> DataFrame:
        return self.stored("classe", lambda: fx.classes(self.t))

    @cached_property
    def bands(self) -> DataFrame:
        return fx.faixas_pdd(self.spark)

    @cached_property
    def params(self) -> DataFrame:
        return fx.parametros(self.t)

    @cached_property
    def titulos(self) -> DataFrame:
        return self.stored("titulo", lambda: fx.titulos(self.t))

    @cached_property
    def eventos(self) -> DataFrame:
        return self.stored("evento", lambda: fx.eventos(self.t, self.titulos))

    @cached_property
    def title_partitions(self) -> int | None:
        return partitions_for(self.titulos)

    @cached_property
    def eventos_resolvidos(self) -> DataFrame:
        """Every recorded event with the title it names and what came of it; status and cash read it."""
        return self.stored("evento_resolvido", lambda: ledger.resolve_events(self.titulos, self.eventos, partitions=self.title_partitions))

    @cached_property
    def titulos_status(self) -> DataFrame:
        """Titles with their current status after every recorded event."""
        def build() -> DataFrame:
            n = self.title_partitions
            return ledger.title_status(self.titulos, dealt(self.eventos_resolvidos, n, *ledger.EVENT_KEY), n)

        return self.stored("titulo_status", build)

    @cached_property
    def cota_movimento(self) -> DataFrame:
        return self.stored("cota_movimento", lambda: fx.cota_movimento(self.t))

    @cached_property
    def movimento_caixa(self) -> DataFrame:
        return self.stored("movimento_caixa", lambda: fx.movimento_caixa(self.t, self.titulos, self.eventos_resolvidos, self.cota_movimento))

    @cached_property
    def grid(self) -> DataFrame:
        """(classe_id, data): every class closed at every month end, from the first acquisition to the last maturity.

        Generated per class row (no join): classes x close dates is small.
        """
        first, last = date_range((self.titulos, "data_aquisicao"), (self.titulos, "data_vencimento"))
        months = F.sequence(F.lit(first[:7] + "-01").cast("date"), F.lit(last[:7] + "-01").cast("date"),
                            F.expr("interval 1 month"))
        return self.classes.select("classe_id", "fundo_id",
                                   F.explode(F.transform(months, lambda m: F.last_day(m))).alias("data"))

    # --- boleta batch ---------------------------------------------------------------------
    @cached_property
    def boleta_raw(self) -> DataFrame:
        """The boleta file as received (text columns and line numbers)."""
        return self.stored("boleta_raw", lambda: fx.boleta_raw(self.t).withColumn("lote_id", F.lit(LOTE_ID)))

    def counterparties(self, role: str) -> DataFrame:
        """The stored table of sellers or debtors that were registered before the batch."""
        return self.stored(f"contraparte_{role}", lambda: fx.prior_counterparties(self.t, role))

    @cached_property
    def validated(self) -> DataFrame:
        """Computed validation of the batch (what ``boleta_validation`` returns)."""
        return validation.validate(validation.normalize(self.boleta_raw), self.fundos, self.classes)

    @cached_property
    def staging(self) -> DataFrame:
        """The stored staging table: the batch with its verdicts, as written by the import."""
        return self.stored("boleta_staging", lambda: self.validated)

    @cached_property
    def boleta_files(self) -> str:
        """Folder of the received files: the derived batch as one ';' CSV file per acquisition month."""
        raw = self.boleta_raw.withColumn("lote", F.concat(F.lit("L"), F.substring("data_aquisicao", 1, 7)))
        return self.stored_path("boleta_arquivos", lambda path: write_boleta_files(raw, path, "lote"))

    def import_files(self, root: str) -> None:
        """Run the file stream over the received files into the tables below ``root``."""
        refs = StreamRefs(self.fundos, self.classes, fx.prior_title_keys(self.titulos), self.counterparties("cedente").select("documento"),
                          self.counterparties("sacado").select("documento"))
        stream_ingest(self.spark, self.boleta_files, root, f"{root}-checkpoint", refs).awaitTermination()

    @cached_property
    def importacao(self) -> Store:
        """The stored tables of an import of all received files, run once per application."""
        return Store(self.spark, self.stored_path("importacao", self.import_files))

    @cached_property
    def ingest(self) -> "ingest.IngestResult":
        return ingest.ingest(self.staging, self.fundos, self.classes, fx.prior_title_keys(self.titulos),
                             self.counterparties("cedente"), self.counterparties("sacado"))

    # --- closes -----------------------------------------------------------------------------
    @cached_property
    def cotistas(self) -> DataFrame:
        return fx.cotistas(self.t)

    @cached_property
    def computed_closes(self) -> DataFrame:
        """Every class closed at every grid date (version 1, no prior closes)."""
        inputs = closing.close_inputs(self.grid, self.titulos_status, self.movimento_caixa, self.cota_movimento,
                                      self.params, self.calendar, self.bands)
        return closing.close_grid(inputs, self.calendar)

    @cached_property
    def closes(self) -> DataFrame:
        """The stored closes table (apuracao.fechamento)."""
        return self.stored("fechamento", lambda: self.computed_closes)

    @cached_property
    def replay(self) -> "replay.Replay":
        """Closes after the report date made again over the stored ones, with the orders after it; run once per application."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        with _LOCK:
            if key not in _REPLAYS:
                day = F.lit(REPORT_DATE).cast("date")
                inputs = closing.close_inputs(self.grid.where(F.col("data") > day), self.titulos_status, self.movimento_caixa, self.cota_movimento,
                                              self.params, self.calendar, self.bands)
                _REPLAYS[key] = replay.replay_orders(inputs, self.calendar, fx.ordens(self.t).where(F.col("data") > day), self.cota_movimento,
                                                     self.closes, self.classes, self.cotistas)
        return _REPLAYS[key]

    # --- access review ----------------------------------------------------------------------
    @cached_property
    def perfis(self) -> DataFrame:
        return fx.perfis(self.t)

    @cached_property
    def usuario_perfil(self) -> DataFrame:
        return fx.usuario_perfil(self.t)
