"""Sinks: staging by batch (S7), month-partitioned facts (S9), report CSV export (S12),
audit trail (X3).

Every write is partitioned by a business column and uses dynamic partition
overwrite, so a retried task or a re-run batch replaces exactly its own
partitions (idempotent), instead of appending duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import IngestResult, month_of
from ..session import STORED


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", sort: list[str] | None = None,
                      clustered: bool = False, **options: str) -> None:
    """Write ``df`` partitioned by ``by``, replacing only the partitions present in ``df``.

    The rows are rebalanced by those columns: small partitions share a task, and a large one is split over several. Rows that
    are ``clustered`` (each partition in few tasks, as a scan of its files or a rebalance leaves them) stay where they are.
    """
    out = df if clustered else df.hint("rebalance", *by)
    if sort:
        out = out.sortWithinPartitions(*by, *sort)  # parquet min/max then prune on the sort columns
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt)
    for k, v in ({**STORED, **options} if fmt == "parquet" else options).items():
        w = w.option(k, v)
    w.save(path)


def write_staging(validated: DataFrame, path: str, clustered: bool = False) -> None:
    """Every line with its verdict, by batch."""
    write_partitioned(validated, path, ["lote_id"], sort=["linha_numero"], clustered=clustered)


TITLES_BY = ["mes_aquisicao", "lote_id"]


def write_titles(titles: DataFrame, path: str, clustered: bool = False) -> None:
    """Receivables by acquisition month (``mes_aquisicao``), sorted by fund and external id inside, so that ranges of ids prune."""
    t = titles if "mes_aquisicao" in titles.columns else titles.withColumn("mes_aquisicao", month_of(F.col("data_aquisicao")))
    write_partitioned(t, path, TITLES_BY, sort=["fundo_id", "identificador_externo"], clustered=clustered)


def write_ingest(result: IngestResult, root: str, lote_id: str, with_staging: bool = True) -> None:
    """Persist a batch: staging, titles, cash, new counterparties. Each output is
    partitioned by the batch id, so re-running the batch replaces its own rows.
    The batch log row is written last by the caller (readers join on it)."""
    if with_staging:
        write_staging(result.staging, f"{root}/boleta_staging")
    write_titles(result.titles, f"{root}/direito_creditorio")
    write_cash(result.cash, root)
    write_parties(result.cedentes.unionByName(result.sacados), root, lote_id)


def write_cash(cash: DataFrame, root: str) -> None:
    """Cash movements by month and batch."""
    write_partitioned(cash.withColumn("mes", month_of(F.col("data"))), f"{root}/movimento_caixa", ["mes", "lote_id"])


def write_parties(parties: DataFrame, root: str, lote_id: str) -> None:
    """New counterparties by role and batch, sorted by document, so that ranges of documents prune."""
    write_partitioned(parties.withColumn("lote_id", F.lit(lote_id)), f"{root}/contraparte", ["papel", "lote_id"], sort=["documento"])


def export_report_csv(lines: DataFrame, root: str) -> None:
    """The lines of ``report.export_lines`` as ';' text files under classe_id=/data_referencia=, in order.

    A report that is too long for one task is split into several files, in order by name.
    """
    by = ["classe_id", "data_referencia"]
    (
        lines.repartitionByRange(*by, "parte", "ordem").sortWithinPartitions(*by, "parte", "ordem", "linha").select(*by, "linha")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(root)
    )


def write_audit(rows: DataFrame, path: str, action_id: str) -> None:
    """Audit records by month and action; writing an action again replaces its own records."""
    write_partitioned(rows.withColumn("acao_id", F.lit(action_id)), path, ["mes", "acao_id"])
