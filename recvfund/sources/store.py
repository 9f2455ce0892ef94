"""The stored tables of the import, read through its commit log.

Layout below a root, every write a dynamic overwrite of its own partitions:

* ``boleta_staging/lote_id=``: every line with its verdict;
* ``direito_creditorio/mes_aquisicao=/lote_id=``: titles as inserted, a folder a month and batch;
* ``titulos_compactos/mes_aquisicao=/geracao=``: titles of a month rewritten into few sorted files (``compact``);
* ``movimento_caixa/mes=/lote_id=``, ``contraparte/papel=/lote_id=``;
* ``lote_importacao/batch_id=``: a row a file, written last: a batch without its rows there does not exist for readers;
* ``compactacao/geracao=``: the (month, batch) folders that a generation replaces, written last likewise.

A reader sees the rows of logged batches only, so an import that stopped half way shows nothing. Of a compacted month it
sees the newest logged generation and the folders that no generation replaces: a compaction becomes visible by one write of
its log, with no moment when rows are missing or double, and nothing is deleted under a reader (``superseded`` lists what may go).

Months and key ranges that a reader needs are literals in the plan, so they prune partitions and row groups at the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from . import sinks

MONTHS_IN_PLAN = 1200  # a century; a wider batch prunes by its first and last month instead


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first write; any other fault of the storage is raised."""
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a folder without files
            return None
        raise


def in_months(column: Column, months: Iterable[str]) -> Column:
    """``column`` (yyyyMM, text or number) is one of ``months``: a filter that the scan takes."""
    numbers = sorted(int(m) for m in months)
    c = column.cast("int")
    if not numbers:
        return F.lit(False)
    return c.isin(numbers) if len(numbers) <= MONTHS_IN_PLAN else c.between(numbers[0], numbers[-1])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _raw(self, name: str) -> DataFrame | None:
        return read_table(self.spark, f"{self.root}/{name}")

    def log(self) -> DataFrame | None:
        """The batch log: a row a file, with counters, hash and times."""
        return self._raw("lote_importacao")

    def _logged(self, rows: DataFrame) -> DataFrame:
        """Rows of logged batches. The log has a row a file; Spark broadcasts it only below its own size limit."""
        log = self.log()
        return rows.limit(0) if log is None else rows.join(log.select("lote_id").distinct(), "lote_id", "left_semi")

    def lines_of(self, lotes: list[str]) -> DataFrame:
        """Staged lines of some batches, logged or not: the batch's own work."""
        return self._raw("boleta_staging").where(F.col("lote_id").isin(lotes))

    def lines(self) -> DataFrame | None:
        """Staged lines of all logged batches."""
        rows = self._raw("boleta_staging")
        return None if rows is None else self._logged(rows)

    def titles_of(self, lotes: list[str], months: Iterable[str]) -> DataFrame | None:
        """Titles that some batches wrote, logged or not."""
        rows = self._raw("direito_creditorio")
        return None if rows is None else self._as_written(rows.where(in_months(F.col("mes_aquisicao"), months) & F.col("lote_id").isin(lotes)))

    @staticmethod
    def _as_written(rows: DataFrame) -> DataFrame:
        return rows.withColumn("mes_aquisicao", F.col("mes_aquisicao").cast("string"))

    def _generations(self) -> tuple[DataFrame, DataFrame] | None:
        """Logged compactions: per month its newest generation, and the folders (month, batch) that are replaced."""
        log = self._raw("compactacao")
        if log is None:
            return None
        newest = log.groupBy("mes").agg(F.max("geracao").alias("geracao"))
        return newest, log.where(F.col("lote_id").isNotNull()).select("mes", "lote_id").distinct()

    def titles(self, months: Iterable[str] | None = None, until: str | date | None = None, ids: tuple[str, str] | None = None) -> DataFrame | None:
        """Titles of logged batches: of some acquisition months, acquired on or before a date, with external ids in a range."""
        raw = self._raw("direito_creditorio")
        if raw is None:
            return None
        month = F.col("mes_aquisicao")

        def cut(rows: DataFrame) -> DataFrame:
            if months is not None:
                rows = rows.where(in_months(month, months))
            if until is not None:
                day = str(until)
                rows = rows.where((month.cast("int") <= int(day[:4] + day[5:7])) & (F.col("data_aquisicao") <= F.lit(day).cast("date")))
            if ids is not None:
                rows = rows.where(F.col("identificador_externo").between(*ids))
            return rows

        rows = self._logged(cut(raw))
        compacted = self._generations()
        if compacted is not None:
            newest, replaced = compacted
            rows = rows.join(replaced, (month == F.col("mes")) & (rows["lote_id"] == replaced["lote_id"]), "left_anti")
            small = cut(self._raw("titulos_compactos"))
            small = small.join(newest, (small["mes_aquisicao"] == newest["mes"]) & (small["geracao"] == newest["geracao"]), "left_semi")
            rows = rows.unionByName(small.select(*rows.columns))
        return self._as_written(rows)

    def cash(self) -> DataFrame | None:
        rows = self._raw("movimento_caixa")
        return None if rows is None else self._logged(rows)

    def parties(self, role: str, documents: tuple[str, str] | None = None) -> DataFrame | None:
        """Counterparties that logged micro-batches registered."""
        rows, log = self._raw("contraparte"), self.log()
        if rows is None or log is None:
            return None
        rows = rows.where(F.col("papel") == role.upper())
        if documents is not None:
            rows = rows.where(F.col("documento").between(*documents))
        batches = log.select(F.concat(F.lit("stream-"), F.col("batch_id").cast("string")).alias("lote_id")).distinct()
        return rows.join(batches, "lote_id", "left_semi")

    def compact(self, months: Iterable[str]) -> int:
        """Rewrite the visible titles of some months into files sorted by fund and external id; returns the new generation.

        The new files come first, then one write of the log makes them visible. A run that stops in between leaves files that
        nobody reads; run again, it writes a new generation.
        """
        months = list(months)
        rows = self.titles(months=months)
        log = self._raw("compactacao")
        last = log.agg(F.max("geracao").alias("g")).first()["g"] if log is not None else None
        generation = 0 if last is None else last + 1
        by = ["mes_aquisicao", "geracao"]
        path = f"{self.root}/titulos_compactos"
        sinks.write_partitioned(rows.withColumn("geracao", F.lit(generation)), path, by, sort=["fundo_id", "identificador_externo"])
        # what was written tells what is replaced: batches that were logged meanwhile stay as they are
        done = self.spark.read.parquet(path).where(in_months(F.col("mes_aquisicao"), months) & (F.col("geracao") == generation))
        pairs = done.select(F.col("mes_aquisicao").cast("int").alias("mes"), "lote_id").distinct()
        sinks.write_partitioned(pairs.withColumn("geracao", F.lit(generation)).coalesce(1), f"{self.root}/compactacao", ["geracao"])
        return generation

    def superseded(self) -> DataFrame | None:
        """Folders that no reader that starts now looks into: ``mes, lote_id, geracao`` (a batch's or an old generation's)."""
        compacted = self._generations()
        if compacted is None:
            return None
        log, (newest, replaced) = self._raw("compactacao"), compacted
        old = log.select("mes", "geracao").distinct().join(newest, ["mes", "geracao"], "left_anti")
        return replaced.select("mes", "lote_id", F.lit(None).cast("int").alias("geracao")).unionByName(old.select("mes", F.lit(None).cast("string").alias("lote_id"), "geracao"))

