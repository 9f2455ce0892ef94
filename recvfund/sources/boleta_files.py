"""Boleta files: CSV reader (S1, S2, S6), file hash (S10) and a CSV writer for test batches.

Many files are read by one job; every file is its own batch (``arquivo``),
with data-row numbers starting at 2 (the header is line 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rows import with_file_line_number
from ..operators.validation import check_header

CSV_OPTIONS = {
    "sep": ";",
    "header": "true",
    "quote": '"',
    "escape": '"',            # a quote inside a quoted value is doubled
    "inferSchema": "false",   # everything is text; types are imposed by validation
    "mode": "PERMISSIVE",     # surplus fields dropped, short rows null-filled
    "encoding": "UTF-8",
}


def read_boletas(spark: SparkSession, path: str, with_lines: bool = True, quoted_breaks: bool = False) -> DataFrame:
    """All-text frame of the contract columns plus ``arquivo`` and ``linha_numero``.

    ``path`` may be a folder or glob of many files. Rows are numbered per file
    from the file scan itself (no shuffle before the numbering). With
    ``quoted_breaks``, a line break inside quotes belongs to its value; a file
    is then read by one task, many files still by many.
    """
    reader = spark.read.option("multiLine", quoted_breaks)
    for k, v in CSV_OPTIONS.items():
        reader = reader.option(k, v)
    df = reader.csv(path)
    check_header(df)
    if not with_lines:
        return df
    return with_file_line_number(df, "linha_numero", start=2)


def file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S2 per file: ``arquivo``, its header's columns and what is wrong with it (``falha``; null: nothing).

    Rows are read by position, so the contract's columns have to come first and in order; more columns may follow. Each
    task keeps the first line of the file beginnings that it reads (a partial aggregate), so one line a file is shuffled.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("_s"))
    first = lines.where("_s = 0").withColumn("_at", F.monotonically_increasing_id()).groupBy("arquivo").agg(F.min_by("value", "_at").alias("_h"))
    columns = F.transform(F.split(F.regexp_replace("_h", "^\ufeff", ""), CSV_OPTIONS["sep"]), lambda c: F.btrim(c, F.lit(' "\r')))
    contract = F.array(*[F.lit(c) for c in K.BOLETA_COLUMNS])
    missing = F.array_except(contract, F.col("colunas"))
    fault = F.when(F.size(missing) > 0, F.concat(F.lit(K.MSG_COLUNAS), F.array_join(missing, ", "))).when(
        F.slice("colunas", 1, len(K.BOLETA_COLUMNS)) != contract, F.lit(K.MSG_ORDEM_COLUNAS))
    return first.select("arquivo", columns.alias("colunas")).withColumn("falha", fault)


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SHA-256 of every file's bytes (one row per file; a file is read whole,
    bounded by ``spark.sql.sources.binaryFile.maxLength``)."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("arquivo"), F.col("length").alias("tamanho"),
        F.sha2(F.col("content"), 256).alias("arquivo_hash"))


def write_boleta_files(raw: DataFrame, path: str, file_key: str) -> None:
    """Write a boleta batch as ';' CSV files, one file per ``file_key`` value, rows in line order.

    Used to produce test batches; every file goes through the same reader as
    production input. The files are compressed (a fifth of the disk, at the fastest level), so each is read by one task.
    """
    (
        raw.repartition(file_key)
        .sortWithinPartitions(file_key, "linha_numero")
        .select(file_key, *K.BOLETA_COLUMNS)
        .write.mode("overwrite").partitionBy(file_key)
        .option("sep", ";").option("header", "true").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("quoteAll", "false").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
