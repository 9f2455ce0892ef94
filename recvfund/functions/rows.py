"""Row numbering without funnelling rows through one task.

A global ``row_number() over (order by ...)`` puts every row in a single
partition. Here the rows are range-partitioned by the order (a distributed
sort), each partition counts its rows, the per-partition counts (one row per
partition) are prefix-summed, and every row adds its partition's offset to its
position inside the partition. This is the DataFrame form of ``zipWithIndex``.

The partition ids must be identical in the counting branch and the numbering
branch. Rows coming out of a shuffle have no stable order, so re-running the
range partitioning could sample different bounds; the tagged rows are therefore
materialised once with a reliable ``checkpoint()`` (written to the cluster's
shared checkpoint folder, so a lost executor does not lose them). Inputs that
are plain file scans are already deterministic and can skip it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, staged

_POS_BITS = 33  # monotonically_increasing_id = (partition << 33) + position
#: Tables of so many rows are dealt into partitions of so many rows each, which a task sorts in memory; smaller ones are left to Spark.
DEALT_FROM, ROWS_A_PARTITION = 2_000_000, 200_000


def partitions_for(table: DataFrame) -> int | None:
    """How many partitions ``table`` is dealt into; None where that is left to Spark, which merges partitions by their compressed
    bytes, whatever a task has to sort. ``table`` is one as stored: its rows are counted without reading columns."""
    rows = table.count()
    if rows < DEALT_FROM:
        return None
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PARTITION))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` in ``n`` partitions by ``keys`` (see ``partitions_for``), which joins and groups by them then take as they are."""
    return df if n is None else df.repartition(n, *keys)


def _number(tagged: DataFrame, out: str, start: int) -> DataFrame:
    # one row per partition: bounded by the partition count, not the data
    counts = tagged.groupBy("_rn_pid").agg(F.count(F.lit(1)).alias("_rn_n"))
    w = Window.orderBy("_rn_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rn_pid", F.coalesce(F.sum("_rn_n").over(w), F.lit(0)).alias("_rn_off"))
    pos = F.col("_rn_mid") - F.shiftleft(F.col("_rn_pid").cast("long"), _POS_BITS)
    return (
        tagged.join(F.broadcast(offsets), "_rn_pid")
        .withColumn(out, (F.col("_rn_off") + pos + F.lit(start)).cast("long"))
        .drop("_rn_pid", "_rn_mid", "_rn_off")
    )


def with_row_number(df: DataFrame, order_cols: list, out: str = "row_number", start: int = 1,
                    deterministic_input: bool = False) -> DataFrame:
    """Dense, gap-free row number over a total order ``order_cols`` (must be unique)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_rn_pid", F.spark_partition_id())
        .withColumn("_rn_mid", F.monotonically_increasing_id())
    )
    if not deterministic_input:
        checkpoint_dir(df.sparkSession)
        tagged = tagged.checkpoint(eager=True)
    return _number(tagged, out, start)


def with_grouped_row_number(df: DataFrame, group: str, order_cols: list, out: str = "row_number", start: int = 1) -> DataFrame:
    """Dense, gap-free row number over ``(group, *order_cols)`` for groups that fit a task (the lines of an order).

    Rows are numbered inside their group and moved by the rows of the groups before it. Only a row a group is sorted across
    partitions and written; the rows themselves are shuffled by ``group`` alone, which their last join may have done already.
    ``df`` is read twice, the first time for ``group`` only, which must not be null.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = staged(  # written once: bounds that are sampled again could differ
        df.groupBy(group).agg(F.count(F.lit(1)).alias("_rn_n")).repartitionByRange(n, group).withColumn("_rn_pid", F.spark_partition_id()), "grupos")
    ranges = counts.groupBy("_rn_pid").agg(F.sum("_rn_n").alias("_rn_all"))  # a row a partition
    before = Window.orderBy("_rn_pid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_rn_pid", F.coalesce(F.sum("_rn_all").over(before), F.lit(0)).alias("_rn_off"))
    inside = Window.partitionBy("_rn_pid").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_rn_pid", F.coalesce(F.sum("_rn_n").over(inside), F.lit(0)).alias("_rn_in"))
    offsets = offsets.join(F.broadcast(ranges), "_rn_pid").select(group, (F.col("_rn_in") + F.col("_rn_off")).alias("_rn_off"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order_cols))
    return (
        df.withColumn("_rn_in", rank).join(offsets, group)
        .withColumn(out, (F.col("_rn_off") + F.col("_rn_in") + F.lit(start - 1)).cast("long")).drop("_rn_in", "_rn_off")
    )


def with_file_line_number(df: DataFrame, out: str = "linha_numero", start: int = 2, of_file: dict[str, Column] | None = None) -> DataFrame:
    """Per-file data-row number for rows read straight from files (no shuffle before).

    A file split is read in file order inside one task, so the position inside
    the split is ``monotonically_increasing_id`` minus the split's first id; the
    split's offset is the row count of the earlier splits of the same file.
    The tagged rows are staged as parquet first, so the files are read once:
    the splits are counted from two narrow columns, and whatever comes later
    reads the staged rows. One row per split is joined back, with ``of_file``: columns
    computed from ``arquivo`` once a split instead of once a line.
    """
    tagged = staged(
        df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"))
        .drop("_metadata").withColumn("_rn_mid", F.monotonically_increasing_id()),
        "linhas")
    splits = tagged.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_rn_mid").alias("_m0"))
    w = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # a row a split, written first: Spark then knows its size and broadcasts it below its own limit
    offs = splits.select(F.col("_f").alias("arquivo"), "_s", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    offs = staged(offs.withColumns(of_file or {}), "partes")
    return (
        tagged.withColumnRenamed("_f", "arquivo").join(offs, ["arquivo", "_s"])
        .withColumn(out, (F.col("_off") + F.col("_rn_mid") - F.col("_m0") + F.lit(start)).cast("long"))
        .drop("_s", "_rn_mid", "_m0", "_off")
    )
