"""Small helpers that the operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, work_dir

#: A word of a plain text, and what stands between words: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are written to the folder the session names, and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = work_dir(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of ``columns`` has in any case (Spark does not tell cases apart), nor one another."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        out.append(next(n for i in range(len(taken) + 1) if (n := f"{name}{i or ''}").lower() not in taken))
        taken.add(out[-1].lower())
    return out


def n_shards(df: DataFrame, rows_each: int) -> int:
    """How many shards of about ``rows_each`` rows hold ``df``."""
    return max(1, -(-df.count() // rows_each))


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows; beyond that, Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
