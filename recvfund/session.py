"""Session helpers: one place for the confs the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Decimal division must keep scale: decimal(20,2) / decimal(28,12) is decimal(38,8)
# under the default rules, too coarse for a 12-dp unit price. With precision loss
# disallowed it is decimal(38,19), and ANSI mode errors on overflow instead of
# silently truncating.
EXACT_DECIMALS = {"spark.sql.decimalOperations.allowPrecisionLoss": "false"}

# The JVM never compiles a method of more than 8,000 bytes of bytecode, and the wide boleta lines give one method far above
# that, which is then interpreted for every line. Under this limit Spark runs such a stage as projections in small methods.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(master: str | None = None, app: str = "recvfund", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("RECVFUND_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**EXACT_DECIMALS, **COMPILED, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def exact_decimals(spark: SparkSession) -> None:
    """Apply the decimal rule, and the limit on generated methods, on a session we did not build (e.g. the driver's)."""
    for k, v in {**EXACT_DECIMALS, **COMPILED}.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the session (``spark.checkpoint.dir`` or the context's directory).
    Only when neither is set and the master is local (tests) a private folder is
    created; on a cluster, whose executors would not see it, that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="recvfund-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


#: Stored and staged tables: about a third smaller than with Spark's own choice.
STORED = {"compression": "zstd"}


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as parquet and read back: its source is read once, later steps read columns."""
    path = work_dir(df.sparkSession, name)
    df.write.options(**STORED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system that ``path`` names has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, under the shared checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/recvfund-{name}-{uuid.uuid4().hex[:12]}"
