"""Streaming ingest of boleta files as they arrive.

``readStream.csv(folder)`` -> ``foreachBatch(ingest)``. Each arriving file is its
own batch (``lote_id`` = hash of the file path) with its own line numbers and
duplicate scope; batch and stream share the same validate/ingest functions.
Outputs are partitioned by ``lote_id`` and written with dynamic partition
overwrite, so a micro-batch replayed after a failure rewrites the same
partitions: the sink is idempotent and the checkpoint gives exactly-once
effects. Staging is written first and read back, so every later step of the
batch reads the stored lines instead of the files. The batch log comes last, and
readers see the rows of logged batches only (``sources.store``).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..functions.rows import with_file_line_number
from ..operators import ingest, validation
from ..sources import sinks
from ..sources.boleta_files import CSV_OPTIONS, file_hashes, file_headers
from ..sources.store import Store

BOLETA_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in K.BOLETA_COLUMNS])


@dataclass
class StreamRefs:
    fundos: DataFrame          # fundo_id, cnpj, situacao
    classes: DataFrame         # classe_id, fundo_id, cnpj, codigo
    prior_title_keys: DataFrame  # fundo_id, identificador_externo, data_aquisicao
    prior_cedentes: DataFrame  # documento
    prior_sacados: DataFrame   # documento


def _more(prior: DataFrame, stored: DataFrame | None, columns: list[str]) -> DataFrame:
    return prior.select(*columns) if stored is None else prior.select(*columns).unionByName(stored.select(*columns))


def ingest_files(batch: DataFrame, batch_id: int, out_root: str, refs: StreamRefs) -> None:
    """One micro-batch: number lines per file, validate, ingest, write; the batch log rows of its files come last.

    What the batch needs of the store is known once its lines are staged: its own batch ids, its acquisition months, the ranges of its
    external ids and documents. They stand in the plans as literals, so a micro-batch reads its own staging
    folders, the months that it touches and the row groups that may hold its keys, however long the history is.
    """
    spark, store = batch.sparkSession, Store(batch.sparkSession, out_root)
    started = datetime.now(timezone.utc)
    raw = with_file_line_number(batch, "linha_numero", start=2, of_file={"lote_id": F.sha2("arquivo", 256)})
    files = {r["lote_id"]: r["arquivo"] for r in raw.select("lote_id", "arquivo").distinct().collect()}  # no more than a trigger takes
    if not files:
        return
    faults = {r["arquivo"]: r["falha"] for r in file_headers(spark, sorted(files.values())).where("falha is not null").collect()}
    rejected = rejected_files(spark, faults, started, batch_id)
    files = {lote: f for lote, f in files.items() if f not in faults}
    own = sorted(files)
    if not own:
        sinks.write_partitioned(rejected.coalesce(1), f"{out_root}/lote_importacao", ["batch_id"])
        return
    raw = raw.where(F.col("lote_id").isin(own))
    validated = validation.validate(validation.normalize(raw), refs.fundos, refs.classes, file_key="arquivo")
    read = Observation()
    sinks.write_staging(validated.observe(read, F.count(F.lit(1)).alias("linhas"), F.count_if("valido").alias("aceitas"), F.count_if(~F.col("valido")).alias("rejeitadas")),
                        f"{out_root}/boleta_staging", clustered=True)  # lines of a file stand where it was read
    progress(spark, out_root, batch_id, "validado", len(own), read.get)
    staged = store.lines_of(own)

    ends = {c: (F.min(c), F.max(c)) for c in ("identificador_externo", "cedente_documento", "sacado_documento")}
    month = F.substring(F.regexp_replace("data_aquisicao", "-", ""), 1, 6)  # of valid lines: ISO dates
    span = staged.where("valido").agg(F.collect_set(month).alias("meses"), *[f.alias(f"{c}_{i}") for c, fs in ends.items() for i, f in enumerate(fs)]).first()
    reach = {c: (span[f"{c}_0"] or "", span[f"{c}_1"] or "") for c in ends}
    titles = store.titles(months=span["meses"], ids=reach["identificador_externo"])
    if titles is not None:  # of earlier batches: a replayed one does not meet its own rows
        titles = titles.where(~F.col("lote_id").isin(own))
    parties = {r: store.parties(r, reach[f"{r}_documento"]) for r in ("cedente", "sacado")}
    other = F.col("lote_id") != F.lit(f"stream-{batch_id}")
    parties = {r: None if p is None else p.where(other) for r, p in parties.items()}

    result = ingest.ingest(staged, refs.fundos, refs.classes, _more(refs.prior_title_keys, titles, ingest.TITLE_KEY),
                           _more(refs.prior_cedentes, parties["cedente"], ["documento"]), _more(refs.prior_sacados, parties["sacado"], ["documento"]),
                           rebalance=tuple(sinks.TITLES_BY))
    new = Observation()
    sinks.write_titles(result.titles.observe(new, F.count(F.lit(1)).alias("inseridas")), f"{out_root}/direito_creditorio", clustered=True)
    progress(spark, out_root, batch_id, "inserido", len(own), {**read.get, **new.get})
    # what was written is read back: the search for existing titles is done once
    written = store.titles_of(own, span["meses"])
    written = result.titles.limit(0) if written is None else written
    sinks.write_cash(ingest.acquisition_cash(written), out_root)
    sinks.write_parties(result.cedentes.unionByName(result.sacados), out_root, f"stream-{batch_id}")
    log = batch_log(spark, staged, written, list(files.values()), started).withColumn("batch_id", F.lit(batch_id).cast("long"))
    sinks.write_partitioned(log.unionByName(rejected).coalesce(1), f"{out_root}/lote_importacao", ["batch_id"])  # written last: makes the batch visible


def batch_log(spark: SparkSession, staged: DataFrame, written: DataFrame, files: list[str], started: datetime) -> DataFrame:
    """Per file its summary, inserted and ignored rows, the hash of its bytes, start and end."""
    n = written.groupBy("lote_id").agg(F.count(F.lit(1)).alias("n"))
    log = validation.batch_summary(staged, ["lote_id", "arquivo"]).join(n, "lote_id", "left")
    done = F.coalesce("n", F.lit(0))
    log = log.withColumns({"registros_inseridos": done, "duplicados_ignorados": F.col("linhas_aceitas") - done}).drop("n")
    log = log.join(file_hashes(spark, files).select("arquivo", "arquivo_hash"), "arquivo", "left")
    return log.withColumns({"iniciado_em": F.lit(started), "concluido_em": F.current_timestamp(), "status": F.lit("PROCESSADO"), "motivo": F.lit(None).cast("string")})


LOG = ("lote_id string, arquivo string, linhas_total long, linhas_aceitas long, linhas_rejeitadas long, data_referencia date, fundo_cnpj string, "
       "registros_inseridos long, duplicados_ignorados long, arquivo_hash string, iniciado_em timestamp, concluido_em timestamp, status string, motivo string, batch_id long")


def rejected_files(spark: SparkSession, faults: dict[str, str], started: datetime, batch_id: int) -> DataFrame:
    """Log rows of files that are refused as a whole (S2): none of their lines is read on."""
    rows = [(None, f, 0, 0, 0, None, None, 0, 0, None, started, datetime.now(timezone.utc), "REJEITADO", why, batch_id) for f, why in sorted(faults.items())]
    return spark.createDataFrame(rows, LOG).withColumn("lote_id", F.sha2("arquivo", 256))


PROGRESS = "arquivos long, linhas long, aceitas long, rejeitadas long, inseridas long, ocorrido_em timestamp, batch_id long, etapa string"


def progress(spark: SparkSession, out_root: str, batch_id: int, step: str, n_files: int, seen: dict[str, int]) -> None:
    """How far a micro-batch has come, with what its writes observed (no job of its own reads the data again)."""
    row = (n_files, seen.get("linhas"), seen.get("aceitas"), seen.get("rejeitadas"), seen.get("inseridas"), datetime.now(timezone.utc), batch_id, step)
    sinks.write_partitioned(spark.createDataFrame([row], PROGRESS), f"{out_root}/progresso", ["batch_id", "etapa"])


def stream_ingest(spark: SparkSession, src_dir: str, out_root: str, checkpoint: str, refs: StreamRefs,
                  available_now: bool = True, max_files_per_trigger: int = 1000, quoted_breaks: bool = False) -> StreamingQuery:
    """Start the import; a trigger takes ``max_files_per_trigger`` files at most, as their names reach the driver.

    ``quoted_breaks``: see ``read_boletas``.
    """
    reader = spark.readStream.schema(BOLETA_SCHEMA).option("multiLine", quoted_breaks)
    for k, v in CSV_OPTIONS.items():
        if k != "inferSchema":
            reader = reader.option(k, v)
    reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = reader.csv(src_dir).select("*", "_metadata")
    writer = (
        src.writeStream.foreachBatch(lambda df, bid: ingest_files(df, bid, out_root, refs))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
