from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recvfund import constants as K
from recvfund.functions.rows import with_file_line_number, with_row_number
from recvfund.operators import ingest, validation
from recvfund.sources.boleta_files import file_hashes, read_boletas
from recvfund.sources.store import Store
from recvfund.streaming.ingest_stream import StreamRefs, stream_ingest

HEADER = ";".join(K.BOLETA_COLUMNS)
ROW1 = ("ACME-2026-000101;12.345.678/0001-90;SENIOR;2026-07-23;DUPLICATA;NF-8842/1;1;3;98765432000121;"
        "Comercial Acme Ltda;11222333000181;Varejo Beta SA;2026-07-20;2026-08-22;10000.00;9720.50;18.500000;PRE;;S;CTA-LIQ-01")
ROW2 = ("ACME-2026-000102;12345678000190;SENIOR;2026-07-23;DUPLICATA;NF-8842/2;2;3;98765432000121;"
        "Comercial Acme Ltda;11222333000181;Varejo Beta SA;2026-07-20;2026-09-22;10000.00;9455.10;18.500000;PRE;;S;CTA-LIQ-01")


def dims(spark):
    fundos = spark.createDataFrame([(1, "12345678000190", "ATIVO"), (2, "99999999000199", "ENCERRADO")],
                                   "fundo_id int, cnpj string, situacao string")
    classes = spark.createDataFrame([("c1", 1, "12345678000190", "SENIOR")],
                                    "classe_id string, fundo_id int, cnpj string, codigo string")
    return fundos, classes


def write_csv(spark, name, lines):
    import tempfile

    d = tempfile.mkdtemp(prefix=f"recvfund-test-{name}-")
    with open(f"{d}/boletas.csv", "w", encoding="utf-8") as fh:
        fh.write("\n".join([HEADER, *lines]) + "\n")
    return d


def validate_lines(spark, lines):
    fundos, classes = dims(spark)
    raw = read_boletas(spark, write_csv(spark, "t", lines)).withColumn("lote_id", F.lit("L1"))
    return validation.validate(validation.normalize(raw), fundos, classes, file_key="arquivo"), fundos, classes


def test_contract_example_is_valid_and_normalised(spark):
    v, _, _ = validate_lines(spark, [ROW1, ROW2])
    rows = {r.linha_numero: r for r in v.collect()}
    assert sorted(rows) == [2, 3]
    assert all(r.valido for r in rows.values())
    assert rows[2].fundo_cnpj == "12345678000190"


def test_rules_and_duplicate_whose_first_is_invalid(spark):
    bad_first = ROW1.replace("Varejo Beta SA", "")           # line 2: invalid (sacado_nome ausente)
    lines = [bad_first, ROW1, ROW2.replace("DUPLICATA", "BOLETO"), ROW2.replace(";PRE;", ";TR;").replace("000102", "000103"),
             ROW2.replace("9455.10", "10000.01").replace("000102", "000104")]
    v, _, _ = validate_lines(spark, lines)
    got = {r.linha_numero: r.motivo_rejeicao for r in v.collect()}
    assert got[2] == K.MSG_SAC_NOME
    assert got[3] == K.MSG_DUPLICADO           # the first occurrence counts even though it is invalid
    assert got[4] == K.MSG_TIPO
    assert got[5] == K.MSG_INDEXADOR
    assert got[6] == K.MSG_VA_MAIOR


def test_missing_header_fails(spark, tmp_path):
    d = str(tmp_path)
    with open(f"{d}/x.csv", "w") as fh:
        fh.write("identificador_externo;fundo_cnpj\na;b\n")
    with pytest.raises(validation.MissingColumns, match="classe_codigo"):
        read_boletas(spark, d)


def test_reimport_inserts_nothing_and_posts_no_cash(spark):
    v, fundos, classes = validate_lines(spark, [ROW1, ROW2])
    empty_keys = spark.createDataFrame([], "fundo_id int, identificador_externo string, data_aquisicao date")
    empty_docs = spark.createDataFrame([], "documento string")
    first = ingest.ingest(v, fundos, classes, empty_keys, empty_docs, empty_docs)
    assert first.titles.count() == 2
    cash = first.cash.collect()
    assert len(cash) == 1 and cash[0].valor == Decimal("-19175.60")
    stored = first.titles.select(*ingest.TITLE_KEY)
    again = ingest.ingest(v, fundos, classes, stored, empty_docs, empty_docs)
    assert again.titles.count() == 0 and again.cash.count() == 0
    res = ingest.batch_result(v, again.titles).first()
    assert (res.linhas_aceitas, res.registros_inseridos, res.duplicados_ignorados) == (2, 0, 2)


def test_counterparty_first_line_name_wins(spark):
    v, fundos, classes = validate_lines(spark, [ROW1, ROW2.replace("Comercial Acme Ltda", "Acme Outro Nome")])
    empty = spark.createDataFrame([], "documento string")
    ced = ingest.new_counterparties(v.where("valido"), empty, "cedente").collect()
    assert [(r.documento, r.nome) for r in ced] == [("98765432000121", "Comercial Acme Ltda")]


def test_row_number_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = sorted((r.k, r.n) for r in with_row_number(df, ["k"], "n", start=2).collect())
    assert got == [(k, k + 2) for k in range(5000)]


def test_file_line_numbers_per_file(spark, tmp_path):
    d = str(tmp_path)
    for name, n in (("a.csv", 3), ("b.csv", 5)):
        with open(f"{d}/{name}", "w") as fh:
            fh.write("x\n" + "\n".join(str(i) for i in range(n)) + "\n")
    df = spark.read.option("header", "true").csv(d)
    got = sorted((r.arquivo.rsplit("/", 1)[1], int(r.x), r.linha_numero) for r in with_file_line_number(df).collect())
    assert got == [("a.csv", i, i + 2) for i in range(3)] + [("b.csv", i, i + 2) for i in range(5)]
    hashes = file_hashes(spark, d).collect()
    assert len(hashes) == 2 and all(len(h.arquivo_hash) == 64 for h in hashes)


def test_poison_values_are_rejected_or_cleared(spark):
    def line(i, face="10000.00", paid="9720.50", rate="18.5"):
        return ROW1.replace("000101", f"0002{i:02d}").replace("10000.00;9720.50;18.500000", f"{face};{paid};{rate}")

    lines = [line(1, face="NaN"), line(2, face="Infinity"), line(3, face="1e30"), line(4, face="0.001"), line(5, face="20000d"),
             line(6, paid="0.001"), line(7, rate="9999999"), line(8, rate="NaN"), line(9)]
    v, fundos, classes = validate_lines(spark, lines)
    rows = {r.linha_numero: r for r in v.collect()}
    assert [rows[k].motivo_rejeicao for k in range(2, 7)] == [K.MSG_VF] * 5 and rows[7].motivo_rejeicao == K.MSG_VA
    assert [(rows[k].valido, rows[k].taxa_desconto_aa) for k in (8, 9, 10)] == [(True, ""), (True, ""), (True, "18.5")]
    empty_keys = spark.createDataFrame([], "fundo_id int, identificador_externo string, data_aquisicao date")
    empty = spark.createDataFrame([], "documento string")
    assert ingest.ingest(v, fundos, classes, empty_keys, empty, empty).titles.count() == 3


def test_one_title_in_two_files_is_inserted_once(spark):
    v, fundos, classes = validate_lines(spark, [ROW1, ROW2])
    other = v.withColumn("arquivo", F.concat("arquivo", F.lit("-later"))).withColumn("cedente_nome", F.lit("Other")).withColumn("lote_id", F.lit("L2"))
    both = v.unionByName(other)
    empty_keys = spark.createDataFrame([], "fundo_id int, identificador_externo string, data_aquisicao date")
    empty = spark.createDataFrame([], "documento string")
    r = ingest.ingest(both, fundos, classes, empty_keys, empty, empty)
    assert [(t.identificador_externo, t.lote_id) for t in r.titles.orderBy("identificador_externo").collect()] == [("ACME-2026-000101", "L1"), ("ACME-2026-000102", "L1")]
    assert sum(c.valor for c in r.cash.collect()) == Decimal("-19175.60")
    assert [c.nome for c in r.cedentes.collect()] == ["Comercial Acme Ltda"]


def test_stream_log_has_hash_and_counters(spark, tmp_path):
    import hashlib

    fundos, classes = dims(spark)
    src = tmp_path / "in"
    src.mkdir()
    texts = {"a.csv": [ROW1, ROW2], "b.csv": [ROW1, ROW2.replace("DUPLICATA", "BOLETO")]}  # the second repeats a title of the first
    for name, rows in texts.items():
        (src / name).write_text("\n".join([HEADER, *rows]) + "\n", encoding="utf-8")
    empty = spark.createDataFrame([], "documento string")
    refs = StreamRefs(fundos, classes, spark.createDataFrame([], "fundo_id int, identificador_externo string, data_aquisicao date"), empty, empty)
    for _ in range(2):  # a second run finds nothing new
        stream_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"), refs).awaitTermination()
    log = {r.arquivo.rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out" / "lote_importacao")).collect()}
    assert {k: (r.linhas_total, r.linhas_aceitas, r.registros_inseridos, r.duplicados_ignorados) for k, r in log.items()} == {"a.csv": (2, 2, 2, 0), "b.csv": (2, 1, 0, 1)}
    assert all(r.arquivo_hash == hashlib.sha256((src / k).read_bytes()).hexdigest() and r.iniciado_em <= r.concluido_em for k, r in log.items())
    cash = spark.read.parquet(str(tmp_path / "out" / "movimento_caixa")).collect()
    assert sum(c.valor for c in cash) == Decimal("-19175.60")


# --- the store behind the stream ---------------------------------------------------------------------

@pytest.fixture
def stream(spark, tmp_path):
    """Import files by name; each call is a run of its own on the same store."""
    fundos, classes = dims(spark)
    empty = spark.createDataFrame([], "documento string")
    refs = StreamRefs(fundos, classes, spark.createDataFrame([], "fundo_id int, identificador_externo string, data_aquisicao date"), empty, empty)
    (tmp_path / "in").mkdir()

    def run(files, per_trigger=1000):
        for name, rows in files.items():
            (tmp_path / "in" / name).write_text("\n".join([HEADER, *rows]) + "\n", encoding="utf-8")
        stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), refs, max_files_per_trigger=per_trigger).awaitTermination()
        return Store(spark, str(tmp_path / "out"))

    run.refs = refs
    return run


def month_row(i, month, day=17):
    return ROW1.replace("000101", f"{i:06d}").replace("2026-07-23", f"2026-{month:02d}-{day:02d}")


def keys(rows):
    return sorted((r.identificador_externo, str(r.data_aquisicao)) for r in rows.collect())


def test_a_batch_without_its_log_row_is_invisible(spark, stream, monkeypatch):
    from recvfund.streaming import ingest_stream

    store = stream({"a.csv": [month_row(1, 3), month_row(2, 4)]})
    before = keys(store.titles())
    assert len(before) == 2 and store.cash().count() == 2 and store.parties("cedente").count() == 1
    log = ingest_stream.batch_log

    def stop(*_):
        raise RuntimeError("stopped before the log")

    monkeypatch.setattr(ingest_stream, "batch_log", stop)
    with pytest.raises(Exception, match="stopped before the log"):
        stream({"b.csv": [month_row(3, 3), month_row(1, 3), ROW2.replace("2026-07-23", "2026-03-18")]})
    raw = spark.read.parquet(f"{store.root}/direito_creditorio")
    assert raw.count() > 2  # its titles are there ...
    assert keys(store.titles()) == before and store.lines().count() == 2 and store.cash().count() == 2  # ... and nobody sees them
    assert store.log().count() == 1
    monkeypatch.setattr(ingest_stream, "batch_log", log)
    store = stream({})  # the stream goes on with the batch that stopped
    assert len(keys(store.titles())) == 4 and store.log().count() == 2
    counters = {r.arquivo.rsplit("/", 1)[1]: (r.linhas_total, r.registros_inseridos, r.duplicados_ignorados) for r in store.log().collect()}
    assert counters == {"a.csv": (2, 2, 0), "b.csv": (3, 2, 1)}
    steps = {(r.batch_id, r.etapa): (r.arquivos, r.linhas, r.aceitas, r.rejeitadas, r.inseridas) for r in spark.read.parquet(f"{store.root}/progresso").collect()}
    assert steps == {(0, "validado"): (1, 2, 2, 0, None), (0, "inserido"): (1, 2, 2, 0, 2), (1, "validado"): (1, 3, 3, 0, None), (1, "inserido"): (1, 3, 3, 0, 2)}


def scan_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(line for line in plan.splitlines() if "PartitionFilters" in line)


def test_a_micro_batch_reads_its_own_months_and_keys(spark, stream):
    store = stream({"a.csv": [month_row(i, 1 + i % 6) for i in range(12)]})
    for rows in (store.titles(months=["202603"], ids=("ACME-2026-000001", "ACME-2026-000005")), store.titles_of(["x", "y"], ["202603"]), store.titles(until="2026-02-20"), store.lines_of(["x"])):
        filters = scan_filters(rows)
        assert "mes_aquisicao" in filters.split("PushedFilters")[0] or "lote_id" in filters.split("PushedFilters")[0]
    plan = scan_filters(store.titles(months=["202603"], ids=("ACME-2026-000001", "ACME-2026-000005")))
    assert "(mes_aquisicao" in plan and "202603" in plan and "GreaterThanOrEqual(identificador_externo,ACME-2026-000001)" in plan
    assert keys(store.titles(until="2026-02-20")) == sorted((f"ACME-2026-{i:06d}", f"2026-{1 + i % 6:02d}-17") for i in range(12) if i % 6 < 2)
    many = [f"{y}{m:02d}" for y in range(1900, 2100) for m in range(1, 13)]
    assert len(keys(store.titles(months=many))) == 12 and not keys(store.titles(months=[]))


def test_compaction_changes_nothing_but_the_files(spark, stream, tmp_path, monkeypatch):
    import tempfile

    from recvfund.sources import sinks

    for n in range(4):
        store = stream({f"{n}.csv": [month_row(10 * n + i, 1 + i % 3) for i in range(6)]})
    before = keys(store.titles())
    files = lambda: sum(1 for _ in Path(store.root, "direito_creditorio").rglob("*.parquet"))
    assert len(before) == 24 and files() == 12
    used = len(store.titles(months=["202601", "202602"]).inputFiles())
    write = sinks.write_partitioned

    def stop(df, path, *a, **k):
        if path.endswith("compactacao"):
            raise RuntimeError("stopped before the log")
        write(df, path, *a, **k)

    monkeypatch.setattr(sinks, "write_partitioned", stop)
    with pytest.raises(RuntimeError):
        store.compact(["202601", "202602"])
    assert keys(store.titles()) == before  # new files, but nobody reads them
    monkeypatch.setattr(sinks, "write_partitioned", write)
    assert store.compact(["202601", "202602"]) == 0
    small = store._raw("titulos_compactos").where("geracao = 0")
    assert len(small.inputFiles()) == 2 < used and keys(store.titles()) == before
    store = stream({"later.csv": [month_row(100, 1), month_row(1, 1)], "again.csv": [month_row(0, 1), month_row(3, 1)]})  # old titles come again
    after = keys(store.titles())
    assert len(after) == len(set(after)) == 26  # 000100 and 000001 of January are new
    assert store.compact(["202601"]) == 1 and keys(store.titles()) == after
    assert keys(store.titles(months=["202601"], ids=("ACME-2026-000100", "ACME-2026-000100"))) == [("ACME-2026-000100", "2026-01-17")]
    old = store.superseded().collect()
    assert {(r.mes, r.geracao) for r in old if r.geracao is not None} == {(202601, 0)} and sum(r.geracao is None for r in old) >= 9
    lotes = {r.lote_id for r in store.titles().collect()}
    assert lotes == {r.lote_id for r in store.log().where("registros_inseridos > 0").collect()}  # the batch of a row is kept


def test_line_breaks_inside_quotes(spark, tmp_path):
    """A name over two lines is one value, in a file that is read as a batch and in one that is streamed."""
    broken = ROW1.replace("Comercial Acme Ltda", '"Comercial ""Acme""\nFilial; Sul"')
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("\n".join([HEADER, broken.replace("000101", name), ROW2.replace("000102", name + "2")]) + "\n", encoding="utf-8")
    rows = read_boletas(spark, str(tmp_path), quoted_breaks=True).collect()
    got = sorted((r.identificador_externo, r.linha_numero, r.cedente_nome) for r in rows)
    name = 'Comercial "Acme"\nFilial; Sul'
    assert got == [("ACME-2026-a.csv", 2, name), ("ACME-2026-a.csv2", 3, "Comercial Acme Ltda"), ("ACME-2026-b.csv", 2, name), ("ACME-2026-b.csv2", 3, "Comercial Acme Ltda")]
    fundos, classes = dims(spark)
    empty = spark.createDataFrame([], "documento string")
    refs = StreamRefs(fundos, classes, spark.createDataFrame([], "fundo_id int, identificador_externo string, data_aquisicao date"), empty, empty)
    stream_ingest(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "ckpt"), refs, quoted_breaks=True).awaitTermination()
    assert Store(spark, str(tmp_path / "out")).titles().count() == 4


def test_files_with_other_headers_are_refused_as_a_whole(spark, stream, tmp_path):
    store = stream({"good.csv": [month_row(1, 3)]})
    short, moved, more = tmp_path / "in" / "short.csv", tmp_path / "in" / "moved.csv", tmp_path / "in" / "more.csv"
    cols = HEADER.split(";")
    short.write_text("\n".join([";".join(cols[:-2]), month_row(2, 3)]) + "\n", encoding="utf-8")
    moved.write_text("\n".join([";".join([cols[1], cols[0], *cols[2:]]), month_row(3, 3)]) + "\n", encoding="utf-8")
    more.write_text("\n".join(["\ufeff" + ";".join([f'"{c}"' for c in cols] + ["nota"]), month_row(4, 3) + ";x"]) + "\n", encoding="utf-8")
    store = stream({})
    log = {r.arquivo.rsplit("/", 1)[1]: (r.status, r.motivo, r.linhas_total, r.registros_inseridos) for r in store.log().collect()}
    assert log == {"good.csv": ("PROCESSADO", None, 1, 1), "more.csv": ("PROCESSADO", None, 1, 1),
                   "short.csv": ("REJEITADO", K.MSG_COLUNAS + ", ".join(cols[-2:]), 0, 0), "moved.csv": ("REJEITADO", K.MSG_ORDEM_COLUNAS, 0, 0)}
    assert [k for k, _ in keys(store.titles())] == ["ACME-2026-000001", "ACME-2026-000004"]
    short.with_name("worse.csv").write_text("x;y\n1;2\n", encoding="utf-8")  # a batch of refused files only
    assert stream({}).log().where("status = 'REJEITADO'").count() == 3


def _order_tables(spark):
    """Two lines share order, line and part; one order has no lines, one line no order; keys repeat in suppliers."""
    from types import SimpleNamespace

    d = "timestamp'1997-03-01 00:00:00'"
    lines = [(o, ln, p, 1 + p % 2, float(q)) for o in (3, 1, 2, 9) for ln, p, q in ((2, 5, 1), (1, 7, 2), (2, 4, 9))]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    return SimpleNamespace(
        lineitem=frame.selectExpr("*", "l_quantity * 100 as l_extendedprice", "0.05D as l_discount", "'N' as l_returnflag", "'O' as l_linestatus", f"{d} as l_shipdate"),
        orders=spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1)], "o_orderkey long, o_custkey long").selectExpr("*", f"{d} as o_orderdate"),
        customer=spark.createDataFrame([(1, "BUILDING", "C1", 0), (2, "MACHINERY", "C2", 1)], "c_custkey long, c_mktsegment string, c_name string, c_nationkey int"),
        nation=spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        supplier=spark.createDataFrame([(1, "S1"), (2, "S2")], "s_suppkey long, s_name string"))


def test_boleta_lines_are_numbered_without_writing_the_wide_rows(spark):
    """Only a row an order is sorted across partitions and written; numbers are those of one order over all lines."""
    from recvfund.functions.rows import with_grouped_row_number
    from recvfund.sources import fixtures as fx

    t = _order_tables(spark)
    raw = fx.boleta_raw(t)
    assert "rangepartitioning" not in raw._jdf.queryExecution().executedPlan().toString()
    assert all("grupos" in f for f in raw.inputFiles())  # nothing else was written on the way
    got = [(r.linha_numero, r.numero_titulo, r.numero_parcela) for r in raw.orderBy("linha_numero").collect()]
    assert [g[0] for g in got] == list(range(2, 11))
    assert [g[2] for g in got] == ["", "2", "2"] * 3
    b = fx.base(t).select(*fx.BOLETA_ORDER)
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(with_grouped_row_number(b, fx.BOLETA_ORDER[0], fx.BOLETA_ORDER[1:], "n").collect()) == key(with_row_number(b, fx.BOLETA_ORDER, "n").collect())


def test_received_files_are_compressed(spark, tmp_path):
    from recvfund.sources.boleta_files import write_boleta_files

    rows = spark.createDataFrame([(i, f"L{i % 2}", *[f"{c}{i}" for c in K.BOLETA_COLUMNS]) for i in range(6)], ["linha_numero", "lote", *K.BOLETA_COLUMNS])
    write_boleta_files(rows, str(tmp_path / "f"), "lote")
    assert {p.suffix for p in (tmp_path / "f").glob("lote=*/part-*")} == {".gz"}
    got = {(r.lote, r.linha_numero, r.numero_titulo) for r in read_boletas(spark, str(tmp_path / "f")).collect()}
    assert got == {("L0", 2, "numero_titulo0"), ("L0", 3, "numero_titulo2"), ("L0", 4, "numero_titulo4"),
                   ("L1", 2, "numero_titulo1"), ("L1", 3, "numero_titulo3"), ("L1", 4, "numero_titulo5")}


def test_stored_tables_are_small(spark, tmp_path):
    from recvfund.session import staged
    import tempfile

    from recvfund.sources import sinks

    files = lambda root: [f for f in root.rglob("*.parquet")]
    sinks.write_partitioned(spark.range(3).withColumn("m", F.lit("x")), str(tmp_path / "t"), ["m"])
    assert files(tmp_path / "t") and all(".zstd." in f.name for f in files(tmp_path / "t"))
    path = Path(staged(spark.range(3), "small").inputFiles()[0].removeprefix("file:"))
    assert ".zstd." in path.name


def test_ids_are_hashed_after_the_shuffles(spark):
    """Hashes do not compress: no exchange of the import carries one."""
    v, fundos, classes = validate_lines(spark, [ROW1, ROW2])
    none = spark.createDataFrame([], "fundo_id int, identificador_externo string, data_aquisicao date")
    docs = spark.createDataFrame([], "documento string")
    titles = ingest.ingest(v, fundos, classes, none, docs, docs).titles
    plan = titles._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "sha2" in plan[0] and len([ln for ln in plan if "sha2" in ln]) == 1
    want = ingest.insert_new(ingest.typed_titles(v.where("valido"), fundos, classes), none)
    assert titles.columns == want.columns and sorted(map(tuple, titles.collect())) == sorted(map(tuple, want.collect()))


def test_repeated_identifiers_are_found_without_moving_the_wide_rows(spark):
    fundos, classes = dims(spark)
    n = 10_000  # several blocks of bits; every third identifier comes twice, one comes a thousand times
    line = F.col("linha_numero")
    name = F.when(line % 10 == 0, "HOT").when(line % 3 == 0, F.concat(F.lit("R"), (line % 3000).cast("string"))).otherwise(F.concat(F.lit("U"), line.cast("string")))
    good = dict(zip(K.BOLETA_COLUMNS, ROW1.split(";"), strict=True))
    raw = spark.range(2, n).withColumnRenamed("id", "linha_numero").select(
        "linha_numero", *[name.alias(c) if c == "identificador_externo" else F.lit(good[c]).alias(c) for c in K.BOLETA_COLUMNS])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        v = validation.validate(validation.normalize(raw), fundos, classes)
        assert "hashpartitioning(identificador_externo" not in v._jdf.queryExecution().executedPlan().toString()
        got = {r["linha_numero"]: r["motivo_rejeicao"] for r in v.select("linha_numero", "motivo_rejeicao").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    seen, again = set(), set()
    for i in range(2, n):
        key = "HOT" if i % 10 == 0 else f"R{i % 3000}" if i % 3 == 0 else f"U{i}"
        again |= {i} if key in seen else set()
        seen.add(key)
    assert len(got) == n - 2 and {i for i, m in got.items() if m == K.MSG_DUPLICADO} == again
    assert {m for i, m in got.items() if i not in again} == {None}


def test_lines_are_staged_and_titles_rebalanced_before_their_ids(spark):
    import tempfile

    from recvfund.sources import sinks

    d = tempfile.mkdtemp(prefix="recvfund-test-clustered-") + "/t"
    rows = spark.range(0, 100, 1, 2).select((F.col("id") >= 50).cast("int").alias("lote_id"), F.col("id").alias("linha_numero"))
    sinks.write_staging(rows, d, clustered=True)
    back = spark.read.parquet(d)
    assert back.count() == 100 and len(back.inputFiles()) == 2
    v, fundos, classes = validate_lines(spark, [ROW1, ROW2])
    none = spark.createDataFrame([], "fundo_id long, identificador_externo string, data_aquisicao date")
    parties = spark.createDataFrame([], "documento string, nome string")
    plain = ingest.ingest(v, fundos, classes, none, parties, parties).titles
    moved = ingest.ingest(v, fundos, classes, none, parties, parties, rebalance=tuple(sinks.TITLES_BY)).titles
    assert moved.columns == plain.columns and sorted(map(str, moved.collect())) == sorted(map(str, plain.collect()))
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("sha2(") < plan.index("RebalancePartitions")  # the parent stands above its child


def test_wide_sorts_follow_the_rows(spark, monkeypatch):
    """Large tables meet by order in as many partitions as their rows need, and what goes on by order does not move them again."""
    from recvfund.functions import rows
    from recvfund.sources import fixtures as fx

    t = _order_tables(spark)
    made = lambda: [sorted(map(tuple, f(t).collect()), key=repr) for f in (fx.titulos, fx.boleta_raw)]
    want = made()
    monkeypatch.setattr(rows, "DEALT_FROM", 5)
    monkeypatch.setattr(rows, "ROWS_A_PARTITION", 1)
    assert rows.partitions_for(t.lineitem) == t.lineitem.count() > 4 and made() == want
    for f in (fx.titulos, fx.boleta_raw):
        plan = f(t)._jdf.queryExecution().executedPlan().toString()
        by_order = [ln for ln in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in ln]
        assert len([ln for ln in by_order if "REPARTITION_BY_NUM" in ln]) == 1 and all(f", {t.lineitem.count()})" in ln for ln in by_order)


def test_day_reads_what_the_pattern_reads(spark):
    texts = ["2026-07-23", "2024-02-29", "2023-02-29", "1997-13-01", "0000-01-01", "0001-01-01", "9999-12-31", "+12026-07-23", "12026-07-23", "2026-7-23", "2026-07-2T",
             "2026-07-23T", "2026-07-23 10:00", "2026-07-2\x01", "2026-07-23\n", "-026-07-23", "20260723", "٢٠٢٦-٠٧-٢٣", "n/d", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.unix_date(validation.day("t")).alias("got"), F.expr("unix_date(try_to_date(t, 'yyyy-MM-dd'))").alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]
    assert rows[0].got is not None and rows[2].got is None


def test_amounts_that_are_no_numbers_are_null(spark):
    texts = ["1.50", "-1", "+2", ".5", "1e3", "NaN", "abc", "n", "Infinity", "1e30", "9" * 30, "1d", "1f", "", " 7", "٣", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", validation._fits("t", 20, 2).alias("got"), F.expr("try_cast(t as decimal(20,2))").alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_columns_of_a_file_are_computed_once_a_split(spark, tmp_path):
    for name, n in (("a", 3), ("b", 1)):
        (tmp_path / f"{name}.csv").write_text("\n".join([HEADER, *[ROW1] * n]) + "\n", encoding="utf-8")
    df = spark.read.option("header", "true").option("sep", ";").csv(str(tmp_path)).select("identificador_externo", "_metadata")
    lines = with_file_line_number(df, of_file={"lote_id": F.sha2("arquivo", 256)})
    assert "sha2" not in lines._jdf.queryExecution().optimizedPlan().toString()
    got = lines.select("arquivo", "linha_numero", (F.col("lote_id") == F.sha2("arquivo", 256)).alias("same")).collect()
    assert sorted((r.arquivo[-5:], r.linha_numero, r.same) for r in got) == [("a.csv", 2, True), ("a.csv", 3, True), ("a.csv", 4, True), ("b.csv", 2, True)]


def test_queries_set_the_limit_on_generated_methods(spark):
    from recvfund.session import exact_decimals

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        exact_decimals(spark)
        assert spark.conf.get(name) == "8000"
    finally:
        spark.conf.set(name, before)
