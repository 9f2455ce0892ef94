"""Domain tables derived from the driver's TPC-H-like parquet.

Each function is a lazy DataFrame over the given tables, so its size grows with
them. Regions act as funds, market segments as share classes, lineitems as
receivables, orders as unit subscriptions/redemptions, events as investor
orders, and the nation tree as the role hierarchy. The DuckDB oracle builds the
same views in SQL (``recvfund.plans.oracle``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.rows import dealt, partitions_for, with_grouped_row_number
from ..operators import ledger
from .tables import Tables

CNPJ_BASE = 10000000000000  # 14-digit document base


def _doc(col) -> F.Column:
    return (F.lit(CNPJ_BASE) + col).cast("string")


def fundos(t: Tables) -> DataFrame:
    """One fund per region; region 4 is a closed fund."""
    r = t.region
    return r.select(
        F.col("r_regionkey").alias("fundo_id"),
        _doc(F.col("r_regionkey")).alias("cnpj"),
        F.col("r_name").alias("nome"),
        F.when(F.col("r_regionkey") == 4, "ENCERRADO").otherwise("ATIVO").alias("situacao"),
    )


def classes(t: Tables) -> DataFrame:
    """One class per (fund, market segment) that has customers in the fund's region.

    Fund 3 has no FURNITURE class (so one class id in the receivables is unknown).
    """
    pairs = (
        t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_regionkey").alias("fundo_id"), F.col("c_mktsegment").alias("codigo"))
        .distinct()
    )
    f = fundos(t)
    return (
        pairs.join(F.broadcast(f), "fundo_id")  # 5 regions: fixed size
        .where(~((F.col("fundo_id") == 3) & (F.col("codigo") == "FURNITURE")))
        .select(
            F.concat_ws("|", "cnpj", "codigo").alias("classe_id"),
            "fundo_id", "cnpj", "codigo", F.concat(F.lit("Cota "), F.col("codigo")).alias("nome"),
            F.when(F.col("codigo") < "C", "SENIOR").when(F.col("codigo") < "H", "MEZANINO").otherwise("SUBORDINADA").alias("tipo"),
        )
    )


def faixas_pdd(spark: SparkSession) -> DataFrame:
    """Provision bands (7 rows of business configuration)."""
    schema = T.StructType([
        T.StructField("dias_atraso_min", T.IntegerType(), False),
        T.StructField("percentual", T.DecimalType(6, 4), False),
        T.StructField("rating", T.StringType(), False),
    ])
    rows = [(d, Decimal(p), r) for d, p, r in K.PDD_BANDS]
    return spark.createDataFrame(rows, schema)


#: A choice of this fixture: holidays on the same day of every year, so that all years of the data have some.
FIXTURE_HOLIDAYS_MMDD = ["01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "11-20", "12-25"]


def feriados(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Holiday table: the fixture's days of every year of the range, and the dates the source is seeded with."""
    years = spark.range(int(start[:4]), int(end[:4]) + 1).select(F.col("id").cast("string").alias("ano"))
    yearly = years.select(F.explode(F.array(*[F.concat("ano", F.lit("-" + x)).cast("date") for x in FIXTURE_HOLIDAYS_MMDD])).alias("data"))
    seeded = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("date") for x in K.SEEDED_HOLIDAYS])).alias("data"))
    return yearly.unionByName(seeded).distinct()


def parametros(t: Tables) -> DataFrame:
    """Two effective-dated fee rows per class: 1.5 % p.a. up to 1998, 2.0 % from 1999."""
    c = classes(t).select("classe_id")
    dec = T.DecimalType(9, 6)
    first = c.select(
        "classe_id",
        F.lit("1990-01-01").cast("date").alias("vigencia_inicio"),
        F.lit("1998-12-31").cast("date").alias("vigencia_fim"),
        F.lit("1.5").cast(dec).alias("taxa_administracao_aa"),
    )
    second = c.select(
        "classe_id",
        F.lit("1999-01-01").cast("date").alias("vigencia_inicio"),
        F.lit(None).cast("date").alias("vigencia_fim"),
        F.lit("2.0").cast(dec).alias("taxa_administracao_aa"),
    )
    return first.unionByName(second)


def base(t: Tables) -> DataFrame:
    """Lineitems enriched with order, customer, nation and supplier columns.

    Orders meet their customers first and suppliers join the narrow lineitems, so that the join by order comes last: its
    shuffle by order also serves what goes on by order. Its partitions are as many as the lineitems need for their sorts.
    """
    li = t.lineitem
    n_parts = partitions_for(li)
    o = t.orders.select("o_orderkey", "o_orderdate", "o_custkey")
    c = t.customer.select("c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_regionkey")
    s = t.supplier.select("s_suppkey", "s_name")
    vf = F.col("l_extendedprice").cast(T.DecimalType(18, 2))
    disc = F.col("l_discount").cast(T.DecimalType(4, 2))
    sold = (
        o.join(c, F.col("c_custkey") == F.col("o_custkey"))
        .join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations: fixed size
    )
    return (
        dealt(li.join(s, F.col("s_suppkey") == F.col("l_suppkey")), n_parts, "l_orderkey")
        .join(dealt(sold, n_parts, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .withColumn("h", F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey") * 3
                    + F.col("l_linenumber"))
        .withColumn("vf", vf)
        .withColumn("va", F.round(vf * (F.lit(1) - disc), 2))
        .withColumn("cnpj", _doc(F.col("n_regionkey")))
        .withColumn("ced_doc", _doc(F.col("l_suppkey")))
    )


def _iso(col) -> F.Column:
    return F.date_format(col.cast("date"), "yyyy-MM-dd")


def _fault(h_mod: int, bad, good) -> F.Column:
    return F.when(F.col("h") % h_mod == 0, bad).otherwise(good)


BOLETA_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def boleta_raw(t: Tables) -> DataFrame:
    """A boleta file as text columns, with line numbers; every rule fires somewhere."""
    b = base(t)
    ln = F.col("l_linenumber")
    cnpj = F.col("cnpj")
    cols = [
        _fault(211, F.lit(""), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), ln.cast("string")))
        .alias("identificador_externo"),
        _fault(223, F.lit("123"), F.concat(F.substring(cnpj, 1, 8), F.lit("/"), F.substring(cnpj, 9, 4),
                                           F.lit("-"), F.substring(cnpj, 13, 2))).alias("fundo_cnpj"),
        _fault(227, F.lit(""), F.col("c_mktsegment")).alias("classe_codigo"),
        _fault(229, F.lit("1997-13-01"), _iso(F.col("o_orderdate"))).alias("data_aquisicao"),
        F.when(F.col("h") % 233 == 0, "BOLETO").when(ln % 3 == 0, "CCB").when(ln % 3 == 1, "DUPLICATA")
        .otherwise("CARTAO").alias("tipo_ativo"),
        _fault(239, F.lit(""), F.concat(F.lit("NF-"), F.col("l_orderkey").cast("string"))).alias("numero_titulo"),
        F.when(ln == 1, "").otherwise(ln.cast("string")).alias("numero_parcela"),
        F.lit("7").alias("total_parcelas"),
        _fault(241, F.lit("999"), F.col("ced_doc")).alias("cedente_documento"),
        _fault(251, F.lit("  "), F.concat(F.lit(" "), F.col("s_name"), F.lit(" "))).alias("cedente_nome"),
        F.when(F.col("h") % 283 == 0, "12345")
        .when(F.col("c_custkey") % 2 == 0, (F.lit(20000000000) + F.col("c_custkey")).cast("string"))
        .otherwise((F.lit(30000000000000) + F.col("c_custkey")).cast("string")).alias("sacado_documento"),
        _fault(257, F.lit(""), F.col("c_name")).alias("sacado_nome"),
        F.when(ln == 2, "x").otherwise(_iso(F.col("o_orderdate"))).alias("data_emissao"),
        _fault(263, F.lit("n/d"), _iso(F.col("l_shipdate"))).alias("data_vencimento"),
        F.when(F.col("h") % 269 == 0, "-1").when(F.col("h") % 293 == 0, "NaN").when(F.col("h") % 307 == 0, "1e30")
        .when(F.col("h") % 311 == 0, "0.001").otherwise(F.col("vf").cast("string")).alias("valor_face"),
        F.when(F.col("h") % 271 == 0, "abc").when(F.col("h") % 277 == 0, (F.col("vf") + 1).cast("string"))
        .otherwise(F.col("va").cast("string")).alias("valor_aquisicao"),
        F.when(ln == 3, "n").when(ln == 4, "9999999").when(ln == 5, "NaN").when(ln == 6, "18.5").otherwise("")
        .alias("taxa_desconto_aa"),
        F.when(F.col("h") % 281 == 0, "TR").when(F.col("l_returnflag") == "A", "cdi")
        .when(F.col("l_returnflag") == "R", "PRE").otherwise("").alias("indexador"),
        F.lit("").alias("percentual_indexador"),
        F.when(F.col("l_linestatus") == "O", "s").otherwise("").alias("coobrigacao"),
        F.concat(F.lit("CTA-"), F.col("l_returnflag")).alias("conta_liquidacao"),
    ]
    numbered = with_grouped_row_number(b.select(*BOLETA_ORDER, *cols_inputs()), BOLETA_ORDER[0], BOLETA_ORDER[1:], "linha_numero", start=2)
    return numbered.select("linha_numero", *cols)


def cols_inputs() -> list[str]:
    return ["h", "cnpj", "c_mktsegment", "o_orderdate", "ced_doc", "s_name", "c_custkey", "c_name",
            "l_shipdate", "vf", "va", "l_returnflag", "l_linestatus"]


def titulos(t: Tables) -> DataFrame:
    """Typed receivables without faults: first row per (order, line) wins."""
    b = base(t).where(F.col("l_shipdate").cast("date") >= F.col("o_orderdate").cast("date"))
    payload = F.struct(
        F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"),
        F.col("n_regionkey"), F.col("c_mktsegment"), F.col("o_orderdate"),
        F.col("l_shipdate"), F.col("vf"), F.col("va"), F.col("s_name"), F.col("c_name"),
        F.col("l_returnflag"), F.col("l_linestatus"),
    )
    # min(struct) is a partial aggregate: a hot key is combined map-side
    first = b.groupBy("l_orderkey", "l_linenumber").agg(F.min(payload).alias("r"))
    return first.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        .alias("identificador_externo"),
        F.col("r.n_regionkey").alias("fundo_id"),
        F.concat_ws("|", _doc(F.col("r.n_regionkey")), F.col("r.c_mktsegment")).alias("classe_id"),
        F.col("r.o_orderdate").cast("date").alias("data_aquisicao"),
        F.col("r.l_shipdate").cast("date").alias("data_vencimento"),
        F.col("r.vf").cast(T.DecimalType(20, 2)).alias("valor_face"),
        F.col("r.va").cast(T.DecimalType(20, 2)).alias("valor_aquisicao"),
        F.col("r.s_name").alias("cedente"),
        F.col("r.c_name").alias("sacado"),
        F.col("r.l_returnflag").alias("l_returnflag"),
        F.col("r.l_linestatus").alias("l_linestatus"),
        F.col("l_linenumber"),
        F.concat(F.lit("NF-"), F.col("l_orderkey").cast("string")).alias("numero_titulo"),
        F.when(F.col("l_linenumber") % 3 == 0, "CCB").when(F.col("l_linenumber") % 3 == 1, "DUPLICATA").otherwise("CARTAO").alias("tipo_ativo"),
    )


def eventos(t: Tables, titles: DataFrame | None = None) -> DataFrame:
    """Events of finished titles in posting order (``ordem``), which is not always the order of their dates.

    Each has one some days after maturity (every third without a value). Some have a delay before it, some a
    write-off that is dated earlier but posted later, some an unknown kind; some events name no known title.
    """
    ti = titles if titles is not None else titulos(t)
    ln = F.col("l_linenumber")
    posted = F.split("identificador_externo", "-")[0].cast("long") * 80 + ln * 8
    kind = (F.when(F.col("l_returnflag") == "A", "PAGAMENTO").when(F.col("l_returnflag") == "R", "RECOMPRA")
            .when(ln % 2 == 0, "BAIXA").otherwise("PAGAMENTO_PARCIAL"))
    face, none = F.col("valor_face"), F.lit(None).cast(T.DecimalType(20, 2))

    def event(name, place: int, days, kind, value) -> F.Column:
        return F.struct(name.alias("identificador_externo"), (posted + place).alias("ordem"),
                        F.date_add(F.col("data_vencimento"), days).alias("data_evento"), value.alias("valor"), kind.alias("tipo"))

    own = F.col("identificador_externo")
    made = F.array(
        F.when(ln % 4 == 0, event(own, 0, F.lit(1), F.lit("ATRASO"), none)),
        event(own, 1, ln.cast("int"), kind, F.when(ln % 3 == 0, none).otherwise(face)),
        F.when(ln == 5, event(own, 2, F.lit(0), F.lit("BAIXA"), none)),
        F.when(ln == 6, event(own, 3, F.lit(9), F.lit("PRORROGACAO"), none)),
        F.when(ln == 7, event(F.concat(F.lit("X-"), own), 4, F.lit(2), F.lit("PAGAMENTO"), face)),
    )
    finished = ti.where(F.col("l_linestatus") == "F")
    return finished.select("fundo_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select(
        "e.identificador_externo", "fundo_id", "e.ordem", "e.data_evento", "e.valor", "e.tipo")


def cota_movimento(t: Tables) -> DataFrame:
    """Unit ledger: finished orders redeem a quarter, the others subscribe, at par."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    f = fundos(t).select("fundo_id", "cnpj")
    red = F.col("o_orderstatus") == "F"
    factor = F.when(red, F.lit("0.25")).otherwise(F.lit("1")).cast(T.DecimalType(4, 2))
    return (
        o.join(c, F.col("c_custkey") == F.col("o_custkey"))
        .join(F.broadcast(t.nation.select("n_nationkey", "n_regionkey")), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(F.broadcast(f), F.col("fundo_id") == F.col("n_regionkey"))
        .select(
            F.col("o_orderkey").alias("mov_id"),
            F.concat_ws("|", "cnpj", "c_mktsegment").alias("classe_id"),
            F.when(F.col("o_orderkey") % 17 != 0, F.col("c_custkey")).alias("cotista_id"),  # some contributions are anonymous
            F.col("o_orderdate").cast("date").alias("data"),
            F.when(red, "RESGATE").otherwise("EMISSAO").alias("tipo"),
            (F.col("o_totalprice").cast(T.DecimalType(18, 2)) * factor).cast(T.DecimalType(28, 12)).alias("quantidade"),
        )
    )


def movimento_caixa(t: Tables, titles: DataFrame | None = None, resolved: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """Cash ledger: unit flows at par, acquisitions (per class/date) and receipts (of ``resolved`` events)."""
    ti = titles if titles is not None else titulos(t)
    resolved = resolved if resolved is not None else ledger.resolve_events(ti, eventos(t, ti))
    money = T.DecimalType(20, 2)
    cm = units if units is not None else cota_movimento(t)
    units = cm.select(
        "classe_id", "data",
        F.when(F.col("tipo") == "EMISSAO", "APORTE").otherwise("RESGATE").alias("tipo"),
        F.when(F.col("tipo") == "EMISSAO", F.round("quantidade", 2)).otherwise(-F.round("quantidade", 2))
        .cast(money).alias("valor"),
    )
    acq = ti.groupBy("classe_id", F.col("data_aquisicao").alias("data")).agg(
        (-F.sum("valor_aquisicao")).cast(money).alias("valor")
    ).select("classe_id", "data", F.lit("AQUISICAO_DC").alias("tipo"), "valor")
    rec = ledger.event_cash(resolved).select("classe_id", "data", "tipo", "valor")
    return units.unionByName(acq).unionByName(rec)


def ordens(t: Tables) -> DataFrame:
    """Investor orders: one per order row, 45 days after it, in the customer's class.

    Every second one redeems, every sixth by units instead of value; some name an unknown class or investor.
    """
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    key = F.col("o_orderkey")
    total = F.col("o_totalprice").cast(T.DecimalType(18, 2))
    return (
        o.join(c, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(fundos(t).select("fundo_id", "cnpj"), F.col("fundo_id") == F.col("n_regionkey"))
        .select(
            key.alias("ordem"),
            F.date_add(F.col("o_orderdate").cast("date"), 45).alias("data"),
            F.when(key % 53 == 0, "?").otherwise(F.concat_ws("|", "cnpj", "c_mktsegment")).alias("classe_id"),
            F.when(key % 59 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("cotista_id"),
            F.when(key % 2 == 0, "RESGATE").otherwise("APLICACAO").alias("tipo"),
            F.round(total * F.lit("0.30").cast(T.DecimalType(4, 2)), 2).cast(T.DecimalType(20, 2)).alias("valor"),
            F.when(key % 6 == 0, total * F.lit("0.40").cast(T.DecimalType(4, 2))).cast(T.DecimalType(28, 12))
            .alias("quantidade_solicitada"),
        )
    )


def perfis(t: Tables) -> DataFrame:
    """Role tree: nation k's parent is (k-1)/2; each role grants one permission."""
    n = F.col("n_nationkey")
    return t.nation.select(
        n.alias("perfil_id"),
        F.when(n > 0, F.floor((n - 1) / F.lit(2.0)).cast("int")).alias("perfil_pai_id"),
        F.concat(F.lit("perm_"), F.col("n_regionkey").cast("string")).alias("permissao"),
    )


def usuario_perfil(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("usuario_id"), F.col("s_nationkey").alias("perfil_id"))


# --- prior state of the store, for idempotent ingest ------------------------------------------
PRIOR_CUTOFF = "1996-01-01"  # titles and counterparties acquired before this were imported earlier


def _sacado_doc() -> F.Column:
    return (F.when(F.col("c_custkey") % 2 == 0, (F.lit(20000000000) + F.col("c_custkey")).cast("string"))
            .otherwise((F.lit(30000000000000) + F.col("c_custkey")).cast("string")))


def prior_title_keys(titles: DataFrame) -> DataFrame:
    return titles.where(F.col("data_aquisicao") < F.lit(PRIOR_CUTOFF).cast("date")) \
        .select("fundo_id", "identificador_externo", "data_aquisicao")


def prior_counterparties(t: Tables, role: str) -> DataFrame:
    b = base(t).where(F.col("o_orderdate").cast("date") < F.lit(PRIOR_CUTOFF).cast("date"))
    if role == "cedente":
        return b.select(F.col("ced_doc").alias("documento"), F.col("s_name").alias("nome")).distinct()
    return b.select(_sacado_doc().alias("documento"), F.col("c_name").alias("nome")).distinct()


def cotistas(t: Tables) -> DataFrame:
    """Investors: one per customer, with an 11- or 14-digit document."""
    return t.customer.select(F.col("c_custkey").alias("cotista_id"), _sacado_doc().alias("documento"), F.col("c_name").alias("nome"),
                             F.when(F.col("c_custkey") % 2 == 0, "PF").otherwise("PJ").alias("tipo_investidor"))


def prior_investors(t: Tables) -> DataFrame:
    """Investors already registered: customers with a unit movement before the cutoff."""
    o = t.orders.where(F.col("o_orderdate").cast("date") < F.lit(PRIOR_CUTOFF).cast("date")).select("o_custkey")
    c = t.customer.join(o.distinct(), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.select(_sacado_doc().alias("documento"))


def corrected_closes(closes: DataFrame) -> DataFrame:
    """A store of closes with gaps and corrections: no April and no October; of every August a second version, with a
    provision and a price that somebody has put right."""
    kept = closes.where(~F.month("data_referencia").isin(4, 10))
    second = kept.where(F.month("data_referencia") == 8).withColumns({
        "versao": F.lit(2).cast("long"), "provisao_adm_acumulada": (F.col("provisao_adm_acumulada") + F.lit("10.00").cast("decimal(20,2)")).cast("decimal(20,2)"),
        "valor_cota": (F.col("valor_cota") + F.lit("0.25").cast("decimal(28,12)")).cast("decimal(28,12)")})
    return kept.unionByName(second)
