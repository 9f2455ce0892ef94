import random
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal, getcontext

from pyspark.sql import functions as F

from recvfund.functions.calendar import build_calendar
from recvfund.operators import ledger
from recvfund.operators.valuation import class_marking, mark_titles_at
from recvfund.sources.fixtures import faixas_pdd

from test_calendar_params import py_business_days

SCHEMA = "identificador_externo string, classe_id string, data_aquisicao date, data_vencimento date, " \
         "valor_face decimal(20,2), valor_aquisicao decimal(20,2), situacao string"


def model_vp(vf: Decimal, va: Decimal, rem: int, tot: int) -> Decimal:
    if rem <= 0 or tot <= 0:
        return vf
    getcontext().prec = 40
    ratio = (vf / va)
    exp = Decimal(rem) / Decimal(tot)
    return (vf / (ratio ** exp)).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_contract_rows_marked(spark):
    """The two rows of the file contract, marked on the day after acquisition."""
    cal = build_calendar(spark, "2025-01-01", "2027-12-31")
    rows = [("ACME-2026-000101", "S", date(2026, 7, 23), date(2026, 8, 22), Decimal("10000.00"), Decimal("9720.50"), "ATIVO"),
            ("ACME-2026-000102", "S", date(2026, 7, 23), date(2026, 9, 22), Decimal("10000.00"), Decimal("9455.10"), "ATIVO")]
    t = spark.createDataFrame(rows, SCHEMA)
    got = {r.identificador_externo: r for r in mark_titles_at(t, "2026-07-24", cal, faixas_pdd(spark)).collect()}
    for ident, _, acq, venc, vf, va, _ in rows:
        tot, rem = py_business_days(acq, venc), py_business_days(date(2026, 7, 24), venc)
        r = got[ident]
        assert (r.du_total, r.du_rem) == (tot, rem)
        assert r.valor_presente == model_vp(vf, va, rem, tot)
        assert r.pdd == 0 and r.a_receber == 0


def test_edge_titles(spark):
    cal = build_calendar(spark, "2025-01-01", "2027-12-31")
    rows = [
        ("same-day", "S", date(2026, 7, 24), date(2026, 7, 24), Decimal("100.00"), Decimal("90.00"), "ATIVO"),
        ("weekend-acq", "S", date(2026, 7, 25), date(2026, 8, 25), Decimal("100.00"), Decimal("95.00"), "ATIVO"),
        ("holiday-mat", "S", date(2026, 8, 1), date(2026, 9, 7), Decimal("100.00"), Decimal("95.00"), "ATIVO"),
        ("va-eq-vf", "S", date(2026, 7, 1), date(2026, 12, 1), Decimal("100.00"), Decimal("100.00"), "ATIVO"),
        ("overdue-31", "S", date(2026, 1, 1), date(2026, 8, 1), Decimal("1000.00"), Decimal("900.00"), "ATIVO"),
        ("paid", "S", date(2026, 1, 1), date(2026, 12, 1), Decimal("1000.00"), Decimal("900.00"), "LIQUIDADO"),
    ]
    t = spark.createDataFrame(rows, SCHEMA)
    got = {r.identificador_externo: r for r in mark_titles_at(t, "2026-09-01", cal, faixas_pdd(spark)).collect()}
    assert "paid" not in got
    assert got["same-day"].valor_presente == Decimal("100.00")
    assert got["va-eq-vf"].valor_presente == Decimal("100.00")
    o = got["overdue-31"]
    assert o.dias_atraso == 31 and o.pdd == Decimal("30.00") and o.a_receber == Decimal("1000.00")
    assert o.valor_presente == Decimal("1000.00")


def test_class_marking_equals_title_level_sum(spark):
    """The step/delta grid marking equals summing per-title marks at each date."""
    rnd = random.Random(7)
    cal = build_calendar(spark, "2025-01-01", "2027-12-31")
    rows = []
    for i in range(300):
        acq = date(2025, 3, 1) + timedelta(days=rnd.randint(0, 500))
        venc = acq + timedelta(days=rnd.choice([0, 1, 2, 5, 30, 61, 120, 200, 400]))
        vf = Decimal(rnd.randint(1000, 10 ** 6)) / 100
        va = (vf * Decimal(rnd.choice(["0.8", "0.9", "0.95", "1"]))).quantize(Decimal("0.01"))
        rows.append((f"t{i}", rnd.choice(["A", "B", "C"]), acq, venc, vf, va, rnd.choice(["ATIVO"] * 5 + ["BAIXADO"])))
    t = spark.createDataFrame(rows, SCHEMA)
    dates = ["2025-03-31", "2025-06-15", "2025-12-31", "2026-03-07", "2026-09-30", "2027-06-30"]
    grid = spark.createDataFrame([(c, date.fromisoformat(d)) for c in "ABCD" for d in dates], "classe_id string, data date")
    fast = {(r.classe_id, r.data): r for r in class_marking(t, grid, cal).collect()}
    bands = faixas_pdd(spark)
    for d in dates:
        slow = (mark_titles_at(t, d, cal, bands).groupBy("classe_id")
                .agg(F.count("*").alias("n"), F.sum("valor_presente").alias("vp"), F.sum("pdd").alias("pdd"),
                     F.sum("a_receber").alias("rec")).collect())
        by = {r.classe_id: r for r in slow}
        for c in "ABCD":
            f = fast[(c, date.fromisoformat(d))]
            s = by.get(c)
            assert f.qtd_ativos == (s.n if s else 0), (c, d)
            assert f.valor_presente == (s.vp if s else 0), (c, d)
            assert f.pdd == (s.pdd if s else 0), (c, d)
            assert f.a_receber == (s.rec if s else 0), (c, d)


def random_titles(rng, n, first=date(2026, 1, 1)):
    rows = []
    for i in range(n):
        acq = first + timedelta(rng.randint(0, 150))
        vf = Decimal(rng.randint(10000, 900000)) / 100
        rows.append((f"t{i}", "AB"[i % 2], acq, acq + timedelta(rng.choice([0, 1, 9, 40, 120])), vf, (vf * Decimal(rng.randint(80, 100)) / 100).quantize(Decimal("0.01")), "ATIVO"))
    return rows


def totals(marked):
    return {r.classe_id: (r.n, r.vp, r.pdd, r.rec) for r in marked.groupBy("classe_id").agg(
        F.count("*").alias("n"), F.sum("valor_presente").alias("vp"), F.sum("pdd").alias("pdd"), F.sum("a_receber").alias("rec")).collect()}


def test_status_as_of_each_close_date(spark):
    """Class totals with leaving days against titles marked one by one with the status of that day."""
    rng = random.Random(23)
    cal, bands = build_calendar(spark, "2025-12-01", "2027-03-31"), faixas_pdd(spark)
    rows = random_titles(rng, 60)
    titles = spark.createDataFrame([(1, *r) for r in rows], "fundo_id int, " + SCHEMA).drop("situacao")
    events, n = [], 0
    for r in rows:
        for _ in range(rng.choice([0, 0, 1, 2, 3])):  # posted in any order, before acquisition and long after maturity too
            n += 1
            events.append((1, r[0], n, r[2] + timedelta(rng.randint(-5, 300)), rng.choice(["PAGAMENTO", "BAIXA", "RECOMPRA", "ATRASO", "AJUSTE", "PAGAMENTO_PARCIAL", "PRORROGACAO"]), None))
    ev = spark.createDataFrame(events, "fundo_id int, identificador_externo string, ordem long, data_evento date, tipo string, valor decimal(20,2)")
    dates = [date(2026, m, d) for m in range(1, 13) for d in (1, 15)]
    grid = spark.createDataFrame([(c, d) for c in "ABC" for d in dates], "classe_id string, data date")
    _, resolved = ledger.apply_title_events(titles, ev)
    got = {(r.classe_id, r.data): (r.qtd_ativos, r.valor_presente, r.pdd, r.a_receber) for r in class_marking(ledger.title_leaving(titles, resolved), grid, cal, bands, leaving="data_saida").collect()}
    for d in dates[::5] + [date(2026, 6, 15), date(2026, 12, 15)]:
        status, _ = ledger.apply_title_events(titles, ev, as_of=d.isoformat())
        want = totals(mark_titles_at(status, d.isoformat(), cal, bands))
        for c in "ABC":
            assert got[c, d] == want.get(c, (0, Decimal("0.00"), Decimal("0.00"), Decimal("0.00"))), (c, d)
    assert any(v[0] for v in got.values())


def test_titles_outside_the_calendar_are_marked_alike(spark):
    rng = random.Random(29)
    wide, bands = build_calendar(spark, "2020-01-01", "2029-12-31"), faixas_pdd(spark)
    table = spark.createDataFrame([(date(2026, 4, 21),)], "data date")
    wide, narrow = (build_calendar(spark, a, b, table) for a, b in (("2020-01-01", "2029-12-31"), ("2026-02-01", "2026-05-31")))
    rows = random_titles(rng, 40, date(2025, 12, 1)) + [("long", "A", date(2021, 1, 4), date(2028, 1, 3), Decimal("1000.00"), Decimal("700.00"), "ATIVO"), ("old", "B", date(2021, 1, 4), date(2021, 3, 3), Decimal("9.00"), Decimal("7.00"), "ATIVO")]
    titles = spark.createDataFrame(rows, SCHEMA)
    dates = [date(2026, m, 27) for m in range(2, 6)]
    grid = spark.createDataFrame([(c, d) for c in "AB" for d in dates], "classe_id string, data date")
    one, two = (sorted(map(tuple, class_marking(titles, grid, cal, bands).collect())) for cal in (wide, narrow))
    assert one == two
    for d in dates:
        want = totals(mark_titles_at(titles, d.isoformat(), narrow, bands))
        assert {r[0]: r[2:] for r in two if r[1] == d} == want
