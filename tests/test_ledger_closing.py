import random
from datetime import date
from decimal import ROUND_HALF_EVEN, Decimal, getcontext

from recvfund.functions.calendar import build_calendar
from pyspark.sql import functions as F

from recvfund.operators import access, closing, orders, registry, replay, report
from recvfund import constants as K

UNITS_SCHEMA = "classe_id string, cotista_id long, data date, tipo string, quantidade decimal(28,12)"


def _inputs(spark, rows):
    return spark.createDataFrame(rows, "classe_id string, fundo_id int, data date, qtd_ativos long, "
                                       "valor_presente decimal(20,2), pdd decimal(20,2), a_receber decimal(20,2), "
                                       "caixa decimal(20,2), quantidade_cotas decimal(28,12), taxa_administracao_aa decimal(9,6)")


def _row(d, vp, pdd, cash, units):
    return ("c", 1, d, 10, Decimal(vp), Decimal(pdd), Decimal(0), Decimal(cash), Decimal(units), Decimal("2.52"))


# worked by hand: 2.52 % a year is 0.01 % a business day of the gross value
CHAIN = [
    # date, present value, provision for losses, cash, units -> days, expense, accumulated, net, price, return
    (_row(date(2026, 1, 30), "1000.00", "10.00", "500.00", "1000"), 1, "0.15", "0.15", "1489.85", "1.489850000000", "0.4898500000"),
    (_row(date(2026, 1, 31), "1000.00", "10.00", "700.00", "1000"), 0, "0.00", "0.15", "1689.85", "1.689850000000", "0.1342417022"),
    (_row(date(2026, 2, 2), "1000.00", "10.00", "700.00", "0"), 1, "0.17", "0.32", "1689.68", None, None),
    (_row(date(2026, 2, 9), "3000.00", "0.00", "-500.00", "1250"), 5, "1.25", "1.57", "2498.43", "1.998744000000", "0.9987440000"),
    (_row(date(2026, 2, 10), "2500.45", "0.45", "0.05", "2500"), 1, "0.25", "1.82", "2498.23", "0.999292000000", "-0.5000400251"),
]


def check_chain(got, want):
    assert len(got) == len(want)
    for g, (row, n, expense, total, net, price, ret) in zip(got, want):
        assert (g.data_referencia, g.n_du, g.despesa_adm_dia, g.provisao_adm_acumulada) == (row[2], n, Decimal(expense), Decimal(total))
        assert g.pl_liquido == Decimal(net) and g.valor_cota == (price and Decimal(price)) and g.rentabilidade_dia == (ret and Decimal(ret))


def test_close_chain_against_worked_figures(spark):
    cal = build_calendar(spark, "2026-01-01", "2026-12-31")
    got = sorted(closing.close_grid(_inputs(spark, [c[0] for c in CHAIN]), cal).collect(), key=lambda r: r.data_referencia)
    check_chain(got, CHAIN)
    assert got[3].cota_anterior is None  # the close before it has no price: its base is par


def test_close_goes_on_from_stored_closes(spark):
    cal = build_calendar(spark, "2026-01-01", "2026-12-31")
    for cut in (1, 2, 3, 4):
        first = closing.close_grid(_inputs(spark, [c[0] for c in CHAIN[:cut]]), cal)
        rest = closing.close_grid(_inputs(spark, [c[0] for c in CHAIN[cut:]]), cal, first)
        check_chain(sorted(rest.collect(), key=lambda r: r.data_referencia), CHAIN[cut:])
    stored = closing.close_grid(_inputs(spark, [c[0] for c in CHAIN]), cal)
    again = closing.close_grid(_inputs(spark, [CHAIN[3][0]]), cal, stored).first()
    assert again.versao == 2 and again.valor_cota == Decimal(CHAIN[3][5]) and again.provisao_adm_acumulada == Decimal("1.57")


def close_by_close(store, row, cal):
    """One close the way an operator makes it: the latest stored date before it, its highest version; appended as the next version."""
    d, before = row[2], [s for s in store if s["d"] < row[2]]
    prev = max(before, key=lambda s: (s["d"], s["v"]), default=None)
    n = cal(prev["d"], d) if prev else 1
    gross = row[4] + row[7]
    expense = (gross * row[9] * n / 25200).quantize(Decimal("0.01"), ROUND_HALF_EVEN)
    total = (prev["total"] if prev else 0) + expense
    net = gross - row[5] - total
    price = (net / row[8]).quantize(Decimal("1e-12"), ROUND_HALF_EVEN) if row[8] > 0 else None
    base = prev["price"] if prev and prev["price"] is not None else Decimal(1)
    ret = (price / base - 1).quantize(Decimal("1e-10"), ROUND_HALF_EVEN) if price is not None and base > 0 else None
    new = {"d": d, "v": max((s["v"] for s in store if s["d"] == d), default=0) + 1, "n": n, "expense": expense, "total": total, "net": net,
           "price": price, "prev": prev and prev["price"], "ret": ret}
    store.append(new)
    return new


def test_gaps_and_recloses_against_closing_one_by_one(spark):
    getcontext().prec = 60
    rng = random.Random(13)
    cal = build_calendar(spark, "2026-01-01", "2026-12-31")
    counts = {r.data: r.du_acumulado for r in cal.collect()}
    days = lambda a, b: max(0, counts[b] - counts[a])
    stores = {f"c{k}": [] for k in range(40)}
    closes = None
    for turn in range(3):  # each run closes some dates of each class, in gaps of the store and again
        rows = []
        for c in stores:
            for m in sorted(rng.sample(range(12), rng.randint(0, 6))):
                units = rng.choice([Decimal(0), Decimal(rng.randint(1, 3000)), Decimal(rng.randint(1, 10**9)) / 1000])
                rows.append((c, 1, date(2026, m + 1, 28 if m % 3 else 27), 1, Decimal(rng.randint(0, 10**6)) / 100, Decimal(rng.randint(0, 99)) / 100, Decimal(0),
                             Decimal(rng.randint(-10**5, 10**6)) / 100, units, Decimal(rng.randint(0, 3 * 10**6)) / 10**6))
        want = {(r[0], r[2]): close_by_close(stores[r[0]], r, days) for r in rows}
        new = closing.close_grid(_inputs(spark, rows), cal, closes)
        got = new.collect()
        assert len(got) == len(want)
        for g in got:
            x = want[g.classe_id, g.data_referencia]
            assert (g.versao, g.n_du, g.despesa_adm_dia, g.provisao_adm_acumulada, g.pl_liquido, g.valor_cota, g.cota_anterior, g.rentabilidade_dia) == (
                x["v"], x["n"], x["expense"], x["total"], x["net"], x["price"], x["prev"], x["ret"])
        fixed = spark.createDataFrame(got, new.schema)
        closes = fixed if closes is None else closes.unionByName(fixed)
    assert any(s["v"] == 3 for store in stores.values() for s in store)


def test_a_close_takes_the_stored_one_before_it(spark):
    """January and March are closed again over a stored February."""
    cal = build_calendar(spark, "2026-01-01", "2026-12-31")
    rows = [_row(date(2026, 1, 30), "1000.00", "0", "0.00", "1000"), _row(date(2026, 3, 3), "5681.82", "0", "0.00", "1000")]
    stored = spark.createDataFrame([("c", date(2026, 1, 30), 1, "SELADO", Decimal("3"), Decimal("7.00")), ("c", date(2026, 2, 28), 1, "PROCESSADO", Decimal("1.5"), Decimal("9.00")),
                                    ("c", date(2026, 2, 28), 2, "SELADO", Decimal("1.9963"), Decimal("11.25"))],
                                   "classe_id string, data_referencia date, versao long, status string, valor_cota decimal(28,12), provisao_adm_acumulada decimal(20,2)")
    jan, mar = sorted(closing.close_grid(_inputs(spark, rows), cal, stored).collect(), key=lambda r: r.data_referencia)
    assert (jan.versao, jan.n_du, jan.provisao_adm_acumulada, jan.cota_anterior) == (2, 1, Decimal("0.10"), None)
    assert (mar.versao, mar.n_du, mar.cota_anterior) == (1, 2, Decimal("1.9963"))
    assert mar.despesa_adm_dia == Decimal("1.14") and mar.provisao_adm_acumulada == Decimal("12.39")


def test_versions_and_seal(spark):
    cal = build_calendar(spark, "2025-01-01", "2027-12-31")
    rows = [("c", 1, date(2026, 3, 31), 1, Decimal("100.00"), Decimal(0), Decimal(0), Decimal("0.00"), Decimal("100"), Decimal(0))]
    v1 = closing.close_grid(_inputs(spark, rows), cal)
    v2 = closing.close_grid(_inputs(spark, rows), cal, prior_closes=v1)
    a, b = v1.first(), v2.first()
    assert (a.versao, b.versao) == (1, 2) and a.valor_cota == b.valor_cota == Decimal("1.000000000000")
    both = v1.unionByName(v2)
    cid = closing.close_id(v1)
    reqs = v1.select(cid.alias("fechamento_id")).crossJoin(spark.createDataFrame([(1,), (2,)], "ordem int")) \
        .unionByName(spark.createDataFrame([("nope", 1)], "fechamento_id string, ordem int"))
    got = sorted((r.fechamento_id == "nope", r.ordem, r.resultado) for r in closing.seal(both, reqs).collect())
    assert got == [(False, 1, "SELADO"), (False, 2, K.MSG_SEAL_SEALED), (True, 1, K.MSG_SEAL_MISSING)]


def brute_orders(rows):
    bal, out = {}, {}
    for ordem, d, cls, inv, tipo, valor in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (cls, inv)
        q = valor  # price is par
        b = bal.get(key, Decimal(0))
        if tipo == "RESGATE":
            ok = q <= b
            bal[key] = b - q if ok else b
        else:
            ok = True
            bal[key] = b + q
        out[ordem] = (ok, bal[key])
    return out


def test_redemption_guard_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        rows.append((i, date(2024, 1, rnd.randint(1, 20)), f"C{rnd.randint(0, 2)}", rnd.randint(0, 9),
                     rnd.choice(["APLICACAO", "RESGATE", "RESGATE"]), Decimal(rnd.randint(1, 5000)) / 100))
    df = spark.createDataFrame(rows, "ordem long, data date, classe_id string, cotista_id long, tipo string, valor decimal(20,2)")
    closes = spark.createDataFrame([], "classe_id string, data_referencia date, versao long, valor_cota decimal(28,12)")
    got = {r.ordem: (r.aceito, r.saldo_cotas) for r in orders.process_orders(df, closes).collect()}
    exp = brute_orders(rows)
    assert got == {k: (ok, b.quantize(Decimal("1e-12"))) for k, (ok, b) in exp.items()}


def test_report_residual_row(spark):
    closes = spark.createDataFrame([("c", date(2026, 3, 31), 1, Decimal("1.500000000000"), Decimal("300"))],
                                   "classe_id string, data_referencia date, versao long, valor_cota decimal(28,12), quantidade_cotas decimal(28,12)")
    units = spark.createDataFrame([("c", 1, date(2026, 1, 1), "EMISSAO", Decimal("100")),
                                   ("c", 2, date(2026, 1, 1), "EMISSAO", Decimal("50")),
                                   ("c", 2, date(2026, 2, 1), "RESGATE", Decimal("60"))], UNITS_SCHEMA)
    units = units.unionByName(spark.createDataFrame([("c", None, date(2026, 1, 1), "EMISSAO", Decimal("200"))], UNITS_SCHEMA))
    got = {r.nome or r.documento: r for r in report.investors(closes, "2026-04-10", units).collect()}
    assert got["1"].valor == Decimal("150.00") and got["1"].participacao == Decimal("0.333333333333")
    assert "2" not in got  # net position <= 0 is not shown
    res = got[K.RESIDUAL_NAME]
    assert res.cotas == Decimal("200") and res.valor == Decimal("300.00")


def test_effective_permissions_and_check(spark):
    roles = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "perfil_id int, perfil_pai_id int")
    perms = spark.createDataFrame([(1, "admin"), (2, "gestor"), (3, "leitura"), (4, "auditor")], "perfil_id int, permissao string")
    loop = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 4)], "perfil_id int, perfil_pai_id int")  # cycles end
    assert sorted((r.role, r.reached) for r in access.inherited_roles(loop).collect()) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(4, 4)]
    users = spark.createDataFrame([(10, 3), (20, 4)], "usuario_id int, perfil_id int")
    eff = access.effective_permissions(users, roles, perms)
    got = sorted((r.usuario_id, r.permissao) for r in eff.collect())
    assert got == [(10, "admin"), (10, "gestor"), (10, "leitura"), (20, "admin"), (20, "auditor")]
    reqs = spark.createDataFrame([(10, "auditor"), (20, "admin")], "usuario_id int, permissao string")
    assert sorted((r.usuario_id, r.permitido) for r in access.has_permission(reqs, eff).collect()) == [(10, False), (20, True)]


def test_investor_registry_rules(spark):
    reqs = spark.createDataFrame([(1, "123.456.789-01", "Ana"), (2, "12345678901", "Ana B"), (3, "1234", "X"),
                                  (4, "98765432100", "  "), (5, "98765432100", "Bia"), (6, "11111111111", "Caio")],
                                 "ordem long, documento string, nome string")
    existing = spark.createDataFrame([("11111111111",)], "documento string")
    got = {r.ordem: r.resultado for r in registry.register_investors(reqs, existing).collect()}
    assert got == {1: "OK", 2: K.MSG_COTISTA_DUP, 3: K.MSG_COTISTA_DOC, 4: K.MSG_COTISTA_NOME, 5: "OK", 6: K.MSG_COTISTA_DUP}


def test_fund_and_class_registry(spark):
    funds = spark.createDataFrame([(1, "12.345.678/0001-90", "Fundo A"), (2, "123", "B"), (3, "98765432000199", " "),
                                   (4, "12345678000190", "Fundo A bis"), (5, "11111111000111", "Fundo C")],
                                  "ordem long, cnpj string, nome string")
    existing = spark.createDataFrame([("11111111000111",)], "cnpj string")
    got = {r.ordem: r.resultado for r in registry.register_funds(funds, existing).collect()}
    assert got == {1: "OK", 2: K.MSG_FUNDO_CNPJ, 3: K.MSG_FUNDO_NOME, 4: K.MSG_FUNDO_DUP, 5: K.MSG_FUNDO_DUP}
    known_funds = spark.createDataFrame([(1,)], "fundo_id int")
    known_classes = spark.createDataFrame([(1, "MEZ")], "fundo_id int, codigo string")
    reqs = spark.createDataFrame(
        [(1, 1, " senior ", "SENIOR"), (2, 1, "", "SENIOR"), (3, 1, "sub", "OUTRO"), (4, 9, "x", "SENIOR"),
         (5, 1, "mez", "MEZANINO"), (6, 1, "SENIOR", "SUBORDINADA")],
        "ordem long, fundo_id int, codigo string, tipo string").withColumn("nome", F.lit("n")) \
        .withColumn("vigencia_inicio", F.lit(date(2026, 1, 1))).withColumn("taxa_administracao_aa", F.lit(Decimal("1.5")))
    res, params = registry.register_classes(reqs, known_funds, known_classes)
    got = {r.ordem: r.resultado for r in res.collect()}
    assert got == {1: "OK", 2: K.MSG_CLASSE_COD, 3: K.MSG_CLASSE_TIPO, 4: K.MSG_CLASSE_FUNDO, 5: K.MSG_CLASSE_DUP,
                   6: K.MSG_CLASSE_DUP}
    assert params.count() == 1


def test_report_export_and_get_close(spark, tmp_path):
    from recvfund.sources.sinks import export_report_csv

    cal = build_calendar(spark, "2025-01-01", "2027-12-31")
    rows = [("c", 1, date(2026, 3, 31), 1, Decimal("100.00"), Decimal(0), Decimal(0), Decimal("0.00"), Decimal("100"), Decimal(0))]
    closes = closing.close_grid(_inputs(spark, rows), cal)
    cid = closes.select(closing.close_id(closes)).first()[0]
    assert closing.get_close(closes, cid).count() == 1 and closing.get_close(closes, "x").count() == 0
    lines = spark.createDataFrame(
        [("c", date(2026, 3, 31), 4, 1, "T"), ("c", date(2026, 3, 31), 0, 0, report.BOM + "Relatorio"), ("c", date(2026, 3, 31), 2, 0, "COTISTA"), ("d", date(2026, 3, 31), 0, 0, "x")],
        "classe_id string, data_referencia date, parte long, ordem long, linha string")
    export_report_csv(lines, str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "classe_id=c" / "data_referencia=2026-03-31").glob("part-*.txt"))
    assert "".join(f.read_text(encoding="utf-8") for f in files).split("\n")[:3] == ["\ufeffRelatorio", "COTISTA", "T"]


def test_event_order_rejects_and_class(spark):
    from recvfund.operators import ledger

    titles = spark.createDataFrame(
        [("a", 1, "c1", date(2026, 1, 1), Decimal(10)), ("b", 1, "c2", date(2026, 1, 1), Decimal(20)), ("b", 1, "c2", date(2026, 2, 1), Decimal(30))],
        "identificador_externo string, fundo_id int, classe_id string, data_aquisicao date, valor_face decimal(20,2)")
    events = spark.createDataFrame(
        [("a", 1, 2, date(2026, 3, 1), None, "PAGAMENTO", "wrong"), ("a", 1, 5, date(2026, 2, 1), None, "BAIXA", "wrong"), ("a", 1, 9, date(2026, 4, 1), None, "ATRASO", "wrong"),
         ("b", 1, 3, date(2026, 3, 1), None, "PAGAMENTO", "c2"), ("z", 1, 4, date(2026, 3, 1), None, "PAGAMENTO", "c1"), ("a", 1, 1, date(2026, 3, 1), None, "OUTRO", "c1")],
        "identificador_externo string, fundo_id int, ordem long, data_evento date, valor decimal(20,2), tipo string, classe_id string")
    status, resolved = ledger.apply_title_events(titles, events)
    got = {(r.identificador_externo, r.data_aquisicao.month): (r.situacao, r.n_eventos) for r in status.collect()}
    assert got == {("a", 1): ("BAIXADO", 3), ("b", 1): ("ATIVO", 0), ("b", 2): ("ATIVO", 0)}  # the last posted, not the latest date
    assert {r.ordem: r.resultado for r in resolved.collect()} == {
        1: K.MSG_EVENTO_TIPO, 2: "OK", 3: K.MSG_EVENTO_AMBIGUO, 4: K.MSG_EVENTO_NAO_ENCONTRADO, 5: "OK", 9: "OK"}
    assert [(r.classe_id, r.valor) for r in ledger.event_cash(resolved).collect()] == [("c1", Decimal("10.00"))]


def test_positions_without_anonymous_units(spark):
    from recvfund.operators import ledger

    units = spark.createDataFrame([("c", 1, date(2026, 1, 1), "EMISSAO", Decimal("100")), ("c", None, date(2026, 1, 1), "EMISSAO", Decimal("200"))], UNITS_SCHEMA)
    closes = spark.createDataFrame([], "classe_id string, data_referencia date, versao long, valor_cota decimal(28,12)")
    got = ledger.position_view(units, closes, "2026-02-01").collect()
    assert [(r.cotista_id, r.participacao) for r in got] == [(1, Decimal("1.000000"))]


def test_orders_of_unknown_class_or_investor(spark):
    rows = [(1, date(2024, 1, 1), "c", 1, "APLICACAO", Decimal("10.00")), (2, date(2024, 1, 2), "x", 1, "APLICACAO", Decimal("5.00")),
            (3, date(2024, 1, 3), "c", 9, "APLICACAO", Decimal("5.00")), (4, date(2024, 1, 4), "c", 1, "RESGATE", Decimal("10.00"))]
    df = spark.createDataFrame(rows, "ordem long, data date, classe_id string, cotista_id long, tipo string, valor decimal(20,2)")
    closes = spark.createDataFrame([], "classe_id string, data_referencia date, versao long, valor_cota decimal(28,12)")
    got = {r.ordem: (r.aceito, r.motivo) for r in orders.process_orders(
        df, closes, None, spark.createDataFrame([("c",)], "classe_id string"), spark.createDataFrame([(1,)], "cotista_id long")).collect()}
    assert got == {1: (True, None), 2: (False, K.MSG_ORDEM_CLASSE), 3: (False, K.MSG_ORDEM_COTISTA), 4: (True, None)}


ORDERS = "ordem long, data date, classe_id string, cotista_id long, tipo string, valor decimal(20,2), quantidade_solicitada decimal(28,12)"


def call_by_call(rows, orders_, opening, store, days):
    """Orders and closes one after the other, as calls come in: a day's orders before its close."""
    half = lambda x, places: x.quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)
    events = [(r[2], 2, 0, r) for r in rows] + [(o[1], 1, o[0], o) for o in orders_] + [(m[2], 0, 0, m) for m in opening]
    balance, units, cash, closes, verdicts = {}, {}, {}, {}, {}
    for d, kind, _, e in sorted(events, key=lambda x: x[:3]):
        if kind == 0:
            balance[e[0], e[1]] = balance.get((e[0], e[1]), Decimal(0)) + (e[4] if e[3] == "EMISSAO" else -e[4])
        elif kind == 1:
            c, i = e[2], e[3]
            priced = [s for s in store[c] if s["d"] < d and s["price"] is not None]
            price = max(priced, key=lambda s: (s["d"], s["v"]))["price"] if priced else Decimal(1)
            q = e[6] if e[6] is not None else half(e[5] / price, 12)
            sells = e[4] == "RESGATE"
            ok = not sells or q <= balance.get((c, i), Decimal(0))
            value = half(q * price, 2) if sells else e[5]
            if ok:
                balance[c, i] = balance.get((c, i), Decimal(0)) + (-q if sells else q)
                units[c], cash[c] = units.get(c, Decimal(0)) + (-q if sells else q), cash.get(c, Decimal(0)) + (-value if sells else value)
            verdicts[e[0]] = (q, price, value, ok, balance.get((c, i), Decimal(0)))
        else:
            c = e[0]
            row = (*e[:7], e[7] + cash.get(c, Decimal(0)), e[8] + units.get(c, Decimal(0)), e[9])
            closes[c, d] = (close_by_close(store[c], row, days), row)
    return closes, verdicts


def test_closes_and_orders_against_call_by_call(spark):
    getcontext().prec = 60
    rng = random.Random(5)
    cal = build_calendar(spark, "2026-01-01", "2026-12-31")
    counts = {r.data: r.du_acumulado for r in cal.collect()}
    store, rows = {}, []
    for c in ("a", "b", "c", "d"):
        store[c] = [{"d": date(2026, 1, 30), "v": 1, "price": Decimal("2.5"), "total": Decimal("3.00")}] if c != "a" else []
        if c == "b":  # a close that the run makes again, and one between its dates
            store[c] += [{"d": date(2026, 4, 30), "v": 1, "price": Decimal("9"), "total": Decimal("1.00")}, {"d": date(2026, 6, 15), "v": 2, "price": Decimal("1.75"), "total": Decimal("2.00")}]
        for m in range(2, 9):
            rows.append((c, 1, date(2026, m, 28 if m == 2 else 30), 1, Decimal(rng.randint(10**4, 10**6)) / 100, Decimal(rng.randint(0, 500)) / 100, Decimal(0),
                         Decimal(rng.randint(0, 10**6)) / 100, Decimal(rng.randint(0, 2000) if c != "d" else 0), Decimal("1.5")))
    stored = spark.createDataFrame([(c, x["d"], x["v"], x["price"], x["total"]) for c, xs in store.items() for x in xs],
                                   "classe_id string, data_referencia date, versao long, valor_cota decimal(28,12), provisao_adm_acumulada decimal(20,2)")
    days_ = [date(2026, m, d) for m in range(1, 10) for d in (1, 10, 28, 30) if (m, d) != (2, 30)]
    orders_ = []
    for k in range(500):
        sells = rng.random() < 0.55
        asked = Decimal(rng.randint(1, 300 * 10**6)) / 10**6 if sells and rng.random() < 0.4 else None
        orders_.append((k, rng.choice(days_), rng.choice("aaabcd"), rng.choice([1, 1, 1, 2, 3, 4]), "RESGATE" if sells else "APLICACAO", Decimal(rng.randint(1, 60000)) / 100, asked))
    opening = [(c, i, date(2026, rng.randint(1, 5), 3), rng.choice(["EMISSAO", "EMISSAO", "RESGATE"]), Decimal(rng.randint(1, 100))) for c in "abcd" for i in (1, 2) for _ in range(2)]
    got = replay.replay_orders(_inputs(spark, rows), cal, spark.createDataFrame(orders_, ORDERS), spark.createDataFrame(opening, UNITS_SCHEMA), stored)
    closes, verdicts = call_by_call(rows, orders_, opening, store, lambda a, b: max(0, counts[b] - counts[a]))
    found = {r.ordem: (r.quantidade, r.valor_cota, r.valor_financeiro, r.aceito, r.saldo_cotas) for r in got.orders.collect()}
    assert found == verdicts and len({v[3] for v in verdicts.values()}) == 2
    new = got.closes.collect()
    assert len(new) == len(rows)
    for r in new:
        x, row = closes[r.classe_id, r.data_referencia]
        assert (r.versao, r.n_du, r.caixa, r.quantidade_cotas, r.provisao_adm_acumulada, r.valor_cota, r.cota_anterior) == (x["v"], x["n"], row[7], row[8], x["total"], x["price"], x["prev"])
    assert got.rounds <= 9


def test_replay_on_worked_figures(spark):
    cal = build_calendar(spark, "2026-01-01", "2026-12-31")
    rows = [c[0] for c in CHAIN]
    plain = replay.replay_orders(_inputs(spark, rows), cal, spark.createDataFrame([], ORDERS))
    assert plain.rounds == 1
    check_chain(sorted(plain.closes.collect(), key=lambda r: r.data_referencia), CHAIN)
    orders_ = [(1, date(2026, 1, 31), "c", 1, "APLICACAO", Decimal("148.99"), None), (2, date(2026, 1, 31), "c", 2, "APLICACAO", Decimal("148.98"), None),
               (3, date(2026, 1, 31), "c", 2, "RESGATE", Decimal("0.00"), Decimal("99.5")), (4, date(2027, 1, 1), "c", 2, "APLICACAO", Decimal("5.00"), None),
               (5, date(2026, 1, 31), "c", 1, "RESGATE", Decimal("148.99"), None), (6, date(2026, 1, 31), "c", 3, "RESGATE", Decimal("0.01"), None)]
    got = replay.replay_orders(_inputs(spark, rows[:2]), cal, spark.createDataFrame(orders_, ORDERS))
    found = {r.ordem: (r.quantidade, r.valor_cota, r.valor_financeiro, r.aceito) for r in got.orders.collect()}
    # at 1.48985 a unit: 148.99 buys 100.003356042555 units, 148.98 buys 99.996643957445; 99.5 units go for 148.240075
    assert found[1] == (Decimal("100.003356042555"), Decimal("1.489850000000"), Decimal("148.99"), True)
    assert found[2][0] == Decimal("99.996643957445") and found[3][2:] == (Decimal("148.24"), True)
    assert found[5] == (Decimal("100.003356042555"), Decimal("1.489850000000"), Decimal("148.99"), True) and not found[6][3]
    last = max(got.closes.collect(), key=lambda r: r.data_referencia)
    # cash 700 + 148.98 - 148.24, units 1000 + 99.996643957445 - 99.5
    assert last.caixa == Decimal("700.74") and last.quantidade_cotas == Decimal("1000.496643957445")
    assert last.pl_liquido == Decimal("1690.59") and last.valor_cota == Decimal("1.689750795478")


def test_hot_investor_is_screened_by_days(spark):
    """One investor with most orders: nothing enters the fold unless a redemption fails, and then only from that day on."""
    rng = random.Random(3)
    rows, held = [], Decimal(0)
    for k in range(600):
        d = date(2024, 1 + k // 60, 1 + k % 28)
        rows.append((k, d, "c", 1 if k % 3 else 2 + k, "APLICACAO", Decimal(rng.randint(1, 100)), None))
    rows.append((1000, date(2024, 12, 1), "c", 1, "RESGATE", Decimal("5.00"), None))
    df = spark.createDataFrame(rows, ORDERS)
    stream = df.select("classe_id", "cotista_id", "data", F.lit(1).alias("_k"), "ordem", (F.col("tipo") == "RESGATE").alias("_redeem"), F.col("valor").cast("decimal(28,12)").alias("_q"))
    clear, rest = orders._screened(stream)
    assert rest.isEmpty() and clear.count() == len(rows)
    late = stream.unionByName(spark.createDataFrame([("c", 1, date(2024, 11, 1), 1, 2000, True, Decimal(10**7)), ("c", 1, date(2024, 11, 2), 1, 2001, True, Decimal(1))], stream.schema))
    clear, rest = orders._screened(late)
    held = sum(r[5] for r in rows if r[3] == 1 and r[4] == "APLICACAO")
    assert {(r.ordem, r._k, r._q) for r in rest.collect()} == {(None, 0, held), (2000, 1, 10**7), (2001, 1, 1), (1000, 1, 5)}
    closes = spark.createDataFrame([], "classe_id string, data_referencia date, versao long, valor_cota decimal(28,12)")
    more = spark.createDataFrame([(2000, date(2024, 11, 1), "c", 1, "RESGATE", Decimal(10**7), None), (2001, date(2024, 11, 2), "c", 1, "RESGATE", Decimal(1), None)], ORDERS)
    got = {r.ordem: (r.aceito, r.saldo_cotas) for r in orders.process_orders(df.unionByName(more), closes).collect()}
    assert got[2000] == (False, held) and got[2001] == (True, held - 1) and got[1000] == (True, held - 6)


def test_audit_is_the_difference_of_two_states(spark):
    schema = "id long, versao long, status string, preco decimal(10,2)"
    before = spark.createDataFrame([(1, 1, "P", Decimal("1.50")), (2, 1, "P", Decimal("2.00")), (3, 1, "P", None), (4, 1, "P", Decimal("4.00"))], schema)
    after = spark.createDataFrame([(1, 1, "P", Decimal("1.50")), (2, 2, "P", Decimal("2.50")), (3, 1, "S", Decimal("3.00")), (5, 1, "P", None)], schema)
    rows = access.audit_changes(before, after, ["id"], ["versao", "status", "preco"], F.when(F.col("d").isNull(), "GONE").when(F.col("a").isNull(), "NEW").otherwise("CHANGED"),
                                "t", F.col("id"), F.lit("2026-03-01").cast("date"))
    got = {int(r.entidade_id): (r.acao, r.campos, r.antes, r.depois, r.mes) for r in rows.collect()}
    assert got == {
        2: ("CHANGED", ["versao", "preco"], '{"versao":1,"preco":2.00}', '{"versao":2,"preco":2.50}', "202603"),
        3: ("CHANGED", ["status", "preco"], '{"status":"P"}', '{"status":"S","preco":3.00}', "202603"),
        4: ("GONE", ["versao", "status", "preco"], '{"versao":1,"status":"P","preco":4.00}', None, "202603"),
        5: ("NEW", ["versao", "status"], None, '{"versao":1,"status":"P"}', "202603"),
    }


def D(day: int) -> date:
    return date(2026, 1, day)


M = Decimal


def test_status_meets_titles_by_their_key_alone(spark):
    """One join by fund and id serves matches and status (the date would shuffle the titles again); null keys and dates match nothing."""
    from recvfund.operators import ledger

    titles = spark.createDataFrame([(1, "a", D(1), "c", M("5.00")), (1, "b", D(1), "c", M("5.00")), (1, "b", D(2), "c", M("5.00")),
                                    (1, "n", None, "c", M("5.00")), (None, "a", D(1), "c", M("5.00"))],
                                   "fundo_id int, identificador_externo string, data_aquisicao date, classe_id string, valor_face decimal(20,2)")
    events = spark.createDataFrame([(i, 1, x, D(3), None, "PAGAMENTO") for i, x in enumerate("abnz")],
                                   "ordem int, fundo_id int, identificador_externo string, data_evento date, valor decimal(20,2), tipo string")
    status, _ = ledger.apply_title_events(titles, events)
    assert sorted((r.fundo_id or 0, r.identificador_externo, r.situacao, r.n_eventos) for r in status.collect()) == [
        (0, "a", "ATIVO", 0), (1, "a", "LIQUIDADO", 1), (1, "b", "ATIVO", 0), (1, "b", "ATIVO", 0), (1, "n", "ATIVO", 0)]
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert "data_aquisicao" not in next(ln for ln in plan.splitlines() if "Join LeftOuter" in ln)


def test_replay_screens_unknown_investors_once(spark, monkeypatch):
    """Refusals and opening balances depend on no price: every round reads them as they were written."""
    from recvfund.operators import orders, replay

    seen = []
    real = orders.opening_units
    monkeypatch.setattr(replay, "opening_units", lambda units: seen.append(1) or real(units))
    inputs = _inputs(spark, [_row(D(d), "100.00", "0.00", "0.00", "100") for d in (10, 20, 30)])
    placed = spark.createDataFrame([(1, D(15), "c", 7, "APLICACAO", M("50.00"), None), (2, D(25), "c", 7, "RESGATE", M("10.00"), None),
                                    (3, D(25), "c", 8, "RESGATE", M("10.00"), None), (4, D(25), "c", 9, "RESGATE", M("10.00"), None)],
                                   "ordem long, data date, classe_id string, cotista_id long, tipo string, valor decimal(20,2), quantidade_solicitada decimal(28,12)")
    units = spark.createDataFrame([("c", 8, D(1), "EMISSAO", M("100"))], "classe_id string, cotista_id long, data date, tipo string, quantidade decimal(28,12)")
    who = spark.createDataFrame([(7,), (8,)], "cotista_id long")
    r = replay.replay_orders(inputs, build_calendar(spark, "2026-01-01", "2026-12-31"), placed, units, classes=spark.createDataFrame([("c",)], "classe_id string"), cotistas=who)
    assert {x.ordem: (x.aceito, x.motivo) for x in r.orders.collect()} == {1: (True, None), 2: (True, None), 3: (True, None), 4: (False, K.MSG_ORDEM_COTISTA)}
    assert r.rounds > 1 and len(seen) == 1


def test_dealt_title_events_are_the_same(spark):
    """Status and resolved events do not depend on how many partitions titles are dealt into; titles are not sorted before they are."""
    from recvfund.operators import ledger

    titles = spark.createDataFrame([(1, "a", D(1), "c", M("5.00")), (1, "b", D(1), "c", M("5.00")), (1, "b", D(2), "d", M("4.00")), (None, "a", D(1), "c", M("5.00"))],
                                   "fundo_id int, identificador_externo string, data_aquisicao date, classe_id string, valor_face decimal(20,2)")
    events = spark.createDataFrame([(i, 1, x, D(3), None, "PAGAMENTO") for i, x in enumerate("abnz")],
                                   "ordem int, fundo_id int, identificador_externo string, data_evento date, valor decimal(20,2), tipo string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = [key(x) for x in ledger.apply_title_events(titles, events)]
    status, resolved = ledger.apply_title_events(titles, events, partitions=7)
    assert [key(status), key(resolved), key(ledger.title_status(titles, resolved, 7))] == [*want, want[0]]
    plan = ledger.resolve_events(titles, events, partitions=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_orders_are_priced_and_screened_once(spark):
    """What several steps of the guard read is written: the result's plan has no window, and reads nothing else."""
    df = spark.createDataFrame([(1, D(3), "c", 1, "APLICACAO", M("10.00")), (2, D(4), "c", 1, "RESGATE", M("4.00")), (3, D(5), "c", 1, "RESGATE", M("9.00")), (4, D(6), "c", 1, "RESGATE", M("6.00"))],
                               "ordem long, data date, classe_id string, cotista_id long, tipo string, valor decimal(20,2)")
    closes = spark.createDataFrame([("c", D(4), 1, M("2"))], "classe_id string, data_referencia date, versao long, valor_cota decimal(28,12)")
    got = orders.process_orders(df, closes)
    # 10 units at par; from the 4th on a unit is worth 2
    assert {r.ordem: (r.aceito, r.saldo_cotas) for r in got.collect()} == {1: (True, 10), 2: (True, 8), 3: (True, M("3.5")), 4: (True, M("0.5"))}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and {f.split("/recvfund-")[-1].rsplit("-", 1)[0] for f in (x.rsplit("/", 1)[0] for x in got.inputFiles())} == {"ordens-preco", "triagem"}
