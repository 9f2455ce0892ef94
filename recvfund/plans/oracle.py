"""DuckDB SQL for every registered query, written independently of the Spark code.

The driver registers the base tables as views; the domain views are rebuilt
here as CTEs. ``with_views(body, *names)`` prepends the CTEs a body needs
(dependencies first).
"""

from __future__ import annotations

import re

from .. import constants as K
from ..sources.fixtures import FIXTURE_HOLIDAYS_MMDD
from .context import MARK_DATE

# wider than any date of the tables: day counts do not depend on where a calendar begins
CAL_START, CAL_END = "1990-01-01", "2010-12-31"

_HOL_MMDD = ", ".join(f"'{x}'" for x in FIXTURE_HOLIDAYS_MMDD)
_HOL_DATED = ", ".join(f"date '{x}'" for x in K.SEEDED_HOLIDAYS)
_BANDS = ", ".join(f"({d}, cast({p} as decimal(6,4)), '{r}')" for d, p, r in K.PDD_BANDS)

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_view("fx_fundo", [], """
select r_regionkey as fundo_id, cast(10000000000000 + r_regionkey as varchar) as cnpj, r_name as nome,
       case when r_regionkey = 4 then 'ENCERRADO' else 'ATIVO' end as situacao
from region""")

_view("fx_classe", ["fx_fundo"], """
select f.cnpj || '|' || p.codigo as classe_id, f.fundo_id, f.cnpj, p.codigo, 'Cota ' || p.codigo as nome,
       case when p.codigo < 'C' then 'SENIOR' when p.codigo < 'H' then 'MEZANINO' else 'SUBORDINADA' end as tipo
from (select distinct n_regionkey as fundo_id, c_mktsegment as codigo
      from customer join nation on n_nationkey = c_nationkey) p
join fx_fundo f on f.fundo_id = p.fundo_id
where not (f.fundo_id = 3 and p.codigo = 'FURNITURE')""")

_view("fx_faixa_pdd", [], f"""
select * from (values {_BANDS}) b(dias_atraso_min, percentual, rating)""")

_view("fx_parametro", ["fx_classe"], """
select classe_id, date '1990-01-01' as vigencia_inicio, date '1998-12-31' as vigencia_fim,
       cast(1.5 as decimal(9,6)) as taxa_administracao_aa from fx_classe
union all
select classe_id, date '1999-01-01', cast(null as date), cast(2.0 as decimal(9,6)) from fx_classe""")

_view("fx_calendario", [], f"""
select d as data, du as dia_util,
       cast(sum(case when du then 1 else 0 end) over (order by d) as integer) as du_acumulado,
       max(case when du then d end) over (order by d) as ultimo_du
from (select cast(g.d as date) as d,
             isodow(g.d) < 6 and strftime(g.d, '%m-%d') not in ({_HOL_MMDD})
             and cast(g.d as date) not in ({_HOL_DATED}) as du
      from generate_series(date '{CAL_START}', date '{CAL_END}', interval 1 day) g(d)) x""")

_view("fx_base", [], """
select l.*, o.o_orderdate, c.c_custkey, c.c_mktsegment, c.c_name, s.s_name, n.n_regionkey,
       l_orderkey * 7 + l_partkey * 13 + l_suppkey * 3 + l_linenumber as h,
       cast(l_extendedprice as decimal(18,2)) as vf,
       round(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))), 2) as va,
       cast(10000000000000 + n_regionkey as varchar) as cnpj,
       cast(10000000000000 + l_suppkey as varchar) as ced_doc
from lineitem l join orders o on o_orderkey = l_orderkey join customer c on c_custkey = o_custkey
join nation n on n_nationkey = c_nationkey join supplier s on s_suppkey = l_suppkey""")

_view("fx_titulo", ["fx_base"], """
select identificador_externo, fundo_id, classe_id, data_aquisicao, data_vencimento, valor_face, valor_aquisicao,
       cedente, sacado, l_returnflag, l_linestatus, l_linenumber, 'NF-' || split_part(identificador_externo, '-', 1) as numero_titulo,
       case l_linenumber % 3 when 0 then 'CCB' when 1 then 'DUPLICATA' else 'CARTAO' end as tipo_ativo
from (
  select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as identificador_externo,
         n_regionkey as fundo_id, cnpj || '|' || c_mktsegment as classe_id,
         cast(o_orderdate as date) as data_aquisicao, cast(l_shipdate as date) as data_vencimento,
         cast(vf as decimal(20,2)) as valor_face, cast(va as decimal(20,2)) as valor_aquisicao,
         s_name as cedente, c_name as sacado, l_returnflag, l_linestatus, l_linenumber,
         row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity) as rn
  from fx_base where cast(l_shipdate as date) >= cast(o_orderdate as date)) t
where rn = 1""")

_view("fx_evento_todos", ["fx_titulo"], """
with f as (select *, cast(split_part(identificador_externo, '-', 1) as bigint) * 80 + l_linenumber * 8 as p from fx_titulo where l_linestatus = 'F')
select identificador_externo, fundo_id, p as ordem, cast(data_vencimento + 1 as date) as data_evento, cast(null as decimal(20,2)) as valor, 'ATRASO' as tipo
from f where l_linenumber % 4 = 0
union all
select identificador_externo, fundo_id, p + 1, cast(data_vencimento + cast(l_linenumber as integer) as date),
       case when l_linenumber % 3 <> 0 then valor_face end,
       case l_returnflag when 'A' then 'PAGAMENTO' when 'R' then 'RECOMPRA'
            else case when l_linenumber % 2 = 0 then 'BAIXA' else 'PAGAMENTO_PARCIAL' end end
from f
union all select identificador_externo, fundo_id, p + 2, data_vencimento, null, 'BAIXA' from f where l_linenumber = 5
union all select identificador_externo, fundo_id, p + 3, cast(data_vencimento + 9 as date), null, 'PRORROGACAO' from f where l_linenumber = 6
union all select 'X-' || identificador_externo, fundo_id, p + 4, cast(data_vencimento + 2 as date), valor_face, 'PAGAMENTO' from f where l_linenumber = 7""")

# events that resolve to one title and are of a known kind; class and missing value come from the title
_view("fx_evento", ["fx_titulo", "fx_evento_todos"], """
select e.identificador_externo, e.fundo_id, t.classe_id, e.ordem, e.data_evento, coalesce(e.valor, t.valor_face) as valor, e.tipo
from fx_evento_todos e join fx_titulo t on t.fundo_id = e.fundo_id and t.identificador_externo = e.identificador_externo
where e.tipo in ('PAGAMENTO', 'PAGAMENTO_PARCIAL', 'BAIXA', 'RECOMPRA', 'ATRASO', 'AJUSTE')""")


def _status(events: str) -> str:
    """Current status: the status-changing event that was posted last wins; without one the title is ATIVO."""
    return f"""
select t.*, coalesce(s.situacao, 'ATIVO') as situacao, coalesce(n.n_eventos, 0) as n_eventos
from fx_titulo t
left join (
  select fundo_id, identificador_externo,
         arg_max(case tipo when 'PAGAMENTO' then 'LIQUIDADO' when 'BAIXA' then 'BAIXADO' else 'RECOMPRADO' end, ordem) as situacao
  from {events} where tipo in ('PAGAMENTO', 'BAIXA', 'RECOMPRA')
  group by fundo_id, identificador_externo) s
on s.fundo_id = t.fundo_id and s.identificador_externo = t.identificador_externo
left join (select fundo_id, identificador_externo, count(*) as n_eventos from {events} group by all) n
on n.fundo_id = t.fundo_id and n.identificador_externo = t.identificador_externo"""


_view("fx_titulo_status", ["fx_titulo", "fx_evento"], _status("fx_evento"))

_view("fx_titulo_ativo", ["fx_titulo_status"], """
select * from fx_titulo_status where situacao = 'ATIVO'""")

_view("fx_grid", ["fx_classe", "fx_titulo"], """
select c.classe_id, c.fundo_id, last_day(m.m) as data
from fx_classe c cross join (
  select cast(unnest(generate_series(date_trunc('month', min(data_aquisicao)), date_trunc('month', max(data_vencimento)), interval 1 month)) as date) as m
  from fx_titulo) m""")


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in _order(list(names)))
    return f"with {'recursive ' if recursive else ''}{ctes}\n{body.strip()}"


# reusable expressions ----------------------------------------------------------------------

def _accrual(vf: str, va: str, rem: str, tot: str) -> str:
    return (f"case when {rem} <= 0 or {tot} <= 0 then {vf} else cast(cast({vf} as double) / "
            f"pow(cast({vf} as double) / cast({va} as double), cast({rem} as double) / cast({tot} as double)) "
            f"as decimal(20,2)) end")


def _pct(days: str) -> str:
    return (f"coalesce((select percentual from fx_faixa_pdd where dias_atraso_min <= {days} "
            f"order by dias_atraso_min desc limit 1), cast(0 as decimal(6,4)))")


SQL: dict[str, str] = {}

SQL["business_days"] = with_views("""
select identificador_externo, data_aquisicao, data_vencimento,
       cast(greatest(cv.du_acumulado - ca.du_acumulado, 0) as bigint) as du_total
from fx_titulo t
left join fx_calendario ca on ca.data = t.data_aquisicao
left join fx_calendario cv on cv.data = t.data_vencimento""", "fx_titulo", "fx_calendario")

SQL["pdd_band"] = with_views(f"""
select identificador_externo, cast(dias_atraso as bigint) as dias_atraso, {_pct('dias_atraso')} as pct_pdd
from (select identificador_externo, greatest(datediff('day', data_vencimento, date '{MARK_DATE}'), 0) as dias_atraso
      from fx_titulo) t""", "fx_titulo", "fx_faixa_pdd")

SQL["param_asof"] = with_views("""
select g.classe_id, g.data, p.vigencia_inicio, coalesce(p.taxa_administracao_aa, cast(0 as decimal(9,6))) as taxa_administracao_aa
from fx_grid g
left join (
  select g2.classe_id, g2.data, arg_max(p2.vigencia_inicio, p2.vigencia_inicio) as vigencia_inicio,
         arg_max(p2.taxa_administracao_aa, p2.vigencia_inicio) as taxa_administracao_aa
  from fx_grid g2 join fx_parametro p2
    on p2.classe_id = g2.classe_id and p2.vigencia_inicio <= g2.data
   and (p2.vigencia_fim is null or p2.vigencia_fim >= g2.data)
  group by g2.classe_id, g2.data) p
on p.classe_id = g.classe_id and p.data = g.data""", "fx_grid", "fx_parametro")

_MARK_BASE = f"""
select t.*, cv.du_acumulado - ca.du_acumulado as du_total,
       cv.du_acumulado - (select du_acumulado from fx_calendario where data = date '{MARK_DATE}') as du_rem,
       greatest(datediff('day', t.data_vencimento, date '{MARK_DATE}'), 0) as dias_atraso
from fx_titulo_ativo t
left join fx_calendario ca on ca.data = t.data_aquisicao
left join fx_calendario cv on cv.data = t.data_vencimento
where t.data_aquisicao <= date '{MARK_DATE}'"""

SQL["title_marking"] = with_views(f"""
select identificador_externo, classe_id, data_aquisicao, data_vencimento, valor_face, valor_aquisicao,
       cast(du_total as bigint) as du_total, cast(du_rem as bigint) as du_rem, cast(dias_atraso as bigint) as dias_atraso,
       pct_pdd,
       {_accrual('valor_face', 'valor_aquisicao', 'du_rem', 'du_total')} as valor_presente,
       cast(case when dias_atraso > 0 then round(valor_face * pct_pdd, 2) else 0 end as decimal(20,2)) as pdd,
       cast(case when dias_atraso > 0 then valor_face else 0 end as decimal(20,2)) as a_receber
from (select b.*, {_pct('b.dias_atraso')} as pct_pdd from ({_MARK_BASE}) b) m""",
                                   "fx_titulo_ativo", "fx_calendario", "fx_faixa_pdd")

_GRID_MARK = """
select g.classe_id, g.data,
       count(t.identificador_externo) as qtd_ativos,
       coalesce(sum(case when cv.du_acumulado - cd.du_acumulado <= 0 or cv.du_acumulado - ca.du_acumulado <= 0
                         then t.valor_face
                         else cast(cast(t.valor_face as double) / pow(cast(t.valor_face as double) / cast(t.valor_aquisicao as double),
                              cast(cv.du_acumulado - cd.du_acumulado as double) / cast(cv.du_acumulado - ca.du_acumulado as double))
                              as decimal(20,2)) end), 0) as valor_presente,
       coalesce(sum(case when datediff('day', t.data_vencimento, g.data) > 0
                         then round(t.valor_face * (select coalesce(max_by(percentual, dias_atraso_min), 0) from fx_faixa_pdd
                                                     where dias_atraso_min <= datediff('day', t.data_vencimento, g.data)), 2)
                         else 0 end), 0) as pdd,
       coalesce(sum(case when datediff('day', t.data_vencimento, g.data) > 0 then t.valor_face else 0 end), 0) as a_receber
from fx_grid g
left join fx_titulo_ativo t on t.classe_id = g.classe_id and t.data_aquisicao <= g.data
left join fx_calendario ca on ca.data = t.data_aquisicao
left join fx_calendario cv on cv.data = t.data_vencimento
left join fx_calendario cd on cd.data = g.data
group by g.classe_id, g.data"""

SQL["class_marking"] = with_views(f"""
select classe_id, data, cast(qtd_ativos as bigint) as qtd_ativos, cast(valor_presente as decimal(20,2)) as valor_presente,
       cast(pdd as decimal(20,2)) as pdd, cast(a_receber as decimal(20,2)) as a_receber
from ({_GRID_MARK}) m""", "fx_grid", "fx_titulo_ativo", "fx_calendario", "fx_faixa_pdd")


# --- boleta batch ------------------------------------------------------------------------------
from .context import LOTE_ID  # noqa: E402
from ..sources.fixtures import CNPJ_BASE, PRIOR_CUTOFF  # noqa: E402

_view("fx_boleta_raw", ["fx_base"], """
select
  row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) + 1 as linha_numero,
  case when h % 211 = 0 then '' else cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) end as identificador_externo,
  case when h % 223 = 0 then '123' else substr(cnpj, 1, 8) || '/' || substr(cnpj, 9, 4) || '-' || substr(cnpj, 13, 2) end as fundo_cnpj,
  case when h % 227 = 0 then '' else c_mktsegment end as classe_codigo,
  case when h % 229 = 0 then '1997-13-01' else cast(cast(o_orderdate as date) as varchar) end as data_aquisicao,
  case when h % 233 = 0 then 'BOLETO' when l_linenumber % 3 = 0 then 'CCB' when l_linenumber % 3 = 1 then 'DUPLICATA' else 'CARTAO' end as tipo_ativo,
  case when h % 239 = 0 then '' else 'NF-' || cast(l_orderkey as varchar) end as numero_titulo,
  case when l_linenumber = 1 then '' else cast(l_linenumber as varchar) end as numero_parcela,
  '7' as total_parcelas,
  case when h % 241 = 0 then '999' else ced_doc end as cedente_documento,
  case when h % 251 = 0 then '  ' else ' ' || s_name || ' ' end as cedente_nome,
  case when h % 283 = 0 then '12345' when c_custkey % 2 = 0 then cast(20000000000 + c_custkey as varchar)
       else cast(30000000000000 + c_custkey as varchar) end as sacado_documento,
  case when h % 257 = 0 then '' else c_name end as sacado_nome,
  case when l_linenumber = 2 then 'x' else cast(cast(o_orderdate as date) as varchar) end as data_emissao,
  case when h % 263 = 0 then 'n/d' else cast(cast(l_shipdate as date) as varchar) end as data_vencimento,
  case when h % 269 = 0 then '-1' when h % 293 = 0 then 'NaN' when h % 307 = 0 then '1e30' when h % 311 = 0 then '0.001'
       else cast(vf as varchar) end as valor_face,
  case when h % 271 = 0 then 'abc' when h % 277 = 0 then cast(vf + 1 as varchar) else cast(va as varchar) end as valor_aquisicao,
  case l_linenumber when 3 then 'n' when 4 then '9999999' when 5 then 'NaN' when 6 then '18.5' else '' end as taxa_desconto_aa,
  case when h % 281 = 0 then 'TR' when l_returnflag = 'A' then 'cdi' when l_returnflag = 'R' then 'PRE' else '' end as indexador,
  '' as percentual_indexador,
  case when l_linestatus = 'O' then 's' else '' end as coobrigacao,
  'CTA-' || l_returnflag as conta_liquidacao
from fx_base""")


def _clean(c: str, digits: bool = False, upper: bool = False) -> str:
    e = f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
    if digits:
        e = f"regexp_replace({e}, '\\D', '', 'g')"
    if upper:
        e = f"upper({e})"
    return f"{e} as {c}"


_DIGITS = {"fundo_cnpj", "cedente_documento", "sacado_documento", "numero_parcela", "total_parcelas"}
def _norm_sql(src: str, extra: str = "") -> str:
    return f"select {extra}linha_numero, " + ", ".join(
        _clean(c, digits=c in _DIGITS, upper=c == "indexador") for c in K.BOLETA_COLUMNS) + f" from {src}"


_view("fx_boleta_norm", ["fx_boleta_raw"], _norm_sql("fx_boleta_raw"))

_TIPOS = ", ".join(f"'{x}'" for x in K.TIPOS_ATIVO)
_INDEX = ", ".join(f"'{x}'" for x in K.INDEXADORES)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _motivo_sql(src: str, part: str) -> str:
    return f"""
select n.*,
  case
    when identificador_externo = '' then {_q(K.MSG_ID_AUSENTE)}
    when length(fundo_cnpj) <> 14 then {_q(K.MSG_CNPJ_INVALIDO)}
    when fundo_cnpj not in (select cnpj from fx_fundo where situacao = 'ATIVO') then {_q(K.MSG_FUNDO_INATIVO)}
    when classe_codigo = '' then {_q(K.MSG_CLASSE_AUSENTE)}
    when not exists (select 1 from fx_classe k where k.cnpj = n.fundo_cnpj and k.codigo = n.classe_codigo) then {_q(K.MSG_CLASSE_FORA)}
    when try_strptime(data_aquisicao, '%Y-%m-%d') is null then {_q(K.MSG_DATA_AQ)}
    when tipo_ativo not in ({_TIPOS}) then {_q(K.MSG_TIPO)}
    when numero_titulo = '' then {_q(K.MSG_NUMERO)}
    when length(cedente_documento) not in (11, 14) then {_q(K.MSG_CED_DOC)}
    when cedente_nome = '' then {_q(K.MSG_CED_NOME)}
    when length(sacado_documento) not in (11, 14) then {_q(K.MSG_SAC_DOC)}
    when sacado_nome = '' then {_q(K.MSG_SAC_NOME)}
    when try_strptime(data_vencimento, '%Y-%m-%d') is null then {_q(K.MSG_DATA_VENC)}
    when try_cast(valor_face as decimal(20,2)) is null or try_cast(valor_face as decimal(20,2)) <= 0 then {_q(K.MSG_VF)}
    when try_cast(valor_aquisicao as decimal(20,2)) is null or try_cast(valor_aquisicao as decimal(20,2)) <= 0 then {_q(K.MSG_VA)}
    when try_cast(valor_aquisicao as decimal(20,2)) > try_cast(valor_face as decimal(20,2)) then {_q(K.MSG_VA_MAIOR)}
    when try_strptime(data_vencimento, '%Y-%m-%d') < try_strptime(data_aquisicao, '%Y-%m-%d') then {_q(K.MSG_VENC_ANTES)}
    when indexador <> '' and indexador not in ({_INDEX}) then {_q(K.MSG_INDEXADOR)}
    when linha_numero > min(linha_numero) over (partition by {part}) then {_q(K.MSG_DUPLICADO)}
  end as motivo_rejeicao
from {src} n"""

def _val_sql(src: str, extra: str = "") -> str:
    return f"""
select {extra}linha_numero, identificador_externo, fundo_cnpj, classe_codigo, data_aquisicao, tipo_ativo, numero_titulo,
       numero_parcela, total_parcelas, cedente_documento, cedente_nome, sacado_documento, sacado_nome,
       case when try_strptime(data_emissao, '%Y-%m-%d') is null then '' else data_emissao end as data_emissao,
       data_vencimento, valor_face, valor_aquisicao,
       case when try_cast(taxa_desconto_aa as decimal(12,6)) is null then '' else taxa_desconto_aa end as taxa_desconto_aa,
       indexador,
       case when try_cast(percentual_indexador as decimal(9,4)) is null then '' else percentual_indexador end as percentual_indexador,
       coobrigacao, conta_liquidacao, motivo_rejeicao is null as valido, motivo_rejeicao
from {src}"""


_view("fx_boleta_motivo", ["fx_boleta_norm", "fx_fundo", "fx_classe"], _motivo_sql("fx_boleta_norm", "identificador_externo"))
_view("fx_boleta_val", ["fx_boleta_motivo"], _val_sql("fx_boleta_motivo"))

SQL["boleta_validation"] = with_views("select * from fx_boleta_val", "fx_boleta_val")

SQL["boleta_rejection_lines"] = with_views("""
select linha_numero, identificador_externo, motivo_rejeicao from fx_boleta_val where not valido""", "fx_boleta_val")

SQL["batch_summary"] = with_views("""
select count(*) as linhas_total, count(*) filter (where valido) as linhas_aceitas,
       count(*) filter (where not valido) as linhas_rejeitadas,
       case when count(distinct data_aquisicao) filter (where valido) = 1
            then cast(min(data_aquisicao) filter (where valido) as date) end as data_referencia,
       case when count(distinct fundo_cnpj) filter (where valido) = 1
            then min(fundo_cnpj) filter (where valido) end as fundo_cnpj
from fx_boleta_val""", "fx_boleta_val")

SQL["rejection_sample"] = with_views("""
select linha_numero, motivo_rejeicao from fx_boleta_val where not valido order by linha_numero limit 20""", "fx_boleta_val")

_view("fx_prior_base", ["fx_base"], f"""
select * from fx_base where cast(o_orderdate as date) < date '{PRIOR_CUTOFF}'""")

SQL["counterparty_upsert"] = with_views("""
select 'CEDENTE' as papel, documento, nome, sha256('cedente|' || documento) as id
from (select cedente_documento as documento, arg_min(cedente_nome, linha_numero) as nome
      from fx_boleta_val where valido group by cedente_documento) v
where documento not in (select ced_doc from fx_prior_base)
union all
select 'SACADO', documento, nome, sha256('sacado|' || documento)
from (select sacado_documento as documento, arg_min(sacado_nome, linha_numero) as nome
      from fx_boleta_val where valido group by sacado_documento) v
where documento not in (select case when c_custkey % 2 = 0 then cast(20000000000 + c_custkey as varchar)
                                    else cast(30000000000000 + c_custkey as varchar) end from fx_prior_base)""",
                                         "fx_boleta_val", "fx_prior_base")

_view("fx_titulo_inserido", ["fx_boleta_val", "fx_fundo", "fx_classe", "fx_titulo"], f"""
select cast(v.data_aquisicao as date) as data_aquisicao, f.fundo_id, c.classe_id, '{LOTE_ID}' as lote_id,
       sha256('cedente|' || v.cedente_documento) as cedente_id, sha256('sacado|' || v.sacado_documento) as sacado_id,
       v.identificador_externo, v.tipo_ativo, v.numero_titulo,
       cast(coalesce(try_cast(nullif(v.numero_parcela, '') as smallint), 1) as bigint) as numero_parcela,
       cast(coalesce(try_cast(nullif(v.total_parcelas, '') as smallint), 1) as bigint) as total_parcelas,
       cast(nullif(v.data_emissao, '') as date) as data_emissao, cast(v.data_vencimento as date) as data_vencimento,
       cast(v.valor_face as decimal(20,2)) as valor_face, cast(v.valor_aquisicao as decimal(20,2)) as valor_aquisicao,
       cast(nullif(v.taxa_desconto_aa, '') as decimal(12,6)) as taxa_desconto_aa,
       coalesce(nullif(v.indexador, ''), 'PRE') as indexador,
       cast(nullif(v.percentual_indexador, '') as decimal(9,4)) as percentual_indexador,
       upper(coalesce(nullif(v.coobrigacao, ''), 'N')) in ('S', 'SIM', 'TRUE', '1') as coobrigacao,
       nullif(v.conta_liquidacao, '') as conta_liquidacao, 'ATIVO' as situacao,
       sha256(cast(f.fundo_id as varchar) || '|' || v.identificador_externo || '|' || v.data_aquisicao) as id,
       strftime(cast(v.data_aquisicao as date), '%Y%m') as mes_aquisicao
from fx_boleta_val v
join fx_fundo f on f.cnpj = v.fundo_cnpj
join fx_classe c on c.fundo_id = f.fundo_id and c.codigo = v.classe_codigo
where v.valido and not exists (
  select 1 from fx_titulo p where p.data_aquisicao < date '{PRIOR_CUTOFF}' and p.fundo_id = f.fundo_id
     and p.identificador_externo = v.identificador_externo and p.data_aquisicao = cast(v.data_aquisicao as date))""")

SQL["title_insert"] = with_views("select * from fx_titulo_inserido", "fx_titulo_inserido")

SQL["acquisition_cash"] = with_views("""
select fundo_id, classe_id, data_aquisicao as data, 'AQUISICAO_DC' as tipo, cast(-sum(valor_aquisicao) as decimal(20,2)) as valor,
       'Aquisição de recebíveis (lote)' as descricao, lote_id
from fx_titulo_inserido group by fundo_id, classe_id, data_aquisicao, lote_id""", "fx_titulo_inserido")

SQL["batch_result"] = with_views("""
select v.linhas_total, v.linhas_aceitas, i.registros_inseridos, v.linhas_total - v.linhas_aceitas as linhas_rejeitadas,
       v.linhas_aceitas - i.registros_inseridos as duplicados_ignorados
from (select count(*) as linhas_total, count(*) filter (where valido) as linhas_aceitas from fx_boleta_val) v,
     (select count(*) as registros_inseridos from fx_titulo_inserido) i""", "fx_boleta_val", "fx_titulo_inserido")


# --- ledgers, closes, report ---------------------------------------------------------------------
from .context import POSITION_DATE, REPORT_DATE  # noqa: E402


def _he(num: str, den: str) -> str:
    """HALF_EVEN rounding of num/den for HUGEINT operands, den > 0."""
    a = f"abs({num})"
    q, r = f"({a} // ({den}))", f"({a} % ({den}))"
    return (f"(sign({num}) * ({q} + case when 2 * {r} > ({den}) or (2 * {r} = ({den}) and {q} % 2 = 1) "
            f"then 1 else 0 end))")


def _units(x: str) -> str:
    """Exact decimal -> HUGEINT in units of its last decimal place."""
    return f"cast(replace(cast({x} as varchar), '.', '') as hugeint)"


def _fixed(u: str, scale: int, width: int) -> str:
    """HUGEINT in units of 10^-scale -> DECIMAL(width, scale), exactly."""
    p = f"cast(1{'0' * scale} as hugeint)"
    a = f"abs({u})"
    return (f"cast(sign({u}) * (cast({a} // {p} as decimal({width},{scale})) + "
            f"cast({a} % {p} as decimal({scale + 1},0)) * cast('0.{'0' * (scale - 1)}1' as decimal({scale + 1},{scale}))) "
            f"as decimal({width},{scale}))")


_E12 = "cast(1000000000000 as hugeint)"

_view("fx_cota_movimento", ["fx_fundo"], """
select o_orderkey as mov_id, cnpj || '|' || c_mktsegment as classe_id, case when o_orderkey % 17 <> 0 then c_custkey end as cotista_id, cast(o_orderdate as date) as data,
       case when o_orderstatus = 'F' then 'RESGATE' else 'EMISSAO' end as tipo,
       cast(cast(o_totalprice as decimal(18,2)) * cast(case when o_orderstatus = 'F' then 0.25 else 1 end as decimal(4,2)) as decimal(28,12)) as quantidade
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
join fx_fundo on fundo_id = n_regionkey""")

_view("fx_cotista", [], """
select c_custkey as cotista_id,
       case when c_custkey % 2 = 0 then cast(20000000000 + c_custkey as varchar) else cast(30000000000000 + c_custkey as varchar) end as documento,
       c_name as nome, case when c_custkey % 2 = 0 then 'PF' else 'PJ' end as tipo_investidor
from customer""")

_view("fx_movimento_caixa", ["fx_cota_movimento", "fx_titulo", "fx_evento"], """
select classe_id, data, case when tipo = 'EMISSAO' then 'APORTE' else 'RESGATE' end as tipo,
       cast(case when tipo = 'EMISSAO' then round(quantidade, 2) else -round(quantidade, 2) end as decimal(20,2)) as valor
from fx_cota_movimento
union all
select classe_id, data_aquisicao, 'AQUISICAO_DC', cast(-sum(valor_aquisicao) as decimal(20,2)) from fx_titulo group by classe_id, data_aquisicao
union all
select classe_id, data_evento, 'RECEBIMENTO_DC', cast(valor as decimal(20,2)) from fx_evento where tipo in ('PAGAMENTO', 'RECOMPRA')""")

_view("fx_grid_mark", ["fx_grid", "fx_titulo_ativo", "fx_calendario", "fx_faixa_pdd"], _GRID_MARK)

_view("fx_close_in", ["fx_grid", "fx_grid_mark", "fx_movimento_caixa", "fx_cota_movimento", "fx_parametro"], """
select g.classe_id, g.fundo_id, g.data, m.qtd_ativos, cast(m.valor_presente as decimal(20,2)) as valor_presente,
       cast(m.pdd as decimal(20,2)) as pdd, cast(m.a_receber as decimal(20,2)) as a_receber,
       cast(coalesce((select sum(valor) from fx_movimento_caixa x where x.classe_id = g.classe_id and x.data <= g.data), 0) as decimal(20,2)) as caixa,
       cast(coalesce((select sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) from fx_cota_movimento u
                      where u.classe_id = g.classe_id and u.data <= g.data), 0) as decimal(28,12)) as cotas,
       cast(coalesce((select arg_max(taxa_administracao_aa, vigencia_inicio) from fx_parametro p
                      where p.classe_id = g.classe_id and p.vigencia_inicio <= g.data
                        and (p.vigencia_fim is null or p.vigencia_fim >= g.data)), 0) as decimal(9,6)) as taxa
from fx_grid g join fx_grid_mark m on m.classe_id = g.classe_id and m.data = g.data""")

_view("fx_close_b", ["fx_close_in", "fx_calendario"], """
select a.*, case when a.prev is null then 1 else greatest(c1.du_acumulado - c0.du_acumulado, 0) end as n_du,
       cast(a.valor_presente + a.caixa as decimal(20,2)) as pl_bruto
from (select *, lag(data) over (partition by classe_id order by data) as prev from fx_close_in) a
left join fx_calendario c0 on c0.data = a.prev
left join fx_calendario c1 on c1.data = a.data""")

_view("fx_close_c", ["fx_close_b"], f"""
select *, {_he(f"{_units('pl_bruto')} * {_units('taxa')} * cast(n_du as hugeint)", "cast(25200000000 as hugeint)")} as desp_c
from fx_close_b""")

_view("fx_close_e", ["fx_close_c"], f"""
select d.*, {_units('pl_bruto')} - {_units('pdd')} - prov_c as liq_c, {_units('cotas')} as u
from (select *, sum(desp_c) over (partition by classe_id order by data rows between unbounded preceding and current row) as prov_c
      from fx_close_c) d""")

_view("fx_close_g", ["fx_close_e"], f"""
select *, lag(cota_u) over (partition by classe_id order by data) as ant_u
from (select *, case when u > 0 then {_he(f"liq_c * {_E12} * cast(10000000000 as hugeint)", "u")} end as cota_u from fx_close_e) f""")

_view("fx_fechamento", ["fx_close_g"], f"""
select fundo_id, classe_id, data as data_referencia, cast(1 as bigint) as versao, 'PROCESSADO' as status,
       valor_presente as valor_presente_ativos, pdd as pdd_total, caixa, a_receber as contas_receber,
       cast(0 as decimal(20,2)) as contas_pagar, pl_bruto,
       {_fixed('desp_c', 2, 20)} as despesa_adm_dia, {_fixed('prov_c', 2, 20)} as provisao_adm_acumulada,
       {_fixed('liq_c', 2, 20)} as pl_liquido, cotas as quantidade_cotas,
       {_fixed('cota_u', 12, 28)} as valor_cota, {_fixed('ant_u', 12, 28)} as cota_anterior,
       case when cota_u is not null and coalesce(ant_u, {_E12}) > 0
            then {_fixed(_he(f"(cota_u - coalesce(ant_u, {_E12})) * cast(10000000000 as hugeint)", f"coalesce(ant_u, {_E12})"), 10, 18)}
       end as rentabilidade_dia,
       cast(qtd_ativos as bigint) as qtd_ativos, cast(n_du as bigint) as n_du
from fx_close_g""")

SQL["cash_balance"] = with_views("""
select g.classe_id, g.data,
       cast(coalesce((select sum(valor) from fx_movimento_caixa x where x.classe_id = g.classe_id and x.data <= g.data), 0) as decimal(20,2)) as caixa
from fx_grid g""", "fx_grid", "fx_movimento_caixa")

SQL["unit_balance"] = with_views("""
select g.classe_id, g.data,
       cast(coalesce((select sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) from fx_cota_movimento u
                      where u.classe_id = g.classe_id and u.data <= g.data), 0) as decimal(28,12)) as quantidade_cotas
from fx_grid g""", "fx_grid", "fx_cota_movimento")

_view("fx_posicao", ["fx_cota_movimento"], f"""
select classe_id, cotista_id, cast(sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) as decimal(28,12)) as cotas
from fx_cota_movimento where data <= date '{POSITION_DATE}' and cotista_id is not null
group by classe_id, cotista_id
having sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) > 0""")

SQL["investor_position"] = with_views("select * from fx_posicao", "fx_posicao")

_PAR = "cast(1 as decimal(28,12))"
SQL["price_asof"] = with_views(f"""
select m.mov_id, m.classe_id, m.data,
       coalesce((select arg_max(valor_cota, data_referencia) from fx_fechamento f
                 where f.classe_id = m.classe_id and f.data_referencia <= m.data and f.valor_cota is not null), {_PAR}) as valor_cota_aplicavel
from fx_cota_movimento m""", "fx_cota_movimento", "fx_fechamento")

SQL["title_status"] = with_views("""
select identificador_externo, fundo_id, classe_id, data_aquisicao, situacao, cast(n_eventos as bigint) as n_eventos
from fx_titulo_status""", "fx_titulo_status")

SQL["event_cash"] = with_views("""
select fundo_id, classe_id, data_evento as data, 'RECEBIMENTO_DC' as tipo, cast(valor as decimal(20,2)) as valor, identificador_externo
from fx_evento where tipo in ('PAGAMENTO', 'RECOMPRA')""", "fx_evento")

SQL["position_view"] = with_views(f"""
select classe_id, cotista_id, cotas, preco as valor_cota_aplicavel,
       {_fixed(_he(f"{_units('cotas')} * {_units('preco')}", "cast(10000000000000000000000 as hugeint)"), 2, 20)} as valor,
       {_fixed(_he(f"{_units('cotas')} * cast(1000000 as hugeint)", "tot"), 6, 20)} as participacao
from (select p.*, sum({_units('p.cotas')}) over (partition by p.classe_id) as tot,
             coalesce((select arg_max(valor_cota, data_referencia) from fx_fechamento f
                       where f.classe_id = p.classe_id and f.data_referencia <= date '{POSITION_DATE}' and f.valor_cota is not null), {_PAR}) as preco
      from fx_posicao p) x""", "fx_posicao", "fx_fechamento")

SQL["close_grid"] = with_views("select * from fx_fechamento", "fx_fechamento")

SQL["close_list"] = with_views("""
select fundo_id, classe_id, data_referencia, versao, status, pl_liquido, quantidade_cotas, valor_cota, rentabilidade_dia, qtd_ativos
from fx_fechamento order by data_referencia desc, versao desc, classe_id limit 200""", "fx_fechamento")

SQL["price_series"] = with_views("""
select classe_id, data_referencia, valor_cota from fx_fechamento where valor_cota is not null""", "fx_fechamento")

SQL["overview"] = with_views("""
select c.classe_id, c.fundo_id, (select count(*) from fx_fundo) as n_fundos,
       k.data_referencia, k.pl_liquido, k.valor_cota, k.rentabilidade_dia, k.qtd_ativos,
       k.n as n_fechamentos_recentes, k.inicio as inicio_janela
from fx_classe c join (
  select classe_id, max(data_referencia) as data_referencia, arg_max(pl_liquido, data_referencia) as pl_liquido,
         arg_max(valor_cota, data_referencia) as valor_cota, arg_max(rentabilidade_dia, data_referencia) as rentabilidade_dia,
         arg_max(qtd_ativos, data_referencia) as qtd_ativos, count(*) as n, min(data_referencia) as inicio
  from (select *, row_number() over (partition by classe_id order by data_referencia desc, versao desc) as r from fx_fechamento) t
  where r <= 8 group by classe_id) k on k.classe_id = c.classe_id""", "fx_classe", "fx_fundo", "fx_fechamento")

_view("fx_report_close", ["fx_fechamento"], f"""
select * from (select *, row_number() over (partition by classe_id order by data_referencia desc, versao desc) as r
               from fx_fechamento where data_referencia <= date '{REPORT_DATE}') t where r = 1""")

SQL["report_composition"] = with_views("""
select f.classe_id, f.fundo_id, fu.nome as fundo_nome, fu.cnpj as fundo_cnpj, c.codigo, c.nome as classe_nome, c.tipo as classe_tipo, f.data_referencia, f.versao, f.status,
       f.pl_bruto, f.pl_liquido, f.valor_cota, f.quantidade_cotas, f.rentabilidade_dia,
       cast(coalesce(m.valor_presente, 0) as decimal(20,2)) as estoque_valorizado,
       cast(coalesce(m.qtd_ativos, 0) as bigint) as estoque_qtd_titulos,
       f.caixa, f.pdd_total as pdd, f.contas_receber, f.contas_pagar, f.provisao_adm_acumulada as provisao_administracao,
       cast(coalesce(m.valor_presente, 0) - f.valor_presente_ativos as decimal(20,2)) as diferenca_estoque
from fx_report_close f
left join fx_grid_mark m on m.classe_id = f.classe_id and m.data = f.data_referencia
left join fx_classe c on c.classe_id = f.classe_id
left join fx_fundo fu on fu.fundo_id = c.fundo_id""", "fx_report_close", "fx_grid_mark", "fx_classe", "fx_fundo")

_view("fx_report_pos", ["fx_report_close", "fx_cota_movimento"], """
select m.classe_id, m.cotista_id, cast(sum(case when m.tipo = 'EMISSAO' then m.quantidade else -m.quantidade end) as decimal(28,12)) as cotas
from fx_cota_movimento m join fx_report_close f on f.classe_id = m.classe_id and m.data <= f.data_referencia
where m.cotista_id is not null
group by m.classe_id, m.cotista_id
having sum(case when m.tipo = 'EMISSAO' then m.quantidade else -m.quantidade end) > 0""")

SQL["report_investors"] = with_views(f"""
select x.classe_id, f.data_referencia, x.cotista_id, x.documento, x.nome, x.tipo_investidor, x.cotas,
       {_fixed(_he(f"{_units('x.cotas')} * {_units('coalesce(f.valor_cota, cast(0 as decimal(28,12)))')}", "cast(10000000000000000000000 as hugeint)"), 2, 20)} as valor,
       case when f.quantidade_cotas > 0
            then {_fixed(_he(f"{_units('x.cotas')} * {_E12}", _units('f.quantidade_cotas')), 12, 20)}
            else cast(0 as decimal(20,12)) end as participacao
from (select p.classe_id, p.cotista_id, c.documento, c.nome, c.tipo_investidor, p.cotas from fx_report_pos p left join fx_cotista c on c.cotista_id = p.cotista_id
      union all
      select f2.classe_id, null, '{K.RESIDUAL_DOC}', '{K.RESIDUAL_NAME}', '{K.RESIDUAL_DOC}',
             cast(f2.quantidade_cotas - coalesce((select sum(cotas) from fx_report_pos p2 where p2.classe_id = f2.classe_id), 0) as decimal(28,12))
      from fx_report_close f2
      where f2.quantidade_cotas - coalesce((select sum(cotas) from fx_report_pos p2 where p2.classe_id = f2.classe_id), 0) > 0.000001) x
join fx_report_close f on f.classe_id = x.classe_id""", "fx_report_close", "fx_report_pos", "fx_cotista")

SQL["stock_top100"] = with_views(f"""
select classe_id, data_referencia, cast(posicao as bigint) as posicao, identificador_externo, numero_titulo, tipo_ativo, data_vencimento, valor_face,
       sacado, cedente, valor_presente, estoque_qtd_titulos, estoque_valorizado
from (select m.*, row_number() over (partition by classe_id order by valor_presente desc, identificador_externo) as posicao,
             count(*) over (partition by classe_id) as estoque_qtd_titulos,
             cast(sum(valor_presente) over (partition by classe_id) as decimal(20,2)) as estoque_valorizado
      from (select t.classe_id, f.data_referencia, t.identificador_externo, t.numero_titulo, t.tipo_ativo, t.data_vencimento, t.valor_face, t.sacado, t.cedente,
                   {_accrual('t.valor_face', 't.valor_aquisicao', 'cv.du_acumulado - cr.du_acumulado', 'cv.du_acumulado - ca.du_acumulado')} as valor_presente
            from fx_titulo_ativo t
            join fx_report_close f on f.classe_id = t.classe_id and t.data_aquisicao <= f.data_referencia
            left join fx_calendario ca on ca.data = t.data_aquisicao
            left join fx_calendario cv on cv.data = t.data_vencimento
            left join fx_calendario cr on cr.data = f.data_referencia) m) r
where posicao <= 100""", "fx_titulo_ativo", "fx_report_close", "fx_calendario")

SQL["receivable_list"] = with_views("""
select classe_id, cast(posicao as bigint) as posicao, identificador_externo, data_aquisicao, data_vencimento, valor_face, valor_aquisicao, situacao
from (select *, row_number() over (partition by classe_id order by data_vencimento, identificador_externo, data_aquisicao) as posicao
      from fx_titulo_status) t where posicao <= 200""", "fx_titulo_status")


# --- orders, seal, registry, access -----------------------------------------------------------------
from ..sources.fixtures import PRIOR_CUTOFF as _CUT  # noqa: E402

_view("fx_ordem", ["fx_fundo"], """
select o_orderkey as ordem, cast(cast(o_orderdate as date) + 45 as date) as data,
       case when o_orderkey % 53 = 0 then '?' else cnpj || '|' || c_mktsegment end as classe_id,
       case when o_orderkey % 59 = 0 then -c_custkey else c_custkey end as cotista_id,
       case when o_orderkey % 2 = 0 then 'RESGATE' else 'APLICACAO' end as tipo,
       cast(round(cast(o_totalprice as decimal(18,2)) * cast(0.30 as decimal(4,2)), 2) as decimal(20,2)) as valor,
       case when o_orderkey % 6 = 0 then cast(cast(o_totalprice as decimal(18,2)) * cast(0.40 as decimal(4,2)) as decimal(28,12)) end as pedida
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join fx_fundo on fundo_id = n_regionkey""")

_view("fx_ordem_preco", ["fx_ordem", "fx_fechamento", "fx_classe", "fx_cotista"], f"""
select o.*, p.preco, coalesce({_units('o.pedida')}, {_he(f"{_units('o.valor')} * cast(10000000000000000000000 as hugeint) * sign({_units('p.preco')})", f"abs({_units('p.preco')})")}) as qu,
       case when o.classe_id not in (select classe_id from fx_classe) then {_q(K.MSG_ORDEM_CLASSE)}
            when o.cotista_id not in (select cotista_id from fx_cotista) then {_q(K.MSG_ORDEM_COTISTA)} end as recusa
from fx_ordem o
join (select o2.ordem, coalesce((select arg_max(valor_cota, data_referencia) from fx_fechamento f
                                 where f.classe_id = o2.classe_id and f.data_referencia <= o2.data and f.valor_cota is not null),
                                {_PAR}) as preco
      from fx_ordem o2) p on p.ordem = o.ordem""")

_view("fx_ordem_stream", ["fx_ordem_preco", "fx_cota_movimento"], f"""
select *, row_number() over (partition by classe_id, cotista_id order by data, k, ordem) as rn
from (select classe_id, cotista_id, data, 1 as k, ordem, tipo = 'RESGATE' as redeem, qu from fx_ordem_preco where recusa is null
      union all
      select classe_id, cotista_id, data, 0, null, false,
             {_units("cast(sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) as decimal(38,12))")}
      from fx_cota_movimento where cotista_id is not null group by classe_id, cotista_id, data) x""")

_view("fx_ordem_fold", ["fx_ordem_stream"], """
select classe_id, cotista_id, rn, ordem, k,
       case when k = 1 and redeem then qu <= 0 else true end as aceito,
       case when k = 0 then qu when redeem then (case when qu <= 0 then 0 - qu else 0 end) else qu end as saldo
from fx_ordem_stream where rn = 1
union all
select s.classe_id, s.cotista_id, s.rn, s.ordem, s.k,
       case when s.k = 1 and s.redeem then s.qu <= f.saldo else true end,
       case when s.k = 0 then f.saldo + s.qu when s.redeem then (case when s.qu <= f.saldo then f.saldo - s.qu else f.saldo end)
            else f.saldo + s.qu end
from fx_ordem_fold f join fx_ordem_stream s on s.classe_id = f.classe_id and s.cotista_id = f.cotista_id and s.rn = f.rn + 1""")

SQL["order_replay"] = with_views(f"""
select o.ordem, o.classe_id, o.cotista_id, o.data, o.tipo, {_fixed('o.qu', 12, 28)} as quantidade, o.preco as valor_cota,
       case when o.tipo = 'RESGATE'
            then {_fixed(_he(f"o.qu * {_units('o.preco')}", "cast(10000000000000000000000 as hugeint)"), 2, 20)}
            else o.valor end as valor_financeiro,
       coalesce(f.aceito, false) as aceito, case when o.recusa is not null then o.recusa when not f.aceito then '{K.MSG_SALDO_INSUFICIENTE}' end as motivo,
       {_fixed('f.saldo', 12, 28)} as saldo_cotas
from fx_ordem_preco o left join fx_ordem_fold f on f.k = 1 and f.ordem = o.ordem""", "fx_ordem_preco", "fx_ordem_fold", recursive=True)

_view("fx_close_ids", ["fx_fechamento"], """
select classe_id, data_referencia, sha256(classe_id || '|' || cast(data_referencia as varchar) || '|' || cast(versao as varchar)) as id
from fx_fechamento""")

SQL["seal_closes"] = with_views(f"""
select fechamento_id, cast(ordem as bigint) as ordem,
       case when fechamento_id not in (select id from fx_close_ids) then {_q(K.MSG_SEAL_MISSING)}
            when row_number() over (partition by fechamento_id order by ordem) > 1 then {_q(K.MSG_SEAL_SEALED)}
            else 'SELADO' end as resultado
from (select id as fechamento_id, 1 as ordem from fx_close_ids
      union all select id, 2 from fx_close_ids
      union all select sha256(classe_id || '|' || cast(data_referencia as varchar) || '|2'), 1 from fx_close_ids) r""", "fx_close_ids")

SQL["investor_registry"] = with_views(f"""
select ordem, documento, nome, resultado, case when resultado = 'OK' then sha256('cotista|' || documento) end as id
from (select ordem, documento, nome,
             coalesce(case when res0 is null and ordem > min(case when res0 is null then ordem end) over (partition by documento)
                           then {_q(K.MSG_COTISTA_DUP)} else res0 end, 'OK') as resultado
      from (select r.*, case when length(documento) not in (11, 14) then {_q(K.MSG_COTISTA_DOC)}
                             when nome = '' then {_q(K.MSG_COTISTA_NOME)}
                             when documento in (select case when c_custkey % 2 = 0 then cast(20000000000 + c_custkey as varchar)
                                                            else cast(30000000000000 + c_custkey as varchar) end
                                                from customer where c_custkey in (select o_custkey from orders
                                                                                  where cast(o_orderdate as date) < date '{_CUT}'))
                             then {_q(K.MSG_COTISTA_DUP)} end as res0
            from (select linha_numero as ordem, regexp_replace(coalesce(sacado_documento, ''), '\\D', '', 'g') as documento,
                         regexp_replace(coalesce(sacado_nome, ''), '^\\s+|\\s+$', '', 'g') as nome
                  from fx_boleta_raw) r) v) w""", "fx_boleta_raw")

_view("fx_perfil", [], """
select n_nationkey as perfil_id, case when n_nationkey > 0 then cast(floor((n_nationkey - 1) / 2.0) as integer) end as perfil_pai_id,
       'perm_' || cast(n_regionkey as varchar) as permissao
from nation""")

# from each user's own role upwards; the way taken so far ends a cycle
_view("fx_alcance", ["fx_perfil"], """
select s_suppkey as usuario, s_nationkey as alcancado, [s_nationkey] as caminho from supplier
union all
select usuario, acima, list_append(caminho, acima)
from (select usuario, caminho, (select perfil_pai_id from fx_perfil where perfil_id = alcancado) as acima from fx_alcance) passo
where acima is not null and not list_contains(caminho, acima)""")

_view("fx_permissao_efetiva", ["fx_alcance", "fx_perfil"], """
select cast(usuario as bigint) as usuario_id, permissao from fx_alcance join fx_perfil on perfil_id = alcancado group by all""")

SQL["effective_permissions"] = with_views("select * from fx_permissao_efetiva", "fx_permissao_efetiva", recursive=True)

SQL["permission_check"] = with_views("""
select cast(s_suppkey as bigint) as usuario_id, 'perm_' || cast(s_suppkey % 5 as varchar) as permissao,
       exists (select 1 from fx_permissao_efetiva e where e.usuario_id = s_suppkey and e.permissao = 'perm_' || cast(s_suppkey % 5 as varchar)) as permitido
from supplier""", "fx_permissao_efetiva", recursive=True)


# --- the same batch as monthly files (one file per acquisition month) -----------------------------
_view("fx_boleta_raw_f", ["fx_boleta_raw"], """
select lote, cast(row_number() over (partition by lote order by linha_numero) + 1 as bigint) as linha_numero,
       """ + ", ".join(K.BOLETA_COLUMNS) + """
from (select 'L' || substr(data_aquisicao, 1, 7) as lote, * from fx_boleta_raw) r""")
_view("fx_boleta_norm_f", ["fx_boleta_raw_f"], _norm_sql("fx_boleta_raw_f", "lote, "))
_view("fx_boleta_motivo_f", ["fx_boleta_norm_f", "fx_fundo", "fx_classe"], _motivo_sql("fx_boleta_norm_f", "lote, identificador_externo"))
_view("fx_boleta_val_f", ["fx_boleta_motivo_f"], _val_sql("fx_boleta_motivo_f", "lote, "))

SQL["boleta_csv_validation"] = with_views("select * from fx_boleta_val_f", "fx_boleta_val_f")

_ins_f = VIEWS["fx_titulo_inserido"][1].replace("from fx_boleta_val v", "from fx_boleta_val_f v").replace(
    f"'{LOTE_ID}' as lote_id,", "v.lote,")
_view("fx_titulo_inserido_f", ["fx_boleta_val_f", "fx_fundo", "fx_classe", "fx_titulo"], _ins_f)
SQL["stream_title_insert"] = with_views("select * from fx_titulo_inserido_f", "fx_titulo_inserido_f")

_LOG = """
select lote, count(*) as linhas_total, count(*) filter (where valido) as linhas_aceitas,
       count(*) filter (where not valido) as linhas_rejeitadas,
       case when count(distinct data_aquisicao) filter (where valido) = 1
            then cast(min(data_aquisicao) filter (where valido) as date) end as data_referencia,
       case when count(distinct fundo_cnpj) filter (where valido) = 1
            then min(fundo_cnpj) filter (where valido) end as fundo_cnpj,
       coalesce(any_value(n), 0) as registros_inseridos, count(*) filter (where valido) - coalesce(any_value(n), 0) as duplicados_ignorados
from fx_boleta_val_f left join (select lote as l, count(*) as n from fx_titulo_inserido_f group by lote) i on l = lote
group by lote"""
SQL["latest_batches"] = with_views(f"select *, true as completo from ({_LOG}) x order by lote desc limit 100", "fx_boleta_val_f", "fx_titulo_inserido_f")
SQL["overview_batches"] = with_views(
    f"select lote, data_referencia, linhas_aceitas, linhas_rejeitadas from ({_LOG}) x order by lote desc limit 5",
    "fx_boleta_val_f", "fx_titulo_inserido_f")

SQL["implied_rate"] = with_views("""
select identificador_externo, du_total,
       case when du_total > 0 then case when abs(r) < 1e6 then cast(round(r, 6) as decimal(38,6)) else cast(cast(round(r) as hugeint) as decimal(38,6)) end end as taxa_implicita_aa
from (select *, case when du_total > 0 then (pow(cast(valor_face as double) / cast(valor_aquisicao as double), 252.0 / du_total) - 1) * 100 end as r
from (select t.identificador_externo, t.valor_face, t.valor_aquisicao,
             cast(greatest(cv.du_acumulado - ca.du_acumulado, 0) as bigint) as du_total
      from fx_titulo t
      left join fx_calendario ca on ca.data = t.data_aquisicao
      left join fx_calendario cv on cv.data = t.data_vencimento) y) x""", "fx_titulo", "fx_calendario")

SQL["investor_balance"] = with_views(f"""
select classe_id, cotista_id, cast(sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) as decimal(28,12)) as saldo_cotas
from fx_cota_movimento where data <= date '{POSITION_DATE}' and cotista_id is not null group by classe_id, cotista_id""", "fx_cota_movimento")

SQL["fund_registry"] = with_views(f"""
select ordem, cnpj, nome, resultado, case when resultado = 'OK' then sha256('fundo|' || cnpj) end as id
from (select ordem, cnpj, nome,
             coalesce(case when res0 is null and ordem > min(case when res0 is null then ordem end) over (partition by cnpj)
                           then {_q(K.MSG_FUNDO_DUP)} else res0 end, 'OK') as resultado
      from (select r.*, case when length(cnpj) <> 14 then {_q(K.MSG_FUNDO_CNPJ)} when nome = '' then {_q(K.MSG_FUNDO_NOME)}
                             when cnpj in (select cnpj from fx_fundo) then {_q(K.MSG_FUNDO_DUP)} end as res0
            from (select cast(n_nationkey as bigint) as ordem,
                         regexp_replace(substr(c, 1, 8) || '/' || substr(c, 9, 6), '\\D', '', 'g') as cnpj,
                         regexp_replace(case when n_nationkey % 6 = 5 then ' ' else n_name end, '^\\s+|\\s+$', '', 'g') as nome
                  from (select *, cast(10000000000000 + n_nationkey % 7 as varchar) as c from nation) n) r) v) w""", "fx_fundo")

SQL["class_registry"] = with_views(f"""
select ordem, fundo_id, codigo, tipo, resultado,
       case when resultado = 'OK' then sha256(cast(fundo_id as varchar) || '|' || codigo) end as classe_id
from (select ordem, fundo_id, codigo, tipo,
             coalesce(case when res0 is null and ordem > min(case when res0 is null then ordem end) over (partition by fundo_id, codigo)
                           then {_q(K.MSG_CLASSE_DUP)} else res0 end, 'OK') as resultado
      from (select r.ordem, cast(r.fundo_id as bigint) as fundo_id, r.codigo, r.tipo,
                   case when r.codigo = '' then {_q(K.MSG_CLASSE_COD)}
                        when r.tipo not in ('SENIOR', 'MEZANINO', 'SUBORDINADA') then {_q(K.MSG_CLASSE_TIPO)}
                        when r.fundo_id not in (select fundo_id from fx_fundo) then {_q(K.MSG_CLASSE_FUNDO)}
                        when exists (select 1 from fx_classe k where k.fundo_id = r.fundo_id and k.codigo = r.codigo) then {_q(K.MSG_CLASSE_DUP)}
                   end as res0
            from (select cast(dense_rank() over (order by fundo_id, codigo_raw) as bigint) as ordem, fundo_id,
                         upper(regexp_replace(codigo_raw, '^\\s+|\\s+$', '', 'g')) as codigo, tipo
                  from (select fundo_id, lower(codigo) as codigo_raw,
                               case codigo when 'AUTOMOBILE' then 'SENIOR' when 'BUILDING' then 'MEZANINO'
                                           when 'MACHINERY' then 'OUTRO' else 'SUBORDINADA' end as tipo
                        from fx_classe
                        union all
                        select fundo_id, ' nova' || cast(fundo_id as varchar), 'SENIOR' from fx_fundo) q) r) v) w""",
                                    "fx_classe", "fx_fundo")

SQL["title_status_asof"] = with_views(f"""
select identificador_externo, fundo_id, classe_id, data_aquisicao, situacao, cast(n_eventos as bigint) as n_eventos
from ({_status(f"(select * from fx_evento where data_evento <= date '{MARK_DATE}')")}) x""", "fx_titulo", "fx_evento")

SQL["close_incremental"] = with_views(f"select * from fx_fechamento where data_referencia > date '{REPORT_DATE}'", "fx_fechamento")

# a December closed again gives the same figures as version 2
SQL["close_reprocess"] = with_views("""
select * replace (case when month(data_referencia) = 12 then 2 else versao end as versao) from fx_fechamento""", "fx_fechamento")

SQL["seal_status"] = with_views(f"""
select classe_id, data_referencia, versao, case when data_referencia <= date '{REPORT_DATE}' then 'SELADO' else status end as status,
       case when data_referencia <= date '{REPORT_DATE}' then date '{REPORT_DATE}' end as selado_em
from fx_fechamento""", "fx_fechamento")

SQL["overview_closes"] = with_views("""
select classe_id, posicao, data_referencia, versao, status, pl_liquido, quantidade_cotas, valor_cota, rentabilidade_dia
from (select *, row_number() over (partition by classe_id order by data_referencia desc, versao desc) as posicao from fx_fechamento) t
where posicao <= 8""", "fx_fechamento")

_view("fx_contraparte", ["fx_boleta_val", "fx_prior_base"], SQL["counterparty_upsert"][SQL["counterparty_upsert"].rindex("select 'CEDENTE'"):] + """
union
select 'CEDENTE', ced_doc, s_name, sha256('cedente|' || ced_doc) from fx_prior_base
union
select 'SACADO', d, c_name, sha256('sacado|' || d)
from (select c_name, case when c_custkey % 2 = 0 then cast(20000000000 + c_custkey as varchar) else cast(30000000000000 + c_custkey as varchar) end as d
      from fx_prior_base) x""")

SQL["chain_stock"] = with_views(f"""
select classe_id, posicao, identificador_externo, numero_titulo, tipo_ativo, data_vencimento, sacado, cedente, valor_face, valor_presente,
       estoque_qtd_titulos, estoque_valorizado
from (select m.*, row_number() over (partition by classe_id order by valor_presente desc, identificador_externo) as posicao,
             count(*) over (partition by classe_id) as estoque_qtd_titulos,
             cast(sum(valor_presente) over (partition by classe_id) as decimal(20,2)) as estoque_valorizado
      from (select t.*, ce.nome as cedente, sa.nome as sacado,
                   {_accrual('t.valor_face', 't.valor_aquisicao', 'cv.du_acumulado - cr.du_acumulado', 'cv.du_acumulado - ca.du_acumulado')} as valor_presente
            from fx_titulo_inserido t
            left join fx_contraparte ce on ce.papel = 'CEDENTE' and ce.id = t.cedente_id
            left join fx_contraparte sa on sa.papel = 'SACADO' and sa.id = t.sacado_id
            left join fx_calendario ca on ca.data = t.data_aquisicao
            left join fx_calendario cv on cv.data = t.data_vencimento
            left join fx_calendario cr on cr.data = date '{MARK_DATE}'
            where t.data_aquisicao <= date '{MARK_DATE}') m) r
where posicao <= 100""", "fx_titulo_inserido", "fx_contraparte", "fx_calendario")


def _body(name: str, *views: str) -> str:
    """The last SELECT of a query, without its views."""
    return SQL[name][len(with_views("", *views)):].strip()


_view("fx_r_comp", ["fx_report_close", "fx_grid_mark", "fx_classe", "fx_fundo"],
      _body("report_composition", "fx_report_close", "fx_grid_mark", "fx_classe", "fx_fundo"))
_view("fx_r_inv", ["fx_report_close", "fx_report_pos", "fx_cotista"], _body("report_investors", "fx_report_close", "fx_report_pos", "fx_cotista"))
_view("fx_r_top", ["fx_titulo_ativo", "fx_report_close", "fx_calendario"], _body("stock_top100", "fx_titulo_ativo", "fx_report_close", "fx_calendario"))


def _joined(*cols: str) -> str:
    return " || ';' || ".join(f"coalesce(cast({c} as varchar), 'null')" for c in cols)


SQL["report_export"] = with_views(f"""
select classe_id, data_referencia, 0 as parte, 0 as ordem, chr(65279) || 'Relatorio de posicao diaria;' || fundo_nome || ';' || cast(data_referencia as varchar) as linha from fx_r_comp
union all select classe_id, data_referencia, 0, 1, '' from fx_r_comp
union all select classe_id, data_referencia, 1, 0, 'COMPOSICAO;valor' from fx_r_comp
union all select classe_id, data_referencia, 1, 1, 'Estoque valorizado;' || cast(estoque_valorizado as varchar) from fx_r_comp
union all select classe_id, data_referencia, 1, 2, 'Caixa;' || cast(caixa as varchar) from fx_r_comp
union all select classe_id, data_referencia, 1, 3, 'Provisao administracao;' || cast(provisao_administracao as varchar) from fx_r_comp
union all select classe_id, data_referencia, 1, 4, 'PL liquido;' || cast(pl_liquido as varchar) from fx_r_comp
union all select classe_id, data_referencia, 1, 5, 'Valor cota;' || coalesce(cast(valor_cota as varchar), 'null') from fx_r_comp
union all select classe_id, data_referencia, 1, 99, '' from fx_r_comp
union all select classe_id, data_referencia, 2, 0, 'COTISTA;documento;tipo;cotas;participacao;valor' from fx_r_comp
union all select classe_id, data_referencia, 2, case when documento = '{K.RESIDUAL_DOC}' then 4611686018427387904 else 2305843009213693952 - cast(floor(cotas) as bigint) end,
                 {_joined('nome', 'documento', 'tipo_investidor', 'cotas', 'participacao', 'valor')} from fx_r_inv
union all select classe_id, data_referencia, 3, 0, '' from fx_r_comp
union all select classe_id, data_referencia, 3, 1, 'TITULO;tipo;vencimento;sacado;cedente;valor_face;valor_presente' from fx_r_comp
union all select classe_id, data_referencia, 4, posicao, {_joined('numero_titulo', 'tipo_ativo', 'data_vencimento', 'sacado', 'cedente', 'valor_face', 'valor_presente')} from fx_r_top""",
                                  "fx_r_comp", "fx_r_inv", "fx_r_top")

# a step of the recursion is a ledger movement, an order or a close of a class; amounts in cents, units and prices in 10^-12
_P22 = "cast(10000000000000000000000 as hugeint)"
_ZERO = "cast(0 as hugeint)"
_view("fx_j_evento", ["fx_close_b", "fx_fechamento", "fx_ordem", "fx_classe", "fx_cotista", "fx_cota_movimento"], f"""
select *, row_number() over (partition by classe_id order by data, k, ordem, cotista_id) as rn
from (select classe_id, data, 1 as k, ordem, cotista_id, tipo = 'RESGATE' as redeem, {_units('valor')} as valor, {_units('pedida')} as qu,
             {_ZERO} as vp, {_ZERO} as pdd, {_ZERO} as cx, {_ZERO} as ct, {_ZERO} as tx, {_ZERO} as n, cast(null as hugeint) as v1
      from fx_ordem where data > date '{REPORT_DATE}' and classe_id in (select classe_id from fx_classe) and cotista_id in (select cotista_id from fx_cotista)
      union all
      select classe_id, data, 0, null, cotista_id, false, 0, {_units("cast(sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) as decimal(38,12))")},
             0, 0, 0, 0, 0, 0, null
      from fx_cota_movimento where cotista_id is not null and data > date '{REPORT_DATE}' group by classe_id, cotista_id, data
      union all
      select b.classe_id, b.data, 2, null, null, false, 0, 0, {_units('b.valor_presente')}, {_units('b.pdd')}, {_units('b.caixa')}, {_units('b.cotas')},
             {_units('b.taxa')}, cast(b.n_du as hugeint), {_units('f.valor_cota')}
      from fx_close_b b join fx_fechamento f on f.classe_id = b.classe_id and f.data_referencia = b.data where b.data > date '{REPORT_DATE}') x""")

_view("fx_j_inicio", ["fx_classe", "fx_fechamento", "fx_cota_movimento"], f"""
select c.classe_id, f.pv, f.ant, coalesce(f.pz, {_E12}) as pz, coalesce(s.m, cast(map() as map(bigint, hugeint))) as m
from fx_classe c
left join (select classe_id, arg_max({_units('provisao_adm_acumulada')}, data_referencia) as pv,
                  {_units('arg_max(valor_cota, data_referencia) filter (where valor_cota is not null)')} as pz,
                  {_units('max_by(struct_pack(c := valor_cota), data_referencia).c')} as ant
           from fx_fechamento where data_referencia <= date '{REPORT_DATE}' group by classe_id) f on f.classe_id = c.classe_id
left join (select classe_id, map_from_entries(list(struct_pack(k := cast(cotista_id as bigint), v := q))) as m
           from (select classe_id, cotista_id, {_units("cast(sum(case when tipo = 'EMISSAO' then quantidade else -quantidade end) as decimal(38,12))")} as q
                 from fx_cota_movimento where cotista_id is not null and data <= date '{REPORT_DATE}' group by classe_id, cotista_id) x
           group by classe_id) s on s.classe_id = c.classe_id""")


def _j_step(src: str) -> str:
    """One event from the state before it: price in force, previous price, provision, units and cash of orders, balances."""
    return f"""
select classe_id, rn, k, data, ordem, cotista_id, q, fin, ok, saldo, pz0, g, dp, liq, un, pr, n, ant0,
       case when k = 2 then coalesce(pr, v1, pz0) else pz0 end as pz, case when k = 2 then pr else ant0 end as ant, case when k = 2 then pv0 + dp else pv0 end as pv,
       case when k = 1 and ok then ux0 + case when redeem then -q else q end else ux0 end as ux,
       case when k = 1 and ok then cx0 + case when redeem then -fin else valor end else cx0 end as cy,
       case when k = 0 or (k = 1 and ok) then map_concat(m0, map([cast(cotista_id as bigint)], [saldo])) else m0 end as m
from (select *, case when k = 2 and un > 0 then {_he(f"liq * {_P22}", "un")} end as pr,
             case when k = 0 or not redeem then bal + q when ok then bal - q else bal end as saldo
      from (select *, g - pdd - pv0 - dp as liq, ct + ux0 as un, case when redeem then q <= bal else true end as ok, case when redeem then {_he(f"q * pz0", _P22)} else valor end as fin
            from (select *, {_he("(vp + cx + cx0) * tx * n", "cast(25200000000 as hugeint)")} as dp, vp + cx + cx0 as g,
                         coalesce(m0[cast(cotista_id as bigint)], {_ZERO}) as bal,
                         coalesce(qu, {_he(f"valor * {_P22} * sign(pz0)", "abs(pz0)")}) as q
                  from {src}) a) b) c"""


_START = f"(select e.*, i.pz as pz0, i.ant as ant0, i.pv as pv0, {_ZERO} as ux0, {_ZERO} as cx0, i.m as m0 from fx_j_evento e join fx_j_inicio i on i.classe_id = e.classe_id where e.rn = 1) y"
_NEXT = "(select e.*, z.pz as pz0, z.ant as ant0, z.pv as pv0, z.ux as ux0, z.cy as cx0, z.m as m0 from fx_j z join fx_j_evento e on e.classe_id = z.classe_id and e.rn = z.rn + 1) y"
_view("fx_j", ["fx_j_evento", "fx_j_inicio"], _j_step(_START) + "\nunion all\n" + _j_step(_NEXT))

SQL["order_close_replay"] = with_views(f"""
select f.fundo_id, j.classe_id, j.data as data_referencia, cast(2 as bigint) as versao, 'PROCESSADO' as status, f.valor_presente_ativos, f.pdd_total,
       {_fixed(f"(j.g - {_units('f.valor_presente_ativos')})", 2, 20)} as caixa, f.contas_receber, f.contas_pagar, {_fixed('j.g', 2, 20)} as pl_bruto,
       {_fixed('j.dp', 2, 20)} as despesa_adm_dia, {_fixed('j.pv', 2, 20)} as provisao_adm_acumulada, {_fixed('j.liq', 2, 20)} as pl_liquido,
       {_fixed('j.un', 12, 28)} as quantidade_cotas, {_fixed('j.pr', 12, 28)} as valor_cota, {_fixed('j.ant0', 12, 28)} as cota_anterior,
       case when j.pr is not null and coalesce(j.ant0, {_E12}) > 0 then {_fixed(_he(f"(j.pr - coalesce(j.ant0, {_E12})) * cast(10000000000 as hugeint)", f"coalesce(j.ant0, {_E12})"), 10, 18)} end as rentabilidade_dia,
       f.qtd_ativos, cast(j.n as bigint) as n_du
from fx_j j join fx_fechamento f on f.classe_id = j.classe_id and f.data_referencia = j.data where j.k = 2""", "fx_j", "fx_fechamento", recursive=True)

# a refused order has a price too: that of the closes before its day, or par for an unknown class
SQL["order_guard_replay"] = with_views(f"""
select o.ordem, o.classe_id, o.cotista_id, o.data, o.tipo, {_fixed('o.q', 12, 28)} as quantidade, {_fixed('o.pz0', 12, 28)} as valor_cota,
       case when o.tipo = 'RESGATE' then {_fixed(_he("o.q * o.pz0", _P22), 2, 20)} else o.valor end as valor_financeiro,
       coalesce(j.ok, false) as aceito, case when o.recusa is not null then o.recusa when not j.ok then '{K.MSG_SALDO_INSUFICIENTE}' end as motivo,
       {_fixed('j.saldo', 12, 28)} as saldo_cotas
from (select *, coalesce({_units('pedida')}, {_he(f"{_units('valor')} * {_P22} * sign(pz0)", "abs(pz0)")}) as q
      from (select p.*, coalesce((select arg_max(z.pz, z.data) from fx_j z where z.k = 2 and z.classe_id = p.classe_id and z.data < p.data),
                                 (select i.pz from fx_j_inicio i where i.classe_id = p.classe_id), {_E12}) as pz0
            from fx_ordem_preco p where p.data > date '{REPORT_DATE}') a) o
left join fx_j j on j.k = 1 and j.ordem = o.ordem""", "fx_j", "fx_j_inicio", "fx_ordem_preco", recursive=True)

# closes over a store with a gap and corrections: a step of the recursion is a date, stored or of the run
_view("fx_linha", ["fx_close_b", "fx_fechamento", "fx_calendario"], f"""
select x.*, row_number() over (partition by x.classe_id order by x.data) as rn,
       case when prev2 is null then 1 else greatest(c1.du_acumulado - c0.du_acumulado, 0) end as dias
from (select b.*, month(b.data) % 4 in (1, 2) as nova, lag(b.data) over (partition by b.classe_id order by b.data) as prev2,
             {_units('f.provisao_adm_acumulada')} + case when month(b.data) = 8 then 1000 else 0 end as gp,
             {_units('f.valor_cota')} + case when month(b.data) = 8 then 250000000000 else 0 end as gc
      from fx_close_b b join fx_fechamento f on f.classe_id = b.classe_id and f.data_referencia = b.data where month(b.data) <> 4) x
left join fx_calendario c0 on c0.data = x.prev2 left join fx_calendario c1 on c1.data = x.data""")


def _linha(src: str, where: str, before: str, price: str) -> str:
    return f"""
select classe_id, fundo_id, data, rn, nova, valor_presente, pdd, caixa, a_receber, pl_bruto, cotas, qtd_ativos, dias, despesa, pv, liq, ant,
       case when not nova then gc when cotas > 0 then {_he(f"liq * {_E12} * cast(10000000000 as hugeint)", _units('cotas'))} end as pr
from (select *, {_units('pl_bruto')} - {_units('pdd')} - pv as liq
      from (select *, case when nova then {before} + despesa else gp end as pv
            from (select *, {price} as ant, {_he(f"{_units('pl_bruto')} * {_units('taxa')} * cast(dias as hugeint)", "cast(25200000000 as hugeint)")} as despesa
                  from {src} where {where}) a) b) c"""


_view("fx_gap", ["fx_linha"], _linha("fx_linha", "rn = 1", "cast(0 as hugeint)", "cast(null as hugeint)") + "\nunion all\n" + _linha(
    "(select s.*, z.pv as zpv, z.pr as zpr from fx_gap z join fx_linha s on s.classe_id = z.classe_id and s.rn = z.rn + 1) y", "true", "zpv", "zpr"))

SQL["close_gap"] = with_views(f"""
select fundo_id, classe_id, data as data_referencia, cast(case when month(data) = 10 then 1 else 2 end as bigint) as versao, 'PROCESSADO' as status,
       valor_presente as valor_presente_ativos, pdd as pdd_total, caixa, a_receber as contas_receber, cast(0 as decimal(20,2)) as contas_pagar, pl_bruto,
       {_fixed('despesa', 2, 20)} as despesa_adm_dia, {_fixed('pv', 2, 20)} as provisao_adm_acumulada, {_fixed('liq', 2, 20)} as pl_liquido,
       cotas as quantidade_cotas, {_fixed('pr', 12, 28)} as valor_cota, {_fixed('ant', 12, 28)} as cota_anterior,
       case when pr is not null and coalesce(ant, {_E12}) > 0 then {_fixed(_he(f"(pr - coalesce(ant, {_E12})) * cast(10000000000 as hugeint)", f"coalesce(ant, {_E12})"), 10, 18)} end as rentabilidade_dia,
       qtd_ativos, cast(dias as bigint) as n_du
from fx_gap where nova""", "fx_gap", recursive=True)

SQL["compacted_titles"] = with_views("""
select mes_aquisicao, identificador_externo, fundo_id, classe_id, data_aquisicao, valor_face, id from fx_titulo_inserido_f
where substr(mes_aquisicao, 1, 4) in ('1996', '1998')""", "fx_titulo_inserido_f")

SQL["receivable_status_list"] = with_views("""
select classe_id, cast(posicao as bigint) as posicao, identificador_externo, data_vencimento, valor_face, situacao
from (select *, row_number() over (partition by classe_id order by data_vencimento, identificador_externo, data_aquisicao) as posicao
      from fx_titulo_status where situacao = 'LIQUIDADO') t where posicao <= 200""", "fx_titulo_status")

SQL["close_by_id"] = with_views(f"""
select * from fx_fechamento where classe_id = '{CNPJ_BASE}|AUTOMOBILE' and data_referencia = date '1998-06-30'""", "fx_fechamento")

# the same closes and report on the imported titles: views of their own, by the name of the title view
_view("fx_c_caixa", ["fx_cota_movimento", "fx_titulo_inserido_f"], """
select classe_id, data, cast(case when tipo = 'EMISSAO' then round(quantidade, 2) else -round(quantidade, 2) end as decimal(20,2)) as valor from fx_cota_movimento
union all
select classe_id, data_aquisicao, cast(-sum(valor_aquisicao) as decimal(20,2)) from fx_titulo_inserido_f group by classe_id, data_aquisicao""")
_CHAIN = {"fx_titulo_ativo": "fx_titulo_inserido_f", "fx_movimento_caixa": "fx_c_caixa"}


def _chained(name: str) -> str:
    """The view ``name`` over the imported titles, made from the original and the views it rests on."""
    if name in _CHAIN:
        return _CHAIN[name]
    deps, sql = VIEWS[name]
    new = {d: _chained(d) for d in deps if d.startswith("fx_")}
    if all(a == b for a, b in new.items()):
        return name
    for a, b in new.items():
        sql = re.sub(rf"\b{a}\b", b, sql)
    _CHAIN[name] = name.replace("fx_", "fx_c_")
    _view(_CHAIN[name], list(new.values()), sql)
    return _CHAIN[name]


_composed = _body("report_composition", "fx_report_close", "fx_grid_mark", "fx_classe", "fx_fundo")
_names = [_chained(n) for n in ("fx_report_close", "fx_grid_mark")]
SQL["chain_report"] = with_views(re.sub(r"\bfx_(report_close|grid_mark)\b", r"fx_c_\1", _composed), *_names, "fx_classe", "fx_fundo")

# status at each close date: titles whose first ending event lies after it
_view("fx_saida", ["fx_evento"], """
select fundo_id, identificador_externo, min(data_evento) as saida from fx_evento where tipo in ('PAGAMENTO', 'BAIXA', 'RECOMPRA') group by all""")
_asof = _GRID_MARK.replace("left join fx_titulo_ativo t on t.classe_id = g.classe_id and t.data_aquisicao <= g.data", """
left join (select f.*, s.saida from fx_titulo f left join fx_saida s on s.fundo_id = f.fundo_id and s.identificador_externo = f.identificador_externo) t
  on t.classe_id = g.classe_id and t.data_aquisicao <= g.data and (t.saida is null or t.saida > g.data)""")
SQL["class_marking_asof"] = with_views(f"""
select classe_id, data, cast(qtd_ativos as bigint) as qtd_ativos, cast(valor_presente as decimal(20,2)) as valor_presente,
       cast(pdd as decimal(20,2)) as pdd, cast(a_receber as decimal(20,2)) as a_receber
from ({_asof}) m""", "fx_grid", "fx_titulo", "fx_saida", "fx_calendario", "fx_faixa_pdd")

_view("fx_calendario_longo", [], f"""
select cast(g.d as date) as data, cast(sum(case when isodow(g.d) < 6 and not (year(g.d) between 1990 and 1999 and strftime(g.d, '%m-%d') in ({_HOL_MMDD}))
             and cast(g.d as date) not in ({_HOL_DATED}) then 1 else 0 end) over (order by g.d) as bigint) as n
from generate_series(date '1960-01-01', date '2040-12-31', interval 1 day) g(d)""")
SQL["business_days_outside"] = with_views("""
select identificador_externo, de, ate, greatest(b.n - a.n, 0) as du
from (select identificador_externo, cast(data_aquisicao - interval 300 month as date) as de, cast(data_vencimento + interval 300 month as date) as ate from fx_titulo) t
join fx_calendario_longo a on a.data = t.de join fx_calendario_longo b on b.data = t.ate""", "fx_titulo", "fx_calendario_longo")


def _json(side: str, fields: dict[str, bool], changed: dict[str, str]) -> str:
    """A JSON object of the fields that changed and are not null; ``fields``: name to whether it is text."""
    parts = ", ".join(f"""case when {changed[f]} and {side}_{f} is not null then '"{f}":{'"' if text else ''}' || cast({side}_{f} as varchar) || '{'"' if text else ''}' end""" for f, text in fields.items())
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x is not null), ',') || '}}'"


_FIELDS = {"versao": False, "status": True, "pl_liquido": False, "valor_cota": False, "provisao_adm_acumulada": False}
_CHANGED = {f: f"a_{f} is distinct from d_{f}" for f in _FIELDS}
_view("fx_mudanca", ["fx_linha", "fx_gap", "fx_fechamento"], f"""
select x.*, case when data <= date '{REPORT_DATE}' then 'SELADO' else 'PROCESSADO' end as d_status
from (select g.classe_id, g.data, case when month(g.data) = 10 then null when month(g.data) = 8 then 2 else 1 end as a_versao,
             case when month(g.data) <> 10 then 'PROCESSADO' end as a_status, case when month(g.data) <> 10 then f.pl_liquido end as a_pl_liquido,
             case when month(g.data) <> 10 then {_fixed('l.gc', 12, 28)} end as a_valor_cota, case when month(g.data) <> 10 then {_fixed('l.gp', 2, 20)} end as a_provisao_adm_acumulada,
             case when month(g.data) = 10 then 1 when g.nova or month(g.data) = 8 then 2 else 1 end as d_versao,
             case when g.nova then {_fixed('g.liq', 2, 20)} else f.pl_liquido end as d_pl_liquido,
             {_fixed('g.pr', 12, 28)} as d_valor_cota, {_fixed('g.pv', 2, 20)} as d_provisao_adm_acumulada
      from fx_gap g join fx_linha l on l.classe_id = g.classe_id and l.data = g.data join fx_fechamento f on f.classe_id = g.classe_id and f.data_referencia = g.data) x""")
SQL["close_audit"] = with_views(f"""
select data as ocorrido_em, 'system' as usuario_email, case when {_CHANGED['versao']} then 'FECHAMENTO_EXECUTADO' else 'FECHAMENTO_SELADO' end as acao,
       'apuracao.fechamento' as entidade, sha256(classe_id || '|' || cast(data as varchar) || '|' || cast(d_versao as varchar)) as entidade_id,
       array_to_string(list_filter([{', '.join(f"case when {c} then '{f}' end" for f, c in _CHANGED.items())}], lambda x: x is not null), ',') as campos,
       case when a_versao is not null then {_json('a', _FIELDS, _CHANGED)} end as antes, {_json('d', _FIELDS, _CHANGED)} as depois, strftime(data, '%Y%m') as mes
from fx_mudanca where {' or '.join(_CHANGED.values())}""", "fx_mudanca", recursive=True)

SQL["boleta_headers"] = with_views(f"""
select lote, cast({len(K.BOLETA_COLUMNS)} as bigint) as n_colunas, 'OK' as resultado from fx_boleta_raw_f group by lote""", "fx_boleta_raw_f")
