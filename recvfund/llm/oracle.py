"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import urls

_RULES = ", ".join(f"({i}, '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for i, (v, r) in enumerate(urls.RULES))
_LONG = ", ".join(f"'{s}'" for s in urls.LONG_SUFFIXES)


def _strength(groups: str, name: str) -> str:
    return f"""
{name} as (
    select least({urls.MOST_STRENGTH}, greatest({urls.LEAST_STRENGTH}, case when rho > 0 then (1 - rho) / rho else {urls.MOST_STRENGTH} end)) as {name}
    from (select case when room > 0 then (spread / (p * (1 - p)) - (g - 1)) / room end as rho
          from (select count(*) as g, (sum(k) + 0.5) / (sum(n) + 1.0) as p, sum(k * k / n) - sum(k) * sum(k) / sum(n) as spread,
                       sum(n) - sum(n * n) / sum(n) - (count(*) - 1) as room from {groups})))"""


OP9 = rf"""
with rules(i, verdict, of, start, rule) as (values {_RULES}),
rest as (
    select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages),
parts as (
    select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
marked as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
outcomes as (
    select host, bad from parts join marked on marked.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1), '') as bigint)),
counted as (select host, count(*)::double as n, sum(bad)::double as k, string_split(regexp_replace(host, ':\d*$', ''), '.') as bits from outcomes group by host),
named as (select *, array_to_string(bits[-2:], '.') as two from counted),
hosts as (
    select host, n, k, case when two in ({_LONG}) then array_to_string(bits[-3:], '.') else two end as domain,
           case when two in ({_LONG}) then two else bits[-1] end as suffix from named),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from hosts group by all),
{_strength("suffixes", "s_suffix")},{_strength("domains", "s_domain")},{_strength("hosts", "s_host")},
top as (select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) as overall from suffixes),
m_suffix as (select suffix, (k + s_suffix * overall) / (n + s_suffix) as m from suffixes, top, s_suffix),
m_domain as (select domain, d.suffix, (k + s_domain * m) / (n + s_domain) as m from domains d join m_suffix s on s.suffix = d.suffix, s_domain),
beta as (select host, k + s_host * m as a, n - k + s_host * (1 - m) as b from hosts h join m_domain d on d.domain = h.domain and d.suffix = h.suffix, s_host),
known as (select host, a / (a + b) - {urls.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > overall as bad from beta, top),
prior as (select false as bad),
fit as (
    select page_id, host, path, rules.rule, rules.verdict from parts left join rules
    on (host = of or ends_with(host, '.' || of)) and starts_with(path, start)),
best as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from fit group by page_id, host, path)
select page_id, best.host as host, path, rule, coalesce(verdict, case when coalesce(known.bad, prior.bad) then 'block' else 'allow' end) as verdict
from best left join known on known.host = best.host, prior
"""

OP10 = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as key from documents),
sources as (
    select source, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from sized group by source),
ratios as (select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio from sources),
levels as (
    select *, (sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
    from ratios window w as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
opened as (select *, max(case when ratio >= level then level end) over () as open_level from levels),
targets as (select source, source_size, least(cap, weight * coalesce(open_level, ratio)) as target from opened),
budgets as (select *, case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as epochs from targets),
placed as (
    select s.*, source_size, target, epochs, floor(target)::bigint - epochs * source_size as rest,
           coalesce(sum(size) over (partition by s.source order by key, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before
    from sized s join budgets b on s.source is not distinct from b.source)
select doc_id, size, source, source_size, target, (size * epochs + least(size, greatest(0, rest - before)))::bigint as taken from placed
"""

def _integers(where: str = "") -> str:
    """Rows of ``embeddings`` that take part, with whole components (exact as doubles)."""
    return f"""select *, list_transform(embedding, lambda x: floor(256 * x::double)) as c from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0{where}"""


OP6 = f"""
with v as ({_integers()}),
scored as (
    select q.vec_id as query_id, v.vec_id, list_dot_product(q.c, v.c)::bigint as score
    from v as q join v on v.vec_id <> q.vec_id and len(v.c) = len(q.c) where q.vec_id % 50 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored)
select * from ranked where rank <= 5
"""

OP13 = f"""
with sound as ({_integers(" and label is not null")}),
v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, c from sound),
scored as (
    select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_dot_product(a.c, v.c)::bigint as score
    from v as a join v on v.vec_id <> a.vec_id and len(v.c) = len(a.c) where a.vec_id % 100 = 0),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id)::int as positive_rank
    from scored where same qualify positive_rank <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_rank order by score desc, vec_id)::int as rank, vec_id as negative_id,
       positive_score, score as negative_score, positive_rank
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""

SQL = {"op9_url_filters": OP9, "op10_mixing": OP10, "op6_topk_search": OP6, "op13_hard_negatives": OP13}
