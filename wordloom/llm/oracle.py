"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

MIX = r"""
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15) as u
  from documents),
per as (
  select source, sum(size)::bigint as source_size,
         (1 + (row_number() over (order by source nulls last) - 1) % 3)::double as w
  from s group by source),
capped as (select *, 3 * source_size as cap, 3 * source_size / w as ratio from per),
lev as (
  select *, ((sum(source_size) over ())
             - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as lvl
  from capped),
t as (
  select source, source_size,
         least(cap::double, coalesce(w * (select arg_min(lvl, ratio) from lev where lvl <= ratio), cap::double)) as target
  from lev),
p as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as fullr,
         case when source_size > 0 then round(target - floor(target / source_size) * source_size)::bigint else 0 end as part
  from t),
c as (
  select s.*, p.source_size, p.target, p.fullr, p.part,
         coalesce(sum(s.size) over (partition by s.source order by s.u range between unbounded preceding and current row), 0)::bigint as upto,
         sum(s.size) over (partition by s.source, s.u)::bigint as tied
  from s join p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
       (fullr * size + case when part <= 0 then 0 when upto <= part then size
                            when upto - tied < part then floor((part - (upto - tied)) * size / tied) else 0 end)::bigint as taken
from c
"""

URL = r"""
with p as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
r as (
  select *, case
    when (host = 'www.example.com' or suffix(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from p),
v as (
  select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as fixed
  from r),
h as (
  select host, count(fixed) as n, count(*) filter (where fixed = 'block') as k, string_split(host, '.') as l from v group by host),
h2 as (
  select *, case when len(l) >= 2 and l[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') and length(l[-1]) = 2
                 then l[-2] || '.' || l[-1] else l[-1] end as sfx from h),
h3 as (
  select *, case when len(l) < len(string_split(sfx, '.')) + 1 then host
                 else array_to_string(l[-(len(string_split(sfx, '.')) + 1):], '.') end as domain from h2),
d as (select sfx, domain, sum(n) as n, sum(k) as k from h3 group by all),
s as (select sfx, sum(n) as n, sum(k) as k from d group by all),
lv as (select 's' as lv, n, k from s union all select 'd', n, k from d union all select 'h', n, k from h3),
mom as (
  select lv, count(*) as g, sum(k) / sum(n) as p, sum(n * pow(k / n, 2)) / sum(n) - pow(sum(k) / sum(n), 2) as s2,
         count(*) / sum(n) as inv from lv where n > 0 group by lv),
raw as (select lv, g, (p * (1 - p) - s2) / nullif(s2 - p * (1 - p) * inv, 0) as m from mom),
st as (
  select lv, case when g < 2 then 10.0 when m is null or m <= 0 then 200.0 else least(greatest(m, 1.0), 200.0) end as m from raw),
k as (
  select coalesce((select m from st where lv = 's'), 10.0) as ms, coalesce((select m from st where lv = 'd'), 10.0) as md,
         coalesce((select m from st where lv = 'h'), 10.0) as mh, (sum(k) + 0.5) / (sum(n) + 1.0) as world from s),
sr as (select sfx, (s.k + ms * world) / (s.n + ms) as sr from s, k),
dr as (select domain, (d.k + md * sr) / (d.n + md) as dr from d join sr using (sfx), k),
hr as (select host, h3.k + mh * dr as a, h3.n - h3.k + mh * (1 - dr) as b from h3 join dr using (domain), k),
hp as (select host, a / (a + b) as rate, a, b from hr),
hl as (select host, rate, rate - 1.6448536269514722 * sqrt(rate * (1 - rate) / (a + b + 1)) as lower from hp)
select page_id, v.host, path, rule, coalesce(fixed, case when lower >= 0.5 then 'block' else 'allow' end) as verdict,
       rate as block_rate, lower as block_lower
from v join hl on v.host = hl.host
"""

DECONTAMINATE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select coalesce(item_id::varchar, 'null') as item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
m as (select item, w, least(10, len(w)) as m from b where len(w) > 0),
win as (
  select distinct item, m, array_to_string(w[i:i + m - 1], ' ') as g
  from (select item, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from m)),
lens as (select distinct m from win),
pos as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as g
  from (select doc_id, w, lens.m, unnest(generate_series(1, len(w) - lens.m + 1)) as i from d, lens where len(w) >= lens.m)),
hit as (select doc_id, win.item, pos.m, pos.i from pos join win on pos.m = win.m and pos.g = win.g),
covered as (select distinct doc_id, unnest(generate_series(i, i + m - 1)) as p from hit),
nh as (select doc_id, count(*) as n_hit from covered group by doc_id),
ni as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha
  from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join nh using (doc_id) left join ni using (doc_id)
"""

AUDIT = r"""
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select t, min(doc_id) as first from w group by t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (
  select part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
                100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t),
                regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] as x,
         coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from w join f using (t) left join l on w.doc_id = l.doc_id),
c as (select part, x, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
i as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as o from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select o, i as step, o[i] as f, o[:i - 1] as before from o, i),
r as (
  select part, array_to_string(list_transform(o, lambda q: 'ABCDE'[q]), '') as filter_order, step::int as step, f,
         coalesce(sum(n) filter (where len(list_filter(before, lambda q: x[q])) = 0 and not x[f]), 0)::bigint as kept,
         coalesce(sum(n) filter (where len(list_filter(before, lambda q: x[q])) = 0 and x[f]), 0)::bigint as removed,
         coalesce(sum(n) filter (where len(list_filter(before, lambda q: x[q])) > 0 and x[f]), 0)::bigint as redundant,
         coalesce(sum(n) filter (where x[f] and len(list_filter(x, lambda q: q)) = 1), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (where len(list_filter(before, lambda q: x[q])) = 0 and x[f]), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (where len(list_filter(before, lambda q: x[q])) = 0 and x[f]), 0)::bigint as toxic_lost
  from c, s group by part, o, step, f)
select * exclude (f), (sum(removed) over (partition by part, f))::bigint as shapley from r
"""

SEARCH = r"""
with d as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
total as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_words from d where len(w) > 0),
tf as (select doc_id, row, len(w)::bigint as n, term, count(*)::bigint as tf
       from (select doc_id, row, w, unnest(w) as term from d) where term in (select term from q) group by all),
df as (select term, count(*)::bigint as df from tf group by term),
s as (
  select q.item_id, row, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint
         * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) as score
  from q join tf using (term) join df using (term), total group by q.item_id, row, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score::bigint as score from r where rank <= 50
"""

ORACLE = {"op12_ranked_search": SEARCH, "op11_filter_audit": AUDIT,
          "op2_decontaminate": DECONTAMINATE, "op3_mix": MIX, "op4_url_reputation": URL}
