"""DuckDB oracle SQL for the registered queries (same names, same columns).

Written independently of the Spark plans, straight from the operator
pre-tokenizer is rebuilt as: cut every whitespace run that precedes a
non-space before its last character, then match the pattern without its
lookahead branch.
"""
from __future__ import annotations

from . import params as P

# Pre-tokenizer pattern without the lookahead branch (fixed value, RE2 syntax).
_PAT = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def pieces_sql(text: str) -> str:
    return (f"flatten(list_transform(string_split(regexp_replace({text}, '(\\s+)(\\s\\S)', "
            f"'\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda seg: regexp_extract_all(seg, '{_PAT}')))")


def byte_ids_sql(text: str) -> str:
    return (f"list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            f"lambda h: ('0x' || h)::int + 5)")


CORPUS = r"""corpus as (
  select lang as source,
         case lang when 'en' then 0 when 'de' then 1 when 'es' then 2 when 'fr' then 3 else 4 end as ord,
         doc_id, text
  from documents
  where text is not null and text <> '' and regexp_matches(text, '[^\s\x1c-\x1f]'))"""

LENS = """lens as (select source, ord, doc_id, strlen(text)::bigint + 1 as n from corpus)"""


def cut_sql(budget: int | str) -> str:
    return f"""cum as (
  select *, sum(n) over (partition by source order by doc_id
                         rows between unbounded preceding and current row) - n as off
  from lens),
cut as (select source, ord, doc_id, off::bigint as off, least(n, {budget} - off)::bigint as m
        from cum where off < {budget}),
tot as (select source, sum(m)::bigint as total,
               floor(sum(m) * 0.005::double)::bigint as n_val from cut group by source),
segs as (
  select c.source, 'val' as split, c.doc_id, c.off as pos, least(c.off + c.m, t.n_val) - c.off as len,
         0::bigint as skip
  from cut c join tot t using (source) where c.off < t.n_val
  union all
  select c.source, 'train' as split, c.doc_id, greatest(c.off, t.n_val) - t.n_val as pos,
         c.off + c.m - greatest(c.off, t.n_val) as len, greatest(c.off, t.n_val) - c.off as skip
  from cut c join tot t using (source) where c.off + c.m > t.n_val)"""


def _w(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


PIECE_COUNTS = f"""pc as (
  select piece, count(*)::bigint as n
  from (select unnest({pieces_sql('substring(text, 1, 5000)')}) as piece from corpus)
  group by piece)"""

_MULTI = r"""multi as (
  select 'documents' as source, 0 as ord, doc_id::bigint as doc_id,
         coalesce(case when text <> '' then text end, case when length(text) > 20 then text end,
                  case when length(lang) > 20 then lang end,
                  case when length(source) > 20 then source end) as text
  from documents
  union all
  select 'conversations', 1, (conv_id * 1000 + turn)::bigint,
         coalesce(case when text <> '' then text end, case when length(role) > 20 then role end,
                  case when length(text) > 20 then text end)
  from conversations
  union all
  select 'benchmark', 2, item_id::bigint,
         coalesce(case when text <> '' then text end, case when length(text) > 20 then text end)
  from benchmark
  union all
  select 'pages', 3, page_id::bigint,
         coalesce(case when length(url) > 20 then url end, case when length(html) > 20 then html end)
  from pages)"""

_SQL: dict[str, str] = {}

_SQL["a1_corpus_scan"] = _w(CORPUS) + """select source, ord, doc_id, length(text)::bigint as n_chars,
  strlen(text)::bigint as n_bytes, md5(text) as text_md5 from corpus"""

_SQL["a1_multi_source_scan"] = _w(_MULTI) + r"""select source, ord, doc_id, length(text)::bigint as n_chars,
  md5(text) as text_md5 from multi
where text is not null and text <> '' and regexp_matches(text, '[^\s\x1c-\x1f]')"""

_SQL["a3_doc_cap"] = _w(CORPUS) + f"""select source, doc_id from (
  select source, doc_id, row_number() over (partition by source order by doc_id) as rn from corpus)
where rn <= {P.CAP_DOCS}"""

_SQL["b1_blend"] = _w(CORPUS) + f"""select source, ord, doc_id, k from (
  select source, ord, doc_id, (row_number() over (partition by source order by doc_id) - 1)::bigint as k
  from corpus) where k < {P.BLEND_DOCS}"""

_SQL["b2_char_cap"] = _w(CORPUS) + """select source, doc_id, length(substring(text, 1, 5000))::bigint as n_chars,
  md5(substring(text, 1, 5000)) as text_md5 from corpus"""

_SQL["b3_pretokenize"] = _w(CORPUS, f"p as (select source, doc_id, {pieces_sql('text')} as p from corpus)") + \
    """select source, doc_id, len(p)::bigint as n_pieces, md5(array_to_string(p, chr(1))) as pieces_md5 from p"""

_SQL["b4_piece_counts"] = _w(CORPUS, PIECE_COUNTS) + "select piece, n from pc"

_SQL["b5_pair_counts"] = _w(CORPUS, PIECE_COUNTS, f"""b as (select n, {byte_ids_sql('piece')} as s from pc
  where strlen(piece) >= 2)""", """pairs as (select n, unnest(list_transform(range(1, len(s)),
  lambda i: {'l': s[i], 'r': s[i + 1]})) as p from b)""") + \
    "select p['l']::int as l, p['r']::int as r, sum(n)::bigint as c from pairs group by all"

_SQL["b8_encode_bytes"] = _w(CORPUS) + f"""select source, doc_id, strlen(text)::bigint as n_tokens,
  array_to_string({byte_ids_sql('text')}, ' ') as ids from corpus"""

_SQL["b9_decode"] = _w(CORPUS) + "select source, doc_id, text from corpus"

_SQL["b10_roundtrip_audit"] = _w(CORPUS) + """select source, count(*)::bigint as docs, 0::bigint as mismatched,
  sum(('0x' || substr(md5(text), 1, 8))::bigint)::bigint as digest_sum from corpus group by source"""

_SQL["b11_fertility"] = _w(CORPUS, r"""w as (select source, strlen(text)::bigint as tokens,
  len(regexp_extract_all(text, '[^\s\x1c-\x1f]+'))::bigint as words from corpus)""") + \
    """select source, sum(tokens)::bigint as tokens, sum(words)::bigint as words,
  round(sum(tokens)::double / sum(words)::double, 6) as fertility from w group by source"""

_SQL["b12_special_audit"] = """with v as (select * from (values
  ('<|endoftext|>', 0), ('<|pad|>', 1), ('<|system|>', 2), ('<|user|>', 3), ('<|assistant|>', 4)) t(text, declared)
  where (select count(*) from documents) > 0),
d as (select distinct '<|' || role || '|>' as text from conversations where role is not null
  union select text from v)
select d.text, v.declared, v.declared as id, v.declared is not null as resolved from d left join v using (text)"""


_SQL["c1_eot_append"] = _w(CORPUS) + \
    "select source, doc_id, strlen(text)::bigint + 1 as n, 0 as last_id from corpus"

_SQL["c2_budget_cut"] = _w(CORPUS, LENS, cut_sql(P.BUDGET)) + "select source, doc_id, off, m from cut"

_PER_SOURCE = "(case " + " ".join(f"when source = '{k}' then {v}" for k, v in P.SOURCE_BUDGETS.items()) + \
    f" else {P.NO_BUDGET} end)"
_SQL["c2_source_budgets"] = _w(CORPUS, LENS, cut_sql(_PER_SOURCE)) + "select source, doc_id, off, m from cut"
_SQL["c3_head_split"] = _w(CORPUS, LENS, cut_sql(P.BUDGET)) + \
    "select source, split, doc_id, pos::bigint as pos, len::bigint as len from segs"

_SQL["c4_progress_marks"] = _w(CORPUS, LENS, cut_sql(P.BUDGET)) + f"""select source, doc_id, (off + n)::bigint as total
from cum where off + n < {P.BUDGET} and (off + n) // {P.PROGRESS_STEP} > off // {P.PROGRESS_STEP}"""

_SQL["c5_corpus_report"] = _w(CORPUS, LENS, cut_sql(P.BUDGET)) + """select source, split,
  count(*)::bigint as segments, sum(len)::bigint as tokens from segs group by rollup (source, split)"""

_DOC_IDS = f"""docids as (select source, doc_id, list_concat({byte_ids_sql('text')}, [0]) as ids from corpus)"""

_SQL["c6_id_guard"] = _w(CORPUS, LENS, cut_sql(P.NO_BUDGET), _DOC_IDS,
                         """sids as (select s.source, d.ids[s.skip + 1 : s.skip + s.len] as ids
  from segs s join docids d using (source, doc_id))""") + \
    f"""select source, min(list_min(ids))::int as min_id, max(list_max(ids))::int as max_id,
  sum(len(list_filter(ids, lambda x: x < 0 or x >= {P.BYTE_VOCAB})))::bigint as violations
from sids group by source"""

_SQL["c6_build_watch"] = _w(CORPUS, LENS, cut_sql(P.BUDGET), _DOC_IDS,
                            """n as (select source, split, sum(len) as len from segs group by all)""",
                            """r as (select min(list_min(d.ids[s.skip + 1 : s.skip + s.len])) as min_id,
  max(list_max(d.ids[s.skip + 1 : s.skip + s.len])) as max_id from segs s join docids d using (source, doc_id))""") + \
    """select sum(ceil(len / 4096.0))::bigint as blocks, sum(len)::bigint as tokens,
  coalesce(sum(len) filter (where split = 'val'), 0)::bigint as val_tokens, any_value(min_id)::int as min_id,
  any_value(max_id)::int as max_id from n, r"""

_SQL["a5_token_blocks"] = _w(CORPUS, LENS, cut_sql(P.NO_BUDGET), _DOC_IDS,
                             """u as (select source, doc_id, unnest(ids) as tok,
  unnest(range(0, len(ids))) as j from docids)""",
                             """t as (select s.source, s.split, s.pos + u.j - s.skip as p, u.tok
  from segs s join u on s.source = u.source and s.doc_id = u.doc_id
  and u.j >= s.skip and u.j < s.skip + s.len)""") + \
    """select source, split, (p // 4096)::bigint as block_id, count(*)::bigint as n,
  string_agg(tok::varchar, ' ' order by p) as toks from t group by all"""


def oracle() -> dict[str, str]:
    return dict(_SQL)


# --- D: mixing --------------------------------------------------------------------

_FLAT = [CORPUS, LENS, cut_sql(P.NO_BUDGET), _DOC_IDS,
         """u as (select source, doc_id, unnest(ids) as tok, unnest(range(0, len(ids))) as j from docids)""",
         """t as (select s.source, s.split, s.pos + u.j - s.skip as p, u.tok
  from segs s join u on s.source = u.source and s.doc_id = u.doc_id
  and u.j >= s.skip and u.j < s.skip + s.len)""",
         """flat as (select source, split, list(tok order by p) as arr, count(*)::bigint as n
  from t group by all)"""]

_MIX = "mix as (select * from (values " + ", ".join(
    f"('{k}', {i}, {float(v)}::double)" for i, (k, v) in enumerate(P.MIX.items())) + \
    ") m(source, ord, weight))"


def _resolve(split: str) -> str:
    fb = "false" if split == "train" else "(coalesce(r.n, 0) = 0 and coalesce(t.n, 0) > 0)"
    return f"""res as (
  select m.source, m.ord, m.weight,
         case when coalesce(r.n, 0) > 0 then '{split}' when coalesce(t.n, 0) > 0 then 'train' end as read_split,
         (case when coalesce(r.n, 0) > 0 then r.n when coalesce(t.n, 0) > 0 then t.n else 0 end)::bigint as n,
         {fb} as fell_back
  from mix m left join (select source, n from flat where split = '{split}') r on m.source = r.source
             left join (select source, n from flat where split = 'train') t on m.source = t.source),
res2 as (select *, case when read_split is null then 'no data'
                        when n <= {P.SEQ_LEN + 1} then 'too short' end as drop_reason from res)"""


_BOUNDS = """b0 as (select *, weight / sum(weight) over () as p from res2 where drop_reason is null),
b1 as (select *, sum(p) over (order by ord rows between unbounded preceding and current row) as hi0 from b0),
bounds as (select *, lag(hi0, 1, 0.0) over (order by ord) as lo,
  case when ord = max(ord) over () then 1.0::double else hi0 end as hi from b1)"""


def _uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::bigint / 4503599627370496.0::double)"


def _draws(n_seq: int, seed: int, split: str, tag: str = "", batch: int = P.BATCH,
           src_tab: str = "bounds") -> str:
    pre = f"'{seed}:{split}:" + (f"{tag}:" if tag else "") + "'"
    return f"""(select d.i, d.i // {batch} as batch_id, (d.i % {batch})::int as seq_in_batch,
    b.source, b.read_split as split,
    floor(d.u2 * (b.n - {P.SEQ_LEN} - 1))::bigint as start
  from (select i, {_uniform(pre + " || i || ':src'")} as u, {_uniform(pre + " || i || ':start'")} as u2
        from range(0, {n_seq}) r(i)) d
  join {src_tab} b on d.u >= b.lo and d.u < b.hi)"""


_WIN = f"""win as {_draws(P.N_BATCHES * P.BATCH, P.SEED, 'train')}"""
_WIN_BODY = f"""wt as (select w.batch_id, w.seq_in_batch, w.source, w.split, w.start, t.p, t.tok
  from win w join t on w.source = t.source and w.split = t.split
  and t.p >= w.start and t.p <= w.start + {P.SEQ_LEN}),
wx as (select batch_id, seq_in_batch, source, split, start,
  list(tok order by p)[1:{P.SEQ_LEN}] as x, list(tok order by p)[2:{P.SEQ_LEN + 1}] as y
  from wt group by all)"""

_SQL["d1_split_resolution"] = _w(*_FLAT, _MIX, _resolve("val")) + \
    "select source, ord, read_split, n, fell_back, drop_reason from res2"

_SQL["d3_mix_weights"] = _w(*_FLAT, _MIX, _resolve("train"), _BOUNDS) + \
    "select source, n, round(p, 6) as p, round(lo, 6) as lo, round(hi, 6) as hi from bounds"

_SQL["d4_source_picks"] = _w(*_FLAT, _MIX, _resolve("train"), _BOUNDS, _WIN) + \
    "select i, source, start from win"

_SQL["d6_mixed_windows"] = _w(*_FLAT, _MIX, _resolve("train"), _BOUNDS, _WIN, _WIN_BODY) + \
    """select batch_id, seq_in_batch, source, split, start, array_to_string(x, ' ') as x,
  array_to_string(y, ' ') as y from wx"""

_SQL["d9_batch_audit"] = _w(*_FLAT, _MIX, _resolve("train"), _BOUNDS, _WIN, _WIN_BODY) + \
    f"""select count(*)::bigint as windows, count(distinct batch_id)::bigint as batches,
  sum(case when len(x) <> {P.SEQ_LEN} or len(y) <> {P.SEQ_LEN} then 1 else 0 end)::bigint as bad_shape,
  sum(case when x[2:] = y[:{P.SEQ_LEN - 1}] then 0 else 1 end)::bigint as bad_shift,
  sum(case when list_min(x) >= 0 and list_max(x) < {P.BYTE_VOCAB} and list_min(y) >= 0
           and list_max(y) < {P.BYTE_VOCAB} then 0 else 1 end)::bigint as bad_range
from wx"""

_PRESETS = "presets as (select * from (values " + ", ".join(
    f"('{a}', {b}, {c}, {d}, {e})" for a, b, c, d, e in P.PRESETS) + \
    ") p(preset, seq_len, batch_size, grad_accum, max_steps))"

_SQL["d10_run_plan"] = _w(*_FLAT, _PRESETS) + """select preset,
  (batch_size * grad_accum * seq_len)::bigint as tokens_per_step,
  (batch_size * grad_accum * seq_len * max_steps)::bigint as total_tokens,
  (select sum(n) from flat where split = 'train')::bigint as corpus_tokens,
  round((batch_size * grad_accum * seq_len * max_steps)::double
        / (select sum(n) from flat where split = 'train')::double, 6) as epochs
from presets"""


def _val_sql() -> str:
    srcs = [s for s in P.MIX if s != "xx"]
    parts = []
    for s in srcs:
        for r in range(P.EVAL_ROUNDS):
            d = _draws(P.VAL_BATCHES * P.VAL_BATCH, P.SEED + 99, "val", f"{s}:{r}", P.VAL_BATCH,
                       f"(select * from vb where source = '{s}')")
            parts.append(f"select '{s}' as loader, {r} as eval_round, * from {d}")
    vb = f"""vb as (select source, 'val' as read_split, n, 0.0::double as lo, 1.0::double as hi
  from flat where split = 'val' and n > {P.SEQ_LEN + 1})"""
    win = "win as (" + "\nunion all\n".join(parts) + ")"
    return [vb, win]


def _val_body() -> str:
    return f"""wt as (select w.loader, w.eval_round, w.batch_id, w.seq_in_batch, w.source, w.split,
  w.start, t.p, t.tok
  from win w join t on w.source = t.source and w.split = t.split
  and t.p >= w.start and t.p <= w.start + {P.SEQ_LEN}),
wx as (select loader, eval_round, batch_id, seq_in_batch, source, split, start,
  list(tok order by p)[1:{P.SEQ_LEN}] as x, list(tok order by p)[2:{P.SEQ_LEN + 1}] as y
  from wt group by all)"""


def _val_sql_full() -> str:
    vb, win = _val_sql()
    return _w(*_FLAT, vb, win, _val_body()) + """select loader, eval_round, batch_id, seq_in_batch,
  source, split, start, array_to_string(x, ' ') as x, array_to_string(y, ' ') as y from wx"""


_SQL["d11_val_windows"] = _val_sql_full()


# --- E: instruction sets ---------------------------------------------------------------

def _strip(x: str) -> str:
    return ("trim(" + x + ", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) "
            "|| chr(28) || chr(29) || chr(30) || chr(31))")


_MCQ = """mcq as (select p_partkey as row_id,
  concat('  Which brand is ', p_name, ' number ', cast(p_partkey as varchar), '? ') as question,
  p_brand as opa, case when p_partkey % 17 = 0 then '' else p_type end as opb,
  case when p_partkey % 19 = 0 then null else p_name end as opc, cast(p_size as varchar) as opd,
  case when p_partkey % 13 = 0 then null else cast(p_partkey % 4 as int) end as cop,
  case p_partkey % 3 when 0 then null when 1 then concat(' Listed as ', p_type, '. ') else '   ' end as exp
  from part)"""

_QA = """qa as (select o_orderkey as row_id,
  case when o_orderkey % 23 = 0 then '  ' else concat('Is order ', cast(o_orderkey as varchar), ' open? ') end as question,
  case o_orderkey % 5 when 0 then 'yes' when 1 then ' NO ' when 2 then 'maybe' when 3 then '' else null end as final_decision,
  case when o_orderkey % 29 = 0 then null else concat(' Status ', o_orderstatus, ', priority ', o_orderpriority, '. ') end as long_answer
  from orders)"""

_INSTR = """instr as (select conv_id * 100 + turn as row_id, text as instruction, coalesce(sys, '') as input,
  nxt as output
  from (select conv_id, turn, role, text,
    lead(text) over (partition by conv_id order by turn) as nxt,
    lead(role) over (partition by conv_id order by turn) as nrole,
    max(case when role = 'system' then text end) over (partition by conv_id) as sys
   from conversations) t
  where role = 'user' and nrole = 'assistant')"""

_MCQP = f"""mcqp as (select row_id,
  {_strip('question')} || chr(10) || 'A. ' || opa || chr(10) || 'B. ' || opb || chr(10) || 'C. ' || opc
    || chr(10) || 'D. ' || opd as "user",
  'The correct answer is ' || ['A', 'B', 'C', 'D'][cop + 1] || '. ' || [opa, opb, opc, opd][cop + 1] || '.'
    || case when exp is not null and exp <> '' then ' ' || {_strip('exp')} else '' end as assistant
  from mcq where opa is not null and opa <> '' and opb is not null and opb <> ''
    and opc is not null and opc <> '' and opd is not null and opd <> ''
    and cop is not null and cop between 0 and 3)"""

_QAP = f"""qap as (select row_id, q as "user",
  case when dec <> '' then upper(substr(dec, 1, 1)) || lower(substr(dec, 2)) || '. ' || lng else lng end as assistant
  from (select row_id, {_strip("coalesce(question, '')")} as q, {_strip("coalesce(final_decision, '')")} as dec,
               {_strip("coalesce(long_answer, '')")} as lng from qa) s
  where q <> '' and lng <> '')"""

_INSTRP = f"""instrp as (select row_id, case when inp <> '' then ins || chr(10) || inp else ins end as "user",
  outp as assistant
  from (select row_id, {_strip("coalesce(instruction, '')")} as ins, {_strip("coalesce(input, '')")} as inp,
               {_strip("coalesce(output, '')")} as outp from instr) s
  where ins <> '' and outp <> '')"""

_UNION = f"""allp as (select 'mcq' as source, * from mcqp union all select 'qa', * from qap
  union all select 'instr', * from instrp),
chatu as (select source, row_id, "user", assistant from (
  select *, row_number() over (partition by source order by row_id) as rn from allp) s
  where (source = 'mcq' and rn <= {P.QUOTAS['mcq']}) or (source = 'qa' and rn <= {P.QUOTAS['qa']})
     or (source = 'instr' and rn <= {P.QUOTAS['instr']}))"""

_CHAT = [_MCQ, _QA, _INSTR, _MCQP, _QAP, _INSTRP, _UNION]

_ENC = f"""enc as (select source, row_id,
  list_concat([3], {byte_ids_sql("chr(10) || " + '"user"')}, [4]) as prompt,
  list_concat({byte_ids_sql("chr(10) || assistant")}, [0]) as resp from chatu),
enc2 as (select source, row_id, len(prompt) as n_prompt, list_concat(prompt, resp) as "full",
  list_concat(list_transform(prompt, lambda x: -1), resp) as labels from enc)"""

_EX = f"""ex as (select source, row_id, n_prompt, "full"[1:{P.SFT_MAX_LEN}] as "full",
  labels[1:{P.SFT_MAX_LEN}] as labels from enc2),
ex2 as (select *, len(list_filter(labels, lambda x: x <> -1)) as n_target from ex where len("full") >= 4)"""

_EPOCHS = f"""eb as (select e.epoch, x.*,
  row_number() over (partition by e.epoch order by md5('{P.SFT_SEED}:' || e.epoch || ':' || x.source || ':' || x.row_id)) - 1 as rnk
  from ex2 x, range(0, {P.SFT_EPOCHS}) e(epoch)),
eb2 as (select *, rnk // {P.SFT_BATCH} as batch_id, (rnk % {P.SFT_BATCH})::int as "row" from eb)"""

_COLL = """co as (select *, max(len("full")) over (partition by epoch, batch_id) as m from eb2),
co2 as (select epoch, batch_id, "row", source, row_id, (m - len("full"))::int as n_pad,
  list_concat("full"[1:len("full") - 1], list_transform(range(0, m - len("full")), lambda i: 1)) as x,
  list_concat(labels[2:], list_transform(range(0, m - len("full")), lambda i: -1)) as y from co)"""

_SQL["e1_mcq_pairs"] = _w(_MCQ, _MCQP) + 'select row_id, "user", assistant from mcqp'
_SQL["e2_qa_pairs"] = _w(_QA, _QAP) + 'select row_id, "user", assistant from qap'
_SQL["e3_instr_pairs"] = _w(_INSTR, _INSTRP) + 'select row_id, "user", assistant from instrp'
_SQL["e4_source_quota"] = _w(*_CHAT) + """select source, count(*)::bigint as rows, min(row_id) as first_row,
  max(row_id) as last_row from chatu group by source"""
_SQL["e5_chat_union"] = _w(*_CHAT) + 'select source, row_id, "user", assistant from chatu'
_SQL["e6_seeded_shuffle"] = _w(*_CHAT) + f"""select source, row_id,
  (row_number() over (order by md5('{P.SFT_SEED}:' || source || ':' || row_id)) - 1)::bigint as position
from chatu"""
_SQL["e7_chat_encode"] = _w(*_CHAT, _ENC) + """select source, row_id, n_prompt::int as n_prompt,
  len("full")::int as n_full, md5(array_to_string("full", ' ')) as full_md5,
  md5(array_to_string(labels, ' ')) as labels_md5 from enc2"""
_SQL["e8_truncate_mask"] = _w(*_CHAT, _ENC, _EX) + \
    'select source, row_id, len("full")::int as n_full, n_target::int as n_target from ex2'
_SQL["e9_short_drop"] = _w(*_CHAT, _ENC, _EX) + """select e.source, count(*)::bigint as encoded,
  coalesce(max(k.kept), 0)::bigint as kept, coalesce(max(k.no_target), 0)::bigint as no_target
from enc2 e left join (select source, count(*) as kept, sum(case when n_target = 0 then 1 else 0 end) as no_target
  from ex2 group by source) k on e.source = k.source group by e.source"""
_SQL["e10_epoch_batches"] = _w(*_CHAT, _ENC, _EX, _EPOCHS) + \
    'select epoch::int as epoch, batch_id::bigint as batch_id, "row", source, row_id from eb2'
_SQL["e11_collate"] = _w(*_CHAT, _ENC, _EX, _EPOCHS, _COLL) + """select epoch::int as epoch,
  batch_id::bigint as batch_id, "row", source, row_id, n_pad, len(x)::int as width,
  md5(array_to_string(x, ' ')) as x_md5, md5(array_to_string(y, ' ')) as y_md5 from co2"""
_SQL["e12_inference_prompts"] = f"""select item_id,
  array_to_string(list_concat([3], {byte_ids_sql("chr(10) || text")}, [4, 15]), ' ') as chat,
  array_to_string({byte_ids_sql("text")}, ' ') as plain from benchmark"""
_SQL["e14_padding_report"] = _w(*_CHAT, _ENC, _EX, _EPOCHS, _COLL) + """select epoch::int as epoch,
  count(*)::bigint as rows, count(distinct batch_id)::bigint as batches, sum(len(x))::bigint as positions,
  sum(n_pad)::bigint as pad, sum(len(list_filter(y, lambda v: v = -1)))::bigint as masked,
  round(sum(n_pad)::double / sum(len(x))::double, 6) as pad_share,
  round(sum(len(list_filter(y, lambda v: v = -1)))::double / sum(len(x))::double, 6) as masked_share
from co2 group by epoch"""


# --- F: evaluation ----------------------------------------------------------------

_NV = f"(select count(*) from tr) + {P.BYTE_VOCAB}"
_SCORER = [*_FLAT,
           "tr as (select source, p, tok from t where split = 'train')",
           """bg as (select a.tok as v, b.tok as w, count(*)::bigint as c from tr a join tr b
  on a.source = b.source and b.p = a.p + 1 group by all)""",
           "uni as (select tok as w, count(*)::bigint as cw from tr group by all)",
           "ctxc as (select v, sum(c)::bigint as cv from bg group by v)"]


def _logp(lam: float) -> str:
    return (f"ln({lam} * (case when cx.cv > 0 then coalesce(b.c, 0)::double / cx.cv else 0.0 end) + "
            f"{1.0 - lam} * (coalesce(u.cw, 0) + 1)::double / ({_NV})::double)")


def _score_join(src: str, lam: float) -> str:
    return f"""(select s.*, {_logp(lam)} as logp from {src} s
  left join bg b on b.v = s.prev and b.w = s.cur
  left join uni u on u.w = s.cur
  left join ctxc cx on cx.v = s.prev)"""


_CANDS = [_MCQ, _QA,
          f"""mcqv as (select * from mcq where opa is not null and opa <> '' and opb is not null and opb <> ''
    and opc is not null and opc <> '' and opd is not null and opd <> '' and cop is not null
    and cop between 0 and 3 order by row_id limit {P.EVAL_LIMIT})""",
          """mc as (select 'mcq' as task, row_id, 'Question: ' || question || chr(10) || 'Answer:' as context,
    cop as gold, unnest([0, 1, 2, 3]) as idx, unnest([opa, opb, opc, opd]) as option from mcqv)""",
          f"""qav as (select row_id, question, lower({_strip("coalesce(final_decision, '')")}) as gold_text
    from qa where lower({_strip("coalesce(final_decision, '')")}) in ('yes', 'no', 'maybe')
    order by row_id limit {P.EVAL_LIMIT})""",
          """qc as (select 'qa' as task, row_id, 'Question: ' || question || chr(10) || 'Answer:' as context,
    (case gold_text when 'yes' then 0 when 'no' then 1 else 2 end)::int as gold,
    unnest([0, 1, 2]) as idx, unnest(['yes', 'no', 'maybe']) as option from qav)""",
          "cands as (select * from mc union all select * from qc)"]


def _toks(max_len: int) -> str:
    return f"""ctok as (select task, row_id, idx, list_concat({byte_ids_sql('context')},
    {byte_ids_sql("' ' || option")}) as ids, len({byte_ids_sql('context')}) as n_ctx,
    len({byte_ids_sql("' ' || option")}) as n_opt from cands),
ctok2 as (select *, greatest(len(ids) - {max_len}, 0) as cut from ctok)"""


def _scores(max_len: int, lam: float, name: str = "sc") -> list[str]:
    return [_toks(max_len),
            """pos as (select task, row_id, idx, ids, unnest(range(greatest(n_ctx, cut + 1), n_ctx + n_opt)) as j
  from ctok2)""",
            "prs as (select task, row_id, idx, ids[j] as prev, ids[j + 1] as cur from pos)",
            f"""{name} as (select c.task, c.row_id, c.idx,
    coalesce(x.tot, 0.0) / greatest(c.n_opt, 1) as score from ctok2 c
  left join (select task, row_id, idx, sum(logp) as tot from {_score_join('prs', lam)} z
             group by all) x using (task, row_id, idx))"""]


def _preds_sql(sc: str = "sc", name: str = "pr") -> str:
    return f"""{name} as (select s.task, s.row_id, first(s.idx order by s.score desc, s.idx) as pred,
    max(g.gold) as gold from {sc} s join (select distinct task, row_id, gold from cands) g
    using (task, row_id) group by s.task, s.row_id)"""


_ACC = """select task, count(*)::bigint as n, sum(case when pred = gold then 1 else 0 end)::bigint as correct,
  round(sum(case when pred = gold then 1 else 0 end)::double / count(*), 6) as accuracy,
  round(case when task = 'mcq' then 0.25 else 1.0 / 3 end, 6) as chance from {} group by task"""

_SQL["f1_mcq_candidates"] = _w(*_CANDS) + \
    "select row_id, idx::int as idx, option, context, gold from mc"
_SQL["f2_qa_candidates"] = _w(*_CANDS) + \
    "select row_id, idx::int as idx, option, context, gold from qc"
_SQL["f3_prompt_tokens"] = _w(*_CANDS, _toks(P.EVAL_MAX_LEN)) + """select task, row_id, idx::int as idx,
  n_ctx::int as n_ctx, n_opt::int as n_opt, array_to_string(ids, ' ') as ids from ctok2"""
_SQL["f10_bigram_counts"] = _w(*_SCORER) + "select v::int as v, w::int as w, c from bg"
_SQL["f4_option_scores"] = _w(*_SCORER, *_CANDS, *_scores(P.EVAL_MAX_LEN, P.LAMBDA)) + \
    "select task, row_id, idx::int as idx, round(score, 6) as score from sc"
_BEFORE = """gr as (select a.tok as w, lag(a.tok, 1) over o as p1, lag(a.tok, 2) over o as p2, lag(a.tok, 3) over o as p3
  from tr a window o as (partition by a.source order by a.p))"""
_SQL["f4_suffix_counts"] = _w(*_FLAT, _SCORER[len(_FLAT)], _BEFORE) + """select (coalesce(p1, -1) + 1)::bigint
  + (coalesce(p2, -1) + 1)::bigint * 131072 + (coalesce(p3, -1) + 1)::bigint * 17179869184 as ctx, w::int as w, count(*)::bigint as c
from gr group by all"""
_SQL["f4_context_scores"] = _w(
    *_SCORER, _BEFORE, *_CANDS, _toks(P.EVAL_MAX_LEN),
    "g1 as (select p1, w, count(*) as c from gr group by all)",
    "g2 as (select p1, p2, w, count(*) as c from gr where p2 is not null group by all)",
    "g3 as (select p1, p2, p3, w, count(*) as c from gr where p3 is not null group by all)",
    "h1 as (select p1, sum(c) as t from g1 group by all)", "h2 as (select p1, p2, sum(c) as t from g2 group by all)",
    "h3 as (select p1, p2, p3, sum(c) as t from g3 group by all)",
    """pos as (select task, row_id, idx, ids, cut, unnest(range(greatest(n_ctx, cut + 1), n_ctx + n_opt)) as j from ctok2)""",
    """rq as (select task, row_id, idx, ids[j + 1] as w, ids[j] as p1, case when j - 1 > cut then ids[j - 1] end as p2,
  case when j - 2 > cut then ids[j - 2] end as p3 from pos)""",
    f"""pr as (select rq.*, (coalesce(cw, 0) + 1)::double / ({_NV})::double as q0, coalesce(g1.c, 0) as c1, coalesce(h1.t, 0) as t1,
  coalesce(g2.c, 0) as c2, coalesce(h2.t, 0) as t2, coalesce(g3.c, 0) as c3, coalesce(h3.t, 0) as t3
  from rq left join uni u on u.w = rq.w left join g1 on g1.p1 = rq.p1 and g1.w = rq.w left join h1 on h1.p1 = rq.p1
  left join g2 on g2.p1 = rq.p1 and g2.p2 = rq.p2 and g2.w = rq.w left join h2 on h2.p1 = rq.p1 and h2.p2 = rq.p2
  left join g3 on g3.p1 = rq.p1 and g3.p2 = rq.p2 and g3.p3 = rq.p3 and g3.w = rq.w
  left join h3 on h3.p1 = rq.p1 and h3.p2 = rq.p2 and h3.p3 = rq.p3)""",
    """lp as (select task, row_id, idx, sum(ln((c3 + (c2 + (c1 + q0) / (t1 + 1)) / (t2 + 1)) / (t3 + 1))) as tot from pr group by all)""") + \
    """select c.task, c.row_id, c.idx::int as idx, round(coalesce(tot, 0.0) / greatest(c.n_opt, 1), 6) as score
from ctok2 c left join lp using (task, row_id, idx)"""
_SQL["f5_truncated_scores"] = _w(*_SCORER, *_CANDS, *_scores(P.TRUNC_MAX_LEN, P.LAMBDA)) + \
    "select task, row_id, idx::int as idx, round(score, 6) as score from sc"
_SQL["f6_predictions"] = _w(*_SCORER, *_CANDS, *_scores(P.EVAL_MAX_LEN, P.LAMBDA), _preds_sql()) + \
    """select task, row_id, pred::int as pred, gold::int as gold,
  (case when pred = gold then 1 else 0 end)::int as correct from pr"""
_SQL["f7_accuracy"] = _w(*_SCORER, *_CANDS, *_scores(P.EVAL_MAX_LEN, P.LAMBDA), _preds_sql()) + \
    _ACC.format("pr")


def _f8() -> str:
    a = _scores(P.EVAL_MAX_LEN, 0.0, "sa")
    b = _scores(P.EVAL_MAX_LEN, P.LAMBDA, "sb")
    # the two scorers share the token CTEs; rename the second chain's helpers
    b = [x.replace("ctok2", "ctokb2").replace("ctok ", "ctokb ").replace("from ctok)", "from ctokb)")
          .replace("pos as", "posb as").replace("from pos)", "from posb)").replace("prs as", "prsb as")
          .replace("'prs'", "'prsb'").replace("from prs ", "from prsb ") for x in b]
    acc = lambda n: _ACC.format(n)
    return _w(*_SCORER, *_CANDS, *a, *b, _preds_sql("sa", "pa"), _preds_sql("sb", "pb"),
              f"aa as ({acc('pa')})", f"ab as ({acc('pb')})") + \
        """select aa.task, aa.accuracy as base, ab.accuracy as tuned,
  round(ab.accuracy - aa.accuracy, 6) as delta from aa join ab using (task)"""


_SQL["f8_model_comparison"] = _f8()


def _f9() -> str:
    vb, win = _val_sql()
    return _w(*_SCORER, vb, win, _val_body(),
              """vp as (select loader, eval_round, batch_id, unnest(x) as prev, unnest(y) as cur from wx)""",
              f"""sc as {_score_join('vp', P.LAMBDA)}""",
              """pb as (select loader, eval_round, batch_id, -avg(logp) as loss from sc group by all)""",
              """ps as (select loader, eval_round, avg(loss) as loss from pb group by all)""") + \
        """select eval_round, 'val_' || loader as series, round(loss, 6) as loss from ps
union all select eval_round, 'val_avg', round(avg(loss), 6) from ps group by eval_round"""


_SQL["f9_heldout_loss"] = _f9()

_SQL["f11_topk_next_token"] = _w(*_SCORER, f"""pr0 as {_score_join(
    f'(select c.v as prev, r.w as cur from ctxc c, range(0, {P.BYTE_VOCAB}) r(w))', P.LAMBDA)}""",
                                 f"""pr1 as (select prev, cur, logp / {max(P.TEMPERATURE, 1e-6)} as logit,
  rank() over (partition by prev order by logp / {max(P.TEMPERATURE, 1e-6)} desc) as rk from pr0)""",
                                 """pr2 as (select prev, cur, exp(logit - max(logit) over (partition by prev)) as e
  from pr1 where rk <= """ + str(P.TOPK) + ")") + \
    "select prev::int as prev, cur::int as cur, round(e / sum(e) over (partition by prev), 6) as prob from pr2"



# --- G: run metrics -------------------------------------------------------------------

_METRICS = """metrics as (select event_type as run, event_id as ingest_seq, 250 * (event_id % 24 + 1) as step,
  value as train_loss, 0.0008::double as lr, (value + value * 1.25) / 2 as val_avg, value as val_en,
  value * 1.25 as val_de, ts from events)"""
_DEDUP = """dd as (select * from metrics
  qualify row_number() over (partition by run, step order by ingest_seq desc) = 1)"""
_LONG = """lg as (select run, step, 'val_en' as series, val_en as value from dd
  union all select run, step, 'val_de', val_de from dd
  union all select run, step, 'val_avg', val_avg from dd
  union all select run, step, 'train_loss', train_loss from dd)"""

_SQL["g1_curves_long"] = _w(_METRICS, _DEDUP, _LONG) + \
    "select run, step, series, round(value, 6) as value from lg where value is not null"
_SQL["g2_running_best"] = _w(_METRICS, _DEDUP) + """select run, step, round(val_avg, 6) as val_avg,
  round(min(val_avg) over (partition by run order by step rows between unbounded preceding and 1 preceding), 6)
    as best_before,
  coalesce(val_avg < min(val_avg) over (partition by run order by step rows between unbounded preceding
    and 1 preceding), true) as is_best from dd"""
_SQL["g3_latest_state"] = _w(_METRICS, _DEDUP) + """select run, max(step) as step,
  round(arg_max(val_avg, step), 6) as val_avg, round(arg_max(train_loss, step), 6) as train_loss,
  round(min(val_avg), 6) as best_val from dd group by run"""
_SQL["g4_resume_dedup"] = _w(_METRICS, _DEDUP) + \
    "select run, step, ingest_seq, round(train_loss, 6) as train_loss from dd"
_SQL["g5_throughput"] = _w(_METRICS, _DEDUP, f"""th as (select run, step,
  (step - lag(step) over (partition by run order by step)) * {P.TOKENS_PER_STEP} as tokens,
  (epoch_us(ts) - lag(epoch_us(ts)) over (partition by run order by step)) / 1e6 as secs from dd)""") + \
    """select run, step, tokens::bigint as tokens, round(secs, 6) as secs,
  round(case when secs = 0 then null else tokens / secs end, 6) as tokens_per_sec
from th where secs is not null"""

_LR, _MIN_LR, _WARM, _MAX = P.LR_SCHEDULE


def _sched(s: str) -> str:
    return f"""(case when {s} < {_WARM} then {_LR}::double * ({s} + 1) / {_WARM}::double
  when {s} >= {_MAX} then {_MIN_LR}::double
  else {_MIN_LR}::double + 0.5 * (1.0 + cos(pi() * ({s} - {_WARM}) / {max(1, _MAX - _WARM)}::double))
       * ({_LR}::double - {_MIN_LR}::double) end)"""


_SQL["g6_lr_audit"] = _w(_METRICS, f"""ms as (select run, step, ingest_seq,
  case when ingest_seq % {P.LR_FAULT_EVERY} = 0 then {_sched('step - 1')} * 1.5 else {_sched('step - 1')} end as lr,
  {_sched('step - 1')} as expected from metrics)""",
                         """au as (select *, abs(lr - expected) / greatest(abs(expected), 1e-30) as rel_err from ms)""") + \
    "select run, step, ingest_seq, round(rel_err, 6) as rel_err from au where rel_err > 1e-9"
_SQL["g7_run_comparison"] = _w(_METRICS, _DEDUP, _LONG, """bst as (select run, series, min(value) as best
  from lg where series like 'val_%' and value is not null group by all)""") + \
    """select run, series, round(best, 6) as best, (rank() over (partition by series order by best))::int as rank
from bst"""
_SQL["g8_start_end_gap"] = _w(_METRICS, _DEDUP, _LONG, """se as (select run, series, arg_min(value, step) as first_value,
  arg_max(value, step) as last_value from lg where value is not null group by all)""") + \
    """select s.run, s.series, round(s.first_value, 6) as first_value, round(s.last_value, 6) as last_value,
  round(case when s.series like 'val_%' then t.last_value - s.last_value end, 6) as gap
from se s left join (select run, last_value from se where series = 'train_loss') t using (run)"""


# --- A4-A9, S: sinks, sources and streams ------------------------------------------------

_SQL["a4_stream_ingest"] = _w(CORPUS) + "select source, ord, doc_id, md5(text) as text_md5 from corpus"
_SQL["a5_block_sink_roundtrip"] = _SQL["a5_token_blocks"]
_SQL["a6_build_if_absent"] = _w(CORPUS, LENS, cut_sql(P.NO_BUDGET), _DOC_IDS,
                                """u as (select source, doc_id, unnest(ids) as tok,
  unnest(range(0, len(ids))) as j from docids)""",
                                """t as (select s.source, s.split, s.pos + u.j - s.skip as p, u.tok
  from segs s join u on s.source = u.source and s.doc_id = u.doc_id
  and u.j >= s.skip and u.j < s.skip + s.len)""") + \
    """select source, split, count(distinct p // 4096)::bigint as blocks, count(*)::bigint as tokens
from t group by all"""
_SQL["a8_chat_jsonl"] = _SQL["e5_chat_union"]
_SQL["a9_metrics_jsonl"] = _w(_METRICS) + """select run, step, ingest_seq, round(val_avg, 6) as val_avg,
  round(val_de, 6) as val_de from metrics"""
_SQL["a9_metrics_long"] = _w(_METRICS) + """select run, step, ingest_seq, series, round(value, 6) as value
from (unpivot (select run, step, ingest_seq, train_loss, val_avg, val_en, val_de from metrics)
  on train_loss, val_avg, val_en, val_de into name series value value)"""
_SQL["s2_stream_piece_counts"] = _SQL["b4_piece_counts"]
_SQL["s2_stream_capped_counts"] = _w(CORPUS, f"""capped as (select text from corpus
  qualify row_number() over (partition by source order by doc_id) <= {P.CAP_DOCS})""",
                                     PIECE_COUNTS.replace("from corpus", "from capped")) + "select piece, n from pc"
_SQL["s3_stream_deduped_best"] = _w(_METRICS, _DEDUP) + \
    "select run, round(min(val_avg), 6) as best_val, count(*)::bigint as steps from dd group by run"
_SQL["s3_stream_run_best"] = _w(_METRICS) + \
    "select run, round(min(val_avg), 6) as best_val, count(*)::bigint as rows from metrics group by run"

_SQL["e13_completion_extraction"] = _w(*_CHAT, _ENC, f"""pl as (select source, row_id,
  {byte_ids_sql('"user"')} as pr, {byte_ids_sql('"user" || assistant')} as out from chatu)""") + """select e.row_id,
  array_to_string(resp, ' ') as chat_completion, array_to_string(pl.out, ' ') as plain_output
from enc e join pl on e.source = pl.source and e.row_id = pl.row_id where e.source = 'instr'"""


_SQL["d10_realised_mix"] = _w(*_FLAT, _MIX, _resolve("train"), _BOUNDS, _WIN) + """select b.source,
  coalesce(w.seqs, 0)::bigint as seqs, coalesce(round(w.seqs / sum(w.seqs) over (), 6), 0.0) as share,
  round(b.p, 6) as weight
from bounds b left join (select source, count(*) as seqs from win group by source) w using (source)"""

_SQL["g6_sft_lr_schedule"] = _w(*_CHAT, _ENC, _EX,
                                f"""tot as (select {P.SFT_EPOCHS} * ceil(count(*) / {P.SFT_BATCH}.0)::bigint as total
  from ex2)""") + f"""select step, round({P.SFT_LR}::double * 0.5 * (1.0 + cos(pi() * step / total::double))
  * 1e6, 6) as lr_micro
from (select unnest(range(0, (select total from tot))) as step, (select total from tot) as total) s"""
