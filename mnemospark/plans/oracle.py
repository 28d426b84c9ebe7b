"""SQL for the queries of the catalogue, over the same tables."""

from __future__ import annotations

from ..functions import words
from .fixtures import COMMITS, EVENTS, PAIRS


def q(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(rows, names) -> str:
    return f"(select * from (values {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({names}))"


def listed(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


DEC = """dec as (select d.doc_id id, d.lang project, string_split(d.text, chr(10))[1] what, d.text why, d.source agent,
  timestamp '2024-01-01' + to_minutes(d.doc_id) created_at, case when l.quality = 1 then 1.0 when l.quality = 0 then 0.5 else 0.8 end::double confidence,
  case when l.toxic = 1 then 1 end archived, case when l.quality = 1 then 'human-reviewed' when l.quality = 0 then 'git-hook' end source
  from documents d left join (select doc_id, min(quality) quality, max(toxic) toxic from labels group by 1) l using (doc_id))"""
EFF = "confidence * power(0.5::double, greatest(0, epoch_us(timestamp '2024-06-01') - epoch_us(created_at)) / 8.64e10 / 90)"
ASKED = "asked as (select item_id query_id, p.project, text from benchmark, (values ('en'), ('fr'), ('de'), ('es')) p(project))"


#: White space, and the rule by which words are stemmed, written down here on their own.
BLANK = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
STEM = r"""case when length(w) <= 3 then w
  when regexp_matches(w, '^.{2,}ie[sd]$') then regexp_replace(w, 'ie[sd]$', 'y')
  when regexp_matches(w, 'sses$') then regexp_replace(w, 'es$', '')
  when regexp_matches(w, '^.+(ct|ss|pt)ion$') then regexp_replace(w, 'ion$', '')
  when regexp_matches(w, '^.{3,}ing$') then regexp_replace(w, 'ing$', '')
  when regexp_matches(w, '^.{3,}(ed|ing)ly$') then regexp_replace(w, '(ed|ing)ly$', '')
  when regexp_matches(w, '^.*(.v|ch|sh|th)ed$') and length(w) > 4 then regexp_replace(w, 'd$', '')
  when regexp_matches(w, '^.{2,}[^aeiou]ed$') then regexp_replace(w, 'ed$', '')
  when regexp_matches(w, '^.{3,}ly$') then regexp_replace(w, 'ly$', '')
  when regexp_matches(w, '[^suio]s$') then regexp_replace(w, 's$', '')
  else w end"""


def tokens(name, source, keys, fields) -> str:
    """CTEs that end in `name`: keys, field, token."""
    raw = " union all ".join(f"select {keys}, {q(f)} field, unnest(string_split_regex({f}, '{BLANK}')) w from {source}" for f in fields)
    more = values([(k, x) for k, v in words.RELATED.items() for x in v], "k, v")
    punct = q(words.PUNCTUATION)
    return f"""{name}_raw as ({raw}), {name}_w as (select {keys}, field, lower(trim(w, {punct})) w from {name}_raw),
      {name}_s as (select {keys}, field, {STEM} token from {name}_w where length(w) > 2 and w not in {listed(words.STOP)}),
      {name} as (select distinct {keys}, field, token from {name}_s union select {keys}, field, v from {name}_s join {more} r on r.k = token)"""


IDF = """idf as (select project, token, count(distinct id) df, ln((any_value(n) + 1) / (count(distinct id) + 1)) + 1 idf from terms join (select project, count(*) n from live group by 1) using (project) group by 1, 2)"""
HITS = f"""{tokens('qt', 'asked', 'query_id, project', ['text'])},
  qw as (select query_id, project, token, coalesce(idf, 1) w from qt left join idf using (project, token)),
  total as (select query_id, project, sum(w) total from qw group by 1, 2),
  flags as (select project, id, token, max(case when field = 'what' then 1 else 0 end) in_what from terms group by 1, 2, 3),
  hits as (select query_id, project, id, sum(w) hit, sum(w * in_what) hit_what from flags join qw using (project, token) group by 1, 2, 3)"""
META = f"""meta as (select *, {EFF} eff, coalesce((row_number() over (partition by project order by created_at, id) - 1) / nullif(count(*) over (partition by project) - 1, 0), 0) * 0.05 recency from live)"""
SCORED = f"""with {DEC}, live as (select * from dec where archived is null), {ASKED}, {tokens('terms', 'live', 'project, id', ['what', 'why'])}, {IDF}, {HITS}, {META},
  scored as (select query_id, h.project, h.id, created_at, hit / total base, hit / total + 0.25 * hit_what / total + recency + 0.05 * (eff - 1) score
    from hits h join total using (query_id, project) join meta m on m.id = h.id and m.project = h.project)"""
ORDER = "round(score, 9) desc, created_at desc, id"
PAIR = values(PAIRS, "project, id, seq, what, why")
GT = f"list_distinct(list_transform(list_filter(string_split_regex(lower(what), '{BLANK}'), lambda w: length(w) > 2 and w not in {listed(words.GUARD_STOP)}), lambda w: trim(w, '.,!?')))"
FUZZY = f"""gt as (select project, id, seq, {GT} t from short), pairs as (select a.project, a.id, b.id other, b.seq, len(list_intersect(a.t, b.t)) c, len(a.t) + len(b.t) u
   from gt a join gt b on a.project = b.project and b.seq < a.seq where len(a.t) > 0 and len(b.t) > 0),
  fuzzy as (select project, id, arg_min(other, seq) other, arg_min(c / (u - c), seq) sim from pairs where c / (u - c) >= 0.45 group by 1, 2)"""
SIDE = lambda x: f"list_filter(list_transform(list_filter(string_split_regex({x}, '{BLANK}'), lambda w: w not in {listed(words.GUARD_STOP)}), lambda w: trim(w, '.,!?')), lambda w: length(w) > 2)"
OPPOSED = f"""marks as (select * from {values(list(enumerate(words.MARKERS)), 'rank, mark')} m),
  sides as (select project, id, seq, rank, {SIDE("split_part(lower(what), mark, 1)")} l, {SIDE("substr(lower(what), strpos(lower(what), mark) + length(mark))")} r from src, marks where contains(lower(what), mark)),
  opp as (select n.project, n.id, arg_min(e.id, e.seq * 10 + e.rank) other from sides n join sides e on n.project = e.project and n.rank = e.rank
    where list_has_any(n.l, e.r) and list_has_any(n.r, e.l) and not (list_has_any(n.l, e.l) and list_has_any(n.r, e.r)) and {{}} group by 1, 2)"""
DENSE = """v as (select vec_id id, embedding::double[] e from embeddings),
  dn as (select q.id query_id, v.id, list_dot_product(v.e, q.e) sim from v, v q where q.id % 20 <= 1),
  dr as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, id) pos from dn),
  dp as (select query_id - query_id % 20 query_id, query_id % 20 part, id, sim, pos from dr)"""
ROUTE = f"""with {DEC}, live as (select * from dec where archived is null), {ASKED}, {tokens('terms', 'live', 'project, id', ['what', 'why'])}, {IDF}, {HITS},
  rel as (select query_id, h.project, h.id, agent, hit / total relevance, hit / total * {EFF} contribution from hits h join total using (query_id, project) join live l on l.id = h.id and l.project = h.project),
  agents as (select query_id, project, agent, sum(contribution) score, count(*) n from rel group by 1, 2, 3),
  best as (select *, row_number() over (partition by query_id, project order by round(score, 9) desc, agent) pos from agents)"""
CUE = "(?i)(^|[^A-Za-z0-9_])(" + "|".join(sorted(words.CUES, key=lambda c: (-len(c), c))) + ")($|[^A-Za-z0-9_])"


def gates(source) -> str:
    ws = "[ \\t\\n\\r\\f\\v]+"
    count = lambda c: f"len(list_filter(string_split_regex({c}, '{ws}'), lambda w: w <> ''))"
    return f"""c0 as (select id, replace(coalesce(message, ''), chr(13) || chr(10), chr(10)) t from {source}),
      c1 as (select id, trim(string_split(t, chr(10))[1]) subject, case when contains(t, chr(10)) then regexp_replace(substr(t, strpos(t, chr(10)) + 1), '^\\s+|\\s+$', '', 'g') else '' end body from c0),
      c2 as (select *, nullif(regexp_extract(subject, '{words.CONVENTIONAL}', 1), '') ctype from c1),
      c3 as (select *, trim(case when ctype is not null then regexp_extract(subject, '{words.CONVENTIONAL}', 2) else subject end) what,
        coalesce(list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda b: array_to_string(list_filter(string_split_regex(b, '{ws}'), lambda w: w <> ''), ' ')), lambda b: b <> '')[1], '') para from c2),
      c4 as (select *, case when para <> '' then para when regexp_matches(what, '{CUE}') then what else '' end why from c3),
      gated as (select *, case when regexp_matches(subject, '{words.MERGE}') or regexp_matches(what, '{words.VERSION}') then 'type_gate'
        when ctype is not null and ctype not in {listed(words.TYPES)} then 'type_gate' when ctype is null and {count('what')} < 5 then 'type_gate'
        when not (regexp_matches(what, '{CUE}') or regexp_matches(body, '{CUE}')) then 'no_cue'
        when {count('what')} < 5 or {count('why')} < 5 then 'too_thin' else 'candidate' end status from c4)"""


HISTORY = "h as (select d.lang project, d.source category, l.quality = 1 ok from labels l join documents d using (doc_id)), c as (select project, category, count(*) n, count(*) filter (where ok) accepted from h group by 1, 2)"
ACTION = "case when n >= 5 and accepted / n <= 0.10 then 'auto_reject' else 'stage' end"


MESSAGES = f"(select * from {values(COMMITS, 'id, message')} m union all select conv_id * 1000 + turn + 1000, text from conversations) c"
#: Vectors of the table beside decisions and passages of the same number.
NEAR = """vd as (select l.project, l.id, e.embedding::double[] e from live l join embeddings e on e.vec_id = l.id),
  vq as (select a.query_id, a.project, e.embedding::double[] e from asked a join embeddings e on e.vec_id = a.query_id),
  near as (select query_id, vd.project, vd.id, list_dot_product(vd.e, vq.e) sim from vq join vd on vd.project = vq.project)"""


def sql() -> dict[str, str]:
    found = {
        "audit_counts": "select event_type kind, count(*) n from events group by 1",
        "audit_tail": "select event_id id, user_id project, event_type kind, props payload from events order by event_id desc limit 50",
        "audit_fails": "select event_id id, user_id project, event_type kind from events where event_type in ('error', 'signup')",
        "imported_events": "select event_id id, user_id project, case when event_type = 'error' then 0 when event_type = 'signup' then null else epoch_us(ts) end created_us from events",
        "resolved_prefixes": """with w as (select item_id::varchar prefix from benchmark union select o_orderkey::varchar from orders),
            m as (select prefix, count(*) n, min(doc_id::varchar) id from w join documents on left(doc_id::varchar, length(prefix)) = prefix group by 1)
            select w.prefix, coalesce(n, 0) found, case when n = 1 then id end id from w left join m on w.prefix = m.prefix""",
        "vague_layouts": """select lang project, count(*) n, count(*) filter (where not contains(line, ',') and not contains(line, '/') and length(trim(line)) < 10) vague
            from (select lang, unnest(string_split(text, chr(10))) line from documents) group by 1""",
        "audit_total": "select count(*) total from events",
        "skip_reason_counts": "select coalesce(json_extract_string(props, '$.k'), 'unknown') reason, count(*) n from events group by 1",
        "policy_tune": f"with {HISTORY} select project, category, {ACTION} as action, n sample_size, round(accepted / n, 6) accept_rate from c",
        "policy_stats": f"with {HISTORY} select project, category, n, accepted, round(accepted / n, 6) accept_rate, {ACTION} as action from c",
        "policy_fixture": f"with {HISTORY} select project, category, {ACTION} as action, n sample_size, round(accepted / n, 6) accept_rate from c union all select 'p' project, * from (values ('dup', 'auto_reject', 6, 0.0::double), ('why', 'stage', 6, 0.833333), ('four', 'stage', 4, 0.0), ('edge', 'auto_reject', 10, 0.1), ('over', 'stage', 11, 0.181818)) t(category, action, sample_size, accept_rate)",
        "source_stats": f"with {DEC} select coalesce(source, 'agent') source, count(*) n, count(*) filter (where confidence >= 1) at_cap from dec where archived is null group by 1",
        "latest_snapshot": "select project, turn, role, n from (select conv_id project, turn, role, length(text) n, row_number() over (partition by conv_id order by turn desc, role desc) k from conversations) where k = 1",
        "hot_tasks_pack": "select project, id, cost, used from (select *, sum(cost) over (partition by project order by id desc) used from (select conv_id project, turn id, greatest(1, length(text) // 4) cost from conversations where role = 'user')) where used <= 500",
        "effective_confidence": f"with {DEC} select id, round_even({EFF}, 6) eff, round(least(1, greatest(0, confidence + 0.25)), 6) reinforced from dec",
        "sweep_archive": f"with {DEC} select id, project, round({EFF}, 6) eff from dec where archived is null and {EFF} < 0.25",
        "tokenize": f"with {DEC}, en as (select * from dec), {tokens('t', 'en', 'id', ['why'])} select id, token from t",
        "document_frequency": f"with {DEC}, live as (select * from dec), {tokens('terms', 'live', 'project, id', ['what', 'why'])}, {IDF} select project, token, df, round(idf, 6) idf from idf",
        "keyword_rank": f"{SCORED} select query_id, project, id, pos, round(base, 6) base, round(score, 6) score from (select *, row_number() over (partition by query_id, project order by {ORDER}) pos from scored) where pos <= 10",
        "warm_pack": f"""{SCORED}, every as (select * from scored union all select a.query_id, m.project, m.id, m.created_at, 0, 0.05 * (eff - 1) from asked a join meta m on a.project = m.project
            where not exists (select 1 from hits h where h.query_id = a.query_id and h.project = m.project and h.id = m.id)),
            p as (select *, row_number() over (partition by query_id, project order by {ORDER}) pos from every),
            c as (select p.*, greatest(1, (length(what) + 1 + length(why)) // 4) cost from p join live l on l.id = p.id and l.project = p.project)
            select query_id, project, id, pos, cost, used from (select *, sum(cost) over (partition by query_id, project order by pos) used from c) where used <= 2500""",
        "recent_rank": f"with {DEC}, live as (select * from dec where archived is null), {META}, s as (select *, recency + 0.05 * (eff - 1) score from meta) select project, id, pos, round(score, 6) score from (select *, row_number() over (partition by project order by {ORDER}) pos from s) where pos <= 5",
        "eval_recall": f"""{SCORED}, ex as (select item_id query_id, min(doc_id) id from benchmark b join documents d on contains(d.text, b.text) group by 1),
            r as (select *, row_number() over (partition by query_id order by round(base, 9) desc, created_at desc, id) pos from scored),
            f as (select ex.query_id, coalesce(pos, 0) pos from ex left join (select * from r where pos <= 10) r using (query_id, id))
            select count(*) n, round(avg(case when pos = 1 then 1.0 else 0 end), 6) recall_1, round(avg(case when pos between 1 and 3 then 1.0 else 0 end), 6) recall_3, round(avg(case when pos > 0 then 1.0::double / pos else 0 end), 6) mrr from f""",
        "eval_by_language": f"""{SCORED}, ex as (select item_id query_id, min(doc_id) id from benchmark b join documents d on contains(d.text, b.text) group by 1),
            r as (select *, row_number() over (partition by query_id order by round(base, 9) desc, created_at desc, id) pos from scored),
            f as (select d.lang category, coalesce(pos, 0) pos from ex join documents d on d.doc_id = ex.id left join (select * from r where pos <= 10) r on r.query_id = ex.query_id and r.id = ex.id)
            select category, count(*) n, round(avg(case when pos = 1 then 1.0 else 0 end), 6) recall_1, round(avg(case when pos between 1 and 3 then 1.0 else 0 end), 6) recall_3, round(avg(case when pos > 0 then 1.0::double / pos else 0 end), 6) mrr from f group by 1""",
        "dense_rank": f"with {DENSE} select query_id, id, pos, round(sim, 6) sim from dp where part = 0",
        "dense_topk": f"with {DENSE} select query_id, id, pos, round(sim, 6) sim from dp where part = 0 and pos <= 10",
        "rrf_fuse": f"""with {DENSE}, f as (select query_id, id, sum(1 / (60 + pos)) score, min(part * 1e9 + pos) first from dp group by 1, 2)
            select query_id, id, round(score, 9) score, row_number() over (partition by query_id order by round(score, 12) desc, first, id) pos from f""",
        "hybrid_pin": f"""with {DENSE}, lead as (select query_id, max(case when pos = 1 then sim end) - max(case when pos = 2 then sim end) >= 0.15 pin from dp where part = 0 group by 1),
            kw as (select query_id, id, pos, pin from dp join lead using (query_id) where part = 0),
            rest as (select *, row_number() over (partition by query_id order by pos) - 1 rk from kw where pos <= 10 and not (pin and pos = 1)),
            rd as (select d.query_id, d.id, row_number() over (partition by d.query_id order by d.pos) - 1 rk from dp d semi join rest using (query_id, id) where d.part = 1),
            fu as (select query_id, rest.id, 1 / (61 + rest.rk) + coalesce(1 / (61 + rd.rk), 0) s, rest.rk from rest left join rd using (query_id, id)),
            o as (select query_id, id, 0 part, 0 k from kw where pin and pos = 1 union all select query_id, id, 1, row_number() over (partition by query_id order by round(s, 12) desc, rk) from fu
              union all select query_id, id, 2, pos from kw where pos > 10)
            select query_id, id, row_number() over (partition by query_id order by part, k) pos from o""",
        "exact_dups": f"with {DEC}, k as (select project, id, translate(trim(what), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from dec) select project, id, other from (select project, id, first_value(id) over (partition by project, k order by id) other from k) where other <> id",
        "fuzzy_dups": f"with {DEC}, short as (select project, id, id seq, what from dec), {FUZZY} select project, id, other, round(sim, 6) sim from fuzzy",
        "contradictions": f"with {DEC}, src as (select * from {PAIR} p union all select project, id + 1000000000000, id + 1000000000000, what, why from dec), {OPPOSED.format('n.id >= 100 and (e.id < 100 or e.id >= 1000000000000)')} select project, id, other from opp",
        "guard_reasons": f"""with {DEC}, short as (select project, id, id seq, what, why from dec union all select project, id + 1000000000000, seq + 1000000000000, what, why from {PAIR} p), src as (select * from short),
            k as (select project, id, first_value(id) over (partition by project, translate(trim(what), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') order by seq) f from short),
            {FUZZY}, {OPPOSED.format('e.seq < n.seq')}
            select s.project, s.id, case when trim(what) = '' then 'Missing required field' when len(list_filter(string_split_regex(what, '{BLANK}'), lambda w: w <> '')) < 5 then 'Too vague'
              when k.f <> s.id then 'Exact duplicate' when o.id is not null then 'Contradicts existing decision' when f.id is not null then 'Too similar to existing decision'
              when trim(why) = '' then 'Missing ''why'' field' else 'ok' end reason
            from short s join k on k.id = s.id and k.project = s.project left join opp o on o.id = s.id and o.project = s.project left join fuzzy f on f.id = s.id and f.project = s.project""",
        "provenance": """select o.o_orderkey id, o.o_orderpriority what, p.o_orderpriority superseded_what, coalesce(n, 0) n_dead, coalesce(tried, '') tried from orders o left join orders p on p.o_orderkey = o.o_orderkey - 1
            left join (select l_orderkey, count(*) n, string_agg(l_linenumber || '/' || l_returnflag || '/' || l_linestatus, ',' order by l_shipdate, l_linenumber, l_returnflag, l_linestatus) tried from lineitem group by 1) l on l.l_orderkey = o.o_orderkey""",
        "handoff_delta": "select o_custkey project, o_orderkey id, o_orderstatus status from orders o left join (select o_custkey, max(o_orderdate) since from orders where o_orderstatus = 'P' group by 1) using (o_custkey) where o_orderstatus <> 'P' and (since is null or o_orderdate > since)",
        "latest_handoff": "select project, id, status from (select o_custkey project, o_orderkey id, o_orderstatus status, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) k from orders) where k = 1",
        "route_task": f"{ROUTE} select query_id, project, agent, pos, n, round(score, 6) score from best where pos <= 3",
        "route_evidence": f"""{ROUTE}, e as (select r.*, row_number() over (partition by r.query_id, r.project, r.agent order by round_even(contribution, 4) desc, r.id) nth from rel r join best b on b.query_id = r.query_id and b.project = r.project and b.agent = r.agent and b.pos <= 3)
            select query_id, project, agent, id, nth, round_even(contribution, 4) relevance from e where nth <= 3""",
        "extract_gates": f"with {gates(MESSAGES)} select id, subject, ctype, status, what, why from gated",
        "extract_conversations": f"with {gates('(select conv_id id, text message from conversations) c')} select status, count(*) n from gated group by 1",
        "calibrate": f"""with {gates(MESSAGES)}, t as (select count(*) total, count(*) filter (where status = 'candidate') passed, count(*) filter (where status = 'type_gate') type_gate,
            count(*) filter (where status = 'no_cue') no_cue, count(*) filter (where status = 'too_thin') too_thin from gated)
            select *, round(passed / total, 6) pass_rate, case when passed / total > 0.4 then 'TOO_BROAD' when passed / total >= 0.15 then 'OK' else 'TOO_NARROW' end verdict from t""",
        "supersede_view": f"""with l as (select * from {values(EVENTS, 'id, seq, op, what, supersedes_id, archived')} e union all
              select 'e' || event_id % 500, event_id + 1000, case when event_type = 'error' then 'delete' else 'insert' end, event_type, 'e' || (event_id * 7) % 500, false from events), n as (select * from (select *, row_number() over (partition by id order by seq desc) k from l) where k = 1 and op <> 'delete')
            select id, seq, what, case when supersedes_id in (select id from n) then supersedes_id end supersedes_id, archived from n""",
        "reason_categories": "select substr(trim(string_split_regex(text, '[:—(]')[1]), 1, 80) category, count(*) n from conversations group by 1",
        "token_costs": f"select doc_id, greatest(1, length(text) // 4) cost, len(list_filter(string_split_regex(text, '{BLANK}'), lambda w: w <> '')) n_words from documents",
        "unit_vectors": "select vec_id id, round(list_dot_product(embedding::double[], embedding::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-9), 6) norm from embeddings",
        "labelled_recall": f"""with live as (select doc_id id, 'set' project, string_split(text, chr(10))[1] what, text why from documents), asked as (select item_id query_id, 'set' project, text from benchmark),
            {tokens('terms', 'live', 'project, id', ['what', 'why'])}, {IDF}, {HITS}, s as (select query_id, id, round(hit / total, 9) score from hits join total using (query_id, project)),
            ex as (select item_id query_id, min(doc_id) id from benchmark b join documents d on contains(d.text, b.text) group by 1),
            a as (select ex.query_id, ex.id own, d.doc_id id, coalesce(s.score, 0) score from ex join documents d on true left join s on s.query_id = ex.query_id and s.id = d.doc_id),
            r as (select *, row_number() over (partition by query_id order by score desc, id) pos from a)
            select query_id, r.id, d.lang category, pos::int pos from r join documents d on d.doc_id = r.id where r.id = own""",
        "hybrid_read": f"""{SCORED}, {NEAR}, k as (select query_id || '/' || project qp, id, base, row_number() over (partition by query_id, project order by {ORDER}) pos from scored),
            dn as (select query_id || '/' || project qp, id, row_number() over (partition by query_id, project order by round(sim, 9) desc, id) pos from near),
            lead as (select qp, count(*) <= 1 or max(case when pos = 1 then base end) - max(case when pos = 2 then base end) >= 0.15 pin from k group by 1),
            kw as (select k.*, pin from k join lead using (qp)),
            rest as (select *, row_number() over (partition by qp order by pos) - 1 rk from kw where pos <= 10 and not (pin and pos = 1)),
            rd as (select d.qp, d.id, row_number() over (partition by d.qp order by d.pos) - 1 rk from dn d semi join rest using (qp, id)),
            fu as (select qp, rest.id, 1 / (61 + rest.rk) + coalesce(1 / (61 + rd.rk), 0) s, rest.rk from rest left join rd using (qp, id)),
            o as (select qp, id, 0 part, 0 k from kw where pin and pos = 1 union all select qp, id, 1, row_number() over (partition by qp order by round(s, 12) desc, rk) from fu union all select qp, id, 2, pos from kw where pos > 10)
            select * from (select qp query_id, id, row_number() over (partition by qp order by part, k) pos from o) where pos <= 10""",
        "route_vectors": f"""with {DEC}, live as (select * from dec where archived is null), {ASKED}, {tokens('terms', 'live', 'project, id', ['what', 'why'])}, {IDF}, {HITS}, {NEAR},
            told as (select distinct query_id, project from qt), r1 as (select query_id, project, id, hit / total rel from hits join total using (query_id, project) union all select query_id, project, id, greatest(0, sim) from near semi join told using (query_id, project)),
            rel as (select query_id, project, id, sum(rel) rel from r1 group by 1, 2, 3), c as (select query_id, r.project, agent, rel * {EFF} contribution from rel r join live l on l.id = r.id and l.project = r.project where rel > 0),
            agents as (select query_id, project, agent, sum(contribution) score, count(*) n from c group by 1, 2, 3)
            select query_id, project, agent, pos, n, round(score, 6) score from (select *, row_number() over (partition by query_id, project order by round(score, 9) desc, agent) pos from agents) where pos <= 3""",
        "dense_contradictions": f"""with {DEC}, sv as (select d.*, e.embedding::double[] e, {' or '.join(f"contains(lower(what), {q(c)})" for c in words.REPLACED)} cue from dec d join embeddings e on e.vec_id = d.id),
            {tokens('ot', 'sv', 'project, id', ['what'])}, tl as (select project, id, list(distinct token) t from ot group by 1, 2)
            select n.project, n.id, min(e.id) other from sv n join sv e on n.project = e.project and e.id < n.id and (n.cue or e.cue) and list_dot_product(n.e, e.e) >= 0.25
              join tl a on a.id = n.id and a.project = n.project join tl b on b.id = e.id and b.project = e.project where list_has_any(a.t, b.t) group by 1, 2""",
        "staging_preview": """select conv_id || '/' || turn id, substr(conv_id || '/' || turn, 1, 8) short_id, conv_id project, case when role = 'user' then 'open_task' else 'snapshot' end type, 'Too vague' reason,
            substr(coalesce(nullif(text, ''), '(no preview)'), 1, 80) preview from conversations""",
        "staging_list": "select user_id project, event_id id, row_number() over (partition by user_id order by ts, event_id) nth from events where event_type = 'error'",
    }
    return found
