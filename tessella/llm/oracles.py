"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SUBSTRING = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i : i + 34], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35)),
dup as (select s from win group by s having count(*) > 1),
hit as (select distinct doc_id, i + k as p from win join dup using (s), range(0, 35) r(k)),
gone as (select doc_id, list(p) as ps from hit group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(array_to_string([x for x, i in ws if ps is null or not list_contains(ps, i)], ' ')) as kept_sha256
from w left join gone using (doc_id)
"""

WARC = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as d from pages),
m as (select page_id, h, d, max(page_id) over (partition by h) as top from p),
b as (select *, [('0x' || substr(d, 1 + 10 * k, 10))::bigint for k in [0, 1, 2, 3]] as parts from m)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> (35 - 5 * j)) & 31)::int, 1) for j in [0, 1, 2, 3, 4, 5, 6, 7]] for x in parts]), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from b
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
bw as (select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[i : i + 12], ' ') as s from (select item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) as i from b where len(ws) > 0)),
dw as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as s from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from bw) where len(ws) >= n)),
hit as (select doc_id, dw.n, i, item_id from dw join bw using (n, s)),
covered as (select doc_id, count(distinct i + k) as n_hit from hit, range(0, 13) r(k) where k < n group by doc_id),
items as (select doc_id, list(distinct item_id::varchar order by item_id::varchar) as xs from hit group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(xs), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(xs, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

#: Runs grow by one line in each step of the recursion, so longest_run has no bound.
LINES = r"""
with recursive l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls, text is null as missing from documents),
f as (select doc_id, [i for i in range(1, len(ls) + 1) if regexp_matches(ls[i], '[^ \t\n\x0B\f\r]')] as spots, ls from l),
q as (select doc_id, i, spots[i] as spot, ls[spots[i]] as x from (select doc_id, spots, ls, unnest(range(1, len(spots) + 1)) as i from f)),
run as (
  select 1 as n, doc_id, i, top from (select doc_id, i, min((doc_id, i)) over (partition by x) as top, count(*) over (partition by x) as c from q) where c > 1
  union all
  select n, doc_id, i, top from (
    select run.n + 1 as n, run.doc_id, run.i, min((run.doc_id, run.i)) over (partition by run.top, q.x) as top, count(*) over (partition by run.top, q.x) as c
    from run join q on q.doc_id = run.doc_id and q.i = run.i + run.n) where c > 1),
deep as (select doc_id, max(n) as longest from run where n >= 2 group by doc_id),
passage as (select doc_id, i, min((doc_id, i)) over (partition by x) as top from q where len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+')) >= 50),
spots as (select doc_id, i + k as i from run, range(0, 2) r(k) where n = 2 and (doc_id, i) <> top union select doc_id, i from passage where (doc_id, i) <> top),
gone as (select doc_id, list(spot) as ps from spots join q using (doc_id, i) group by doc_id)
select doc_id, case when missing then 0 else len(ls) end::bigint as n_lines, coalesce(len(ps), 0)::bigint as n_removed, coalesce(longest, 0)::bigint as longest_run,
  sha256(array_to_string([x for x, i in ls if ps is null or not list_contains(ps, i)], chr(10))) as kept_sha256
from l left join gone using (doc_id) left join deep using (doc_id)
"""

FILL_MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select *, len(u) as n, [('0x' || substr(x, 1 + 8 * i, 8))::bigint for i in [0, 1, 2, 3]] as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[1 : a], '') as p, array_to_string(u[a + 1 : b], '') as m, array_to_string(u[b + 1 : n], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""

NEAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, x from (select doc_id, unnest(case when len(ws) between 1 and 2 then [array_to_string(ws, ' ')] else [array_to_string(ws[i : i + 2], ' ') for i in range(1, len(ws) - 1)] end) as x from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select p.doc_id as a, q.doc_id as b, count(*) as i from s p join s q on p.x = q.x and p.doc_id <> q.doc_id group by all),
link as (select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * i >= 85 * (p.n + q.n - i)),
reach as (select doc_id as node, doc_id as found from documents union select node, b from reach join link on a = found)
select doc_id, coalesce(n, 0)::bigint as n_shingles, min(found) as component_id, doc_id = min(found) as kept
from documents left join n using (doc_id) join reach on node = doc_id group by doc_id, n
"""

def _edit(state: str, letter: str, cost: str, turn: str | None, when: str = "true") -> str:
    """An edit before what follows in a state; null where it is not allowed."""
    text = f"list_prepend({turn}, {state}.t)" if turn else f"{state}.t"
    return f"case when {when} then {{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 't': {text}}} end"


def _repair() -> str:
    """Damage by CRC-32, bit by bit; then the cheapest edits of each conversation from its last turn to its first: e, s, u and a
    are the best ways to finish where nothing, a system, a user or an assistant turn stands before."""
    keep, plain = "role || ':' || text", "fault not in (1, 2)"
    more = "(case fault when 3 then 3 else 0 end)"

    def turn(state: str, kept: dict[str, str], again: str) -> str:
        role = {"u": "user", "a": "assistant"}[again]
        found = [_edit(state, "D", "4", None), *(_edit(to, "K", more, keep, f"{plain} and initial = '{i}'") for i, to in kept.items()), _edit(again, "R", f"3 + {more}", f"'{role}:' || text", plain)]
        return f"list_min([x for x in [{', '.join(found)}] if x is not null]) as w{state}"

    def put(*states: str) -> str:
        """Inserted turns that lead through the states, the last one's best way after them."""
        role = {"u": "'user:'", "a": "'assistant:'"}
        texts = f"list_concat([{', '.join(role[x] for x in states)}], w{states[-1]}.t)"
        return f"{{'c': w{states[-1]}.c + {3 * len(states)}, 'a': '{'I' * len(states)}' || w{states[-1]}.a, 't': {texts}}}"

    before = {"e": [put("u"), put("u", "a")], "s": [put("u"), put("u", "a")], "u": [put("a")], "a": [put("u")]}
    closed = ", ".join(f"list_min([w{x}, {', '.join(p)}]) as {x}" for x, p in before.items())
    turns = ", ".join([turn("e", {"s": "s", "u": "u"}, "u"), turn("s", {"u": "u"}, "u"), turn("u", {"a": "a"}, "a"), turn("a", {"u": "u"}, "u")])
    return rf"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
h as (select *, xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten([[ord(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(k, '')])),
  lambda c, o: case when o >= 0 then xor(c, o) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) % 20 as d from raw),
damaged as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when d = 3 then [1, 2] else [1] end) as copy from h where d <> 0),
placed as (select *, left(role, 1) as initial, regexp_replace(text, '[ 	
]+$', '') as told, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from damaged),
f as (select *, lag(initial) over (partition by conv_id order by i) || initial as pair, case when told = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(told, 1) not in ('.', '!', '?') then 3 else 0 end as fault from placed),
walk as (
  select conv_id, max(i) + 1 as i, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}} as e, {{'c': 6::bigint, 'a': 'II', 't': ['user:', 'assistant:']}} as s, {{'c': 3::bigint, 'a': 'I', 't': ['assistant:']}} as u, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}} as a from f group by conv_id
  union all
  select conv_id, i, {closed} from (select f.conv_id, f.i, {turns} from walk join f on f.conv_id is not distinct from walk.conv_id and f.i = walk.i - 1)),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
  count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select r.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) r left join counts c on c.conv_id is not distinct from r.conv_id left join walk w on w.conv_id is not distinct from r.conv_id and w.i = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING, "op6_warc": WARC, "op7_decontaminate": DECONTAMINATE, "op9_line_dedup": LINES, "op11_minhash": NEAR, "op12_conversations": _repair(), "op13_fill_middle": FILL_MIDDLE}
