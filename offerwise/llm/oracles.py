"""Oracle SQL (DuckDB) of the queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWER = "'abcdefghijklmnopqrstuvwxyz'"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line,
             unnest(range(len(string_split(text, chr(10))))) as i from d),
k as (select *, translate(trim(line, {STRIP}), {UPPER}, {LOWER}) as key from l),
f as (select key from k where key <> '' group by key having count(distinct r) >= 10)
select doc_id, count(*) as n_lines,
       count(*) filter (where key in (select key from f)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i)
              filter (where key not in (select key from f)), '')) as kept_sha256
from k group by r, doc_id
"""

WORD10 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP10 = f"""
with d as (select row_number() over () as r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {WORD10}) as w
           from documents),
i as (select item_id, regexp_extract_all(translate(text, {UPPER}, {LOWER}), {WORD10}) as w
      from benchmark where text is not null),
iw as (select distinct item_id, least(13, len(w)) as n, w[s + 1 : s + least(13, len(w))] as win
       from (select item_id, w, unnest(range(greatest(0, len(w) - least(13, len(w)) + 1))) as s
             from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select r, s, n, w[s + 1 : s + n] as win from
        (select r, w, n, unnest(range(greatest(0, len(w) - n + 1))) as s from d, sizes)),
m as (select r, s, dw.n, item_id from dw join iw on dw.n = iw.n and dw.win = iw.win),
h as (select r, count(distinct p) as n_hit
      from (select r, unnest(range(s, s + n)) as p from m) group by r),
t as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
      from (select distinct r, item_id::varchar as item_id from m) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join t using (r)
"""

OP9 = f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}),
                                    '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then w else w[i + 1 : i + 5] end as g
      from (select doc_id, w, unnest(range(greatest(1, len(w) - 4))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
m as (select a.doc_id as a, b.doc_id as b, count(*) as met
      from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from m join n x on x.doc_id = a join n y on y.doc_id = b
          where 100 * met >= 85 * (x.n + y.n - met)),
reach as (select doc_id as a, doc_id as b from d
          union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id,
       doc_id = component_id as kept
from c left join n using (doc_id)
"""

OP2 = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
r as (select *, case when payload_bytes >= 100
                     then min(page_id) over (partition by payload_digest) end as original from q)
select page_id, payload_bytes, payload_digest,
       case when original is null or original is not distinct from page_id
            then 'response' else 'revisit' end as record_type,
       case when original is distinct from page_id then original end as refers_to
from r
"""

# the table of CRC-32, and the checksum of an ASCII string by it
CRC_TABLE = """bits(k, i, c) as (select k, 0, k from range(256) r(k) union all
  select k, i + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where i < 8),
crc as (select list(c order by k) as t from bits where i = 8)"""


def crc32(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::bigint)"
    step = "xor(c >> 8, t[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: {step}), 4294967295)"


def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


# dear enough to stand for a state that no edits reach
FAR = "{'c': 1000000000, 'a': ''}"


def _follow(initial: str, state: str) -> str:
    """Keep or change the next row to the role with this initial."""
    return f"""case when gone then {FAR} when initial = '{initial}' then {_edit(state, 'cut', 'K')}
      else {_edit(state, '2 + cut', 'R')} end"""


OP11 = f"""
with recursive {CRC_TABLE},
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
fated as (select conv_id, turn, role, text, {crc32("key")} % 20 as fate from keyed, crc),
hurt as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when fate = 3 then 2 else 1 end)) as copy from fated where fate <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from hurt),
again as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as repeated,
    trim(text, {STRIP}) as bare from placed),
judged as (select *, bare = '' as blank, bare <> '' and repeated as duplicate,
    bare <> '' and not repeated and right(bare, 1) not in ('.', '!', '?') as truncated,
    left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as before from again),
rows_ as (select *, blank or duplicate as gone, truncated::bigint as cut from judged),
start as (select distinct conv_id, {{'c': 0::bigint, 'a': ''}} as x from conversations),
walk(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, x, {FAR}, {_edit("x", "2", "I")}, {_edit("x", "4", "II")} from start
  union all
  select conv_id, i, n0, n1, m2, {_least("n3", _edit("m2", "2", "I"))} from (
    select *, {_least("n2", _edit("n0", "2", "I"), _edit("n1", "2", "I"), _edit("n3", "2", "I"))} as m2 from (
      select w.conv_id, r.i, {_edit("s0", "3", "D")} as n0,
        {_least(_edit("s1", "3", "D"), f"case when gone or initial <> 's' then {FAR} else {_edit('s0', 'cut', 'K')} end")} as n1,
        {_least(_edit("s2", "3", "D"), _follow("u", "s0"), _follow("u", "s1"), _follow("u", "s3"))} as n2,
        {_least(_edit("s3", "3", "D"), _follow("a", "s2"))} as n3
      from walk w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1))),
ended as (select conv_id, i, {_least("s0", "s3")} as best from walk
  qualify row_number() over (partition by conv_id order by i desc) = 1),
letters as (select conv_id, best.a as audit, p, substr(best.a, p::int, 1) as op
  from ended, lateral (select unnest(range(1, length(best.a) + 1)) as p)),
counted as (select *, count(*) filter (op <> 'I') over up as i, count(*) filter (op <> 'D') over up as made
  from letters window up as (partition by conv_id order by p)),
told as (select c.*, r.role, r.text,
    max(case when op = 'K' and made = 1 and initial = 's' then 1 else 0 end) over (partition by c.conv_id) as led
  from counted c left join rows_ r on op <> 'I' and r.conv_id is not distinct from c.conv_id and r.i = c.i),
lines as (select conv_id, p, case op when 'K' then role
    else case when (made - led) % 2 = 1 then 'user' else 'assistant' end end || ':' ||
    case op when 'I' then '' else text end as line from told where op <> 'D'),
texts as (select conv_id, string_agg(line, chr(10) order by p) as text from lines group by conv_id),
faults as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
    count(*) filter (truncated) as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from rows_ group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
  sha256(coalesce(t.text, '')) as repaired_sha256
from ended e left join faults f on f.conv_id is not distinct from e.conv_id
  left join texts t on t.conv_id is not distinct from e.conv_id
"""

def _tree(name: str, levels: int) -> str:
    """CTEs of the trees over ``{name}0`` (g, r, d, n: group, rank, digest, nodes of the group):
    a CTE for each level, ``{name}_roots`` (g, d), and ``{name}_sides`` (k, g, r, l, e), the
    digests left and right of each node in its run."""
    out, holds = [], "n > 1"
    for k in range(1, levels + 1):
        out.append(
            f"{name}{k} as (select g, r // 16 as r, sha256(string_agg(d, '' order by r)) as d, (n + 15) // 16 as n "
            f"from {name}{k - 1} where {holds} group by g, r // 16, n)"
        )
    every = " union all ".join(f"select {k} as k, g, r, d, n from {name}{k}" for k in range(levels + 1))
    run = "partition by k, g, r // 16 order by r rows between"
    out.append(f"{name}_all as ({every})")
    out.append(f"{name}_roots as (select g, d from {name}_all where n = 1)")
    out.append(
        f"{name}_sides as (select k, g, r, "
        f"coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') as l, "
        f"coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') as e "
        f"from {name}_all where n > 1)"
    )
    return ",\n".join(out)


def _climb(start: str, name: str, levels: int, group: str, rank: str) -> str:
    """CTEs ``{start}0`` to ``{start}{levels}``: ``proof`` grows and ``x`` is folded level by level."""
    out = []
    for k in range(levels):
        out.append(
            f"{start}{k + 1} as (select a.* exclude (x, proof), a.proof || coalesce(l || e, '') as proof, "
            f"case when s.k is null then x else sha256(l || x || e) end as x "
            f"from {start}{k} a left join {name}_sides s on s.k = {k} and s.g is not distinct from a.{group} "
            f"and s.r = a.{rank} // {16**k})"
        )
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


# trees of up to 16 ** 6 leaves and 16 ** 4 sources
OP12 = f"""
with recursive {CRC_TABLE},
leaves as (select doc_id, source, {_leaf("text")} as leaf,
    case when {crc32("doc_id::varchar")} % 5 = 0 then {_leaf(f"translate(text, {UPPER}, {LOWER})")} end as hurt
  from documents, crc),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r,
    count(*) over (partition by source) as n from leaves),
t0 as (select source as g, r, leaf as d, n from placed),
{_tree("t", 6)},
ranked as (select g as source, d as subroot, row_number() over (order by g nulls first) - 1 as q,
    count(*) over () as n from t_roots),
u0 as (select 0 as g, q as r, subroot as d, n from ranked),
{_tree("u", 4)},
a0 as (select p.doc_id, p.leaf, p.source, p.r, k.subroot, k.q, 0 as one, '' as proof, coalesce(p.hurt, p.leaf) as x
  from placed p join ranked k on k.source is not distinct from p.source),
{_climb("a", "t", 6, "source", "r")},
b0 as (select * from a6),
{_climb("b", "u", 4, "one", "q")}
select doc_id, leaf, subroot, u_roots.d as root, sha256(proof) as proof_sha256, x as folded_root,
  x = u_roots.d as verified
from b4, u_roots
"""

ORACLES = {
    "op2_warc": OP2,
    "op9_minhash": OP9,
    "op5_line_dedup": OP5,
    "op10_decontamination": OP10,
    "op11_conversations": OP11,
    "op12_manifest": OP12,
}
