"""DuckDB SQL of the queries that SQL can express over whole tables: op1, op2, op4, op7 and op8."""

from __future__ import annotations

from . import quality_rules as rules


def row_text(*columns: str) -> str:
    """What util.row_key hashes of a row."""
    return " || ".join(f"case when {c} is null then 'n' else length({c}::varchar) || ':' || {c}::varchar end" for c in columns)


def op1() -> str:
    counts, signals, units = rules.COUNTS, rules.SIGNALS, rules.SIZES
    bucket = lambda v: f"(case when {v} < 32 then {v} else (length(bin({v})) - 5) * 16 + {v} // (1::bigint << (length(bin({v})) - 5)::bigint) end)"
    top = "case when b < 32 then b else (b - ((b - 16) // 16) * 16 + 1) * (1::bigint << ((b - 16) // 16)::bigint) - 1 end"
    rate = lambda k: f"case when {signals[k][1]} > 0 then {signals[k][0]} * 1000 // {signals[k][1]} else 0 end"
    rows = " union all ".join([f"select lk, sk, '{k}' as signal, {bucket('(' + rate(k) + ')')} as b from c" for k in signals] + [f"select lk, sk, '{k}', {bucket(k)} from c" for k in units])

    def quartiles(keys: str) -> str:
        by = f"{keys}, signal" if keys else "signal"
        run = f"select {by}, {top} as v, sum(n) over (partition by {by} order by b) as below, sum(n) over (partition by {by}) as total from (select {by}, b, count(*) as n from rows group by {by}, b)"
        q = ", ".join(f"min(case when below * 4 >= total * {i} then v end) as q{i}" for i in (1, 2, 3))
        return f"select {by}, {q}, max(total) as docs from ({run}) group by {by}"

    mixed = lambda a, b, i: f"(({a}.docs * {a}.q{i} + {rules.PRIOR} * {b}.q{i}) // ({a}.docs + {rules.PRIOR}))::bigint as q{i}"
    blend = ", ".join(mixed("l", "w", i) for i in (1, 2, 3)), ", ".join(mixed("g", "m", i) for i in (1, 2, 3))
    ok = lambda k: (
        f"{signals[k][0]} <= ({k}.q3 + {rules.SPREADS} * ({k}.q3 - {k}.q1)) * {signals[k][1]} // 1000 + {rules.SPREADS * signals[k][2]} * greatest({signals[k][1]}, greatest({signals[k][1]}_.q2, 1)) // greatest({signals[k][1]}_.q2, 1)"
    )
    joins = " ".join(f"join f as {k} on {k}.lk = c.lk and {k}.sk = c.sk and {k}.signal = '{k}'" for k in signals) + " " + " ".join(f"join f as {k}_ on {k}_.lk = c.lk and {k}_.sk = c.sk and {k}_.signal = '{k}'" for k in units)
    return rf"""with t as (select doc_id, coalesce(text, '') as text, case when lang is null then 'n' else 'v' || lang end as lk, case when source is null then 'n' else 'v' || source end as sk from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
e as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
v as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from e) where n > 1),
p as (select doc_id, count(distinct i + k)::bigint as n from v, range(0, 8) as r(k) group by doc_id),
c as (select w.doc_id, lk, sk, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint as n_adjacent, (length(text) - length(replace(text, '!', '')))::bigint as n_bangs, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_upper
  from w left join p on p.doc_id = w.doc_id),
rows as ({rows}), whole as ({quartiles('')}), langs as ({quartiles('lk')}), narrow as ({quartiles('lk, sk')}),
mid as (select l.lk, l.signal, {blend[0]} from langs l join whole w on w.signal = l.signal),
f as (select g.lk, g.sk, g.signal, {blend[1]} from narrow g join mid m on m.lk = g.lk and m.signal = g.signal)
select doc_id, {', '.join(counts[:5])}, base_failed, not base_failed and good as kept from (
  select c.*, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {' and '.join(ok(k) for k in signals)} as good from c {joins})"""


def op2(shares: dict[str, int], block_rows: int = 64) -> str:
    """Every frame's slots one after the other, all frames at once."""
    share = " ".join(f"when src = 'v{k}' then {v}" for k, v in shares.items())
    return f"""with recursive
d as (select doc_id, source, case when source is null then 'n' else 'v' || source end as src, sha256({row_text('doc_id', 'source')}) as key from documents),
r as (select *, row_number() over (partition by src order by key) - 1 as rank from d),
s as (select src, share, n, row_number() over (order by src) as x from (select src, case {share} else 1 end as share, (count(*) + {block_rows - 1}) // {block_rows} as n from d group by src)),
f as (select frame, list(greatest(0, least(share, n - share * frame)) order by x) as k, list(share order by x) as shares, list(src order by x) as srcs, sum(least(n, share * frame))::bigint as start
  from s, (select unnest(range(0, (select max((n + share - 1) // share) from s))) as frame) group by frame),
run(frame, t, picked, nxt) as (
  select frame, -1::bigint, null::bigint, list_transform(k, lambda v: 0::bigint) from f
  union all
  select frame, t, p.x, list_transform(nxt, lambda v, i: v + case when i = p.x then 1 else 0 end) from (
    select run.frame, run.t + 1 as t, nxt, list_sort(list_filter(list_transform(range(1, len(k) + 1), lambda x: case when nxt[x] < k[x] and (list_sum(k) * nxt[x]) // k[x] <= run.t + 1
      then {{'d': (list_sum(k) * (nxt[x] + 1) + k[x] - 1) // k[x], 'x': x}} end), lambda z: z is not null))[1] as p
    from run join f on f.frame = run.frame where run.t + 1 < list_sum(k))),
b as (select srcs[picked] as src, shares[picked] * f.frame + nxt[picked] - 1 as block, start + t as slot, start + (list_sum(k) * (nxt[picked] - 1)) // k[picked] as release,
  start + (list_sum(k) * nxt[picked] + k[picked] - 1) // k[picked] as deadline from run join f on f.frame = run.frame where t >= 0)
select doc_id, source, r.rank // {block_rows} as block, r.rank % {block_rows} as place, slot::bigint as slot, release::bigint as release, deadline::bigint as deadline
from r join b on b.src = r.src and b.block = r.rank // {block_rows}"""


#: CRC-32 of the bytes of a text: its table of 256 numbers, and the fold over the bytes (polynomial 0xEDB88320).
CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint))"
CRC_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)"
CRC = "xor(list_reduce(bytes, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint)"


def op8(shards: int = 8, vnodes: int = 64) -> str:
    """The ring walked arc by arc."""
    n = shards * vnodes
    owner = "(select list(shard order by arc) from ring)"
    put = "least(room[o], queued)"
    return f"""with recursive
ring as (select shard, pt, row_number() over (order by pt) as arc from (select s as shard, ('0x' || left(md5('shard-' || s || '#' || v), 13))::bigint as pt from range(0, {shards}) a(s), range(0, {vnodes}) b(v))),
d as (select doc_id, (len(bytes) + 1)::bigint as size, {CRC} as text_crc32 from (select doc_id, {CRC_BYTES} as bytes from documents), (select {CRC_TABLE} as tab)),
h as (select *, ('0x' || left(md5(coalesce(doc_id::varchar, chr(0) || 'null')), 13))::bigint as pt, sha256({row_text('doc_id', 'size', 'text_crc32')}) as key from d),
a as (select h.*, coalesce(ring.arc, 1) as arc from h asof left join ring on h.pt <= ring.pt),
r as (select *, row_number() over (partition by arc order by key) - 1 as rank from a),
c as (select ring.arc, ring.shard, count(a.arc) as n from ring left join a on a.arc = ring.arc group by ring.arc, ring.shard),
cap as (select list(total // {shards} + case when j < total % {shards} then 1 else 0 end order by j) as room from (select count(*) as total from d), range(0, {shards}) s(j)),
own as (select *, coalesce(sum(n) over (partition by shard order by arc rows between unbounded preceding and 1 preceding), 0) as past from c),
home as (select arc, shard, n, least(past, room[shard + 1]) as base, least(past + n, room[shard + 1]) - least(past, room[shard + 1]) as taken from own, cap),
o as (select *, coalesce(sum(n - taken) over (order by arc rows between unbounded preceding and 1 preceding), 0) as over from home),
left_ as (select list(room - used order by shard) as room, list(used order by shard) as used from (select shard, sum(taken) as used, any_value(cap.room[shard + 1]) as room from home, cap group by shard)),
lists as (select (select list(n - taken order by arc) from home) as spare, {owner} as owners),
walk(e, room, used, queued, placed, pt, len, shard, base) as (
  select 0::bigint, room::bigint[], used::bigint[], 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from left_
  union all
  select e + 1, list_transform(room, lambda v, i: (v - case when i = o then {put} else 0 end)::bigint), list_transform(used, lambda v, i: (v + case when i = o then {put} else 0 end)::bigint),
    (queued - {put} + case when e < {n} then spare[e + 1] else 0 end)::bigint, (placed + {put})::bigint, placed, {put}::bigint, o - 1, used[o]::bigint
  from (select walk.*, spare, owners[(e % {n}) + 1] + 1 as o from walk, lists where e < {2 * n}))
select doc_id, size, text_crc32, 'rows' as law, coalesce(w.shard, o.shard)::int as shard, (case when r.rank < o.taken then o.base + r.rank else w.base + o.over + r.rank - o.taken - w.pt end)::bigint as slot, null::int as grown_shard
from r join o on o.arc = r.arc left join (select * from walk where len > 0) w on r.rank >= o.taken and o.over + r.rank - o.taken >= w.pt and o.over + r.rank - o.taken < w.pt + w.len"""


def op4(width: int = 50) -> str:
    """All windows of all texts, grouped."""
    return f"""with d as (select doc_id, encode(coalesce(text, '')) as x from documents),
n as (select *, octet_length(x) as n from d),
w as (select doc_id, i, x[i + 1 : i + {width}] as w from (select doc_id, x, unnest(range(0, n - {width - 1})) as i from n where n >= {width})),
g as (select w, min(doc_id) as first from w group by w having min(doc_id) < max(doc_id)),
gone as (select doc_id, i from w join g using (w) where doc_id > first),
runs as (select *, sum(case when i > before + {width} then 1 else 0 end) over (partition by doc_id order by i) as run from (select *, lag(i) over (partition by doc_id order by i) as before from gone)),
spans as (select doc_id, min(i) as lo, max(i) + {width} as hi from runs group by doc_id, run),
listed as (select doc_id, list(lo order by lo) as lo, list(hi order by lo) as hi from spans group by doc_id)
select n.doc_id, n::bigint as n_bytes, coalesce(list_sum(hi) - list_sum(lo), 0)::bigint as n_removed, coalesce(len(lo), 0)::bigint as n_spans,
  sha256(case when lo is null then x else unhex(list_aggregate(list_transform(list_zip(list_concat([0::bigint], hi), list_concat(lo, [n])), lambda p: hex(x[p[1] + 1 : p[2]])), 'string_agg', '')) end) as kept_sha256
from n left join listed using (doc_id)"""


def op7(percent: int = 80) -> str:
    """All pairs that share a shingle of two words, and what is reachable by links."""
    return rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from w),
s as (select doc_id, len(s) as n, unnest(s) as s from l),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as m, any_value(b.n) as n, count(*) as common from s a join s b on a.s = b.s and a.doc_id < b.doc_id and 100 * a.n >= {percent} * b.n and 100 * b.n >= {percent} * a.n group by a.doc_id, b.doc_id),
e as (select a, b from p where 100 * common >= {percent} * (m + n - common)),
both_ways as (select a, b from e union all select b, a from e),
reach(a, b) as (select a, b from both_ways union select reach.a, x.b from reach join both_ways x on x.a = reach.b)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(c, doc_id)) as component_id, doc_id <= coalesce(c, doc_id) as kept
from l left join (select a, min(b) as c from reach group by a) r on r.a = doc_id"""
