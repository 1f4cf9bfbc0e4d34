"""SQL of another engine for the corpus queries that it can express, over whole tables."""

from __future__ import annotations

SAID = "<|im_end|><|im_start|>assistant ok"

OP2 = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{SAID}' union all select -1, 1, 'assistant', '{SAID}'
), conv as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
    cast(sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) + length('<|im_end|>') + 1) as bigint) as formatted_chars
  from turns group by conv_id
)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, false as rewrites_history from conv"""

# Bytes as pairs of hexadecimal digits.
OP3 = """
with docs as (select row_number() over () as r, doc_id, octet_length(encode(coalesce(text, ''))) as n, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as h from documents),
places as (select r, doc_id, n, unnest(range(1, len(h) + 1)) as p, unnest(h) as b from docs),
starts as (select r, doc_id, p, b, case when p + 49 <= n then string_agg(b, '') over (partition by r order by p rows between current row and 49 following) end as w from places),
least as (select w, min(doc_id) as first from starts where w is not null group by w),
flagged as (select s.r, s.p, s.b, coalesce(l.first < s.doc_id, false) as f from starts s left join least l on s.w = l.w),
gone as (select r, p, b, max(f) over (partition by r order by p rows between 49 preceding and current row) as g from flagged),
edges as (select r, p, b, g, g and not coalesce(lag(g) over (partition by r order by p), false) as e from gone),
kept as (select r, count(*) filter (g) as n_removed, count(*) filter (e) as n_spans, coalesce(string_agg(b, '' order by p) filter (not g), '') as k from edges group by r)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from docs left join kept using (r)"""

OP5 = """
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
places as (select r, len(w) as n, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from docs),
starts as (select r, p, word, case when p + 34 <= n then string_agg(word, ' ') over (partition by r order by p rows between current row and 34 following) end as run from places),
often as (select run from starts where run is not null group by run having count(*) > 1),
flagged as (select s.r, s.p, s.word, o.run is not null as f from starts s left join often o on s.run = o.run),
gone as (select r, p, word, max(f) over (partition by r order by p rows between 34 preceding and current row) as g from flagged),
kept as (select r, count(*) filter (g) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (not g), '') as k from gone group by r)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from docs left join kept using (r)"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""
with items as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as run
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)
),
sizes as (select distinct n from windows),
docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
starts as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as run from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
runs as (select distinct n, run from windows),
found as (select s.r, s.n, s.i, s.run from starts s join runs u on s.n = u.n and s.run = u.run),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) group by r),
named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, cast(item_id as varchar) as item from (select distinct r, n, run from found) f join windows using (n, run)) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)"""

OP12 = """
with recursive docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as materialized (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))) end as s from docs
),
nodes as materialized (select row_number() over () as k, s, len(s) as n, min(doc_id) as least from sets where len(s) > 0 group by s),
tokens as materialized (select k, n, unnest(s) as t from nodes),
pairs as materialized (select a.k as x, b.k as y from tokens a join tokens b on a.t = b.t and a.k < b.k group by a.k, a.n, b.k, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as materialized (select x, y from pairs union all select y, x from pairs),
reach(k, other) as (select k, k from nodes union select e.x, r.other from reach r join edges e on e.y = r.k),
roots as (select k, min(least) as component_id from (select r.k, n.least from reach r join nodes n on n.k = r.other) group by k)
select doc_id, len(sets.s) as n_shingles, coalesce(component_id, doc_id) as component_id from sets left join nodes on nodes.s = sets.s and len(sets.s) > 0 left join roots using (k)"""

# The orders and the masks of the filters before each step, then every document's count at each step.
OP13 = """
with letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, cast(s as integer) as step, filter_order[s] as x, filter_order[1 : s - 1] as before from orders, range(1, 6) t(s)),
words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
first as (select t, min(doc_id) as first from words group by t),
marks as (select doc_id, max(cast(quality = 1 as integer)) as good, max(cast(toxic = 1 as integer)) as toxic from labels group by doc_id),
fails as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 50 then 'A' else '' end
    || case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when coalesce(first < doc_id, false) then 'E' else '' end as f
  from words left join first using (t) left join marks using (doc_id)
),
sums as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, f),
walked as (
  select part, filter_order, step, x, f, n, good, toxic, contains(f, x) as here, length(translate(f, before, '')) < length(f) as earlier from sums, steps
),
counts as (
  select part, filter_order, step, any_value(x) as x,
    cast(coalesce(sum(n) filter (not here and not earlier), 0) as bigint) as kept,
    cast(coalesce(sum(n) filter (here and not earlier), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (here and earlier), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (f = x), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (here and not earlier), 0) as bigint) as good_lost,
    cast(coalesce(sum(toxic) filter (here and not earlier), 0) as bigint) as toxic_lost
  from walked group by part, filter_order, step
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from counts"""

OP11 = """
with docs as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as materialized (select row_number() over () as q, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from docs)),
places as materialized (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces where len(w) > 0),
phrases as materialized (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, any_value(w[i : i + k - 1]) as w, cast(count(*) as bigint) as a
  from places, (values (1), (2), (3)) s(k) where i + k - 1 <= len(w) group by lang, k, array_to_string(w[i : i + k - 1], ' ')
),
often as materialized (select * from phrases where a >= 10),
sizes as (select lang, cast(sum(a) as bigint) as n from phrases where k = 1 group by lang),
halves as materialized (
  select lang, phrase, k, a, s as c, array_to_string(w[1 : s], ' ') as x, array_to_string(w[s + 1 : k], ' ') as y from (select *, unnest(range(1, k)) as s from often)
),
cuts as (
  select h.lang, h.phrase, h.k, h.a, h.c, x.a as l, y.a as r, cast((1000000 * cast(h.a as hugeint) * h.a) // (cast(x.a as hugeint) * y.a) as bigint) as score
  from halves h join often x on x.lang = h.lang and x.phrase = h.x join often y on y.lang = h.lang and y.phrase = h.y
),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (
  select lang, phrase, max(a) as longer from (
    select lang, a, array_to_string(w[1 : 2], ' ') as phrase from often where k = 3
    union all select lang, a, array_to_string(w[2 : 3], ' ') from often where k = 3
  ) group by lang, phrase
),
kept as (select o.* from lowest o left join inside i on i.lang = o.lang and i.phrase = o.phrase and o.k = 2 where coalesce(100 * longer < 50 * a, true)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000"""

ORACLE = {"op2_chat_formatting": OP2, "op3_suffixes": OP3, "op5_passages": OP5, "op7_decontamination": OP7, "op11_collocations": OP11, "op12_jaccard_join": OP12, "op13_filter_audit": OP13}
