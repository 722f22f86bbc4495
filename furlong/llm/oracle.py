"""DuckDB counterparts of the queries that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MEASURES = ("word_length", "symbol_share", "line_share", "repeat_share")
# Least distances of a fence from its quartile, the factor and the least group, as the method states them.
_SLACK = {"word_length": 400, "symbol_share": 60, "line_share": 250, "repeat_share": 160}


def _fences(name: str, columns: str, using: str) -> str:
    sides = ", ".join(
        f"""min(value) filter (measure = '{m}' and 4 * upto >= 3 * total)
              + greatest(4 * (min(value) filter (measure = '{m}' and 4 * upto >= 3 * total)
                            - min(value) filter (measure = '{m}' and 4 * upto >= total)), {_SLACK[m]}) as {m}_most"""
        for m in _MEASURES
    )
    low = """min(value) filter (measure = 'word_length' and 4 * upto >= total)
              - greatest(4 * (min(value) filter (measure = 'word_length' and 4 * upto >= 3 * total)
                            - min(value) filter (measure = 'word_length' and 4 * upto >= total)), 400) as word_length_least"""
    part = ", ".join(x for x in (columns, "measure") if x)
    return f"""
    {name} as (
      select {columns + ',' if columns else ''} max(total) as size, {sides}, {low}
      from (select {part}, sum(n) over (partition by {part} order by b) as upto, sum(n) over (partition by {part}) as total,
                   case when b < 32 then b else (b - 16 * (b // 16 - 1)) << (b // 16 - 1)::int end as value
            from (select {part}, b, sum(n)::bigint as n from sketch group by {part}, b))
      {using})"""


_LIMITS = ", ".join(
    f"case when o.size >= 50 then o.{c} when l.size >= 50 then l.{c} else a.{c} end as {c}"
    for c in (*(f"{m}_most" for m in _MEASURES), "word_length_least")
)

QUALITY = f"""
with base as (
  select doc_id, lang, source, coalesce(text, '') as text, {WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
         row_number() over () as r
  from documents),
windows as (
  select r, i, w[i:i + 4] as g from (select r, w, unnest(range(1, len(w) - 3)) as i from base where len(w) >= 5)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from windows) where c > 1),
covered as (select r, count(distinct i + j) as n from (select r, i, unnest(range(0, 5)) as j from twice) group by r),
counted as (
  select b.r, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from base b left join covered c using (r)),
measured as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         case when n_words > 0 then word_chars * 100 // n_words else 0 end as word_length,
         case when word_chars > 0 then n_symbols * 1000 // word_chars else 0 end as symbol_share,
         case when n_lines > 0 then n_dup_lines * 1000 // n_lines else 0 end as line_share,
         case when n_words > 0 then n_repeat_words * 1000 // n_words else 0 end as repeat_share
  from counted),
sketch as (
  select lang, source, measure,
         case when v < 32 then v else 16 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 5)::int) end as b, count(*) as n
  from (unpivot (select lang, source, word_length, symbol_share, line_share, repeat_share from measured where not base_failed)
        on word_length, symbol_share, line_share, repeat_share into name measure value v)
  group by all),
{_fences("own", "lang, source", "group by lang, source")},
{_fences("by_lang", "lang", "group by lang")},
{_fences("everything", "", "")},
limits as (
  select o.lang, o.source, {_LIMITS}
  from own o join by_lang l on o.lang is not distinct from l.lang, everything a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(
         {" and ".join(f"{m} <= {m}_most" for m in _MEASURES)} and word_length >= word_length_least, false) as kept
from measured m left join limits t on m.lang is not distinct from t.lang and m.source is not distinct from t.source
"""

CHAT = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
escaped as (
  select *, regexp_replace(text, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role:|<\|end\|>|<\|(image|audio|document):)',
                           '\1\1\\\2', 'g') as body
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(body) + case role when 'user' then 18 when 'system' then 17 when 'assistant' then 6
                          else 18 + length(coalesce(role, '')) end)::bigint as formatted_chars
from escaped group by conv_id
"""

SUBSTRINGS = f"""
with words as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
windows as (
  select r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g
  from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
covered as (
  select distinct r, i + j as place
  from (select r, i, unnest(range(0, 50)) as j
        from (select r, doc_id, i, min(doc_id) over (partition by g) as first from windows) where first < doc_id)),
places as (select r, unnest(range(1, len(w) + 1)) as place, unnest(w) as word from words),
kept as (
  select r, string_agg(word, ' ' order by place) as text, count(*) as n
  from places anti join covered using (r, place) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from words left join kept using (r)
"""

MIXING = f"""
with sized as (select doc_id, source, len({WORDS})::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as sid from sized group by source),
weighed as (
  select *, [5, 2, 1][(sid % 3 + 1)::int] as weight, 3 * source_size as most from sources),
filling as (
  select *, most / weight as ratio,
         (sum(source_size) over () - coalesce(sum(most) over f, 0)) / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as level
  from weighed window f as (order by most / weight, sid rows between unbounded preceding and 1 preceding)),
targets as (
  select sid, source, source_size,
         case when ratio <= level then most::double else weight * max(level) filter (ratio > level) over () end as target
  from filling),
placed as (
  select s.*, t.source_size, t.target, floor(t.target)::bigint as goal,
         (sum(size) over (partition by t.sid order by md5('mix:' || coalesce(doc_id::varchar, '')), doc_id, size
                          rows between unbounded preceding and current row) - size)::bigint as start
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when source_size = 0 then 0
            else (goal // source_size) * size + greatest(0, least(start + size, goal % source_size) - start) end::bigint as taken
from placed
"""

TOP_K = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v, row_number() over () as r
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from (select distinct vec_id, v from vectors where vec_id % 20 = 0) q
  join vectors c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

# DuckDB has no crc32: eight steps for every byte of the decimal id, over 32 bits.
_CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(doc_id::varchar) + 1),
    lambda i: [ascii(substr(doc_id::varchar, i::int, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, b: case when b >= 0 then xor(crc, b) when crc % 2 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end))"""


def _leaf(text: str) -> str:
    values = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"case when {v} is null then '-' else strlen({v}::varchar) || ':' || {v} end" for v in values) + ")"


def _levels(name: str, group: str, count: int) -> str:
    """Tables ``name``_0 to ``name``_count: the nodes (``h``) of a level, ``n`` in all; a lone node is passed on."""
    steps = []
    for k in range(count):
        steps.append(f"""
{name}_{k + 1} as (
  select {group}, p // 8 as p, case when n = 1 then any_value(h) else sha256(string_agg(h, '' order by p)) end as h, (n + 7) // 8 as n
  from {name}_{k} group by {group}, p // 8, n),
{name}_run_{k} as (select {group}, p // 8 as run, list(h order by p) as hs, n from {name}_{k} where n > 1 group by {group}, p // 8, n)""")
    return ",".join(steps)


def _proof(name: str, k: int, source: str, place: str, on: str) -> str:
    """Adds a level's siblings to the proof and folds it."""
    at = f"({place} // {8**k})"
    left = f"coalesce(array_to_string(hs[1:({at} % 8)::int], ''), '')"
    right = f"coalesce(array_to_string(hs[({at} % 8 + 2)::int:], ''), '')"
    return f"""
{source}_{name}_{k} as (
  select s.* exclude (proof, folded), case when hs is null then proof else proof || {left} || {right} end as proof,
         case when hs is null then folded else sha256({left} || folded || {right}) end as folded
  from {{before}} s left join {name}_run_{k} r on {on} and r.run = {at} // 8)"""


def _merkle(depth: int = 8) -> str:
    """Trees of up to 8 ** depth leaves a language and as many languages."""
    steps, before = [], "started"
    for name, place, on in (("leaves", "s.place", "s.lang is not distinct from r.lang"), ("tops", "s.top", "r.one = 1")):
        for k in range(depth):
            steps.append(_proof(name, k, "step", place, on).replace("{before}", before))
            before = f"step_{name}_{k}"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with hashed as (
  select doc_id, lang, {_leaf("text")} as leaf, {_leaf(f"case when {_CRC} % 3 = 0 then {lowered} else text end")} as seen
  from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place from hashed),
leaves_0 as (select lang, place as p, leaf as h, count(*) over (partition by lang) as n from placed),
{_levels("leaves", "lang", depth)},
tops_0 as (select 1 as one, row_number() over (order by lang nulls first) - 1 as p, h, count(*) over () as n, lang from leaves_{depth}),
{_levels("tops", "one", depth)},
started as (
  select p.*, t.p as top, t.h as subroot, r.h as root, '' as proof, p.seen as folded
  from placed p join tops_0 t on p.lang is not distinct from t.lang, tops_{depth} r),
{",".join(steps)}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from {before}
"""


# Longer rules first.
_URL_RULES = (
    ("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow"),
)


def _first_rule(value: str) -> str:
    found = " ".join(
        f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{host + path if value == 'rule' else verdict}'"
        for host, path, verdict in _URL_RULES
    )
    return f"case {found} end"


def _crc_of_hex(text: str) -> str:
    """CRC-32 of the bytes that a text of hex digits spells."""
    digit = "(instr('0123456789ABCDEF', substr({0}, {1}, 1)) - 1)"
    byte = f"(16 * {digit.format(text, '(2 * i + 1)::int')} + {digit.format(text, '(2 * i + 2)::int')})::bigint"
    return f"""xor(4294967295, list_reduce(
  list_prepend(4294967295::bigint, flatten(list_transform(range(0, length({text}) // 2), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, b: case when b >= 0 then xor(crc, b) when crc % 2 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end))"""


def _url_filter(order: int = 5) -> str:
    """Witten-Bell models by tables of n-grams in hex, for all counts and without either fold."""
    levels = []
    for k in range(1, order + 2):
        below = f"join p_{k - 1} b on b.m = l.m and b.s = l.s and b.g = right(l.g, {2 * k - 2})" if k > 1 else ""
        base = "b.p" if k > 1 else "(1.0::double / 256)"
        levels.append(f"""
l_{k} as (select m, s, right(g, {2 * k}) as g, sum(n)::bigint as n from counts group by m, s, right(g, {2 * k})),
c_{k} as (select m, s, left(g, {2 * k - 2}) as c, sum(n)::bigint as n, count(*) filter (n > 0) as t from l_{k} group by all),
p_{k} as materialized (
  select l.m, l.s, l.g, case when c.n > 0 then (l.n + c.t * {base}) / (c.n + c.t) else {base} end as p
  from l_{k} l join c_{k} c on c.m = l.m and c.s = l.s and c.c = left(l.g, {2 * k - 2}) {below})""")
    top = order + 1
    return f"""
with raw as (
  select row_number() over () as r, page_id, hex(encode(coalesce(url, ''))) as bytes,
    case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from raw),
urls as materialized (
  select *, {_first_rule('rule')} as rule, {_first_rule('verdict')} as ruled, {_crc_of_hex('bytes')} % 2 as fold from parts),
grams as materialized (
  select r, ruled, fold, substr(repeat('00', {order}) || bytes || '01', (2 * i + 1)::int, {2 * top}) as g
  from (select *, unnest(range(0, length(bytes) // 2 + 1)) as i from urls)),
seen as (
  select g, s, count(*) filter (ruled = v) as n, count(*) filter (ruled = v and fold = 0) as n_0
  from grams, (values ('yes', 'allow'), ('no', 'block')) x(s, v) group by g, s),
counts as materialized (
  select 'whole' as m, s, g, n from seen union all select 'fold_0', s, g, n - n_0 from seen union all select 'fold_1', s, g, n_0 from seen),
{",".join(levels)},
ratios as (
  select m, g, floor((ln(max(p) filter (s = 'yes')) - ln(max(p) filter (s = 'no'))) * 1000000 + 0.5)::bigint as score from p_{top} group by m, g),
scored as materialized (
  select x.r, floor(sum(score)::double / (count(*) * 1000))::bigint as score
  from grams x join ratios q on q.g = x.g and q.m = case when x.ruled is null then 'whole' else 'fold_' || x.fold end group by x.r),
judged as materialized (select u.*, greatest(-20000, least(20000, score)) as spot from urls u join scored using (r)),
bins as (
  select spot, count(*) filter (ruled = 'allow') as yes, count(*) filter (ruled = 'block') as no from judged where ruled is not null group by spot),
cuts as (
  select greatest(coalesce(lag(spot) over (order by spot) + 1, -20000), least(spot, 0)) as least,
    (sum(no) over ())::double * (sum(yes) over () - coalesce(sum(yes) over before, 0))
      + (sum(yes) over ())::double * coalesce(sum(no) over before, 0) as right_ones,
    sum(yes) over () as all_yes, sum(no) over () as all_no
  from bins window before as (order by spot rows between unbounded preceding and 1 preceding)),
chosen as (select first(least order by right_ones desc, abs(least), least) filter (all_yes > 0 and all_no > 0) as least, max(all_no) as no, max(all_yes) as yes from cuts)
select page_id, host, path, rule,
  coalesce(ruled, case when c.least is not null then case when spot >= c.least then 'allow' else 'block' end
                       when coalesce(c.no, 0) > 0 and coalesce(c.yes, 0) = 0 then 'block' else 'allow' end) as verdict
from judged, chosen c
"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": QUALITY,
    "op2_chat_format": CHAT,
    "op5_substring_dedup": SUBSTRINGS,
    "op6_source_mixing": MIXING,
    "op10_exact_top_k": TOP_K,
    "op11_url_filter": _url_filter(),
    "op12_merkle_manifest": _merkle(),
}
