"""DuckDB SQL for the operators that SQL can express, over whole tables, without their methods."""

from __future__ import annotations

from ledgerflow.llm.licenses import PHRASES, TEMPLATES

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_PLAIN = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP1 = f"""
with recursive worded as (select doc_id, {_SPACED.format("text")} as w from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from worded),
each as (select doc_id, unnest(s) as g, len(s) as n from shingled),
links as (
  select a.doc_id as x, b.doc_id as y from each a join each b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select x, y from links union select y, x from links),
reach as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
smallest as (select x, min(y) as y from reach group by x)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id
from shingled left join smallest on x = doc_id
"""

OP3 = f"""
with items as (select item_id, {_PLAIN.format("text")} as w from benchmark),
windows as (
  select distinct item_id, array_to_string(w[i:i + 12], ' ') as win, least(len(w), 13) as size
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)),
worded as (select doc_id, {_PLAIN.format("text")} as w from documents),
sizes as (select distinct size from windows),
places as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from worded, sizes where len(w) >= size)),
found as (select doc_id, i, p.size, item_id from places p join windows v on p.win = v.win and p.size = v.size),
hit as (
  select doc_id, count(*) as n_hit
  from (select distinct doc_id, unnest(range(i, i + size)) as word from (select distinct doc_id, i, size from found)) group by doc_id),
met as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item_id from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from worded left join hit using (doc_id) left join met using (doc_id)
"""


def _values(rows: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(rows))


OP7 = f"""
with phrases as (select label, {_PLAIN.format("phrase")} as p from (values {_values(PHRASES)}) v(n, phrase, label)),
templates as (
  select n, label, list_distinct({_PLAIN.format("body")}) as t from (values {_values(TEMPLATES)}) v(n, body, label)),
worded as (select doc_id, {_PLAIN.format("text")} as w from documents),
placed as (
  select doc_id, label, i - 1 as place from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from worded) d, phrases
  where w[i:i + len(p) - 1] = p),
base as (
  select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word,
    array_to_string(list_sort(list(distinct label)), ',') as base_labels from placed group by doc_id),
blocks as (
  select doc_id, b, {_PLAIN.format("line")} as w
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as b from documents)),
met as (
  select doc_id, label, len(list_intersect(w, t)) / len(t) as share from blocks, templates
  where len(w) > 0 and len(list_intersect(w, t)) >= ceil(0.8 * len(t) - 1e-9)),
every_label as (select doc_id, label from placed union select doc_id, label from met),
labelled as (select doc_id, array_to_string(list_sort(list(label)), ',') as labels from every_label group by doc_id),
scored as (select doc_id, max(share) as share from met group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from worded left join base using (doc_id) left join labelled using (doc_id) left join scored using (doc_id)
"""

OP11 = """
with payloads as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
digests as (
  select page_id, body, hex,
    array_to_string(list_transform(string_split(hex, ''), lambda x:
      lpad(bin(instr('0123456789abcdef', x) - 1), 4, '0')), '') as bits
  from payloads),
named as (
  select page_id, hex, octet_length(encode(body)) as payload_bytes,
    array_to_string(list_transform(range(0, 160, 5), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
        16 * cast(bits[i + 1] as int) + 8 * cast(bits[i + 2] as int) + 4 * cast(bits[i + 3] as int)
        + 2 * cast(bits[i + 4] as int) + cast(bits[i + 5] as int) + 1 as int), 1)), '') as payload_digest
  from digests),
placed as (select *, max(page_id) over (partition by hex) as response from named)
select page_id, payload_bytes, payload_digest,
  case when page_id = response then 'response' else 'revisit' end as record_type,
  case when page_id <> response then response end as refers_to
from placed
"""

OP12 = """
with hashed as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents),
drawn as (
  select *, cast('0x' || substr(h, 1, 8) as ubigint) % (n + 1) as a, cast('0x' || substr(h, 9, 8) as ubigint) % (n + 1) as b,
    cast('0x' || substr(h, 17, 8) as ubigint) % 100 as kept, cast('0x' || substr(h, 25, 8) as ubigint) % 100 as swapped
  from hashed),
formed as (
  select *, least(a, b) as x, greatest(a, b) as y,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or kept >= 90 then 'plain'
      when swapped < 20 then 'spm' else 'psm' end as form
  from drawn),
cut as (
  select *, t[:x] as prefix, t[x + 1:y] as middle, t[y + 1:] as suffix from formed)
select doc_id, n, form, case when form <> 'plain' then cast(x as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(y - x as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from cut
"""

ORACLES = {
    "op1_ngram_join": OP1,
    "op3_decontamination": OP3,
    "op7_licenses": OP7,
    "op11_warc": OP11,
    "op12_fill_in_middle": OP12,
}
