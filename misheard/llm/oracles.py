"""DuckDB SQL for the queries of this folder that SQL can express."""

from misheard.llm import licenses

ORACLES: dict = {}

ORACLES["op1_mix_sources"] = r"""
with d as (
  select doc_id, source, coalesce('=' || source, '') as k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('0|' || coalesce(doc_id::varchar, '')) as ord
  from documents
), s as (
  select k, any_value(source) as source, sum(size)::bigint as source_size from d group by k
), n as (
  select *, row_number() over (order by source nulls last) - 1 as source_no,
         [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from s
), r as (
  select *, source_size * 2 as cap, (source_size * 2)::double / weight as ratio from n
), l as (
  select *, (1.5::double * (sum(source_size) over ())::double
      - coalesce(sum(cap) over (order by ratio, source_no rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(weight) over (order by ratio, source_no rows between current row and unbounded following)) as lv from r
), f as (
  select *, max(case when ratio > lv then lv end) over () as level from l
), t as (
  select k, source_no, source_size,
         case when level is null or ratio <= level then cap::double else level * weight end as target from f
), p as (
  select doc_id, d.source, size, source_size, target, source_no, floor(target + 0.5)::bigint as wanted,
         coalesce(sum(size) over (partition by d.k order by ord, size rows between unbounded preceding and 1 preceding),
                  0)::bigint as before
  from d join t on d.k = t.k
), q as (
  select *, greatest(least(wanted - before, size), 0) + greatest(least(wanted - (source_size + before), size), 0) as taken,
         case when wanted > before and size > 0 then before::double / wanted::double end as share
  from p
)
select doc_id, source, size, source_size, target, taken::bigint as taken,
  case source_no % 3
    when 0 then 0.0::double + (2.0::double * (share - 0.0)) / (1.5::double + sqrt(greatest(0.0::double, 2.25::double + -2.0::double * (share - 0.0))))
    when 1 then 0.0::double + (2.0::double * (share - 0.0)) / (1.0::double + sqrt(greatest(0.0::double, 1.0::double + 0.0::double * (share - 0.0))))
    else case when share * 1.0::double <= 0.3125
      then 0.0::double + (2.0::double * (share - 0.0)) / (0.5::double + sqrt(greatest(0.0::double, 0.25::double + 1.0::double * (share - 0.0))))
      else 0.5::double + (2.0::double * (share - 0.3125)) / (0.75::double + sqrt(greatest(0.0::double, 0.5625::double + 5.0::double * (share - 0.3125)))) end
  end as position
from q
"""

ORACLES["op2_warc_conversion"] = """
with p as (
  select page_id, coalesce(strlen(html), 0)::bigint as n, sha256(coalesce(html, '')) as digest from pages
), f as (
  select *, min(page_id) over (partition by digest) as first from p
)
select page_id, n as payload_bytes, digest as payload_digest,
       case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id > first then first end as refers_to
from f
"""


def _rule_rows() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ",\n  ".join(
        f"({r['rule']}, {quoted(r['label'])}, {r['priority']}, {r['trust']}::double, {quoted(r['re'])}, "
        f"[{', '.join(quoted(' ' + k + ' ') for k in r['keys'])}], {str(r['base']).lower()})"
        for r in licenses.RULES
    )


# All rules against all texts that hold their words; a match is dropped if any better
# one contains it, by the definition.
ORACLES["op12_license_scan"] = r"""
with rules(rule, label, priority, trust, re, keys, base) as (values
  """ + _rule_rows() + r"""
), w as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), d as materialized (
  select rid, doc_id, len(words)::bigint as n_words, ' ' || array_to_string(words, '  ') || ' ' as norm from w
), m as materialized (
  select rid, rule, label, priority, trust, base,
         regexp_extract_all(norm, re) as found, string_split_regex(norm, re) as gaps
  from d join rules on len([k for k in keys if not contains(norm, k)]) = 0
  where regexp_matches(norm, re)
), p as (
  select *, unnest(generate_series(1, len(found))) as k from m
), i as (
  select rid, rule, label, priority, trust, base,
         (list_sum([len(g) - len(replace(g, ' ', '')) for g in gaps[1:k]])
          + coalesce(list_sum([len(g) - len(replace(g, ' ', '')) for g in found[1:k-1]]), 0)) // 2 as lo,
         (len(found[k]) - len(replace(found[k], ' ', ''))) // 2 as n
  from p
), h as materialized (
  select *, lo + n as hi from i
), kept as (
  select * from h where base or not exists (
    select 1 from h e where e.rid = h.rid and e.lo <= h.lo and e.hi >= h.hi
      and (e.priority < h.priority
           or e.priority = h.priority and (e.lo < h.lo or e.hi > h.hi or e.rule < h.rule)))
), g as (
  select rid, count(*) filter (base) as n_base, min(lo) filter (base) as first_word, max(lo) filter (base) as last_word,
         string_agg(distinct label, ',' order by label) filter (base) as base_labels,
         string_agg(distinct label, ',' order by label) as labels, max(trust) as score
  from kept group by rid
)
select doc_id, n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0)::double as score
from d left join g using (rid)
"""


# The checksum byte by byte; near words by the words they leave with one letter deleted.
ORACLES["op11_spelling_variants"] = """
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents
), lows as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, count(*) as c
  from runs where length(run) >= 5 group by all
), numbered as materialized (
  select row_number() over () as r, low, c, hex(id || ':' || low) as hx from lows
), bits(i, v, k) as (
  select i::bigint, i::bigint, 0 from range(256) t(i)
  union all
  select i, case when v & 1 = 1 then xor(3988292384::bigint, v >> 1) else v >> 1 end, k + 1 from bits where k < 8
), crc(r, hx, k, v) as (
  select r, hx, 0, 4294967295::bigint from numbered
  union all
  select c.r, c.hx, c.k + 1, xor(b.v, c.v >> 8)
  from crc c join bits b on b.k = 8 and b.i = xor(c.v, ('0x' || substr(c.hx, 2 * c.k + 1, 2))::bigint) & 255
  where c.k < length(c.hx) // 2
), marked as (
  select low, c, xor(v, 4294967295::bigint) as h from crc join numbered using (r) where k = length(crc.hx) // 2
), words as materialized (
  select case when h % 97 = 0 then substr(low, 1, (h % length(low))::int) || substr(low, (h % length(low))::int + 2)
              else low end as word, sum(c)::bigint as n
  from marked group by 1 having length(word) >= 5 and sum(c) >= 3
), cut as materialized (
  select word, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest
  from (select word, unnest(generate_series(1, length(word)))::int as k from words)
), near as materialized (
  select distinct word, other from (
    select a.word, b.word as other from cut a join cut b on a.k = b.k and a.rest = b.rest and a.word <> b.word
    union all select word, rest from cut where rest in (select word from words)
    union all select rest, word from cut where rest in (select word from words)
  )
), ranked as (
  select near.word, other, words.n as other_n, count(*) over (partition by near.word) as n_near,
         row_number() over (partition by near.word order by words.n desc, other) as place
  from near join words on words.word = near.other
), forms as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
         case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
  from words w left join ranked r on r.word = w.word and r.place = 1
), walk(word, here) as (
  select word, word from forms
  union all
  select walk.word, forms.form from walk join forms on forms.word = walk.here where forms.form is not null
), last as (
  select walk.word, walk.here as root from walk join forms on forms.word = walk.here where forms.form is null
)
select word, form, root, n, n_near, form_n from forms join last using (word)
"""

# All pairs in double precision; components by the smallest vector reached.
ORACLES["op6_embedding_neighbours"] = """
with recursive v as (
  select vec_id, [x::double for x in embedding] as e from embeddings
), u as materialized (
  select vec_id, e, sqrt(list_inner_product(e, e)) as norm
  from v where len([x for x in e if x is null or not isfinite(x)]) = 0 and list_sum([abs(x) for x in e]) > 0
), links as materialized (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reached(a, b) as (
  select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b
), least as (
  select a, min(b) as b from reached group by a
), counted as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(least.b, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(least.b, vec_id)) as kept
from v left join least on least.a = vec_id left join counted on counted.a = vec_id
"""

# Every string of 400 bytes is hashed; texts are hex digits, two for a byte.
ORACLES["op9_repeated_passages"] = """
with d as materialized (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), starts as (
  select r, unnest(range(0, len(h) // 2 - 399)) as pos, h from d
), hashed as materialized (
  select r, pos, md5_number(substr(h, 2 * pos + 1, 800)) as m from starts
), often as (
  select m from hashed group by m having count(*) > 1
), hits as (
  select r, pos, lag(pos) over (partition by r order by pos) as before from hashed semi join often using (m)
), runs as (
  select r, pos, sum(case when before is null or pos > before + 400 then 1 else 0 end) over (partition by r order by pos) as run
  from hits
), spans as materialized (
  select r, min(pos) as s, max(pos) + 400 as e from runs group by r, run
), pieces as (
  select r, coalesce(lag(e) over (partition by r order by s), 0) as s, s as e from spans
  union all select r, max(e), 1000000000 from spans group by r
), kept as (
  select p.r, string_agg(substr(d.h, 2 * p.s + 1, 2 * (p.e - p.s)), '' order by p.s) as h
  from pieces p join d using (r) group by p.r
), removed as (
  select r, sum(e - s)::bigint as n_removed, count(*) as n_spans from spans group by r
)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join removed using (r) left join kept using (r)
"""
