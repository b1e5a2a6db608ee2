"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

MIX = r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as draw,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         (row_number() over (order by source nulls last) - 1) % 3 as place
  from d group by source
),
w as (
  select source, source_size, case place when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight,
         2.0::double * source_size as cap, 1.5::double * sum(source_size) over () as budget
  from s
),
l as (
  select *, (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last
                    rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(weight) over (order by cap / weight, source nulls last
                    rows between current row and unbounded following) as level
  from w
),
t as (
  select source, source_size, least(cap, weight * max(level) over ()) as target from l
),
p as (
  select d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) over (partition by d.source order by d.draw, d.doc_id, d.size
                           rows between unbounded preceding and current row) as ends
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast(greatest(0, least(size, floor(target) - ends + size))
          + greatest(0, least(size, floor(target) - ends - source_size + size)) as bigint) as taken
from p
"""

COPIES = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
)
select doc_id, min(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over (partition by norm order by doc_id nulls last) = 1 as kept,
       sha256(norm) as text_sha256
from d
"""

# Five hex digits are four base-32 digits.
ARCHIVE = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h,
         min(page_id) over (partition by coalesce(html, '')) as first
  from pages
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)
         for i in range(0, 32)], '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from p
"""

CONTAMINATION = r"""
with d as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
),
iw as (
  select distinct item_id, least(len(w), 10) as size,
         array_to_string(w[pos : pos + least(len(w), 10) - 1], ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as pos from i where len(w) > 0)
),
sizes as (select distinct size from iw),
dw as (
  select r, pos, size, array_to_string(w[pos : pos + size - 1], ' ') as phrase
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as pos from d, sizes where len(w) >= size)
),
hit as (
  select distinct dw.r, dw.pos, dw.size, iw.item_id from dw join iw using (size, phrase)
),
words as (
  select r, count(distinct place) as n_hit
  from (select r, unnest(range(pos, pos + size)) as place from (select distinct r, pos, size from hit)) group by r
),
items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct r, cast(item_id as varchar) as item from hit) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

SQL: dict[str, str] = {"op3_exact_dedup": COPIES, "op8_mix_sources": MIX, "op9_warc": ARCHIVE, "op12_phrase_index": CONTAMINATION}
