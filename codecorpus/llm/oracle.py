"""The same results in SQL for DuckDB, where SQL can express the operator."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BENCH_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
LINE = r"lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))"
HAS_WORD = r"regexp_matches(line, '[^\x20\x09-\x0D]')"

OP1 = f"""
with d as (select doc_id, {BENCH_WORDS} as w from documents),
i as (select item_id, {BENCH_WORDS} as w from benchmark),
iw as (
  select distinct item_id, least(10, len(w)) as n,
    array_to_string(w[s : s + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s from i where len(w) > 0)
),
sizes as (select distinct n from iw),
dw as (
  select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)
),
h as (select doc_id, s, n, item_id from dw join iw using (n, win)),
c as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from h))
  group by doc_id
),
t as (
  select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items
  from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""

OP4 = f"""
with d as (select doc_id, {WORDS} as w from documents),
win as (
  select doc_id, s, sha256(array_to_string(w[s : s + 34], ' ')) as v
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35)
),
twice as (select v from win group by v having count(*) > 1),
gone as (
  select distinct doc_id, p
  from (select doc_id, unnest(range(s, s + 35)) as p from win where v in (select v from twice))
),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as t
  from words anti join gone using (doc_id, p) group by doc_id
),
n as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n.n, 0) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""

_LINES = f"""
l as (
  select doc_id, source, pos, line, {LINE} as k, {HAS_WORD} as full_line
  from (
    select doc_id, source, unnest(x) as line, unnest(range(len(x))) as pos
    from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as x from documents)
  )
),
totals as (select source, count(*) as docs from documents group by source),
counts as (select source, k, count(distinct doc_id) as n from l where full_line group by source, k)"""

OP2 = f"""
with w as (select doc_id, text, {WORDS} as w from documents),
win as (
  select doc_id, s, array_to_string(w[s : s + 4], chr(1)) as v
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as s from w where len(w) >= 5)
),
twice as (select doc_id, v from win group by doc_id, v having count(*) > 1),
cover as (
  select doc_id, count(distinct p) as n
  from (select doc_id, unnest(range(s, s + 5)) as p from win join twice using (doc_id, v))
  group by doc_id
),{_LINES},
common as (
  select counts.source, k from counts join totals on counts.source is not distinct from totals.source
  where n > 10000 or (n >= 20 and n > 0.2 * docs)
),
marked as (
  select l.*, exists (
    select 1 from common where common.source is not distinct from l.source and common.k = l.k
  ) and full_line as gone from l
),
remain as (
  select doc_id, count_if(gone) as n_lines_removed,
    coalesce(sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) filter (not gone), 0) as n_left
  from marked group by doc_id
),
lines as (
  select doc_id, count(*) filter (full_line) - count(distinct line) filter (full_line) as n_dup
  from l group by doc_id
),
base as (
  select w.doc_id, len(w) as n_words,
    length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
    n_dup as n_dup_lines, coalesce(cover.n, 0) as n_repeat_words,
    n_lines_removed, n_left as n_words_left
  from w left join cover using (doc_id) join lines using (doc_id) join remain using (doc_id)
)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and n_words_left >= 10 and n_words_left >= 0.3 * n_words as kept
from base
"""

OP5 = f"""
with {_LINES},
common as (
  select counts.source, k from counts join totals on counts.source is not distinct from totals.source
  where n >= 2 and n > 0.1 * docs
),
marked as (
  select l.*, exists (
    select 1 from common where common.source is not distinct from l.source and common.k = l.k
  ) and full_line as gone from l
),
texts as (
  select doc_id, source, count(*) as n_lines, count_if(gone) as n_dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as t
  from marked group by doc_id, source
)
select doc_id, source, n_lines, n_dropped, length(t) as n_chars_left, sha256(t) as clean_sha256
from texts
"""

OP6 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
x as (
  select *, role || chr(10) || text || chr(10) as said,
    length('<|im_start|>') + length(role) + 1
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1 as n
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(said, '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
    filter (role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars
from x group by conv_id
"""

OP10 = """
with p as (
  select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n,
    sha256(coalesce(html, '')) as d
  from pages
),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when n >= 100 and page_id is distinct from first then 'revisit' else 'response' end
    as record_type,
  case when n >= 100 and page_id is distinct from first then first end as refers_to
from p left join f on p.d = f.d
"""

ORACLE: dict[str, str] = {
    "op1_benchmark_decontamination": OP1,
    "op2_quality_rules": OP2,
    "op4_repeated_phrases": OP4,
    "op5_line_dedup": OP5,
    "op6_chat_formatting": OP6,
    "op10_warc": OP10,
}
