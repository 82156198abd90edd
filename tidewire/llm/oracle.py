"""Queries of the operators that SQL can express, for a side-by-side check in another engine."""

from __future__ import annotations

from tidewire.llm.decontaminate import LEAST_SUM, LEAST_WORDS, MASKS, SIMILARITY
from tidewire.llm.mixing import BUDGET, LEAST, LEVELS, MOST, ORDER_BITS, OTHER, SEED, TARGETS
from tidewire.llm.sharding import MULTIPLIER, OVERHEAD

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _seeds(table: str) -> str:
    """Each mask laid on each place of the word lists ``w`` of a table."""
    laid = []
    for number, mask in enumerate(MASKS):
        words = ", ".join(f"w[i + {k}]" for k, c in enumerate(mask) if c == "1")
        laid.append(
            f"select k, {number} as mask, i, concat_ws(' ', {words}) as seed "
            f"from (select k, w, unnest(range(1, len(w) - {len(mask) - 2})) as i from {table})"
        )
    return " union all ".join(laid)


SPACED_SEEDS = f"""
with texts as (select text as k, any_value({_WORDS}) as w from documents group by text),
items as (select item_id as k, {_WORDS} as w from benchmark where len({_WORDS}) >= {len(MASKS[0])}),
met as (
  select distinct d.k as text, b.k as item_id, d.i - b.i as diagonal
  from ({_seeds("texts")}) d join ({_seeds("items")}) b using (mask, seed)),
flags as (
  select m.text, m.item_id, m.diagonal, i, len(b.w) as words,
         i + m.diagonal >= 1 and coalesce(t.w[i + m.diagonal] = b.w[i], false) as equal
  from met m join texts t on t.k is not distinct from m.text
  join (select k, w, unnest(range(1, len(w) + 1)) as i from items) b on b.k = m.item_id),
equals as (
  select text, item_id, diagonal, words, i, row_number() over (partition by text, item_id, diagonal order by i) as n
  from flags where equal),
stretches as (
  select a.text, a.item_id, a.words, a.i as first, b.i as last,
         5 * (b.n - a.n + 1) - 4 * (b.i - a.i + 1) as gain
  from equals a join equals b on a.text is not distinct from b.text and a.item_id = b.item_id
       and a.diagonal = b.diagonal and a.i <= b.i),
ends as (
  select text, item_id, words, first, max(last) as last from stretches
  where gain >= {LEAST_SUM} or gain >= 0 and last - first + 1 >= least(ceil(words * {SIMILARITY}), {LEAST_WORDS})
  group by all),
covered as (
  select text, item_id, words, count(distinct place) as overlap
  from (select text, item_id, words, unnest(range(first, last + 1)) as place
        from ends)
  group by all)
select d.doc_id, c.item_id, c.overlap::int as overlap, c.words::int as words
from documents d join covered c on d.text is not distinct from c.text
where overlap >= least(ceil(words * {SIMILARITY}), {LEAST_WORDS}) or words * {SIMILARITY} <= overlap
"""

# The checksum's table is made from its rule; the walk of a key is one row per jump.
JUMP_SHARDING = f"""
with recursive
crc_steps(i, step, value) as (
  select i, 0, i::bigint from range(256) t(i)
  union all
  select i, step + 1, case when value & 1 = 1 then xor(value >> 1, 3988292384) else value >> 1 end
  from crc_steps where step < 8),
crc_table as (select list(value order by i) as v from crc_steps where step = 8),
bytes as (
  select doc_id, strlen(coalesce(text, '')) + {OVERHEAD} as size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                        lambda x: ('0x' || x)::bigint) as b
  from documents),
sums as (
  select doc_id, size,
         xor(list_reduce(list_prepend(4294967295, b),
                         lambda a, x: xor(a >> 8, v[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32
  from bytes, crc_table),
walk(doc_id, shards, stand, following, key) as (
  select doc_id, n, 0::bigint as stand, 0::bigint as following,
         coalesce(doc_id, 0)::hugeint
           + case when doc_id < 0 then 18446744073709551616 else 0 end
  from (select distinct doc_id from documents), (select unnest([40, 41]) as n)
  union all
  select doc_id, shards, following,
         floor((following + 1) * (2147483648.0::double
           / (((key * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 + 1)::double))::bigint,
         (key * {MULTIPLIER} + 1) % 18446744073709551616
  from walk where following < shards),
placed as (
  select doc_id, max(stand) filter (shards = 40) as shard, max(stand) filter (shards = 41) as grown
  from walk group by doc_id)
select s.doc_id, s.size, s.text_crc32, 'key' as law, p.shard::int as shard,
       row_number() over (partition by p.shard order by s.doc_id nulls first, s.text_crc32, s.size) - 1
         as slot,
       p.grown::int as grown_shard
from sums s join placed p on s.doc_id is not distinct from p.doc_id
"""



def _weight(level: str) -> str:
    listed = " ".join(f"when '{name}' then {share}" for name, share in TARGETS[level].items())
    return f"(case {level} {listed} else {OTHER} end)::double" if listed else f"{OTHER}::double"


def _family(depth: int) -> str:
    """Amounts of the nodes at one depth: a family's sum of clamp(x * w, lo, hi) is what it is given."""
    above, own = ["root", *LEVELS[:depth]], ["root", *LEVELS[: depth + 1]]
    keys, node = ", ".join(above), ", ".join(own)
    n = depth
    return f"""
nodes{n} as (
  select l.*, p.give, sum(lo) over (partition by {keys}) as base
  from (select {node}, sum(lo) as lo, sum(hi) as hi, {_weight(LEVELS[depth])} as w from limits group by {node}) l
  join given{n} p using ({keys})),
bends{n} as (
  select {keys}, give, base, x, sum(turn) as turn
  from (select {keys}, give, base, lo / w as x, w as turn from nodes{n} where w > 0 and hi > lo
        union all
        select {keys}, give, base, hi / w, -w from nodes{n} where w > 0 and hi > lo)
  group by all),
slopes{n} as (
  select *, sum(turn) over (partition by {keys} order by x) as slope from bends{n}),
rises{n} as (
  select *, coalesce(lag(slope) over o * (x - lag(x) over o), 0) as rise
  from slopes{n} window o as (partition by {keys} order by x)),
levels{n} as (
  select *, base + sum(rise) over (partition by {keys} order by x) as level from rises{n}),
found{n} as (
  select {keys}, x + case when slope > 1e-9 then (give - level) / slope else 0 end as x
  from levels{n} where level <= give
  qualify row_number() over (partition by {keys} order by x desc) = 1),
given{n + 1} as (
  select {node}, coalesce(least(greatest(f.x * w, lo), hi), lo) as give
  from nodes{n} left join found{n} f using ({keys}))"""


TREE_MIXING = f"""
with docs as (
  select doc_id, text, lang as own_lang, source as own_source, coalesce(lang, '(none)') as lang,
         coalesce(source, '(none)') as source,
         regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as number,
         coalesce(len(regexp_extract_all(text, '\\S+')), 0) as tokens,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as row_key
  from documents),
rows_ as (
  select *, case when number = '' then 'other' else 'd' || (number::bigint // 5) end as domain from docs),
leaves as (select domain, lang, source, sum(tokens) as tokens from rows_ group by all),
limits as (
  select *, 0 as root, tokens * {float(LEAST)}::double as lo, tokens * {float(MOST)}::double as hi from leaves),
given0 as (
  select 0 as root, sum(tokens) * {min(max(BUDGET, LEAST), MOST)}::double as give from leaves),
{",".join(_family(depth) for depth in range(len(LEVELS)))},
plan as (
  select domain, lang, source,
         case when tokens > 0 then floor(give / tokens + 1e-9) else {LEAST} end::int as passes,
         case when tokens > 0 then give - floor(give / tokens + 1e-9) * tokens else 0 end as rest
  from leaves join given{len(LEVELS)} using (domain, lang, source)),
placed as (
  select r.*, passes, rest,
         ('0x' || left(md5({SEED} || ':' || passes || ':' || row_key), {ORDER_BITS // 4}))::bigint as h
  from rows_ r join plan using (domain, lang, source)),
taken as (
  select *, sum(tokens) over (partition by domain, lang, source order by h) <= rest as fits from placed)
select doc_id, domain, own_lang as lang, own_source as source, tokens::bigint as tokens,
       unnest(range(passes + case when fits then 1 else 0 end))::int as epoch
from taken
"""

# A turn is written as control string, role, line feed, text, control string, line feed; each place of a text that
# looks like a control string takes one more sign.
CHAT = r"""
with probe(text) as (select '<|im_end|><|im_start|>assistant ok'),
turns as (
  select conv_id, false as added, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, true, unnest([0, 1]), unnest(['user', 'assistant']), text from probe),
sizes as (
  select *, len('<|im_start|>') + 1 + len('<|im_end|>') + 1
              + len(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;'))
              + len(text) + len(regexp_extract_all(text, '<\\*\|')) as chars
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(len(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), ''))
         as loss_sha256,
       sum(chars)::bigint as formatted_chars
from sizes group by conv_id, added
"""

ORACLE = {
    "op2_spaced_seeds": SPACED_SEEDS,
    "op6_tree_mixing": TREE_MIXING,
    "op7_jump_sharding": JUMP_SHARDING,
    "op11_reply_trees": CHAT,
}
