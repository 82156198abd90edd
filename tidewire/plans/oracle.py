"""The named queries as SQL, for a side-by-side check in another engine."""

from __future__ import annotations

from tidewire.operators.relevance import HIGH_TIER, MID_TIER
from tidewire.plans.catalog import (
    DATE_SPELLINGS, DIGITS, NEWS_EDITS, RAW_EDITS, ROLES, ROLLING_COSINE, SAMPLE_ROWS, SOURCE_WEIGHTS, WORD_LISTS,
)

def _put(column: str, edits: list[tuple[int, int, str, str]]) -> str:
    value = column
    for modulus, rest, before, after in edits:
        one, two = before.replace("'", "''"), after.replace("'", "''")
        value = f"case when ord % {modulus} = {rest} then '{one}' || {value} || '{two}' else {value} end"
    return value


NEWS = f"""
plain_news as (
  select lang as ticker, doc_id as ord, source,
         date '2024-01-01' + cast(doc_id % 90 as int) as date,
         split_part(text, chr(10), 1) as headline,
         trim(substr(text, length(split_part(text, chr(10), 1)) + 2)) as summary
  from documents),
news as (
  select ticker, ord, source, date, {_put("headline", NEWS_EDITS["headline"])} as headline,
         {_put("summary", NEWS_EDITS["summary"])} as summary
  from plain_news)
"""

LABELLED = """
labelled as (
  select n.*, case when toxic = 1 then -1 when quality = 1 then 1 else 0 end::int
           as directional_sentiment
  from news n join labels l on l.doc_id = n.ord)
"""

_NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', " \
      "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"


def _field(name: str) -> str:
    bare = f"replace(replace({name}, chr(34), ''), chr(39), '')"
    return f"case when {bare} not in {_NA} then {bare} end"


MARKED = f"""
{NEWS},
raw as (
  select ticker, ord, source, {_put("summary", RAW_EDITS["summary"])} as summary,
         case when ord % 73 = 13 then 'NA' else {_put("headline", RAW_EDITS["headline"])} end as headline,
         case when ord % 97 = 5 then 'not a date'
              when ord % 2 = 0 then strftime(date, '%d/%m/%Y')
              else strftime(date, '%Y-%m-%d') end as date
  from news),
fields as (
  select ticker, ord, {_field('date')} as raw_date, {_field('headline')} as headline,
         {_field('source')} as source, {_field('summary')} as summary
  from raw),
typed as (
  select ticker, ord, raw_date, source,
         coalesce(try_strptime(raw_date, '%d/%m/%Y'), try_strptime(raw_date, '%Y-%m-%d'))::date
           as date,
         case when not regexp_full_match(headline, '[\\s\\p{{Z}}]*') then headline end as headline,
         case when not regexp_full_match(summary, '[\\s\\p{{Z}}]*') then summary end as summary
  from fields),
ruled as (
  select *, case when date is null then 'bad_date'
                 when headline is null or summary is null then 'missing'
                 when contains(upper(headline), '#NAME?') or contains(upper(summary), '#NAME?')
                   then 'placeholder'
                 when regexp_matches(summary, '(?i)\\bzacks\\.com\\b|\\bproven\\s+results\\b')
                   then 'promotion' end as reason
  from typed),
firsts as (
  select ticker, ord, summary,
         row_number() over (partition by ticker, headline order by ord) as k
  from ruled where reason is null),
seconds as (
  select ticker, ord, row_number() over (partition by ticker, summary order by ord) as k
  from firsts where k = 1),
marked as (
  select r.* exclude (reason),
         case when reason is not null then reason
              when f.k > 1 then 'duplicate_headline'
              when s.k > 1 then 'duplicate_summary' end as reject_reason
  from ruled r left join firsts f using (ticker, ord) left join seconds s using (ticker, ord))
"""

_WEIGHT = "case source " + " ".join(
    f"when '{name}' then {weight}" for name, weight in SOURCE_WEIGHTS.items()
) + " else 0.5 end::double"

TRUST = f"trust as (select *, {_WEIGHT} as x3_factor from news)"


def _literal(word: str) -> str:
    return "\\Q" + word + "\\E"


def _pattern(words: list[str]) -> str:
    return "(?i)" + "|".join(map(_literal, words)) if words else "."


def _whole_word(words: str) -> str:
    """A Unicode word border; the SQL engine's own border knows ASCII only."""
    return f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){words}(?:$|[^\\p{{L}}\\p{{N}}_])"


def _rule_row(ticker: str, lists: dict[str, list[str]]) -> str:
    aliases = lists["aliases"]
    whole = _whole_word("(?:" + "|".join(map(_literal, aliases)) + ")") if aliases else "a^"
    values = [
        ticker, aliases[0] if aliases else "the target stock", whole, _pattern(aliases),
        _pattern(lists["direct_keywords"] + lists["products"]),
        _pattern(lists["indirect_keywords"]), _pattern(lists["low_signal_phrases"]),
    ]
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


RULE_TABLE = (
    "rules(ticker, target, target_re, alias_re, direct_re, indirect_re, low_re) as (values "
    + ", ".join(_rule_row(*item) for item in WORD_LISTS.items())
    + ")"
)
_HIGH, _MID = (
    _whole_word(p.removeprefix("(?iuU)\\b").removesuffix("\\b")) for p in (HIGH_TIER, MID_TIER)
)

RELEVANCE = f"""
{RULE_TABLE},
texts as (
  select n.*, r.* exclude (ticker), headline || ' ' || source || ' ' || summary as txt
  from news n join rules r using (ticker)),
tested as (
  select *, regexp_matches(txt, target_re) as is_target, regexp_matches(txt, direct_re) as direct,
         regexp_matches(txt, indirect_re) as indirect, regexp_matches(txt, low_re) as low
  from texts),
relevance as (
  select *,
    case when is_target and direct then
           case when regexp_matches(txt, '{_HIGH}') then 0.92
                when regexp_matches(txt, '{_MID}') then 0.86 else 0.75 end
         when is_target then case when low then 0.34 else 0.48 end
         when indirect then case when low then 0.36 else 0.44 end
         else case when low then 0.06 else 0.12 end end::double as relevance_score,
    case when is_target and direct then 'Directly Related'
         when is_target or indirect then 'Indirectly Related' else 'Unrelated' end as category,
    case when is_target and direct then
           'Article contains company-specific, near-term catalyst '
           || '(earnings/regulatory/transaction) likely to move ' || target || ' next week.'
         when is_target or indirect then
           'Mentions ' || target || ' or sector/peer factors with plausible but weaker '
           || 'near-term impact on ' || target || '.'
         else 'General market or unrelated content with no expected near-term effect on '
           || target || '.' end as rationale
  from tested)
"""

_QUOTED = "'[\"''][^\"'']{10,180}[\"'']'"


def _span(expression: str) -> str:
    cut = f"regexp_replace(substr({expression}, 1, 160), '[\\s\\p{{Z}}]+$', '') || '…'"
    fitted = f"case when length({expression}) > 160 then {cut} else {expression} end"
    return f"replace({fitted}, chr(34), chr(34) || chr(34))"


def _stripped(expression: str) -> str:
    return f"regexp_replace({expression}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _window(field: str) -> str:
    located = "'(?s)^(.*?)(?-s)((?:' || snippet_re || '))'"
    start = f"length(regexp_extract({field}, {located}, 1))"
    size = f"length(regexp_extract({field}, {located}, 2))"
    left = f"greatest({start} - 40, 0)"
    return f"substr({field}, {left} + 1, {start} + {size} + 40 - {left})"


EVIDENCE = f"""
{RELEVANCE},
branch as (
  select *, case when is_target and direct then direct_re when is_target then alias_re
                 when indirect then indirect_re else '.+' end as snippet_re
  from relevance),
windows as (
  select *,
    case when regexp_matches(headline, snippet_re) then {_stripped(_window('headline'))} end as h,
    case when (is_target or indirect) and regexp_matches(summary, snippet_re)
         then {_stripped(_window('summary'))} end as s,
    list_concat(regexp_extract_all(headline, {_QUOTED}), regexp_extract_all(summary, {_QUOTED}))
      as quoted,
    nullif({_stripped('headline')}, '') as whole_headline,
    nullif({_stripped('summary')}, '') as whole_summary
  from branch),
spans as (
  select *,
    list_concat(
      list_transform(quoted, lambda q: case
        when starts_with(q, chr(34)) and ends_with(q, chr(34)) then substr(q, 2, length(q) - 2)
        else q end),
      list_filter([{_span('h')}, {_span('s')}], lambda x: x is not null))[1:3] as found,
    {_span('coalesce(whole_headline, whole_summary)')} as fallback
  from windows),
evidence as (
  select *, case when len(found) > 0 then found when fallback is not null then [fallback]
                 else []::varchar[] end as spans
  from spans)
"""

DAILY_INPUTS = f"{NEWS}, {LABELLED}, {TRUST}, {RELEVANCE}"


def _daily(mean_from: str) -> str:
    return f"""
select ticker, date,
       case when sum(abs(x2) * abs(x3)) > 0
            then round_even(sum(x1 * pow(x2, 2.0) * pow(x3, 1.5) * abs(x2) * abs(x3))
                            / sum(abs(x2) * abs(x3)), {DIGITS}) else 0.0 end as Final_Sentiment,
       count(*) as Num_News, round_even(avg(x2), {DIGITS}) as Avg_Relevance,
       round_even(avg(x3), {DIGITS}) as Avg_Trustfulness,
       round_even(avg(x1), {DIGITS}) as Avg_Directional
from {mean_from} group by ticker, date
"""


_BY_DATE = """(
  select l.ticker, l.date, l.directional_sentiment::double as x1, r.relevance_score as x2,
         t.x3_factor as x3
  from labelled l join relevance r on l.ticker = r.ticker and l.date = r.date
       join trust t on l.ticker = t.ticker and l.date = t.date)"""

ARTICLES = """
articles as (
  select l.ticker, l.ord, l.date, l.directional_sentiment::double as x1, r.relevance_score as x2,
         t.x3_factor as x3
  from labelled l join relevance r using (ticker, ord) join trust t using (ticker, ord))
"""

# Sequential keep-first over the articles that have an earlier candidate or are one.
WALK = """
nodes as (
  select ticker, o, row_number() over (partition by ticker order by o) as k
  from (select ticker, late as o from edges union select ticker, early from edges)),
steps as (
  select n.ticker, n.o, n.k, coalesce(list(e.early) filter (e.early is not null), []) as early
  from nodes n left join edges e on e.ticker = n.ticker and e.late = n.o group by all),
walk(ticker, k, kept) as (
  select distinct ticker, 0::bigint, []::bigint[] from nodes
  union all
  select w.ticker, s.k, case when list_has_any(w.kept, s.early) then w.kept
                             else list_append(w.kept, s.o) end
  from walk w join steps s on s.ticker = w.ticker and s.k = w.k + 1),
survivors as (
  select ticker, unnest(kept) as o from walk
  qualify row_number() over (partition by ticker order by k desc) = 1),
dropped as (select ticker, o from nodes except select ticker, o from survivors)
"""

_COMPARABLE = """
ordered as (
  select ticker, ord, date, headline, source, summary, length(summary) as size,
         row_number() over (partition by ticker order by date, ord) as o
  from news)
"""

ROLLING = f"""
{NEWS}, {_COMPARABLE},
items as (select x.*, e.embedding from ordered x join embeddings e on e.vec_id = x.ord),
edges as (
  select i.ticker, i.o as late, j.o as early
  from items i join items j
    on i.ticker = j.ticker and j.o < i.o and i.date - j.date <= 3 and i.size <= j.size
   and list_cosine_similarity(i.embedding, j.embedding) >= {ROLLING_COSINE}),
{WALK}
"""


def _tfidf(text: str) -> str:
    return f"""
terms as (
  select ticker, ord, term, count(*) as tf
  from (select ticker, ord, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))
          as term from news)
  group by all),
vocab as (
  select t.ticker, term, ln((n + 1) / (count(*) + 1)) + 1 as idf
  from terms t join (select ticker, count(*) as n from news group by ticker) d using (ticker)
  group by t.ticker, term, n),
weights as (
  select ticker, ord, term,
         tf * idf / sqrt(sum((tf * idf) * (tf * idf)) over (partition by ticker, ord)) as w
  from terms join vocab using (ticker, term))
"""


_SPACES = "[\\s\\p{Z}]"
_COMPARISON = (
    "trim(regexp_replace(regexp_replace(lower(headline || ' ' || summary), "
    f"'^(breaking|update|live|market alert):{_SPACES}*', ''), '{_SPACES}+', ' ', 'g'))"
)

ROLLING_TEXT = f"""
{NEWS}, {_COMPARABLE}, {_tfidf(_COMPARISON)},
edges as (
  select i.ticker, i.o as late, j.o as early
  from ordered i join ordered j
    on i.ticker = j.ticker and j.o < i.o and i.date - j.date <= 3 and i.size <= j.size
  join weights a on a.ticker = i.ticker and a.ord = i.ord
  join weights b on b.ticker = j.ticker and b.ord = j.ord and b.term = a.term
  group by i.ticker, i.o, j.o having sum(a.w * b.w) >= 0.7 - 1e-9),
{WALK}
"""

WEEKLY = f"""
{NEWS}, {_tfidf("headline || ' ' || summary")},
dated as (select ticker, ord, date_trunc('week', date) as week,
                 length(headline) + length(summary) as size from news),
links as (
  select i.ticker, i.ord as a, j.ord as b
  from dated i join dated j on i.ticker = j.ticker and i.week = j.week and i.ord <> j.ord
  join weights x on x.ticker = i.ticker and x.ord = i.ord
  join weights y on y.ticker = j.ticker and y.ord = j.ord and y.term = x.term
  group by i.ticker, i.ord, j.ord having sum(x.w * y.w) > 0.7 + 1e-9),
reach(ticker, a, b) as (
  select ticker, ord, ord from dated
  union
  select r.ticker, r.a, l.b from reach r join links l on l.ticker = r.ticker and l.a = r.b),
placed as (select ticker, a as ord, min(b) as component from reach group by ticker, a)
"""

PRICES = (
    "prices as (select ts::date as date, case event_type "
    + " ".join(f"when '{event}' then '{symbol}'" for event, symbol in ROLES.items())
    + " end as symbol, avg(value) as adj_close from events group by all)"
)


def _change(series: str) -> str:
    return f"({series} / nullif(lag({series}) over (order by date), 0) - 1) * 100"


def _factors(smb: str, hml: str) -> str:
    def filled(value: str, name: str) -> str:
        return (
            f"last_value({value} ignore nulls) over (order by date rows between unbounded "
            f"preceding and current row) as {name}"
        )

    return f"""
{PRICES},
wide as (
  select date, max(adj_close) filter (symbol = 'SPY') as spy,
         max(adj_close) filter (symbol = 'IWM') as iwm, max(adj_close) filter (symbol = 'IWD') as iwd,
         max(adj_close) filter (symbol = 'IWF') as iwf, max(adj_close) filter (symbol = 'IRX') as irx
  from prices where symbol is not null group by date),
series as (
  select date, irx, {filled('spy', 'market')}, {filled('iwm', 'small')}, {filled('iwd', 'val')},
         {filled('iwf', 'growth')}, {filled('iwm - spy', 'size_gap')},
         {filled('iwd - iwf', 'style_gap')}
  from wide),
factors as (
  select * from (
    select date, {_change('market')} - irx / 365 as mkt_rf, {smb} as smb, {hml} as hml,
           irx / 365 as rf from series)
  where mkt_rf is not null and smb is not null and hml is not null and rf is not null)
"""


FACTORS = _factors(_change("size_gap"), _change("style_gap"))
RETURN_DIFF = _factors(
    f"{_change('small')} - {_change('market')}", f"{_change('val')} - {_change('growth')}"
)


def _factor_rows(digits: int) -> str:
    columns = ", ".join(f"round_even({c}, {digits}) as {c}" for c in ("mkt_rf", "smb", "hml", "rf"))
    return f"select date, {columns} from factors"


QUOTA = f"""
months as (
  select ticker, date_trunc('month', date)::date as month, count(*) as num_rows,
         min(ord) as first_ord
  from news group by all),
ranked as (
  select *, row_number() over (partition by ticker order by first_ord, month)::int as month_rank,
         count(*) over (partition by ticker) as num_months,
         sum(num_rows) over (partition by ticker)::bigint as ticker_rows,
         {SAMPLE_ROWS}::int as n_total
  from months),
sized as (
  select * exclude (first_ord), n_total >= ticker_rows as whole,
         n_total // num_months
           + case when month_rank <= n_total % num_months then 1 else 0 end as quota
  from ranked),
quotas as (
  select *, least(quota, num_rows) as first_take,
         (n_total - sum(least(quota, num_rows)) over (partition by ticker))::bigint as gap
  from sized)
"""

_K = (0, 1, 2)


def _each(template: str) -> str:
    return ", ".join(template.replace("@", str(k)) for k in _K)


CLASSIFIER = f"""
{NEWS}, {LABELLED},
examples as (
  select *, directional_sentiment + 1 as label,
         left(md5(ticker || ':' || ord), 2) < '1a' as held_out
  from labelled),
news_words as (
  select ticker, ord,
         unnest(regexp_extract_all(lower(headline || ' ' || summary), '[\\p{{L}}\\p{{N}}_]+')) as word
  from news),
counts as (
  select ticker, word, {_each('count_if(label = @)::bigint as n@')}
  from examples join news_words using (ticker, ord) where not held_out group by all),
sizes as (
  select ticker, {_each('count_if(label = @) as r@')} from examples where not held_out group by all),
totals as (
  select ticker, {_each('sum(n@) as t@')}, count(*) as vocabulary from counts group by all),
found as (
  select ticker, ord, sum(times) as length, {_each('sum(times * ln(n@ + 1)) as s@')}
  from (select ticker, ord, word, count(*) as times from news_words group by all)
  join counts using (ticker, word) group by all),
scored as (
  select n.ticker, n.ord,
         {_each("case when r@ > 0 then round(ln(r@ / (r0 + r1 + r2)) + coalesce(s@, 0) - coalesce(length * ln(t@ + vocabulary), 0), 6) else '-infinity'::double end as c@")}
  from news n join sizes using (ticker) left join totals using (ticker)
  left join found using (ticker, ord)),
guesses as (
  select ticker, ord, case when c0 >= c1 and c0 >= c2 then 0 when c1 >= c2 then 1 else 2 end as label
  from scored)
"""

ORACLE: dict[str, str] = {
    "clean_news": f"""with {MARKED}
select ticker, ord, date, headline, source, summary from marked where reject_reason is null""",
    "clean_rejects": f"""with {MARKED}
select ticker, ord, raw_date, source, reject_reason from marked where reject_reason is not null""",
    "clean_counts": f"""with {MARKED}
select ticker, coalesce(reject_reason, 'kept') as outcome, count(*) as num_rows
from marked group by all""",
    "integrity_report": f"""with {NEWS}
select ticker, count(*) as num_rows, count_if(date is null)::bigint as null_date,
       count_if(headline is null)::bigint as null_headline, count_if(summary is null)::bigint as null_summary,
       count_if(contains(upper(headline), '#NAME?') or contains(upper(summary), '#NAME?'))
         ::bigint as placeholder,
       count(*) - count(distinct headline) as duplicate_headline,
       count(*) - count(distinct summary) as duplicate_summary
from news group by ticker""",
    "comparison_text": f"with {NEWS} select ticker, ord, {_COMPARISON} as text from news",
    "trust_scores": f"""with {NEWS}, {TRUST}
select ticker, ord, source, x3_factor,
       round_even(avg(x3_factor) over (partition by ticker), {DIGITS}) as x3_factor_avg
from trust""",
    "trust_preview": f"""with {NEWS}, {TRUST}
select ticker, date, ord, source, x3_factor,
       round_even(avg(x3_factor) over (partition by ticker), {DIGITS}) as x3_factor_avg
from trust order by ticker, date, ord limit 5""",
    "trust_overall": f"""with {NEWS}, {TRUST}
select round_even(avg(x3_factor), {DIGITS}) as avg_x3_factor from trust""",
    "relevance_scores": f"""with {NEWS}, {RELEVANCE}
select ticker, ord, date, relevance_score, category, rationale from relevance""",
    "relevance_evidence": f"""with {NEWS}, {EVIDENCE}
select ticker, ord, strftime(date, '%Y-%m-%d') as date,
       printf('%.2f', relevance_score) as relevance_score, category, rationale,
       '[' || array_to_string(list_transform(spans, lambda x: to_json(x)::varchar), ', ') || ']'
         as evidence_spans
from evidence""",
    "sample_quota": f"with {NEWS}, {QUOTA} select * from quotas",
    "stratified_sample": f"""with {NEWS}, {QUOTA},
hashed as (
  select ticker, ord, date_trunc('month', date)::date as month,
         md5('42|' || ticker || '|' || ord) as h from news),
first_pass as (
  select h.ticker, h.ord, h.h, gap,
         whole or row_number() over (partition by h.ticker, h.month order by h.h) <= quota as taken
  from hashed h join quotas using (ticker, month)),
second_pass as (
  select *, row_number() over (partition by ticker, taken order by h) as place from first_pass)
select ticker, ord, case when taken then 'quota' else 'gap' end as taken_by
from second_pass where taken or place <= gap""",
    "chunk_numbers": f"""with {NEWS},
numbered as (
  select *, row_number() over (partition by ticker order by date, ord) as number from news)
select ticker, ((number - 1) // 100 + 1)::int as chunk, number,
       coalesce(headline, 'nan') || ' ' || coalesce(summary, 'nan') as text
from numbered""",
    "positional_combine": f"""with {NEWS}, {LABELLED},
s as (select *, row_number() over (partition by ticker order by date, ord) as k from labelled),
l as (select ticker, directional_sentiment,
             row_number() over (partition by ticker order by ord) as k from labelled)
select s.ticker, s.ord, s.date, l.directional_sentiment from s join l using (ticker, k)""",
    "label_override": f"""with {NEWS}, {LABELLED},
truth as (
  select ticker, date, headline, summary, arg_min(directional_sentiment, ord) as label
  from labelled group by all)
select n.ticker, n.ord, n.date,
       coalesce(t.label, length(n.headline) % 3 - 1)::int as directional_sentiment
from news n left join truth t on t.ticker = n.ticker and t.date = n.date
     and t.headline = n.headline and t.summary = n.summary""",
    "label_passthrough": f"""with {NEWS}, {LABELLED}
select ticker, ord, date, directional_sentiment from labelled""",
    "label_codes": f"""with {NEWS}, {LABELLED}
select ticker, ord, directional_sentiment, directional_sentiment + 1 as code,
       directional_sentiment as decoded from labelled""",
    "rolling_dedup": f"""with recursive {ROLLING}
select ticker, ord, date from ordered x
where not exists (from dropped d where d.ticker = x.ticker and d.o = x.o)""",
    "rolling_dedup_text": f"""with recursive {ROLLING_TEXT}
select ticker, ord, date from ordered x
where not exists (from dropped d where d.ticker = x.ticker and d.o = x.o)""",
    "rolling_counts": f"""with recursive {ROLLING},
gone as (select ticker, count(*) as n from dropped group by ticker)
select ticker, count(*) as input_rows, count(*) - coalesce(max(g.n), 0) as output_rows,
       coalesce(max(g.n), 0) as removed_rows
from ordered left join gone g using (ticker) group by ticker""",
    "weekly_tfidf_dedup": f"""with recursive {WEEKLY}
select ticker, ord, component from placed join dated using (ticker, ord)
qualify row_number() over (partition by ticker, component order by size desc, ord) = 1""",
    "daily_sentiment_date": f"with {DAILY_INPUTS} {_daily(_BY_DATE)}",
    "daily_sentiment_article": f"with {DAILY_INPUTS}, {ARTICLES} {_daily('articles')}",
    "daily_overall": f"""with {DAILY_INPUTS}, {ARTICLES}, daily as ({_daily('articles')})
select ticker, count(*) as num_days,
       round_even(avg(Final_Sentiment), {DIGITS}) as avg_final_sentiment
from daily group by ticker""",
    "composite_score": f"""with {DAILY_INPUTS}, {ARTICLES}
select ticker, ord, round_even(x2 * (x1 + x3) / 2, {DIGITS}) as equal_score,
       round_even(x2 * (3 * x1 + x3) / 4, {DIGITS}) as weighted_score
from articles""",
    "direction_bands": f"""with {DAILY_INPUTS}, {ARTICLES}
select ticker, ord,
       case when x1 * x3 >= 0.6 then 'Bullish' when x1 * x3 <= -0.6 then 'Bearish'
            else 'Neutral' end as direction,
       case when x2 >= 0.7 then 'Directly related' when x2 >= 0.3 then 'Indirectly related'
            else 'Neutral' end as relevance
from articles""",
    "classifier_split": f"with {CLASSIFIER} select ticker, ord, label, held_out from examples",
    "classifier_words": f"with {CLASSIFIER} select ticker, word, n0, n1, n2 from counts",
    "classifier_guesses": f"with {CLASSIFIER} select ticker, ord, label from guesses",
    "classifier_scores": f"""with {CLASSIFIER},
truth as (
  select ticker, date, headline, summary, arg_min(directional_sentiment, ord) as label
  from labelled group by all)
select n.ticker, n.ord, n.date, coalesce(t.label, g.label - 1)::int as directional_sentiment
from news n join guesses g using (ticker, ord)
left join truth t on t.ticker = n.ticker and t.date = n.date
     and t.headline = n.headline and t.summary = n.summary""",
    "classifier_metrics": f"""with {CLASSIFIER},
pairs as (
  select ticker, e.label as truth, g.label from examples e join guesses g using (ticker, ord) where held_out),
sides as (
  select ticker, k, count_if(truth = k and label = k) as hits, count_if(truth = k) as wanted,
         count_if(label = k) as given
  from pairs, (select unnest([0, 1, 2]) as k) group by all)
select ticker, sum(wanted)::bigint as num_rows, round_even(sum(hits) / sum(wanted), {DIGITS}) as accuracy,
       round_even(avg(case when wanted + given > 0 then 2 * hits / (wanted + given) end), {DIGITS}) as f1
from sides group by ticker""",
    "clean_news_titles": f"""with {MARKED}
select ticker, ord, date, headline, source, summary from marked where reject_reason is null""",
    "date_spellings": f"""with {NEWS}
select ticker, ord, case when ord % {len(DATE_SPELLINGS) + 1} < {len(DATE_SPELLINGS)} then date end as date from news""",
    "rules_missing": f"""with {NEWS}
select ticker, count(*) as num_rows from news where ticker = 'es' group by ticker""",
    "relevance_skipped": f"""with {NEWS}, {RELEVANCE}
select ticker, ord, date, relevance_score, category, rationale from relevance where ticker = 'de'""",
    "count_mismatches": f"""with {NEWS}, {LABELLED}
select ticker, count(*) as left_rows, count(directional_sentiment) as right_rows
from news left join (select ticker, ord, directional_sentiment from labelled) using (ticker, ord)
group by ticker having count(*) <> count(directional_sentiment)""",
    "positional_skip": f"""with {NEWS}, {LABELLED},
s as (select *, row_number() over (partition by ticker order by date, ord) as k from labelled),
l as (select ticker, directional_sentiment,
             row_number() over (partition by ticker order by ord) as k from labelled)
select s.ticker, s.ord, s.date, l.directional_sentiment from s join l using (ticker, k)
where ticker <> 'fr'""",
    "factor_proxies": f"with {FACTORS} {_factor_rows(DIGITS)}",
    "factor_return_diff": f"with {RETURN_DIFF} {_factor_rows(DIGITS)}",
    "factor_last_days": f"with {FACTORS} {_factor_rows(4)} order by date desc limit 15",
    "factor_summary": f"""with {FACTORS}
select min(date) as first_day, max(date) as last_day, count(*) as num_days from factors""",
}


def _loadings() -> str:
    """Ordinary least squares by its sums: three equations solved by determinants, here in the query."""
    names = ["mkt_rf", "smb", "hml"]

    def determinant(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    matrix = [[f"covar_pop({a}, {b})" for b in names] for a in names]
    against = [f"covar_pop({a}, y)" for a in names]
    betas = [
        "case when count(*) >= 5 and "
        f"{determinant(matrix)} > 1e-12 * var_pop(mkt_rf) * var_pop(smb) * var_pop(hml) then "
        + determinant([[against[r] if c == k else matrix[r][c] for c in range(3)] for r in range(3)])
        + f" / {determinant(matrix)} end"
        for k in range(3)
    ]
    fitted = ", ".join(f"{b} as beta_{n}, avg({n}) as m_{n}, covar_pop({n}, y) as c_{n}" for b, n in zip(betas, names))
    alpha = "m_y - " + " - ".join(f"beta_{n} * m_{n}" for n in names)
    share = "(" + " + ".join(f"beta_{n} * c_{n}" for n in names) + ") / v_y"
    columns = ", ".join(f"round_even(beta_{n}, 6) as beta_{n}" for n in names)
    return f"""with {NEWS}, {LABELLED}, {TRUST}, {RELEVANCE}, {ARTICLES}, daily as ({_daily('articles')}),
{FACTORS.strip().removeprefix('with ')},
days as (select ticker, Final_Sentiment as y, mkt_rf, smb, hml from daily join factors using (date)),
fits as (select ticker, count(*) as num_days, avg(y) as m_y, var_pop(y) as v_y, {fitted} from days group by ticker)
select ticker, num_days, round_even({alpha}, 6) as alpha, {columns}, round_even({share}, 6) as r_squared from fits"""


ORACLE["factor_loadings"] = _loadings()


def _daily_signal() -> str:
    """Cleaning, rolling dedup and scoring in one statement."""
    start = MARKED.replace("\nnews as (", "\nsource_news as (", 1).replace("from news)", "from source_news)", 1)
    cleaned = "clean_news as (select ticker, ord, date, headline, source, summary " \
        "from marked where reject_reason is null)"
    rolled = ROLLING.replace(NEWS, "").replace("from news)", "from clean_news)").strip().lstrip(",")
    kept = "news as (select x.* exclude (size, o) from ordered x where not exists " \
        "(from dropped d where d.ticker = x.ticker and d.o = x.o))"
    known = LABELLED.replace("from news n", "from source_news n")
    return f"with recursive {start}, {cleaned}, {rolled}, {kept}, {known}, {TRUST}, " \
        f"{RELEVANCE}, {ARTICLES} {_daily('articles')}"


ORACLE["daily_signal"] = _daily_signal()
# The same results whatever the size of the tiles.
for _tiled, _whole in (
    ("rolling_dedup_tiled", "rolling_dedup"), ("rolling_text_tiled", "rolling_dedup_text"), ("weekly_tiled", "weekly_tfidf_dedup"),
):
    ORACLE[_tiled] = ORACLE[_whole]
