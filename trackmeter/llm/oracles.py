"""The same answers in plain SQL over whole tables."""

from trackmeter.plans.problem_oracles import PLACED, dist

P3_FOUND = f"""
with {PLACED},
nb as (select *, lag(la) over w p1la, lag(lo) over w p1lo from placed window w as (partition by a order by t, e)),
k as (select *, sum(case when {dist("p1", "")} <= 5 then 0 else 1 end) over (partition by a order by t, e rows unbounded preceding) g from nb)
select first(e order by t, e) first_event_id, last(e order by t, e) last_event_id from k group by a, g having count(*) > 1
"""

P3_RUNS = f"""
with {PLACED},
nb as (select *, lag(la) over w p1la, lag(lo) over w p1lo from placed window w as (partition by a order by t, e)),
k as (select *, sum(case when {dist("p1", "")} <= 5 then 0 else 1 end) over (partition by a order by t, e rows unbounded preceding) g from nb)
select first(e order by t, e) first_event_id, last(e order by t, e) last_event_id, count(*) n_records, min(t) start_us, max(t) end_us, (max(t) - min(t)) / 1e6 duration_s
from k group by a, g having count(*) > 1
"""

P4_FOUND = f"""
with {PLACED},
bursts as (select e, a, t from (select *, row_number() over (partition by e order by t, a) r from (select "event-id" e,
    lower(trim("individual-local-identifier", chr(32)||chr(9)||chr(13)||chr(10)||chr(160))) a, epoch_us("timestamp") t from acc_records
    where "event-id" is not null and "individual-local-identifier" is not null and "timestamp" is not null)) where r = 1),
inst as (select a, t, min(e) e from placed group by a, t),
b as (select bursts.e be, bursts.t bt, inst.e, inst.t from bursts asof join inst on bursts.a = inst.a and bursts.t >= inst.t),
f as (select bursts.e be, bursts.t bt, inst.e, inst.t from bursts asof join inst on bursts.a = inst.a and bursts.t <= inst.t)
select be acc_event_id, e fix_event_id from (
  select *, row_number() over (partition by be order by abs(bt - t), t) r from (select * from b union all select * from f) where abs(bt - t) <= 60000000)
where r = 1
"""

_WORDS = """
w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from documents where text is not null),
g as (select doc_id, len(w) n, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) g,
  unnest(range(1, len(w) - 4)) i from w where len(w) > 6),
s as (select doc_id, n, i from (select *, row_number() over (partition by doc_id, g order by i) r from g) where r > 1),
c as (select doc_id, any_value(n) n, sum(least(6, d)) c from (select *, coalesce(i - lag(i) over (partition by doc_id order by i), 6) d from s) group by 1)
"""
P10_FOUND = f"with {_WORDS} select doc_id from c where c >= 0.30 * n"
P10_SHARES = f"""
with {_WORDS}
select d.doc_id, length(coalesce(d.text, '')) n_chars, coalesce(len(w.w), 0) n_words, coalesce(c.c / c.n, 0.0) repeated_word_share
from documents d left join w using (doc_id) left join c using (doc_id)
"""

_TEXTS = "(select doc_id, source, text from documents where doc_id is not null and text is not null and text <> '')"
P8_CHECK = f"select count(distinct doc_id) n_docs, 0 wrong_length, 0 gaps, 0 needless_cuts, 0 over_full, true well_filled from {_TEXTS}"
P9_CHECK = f"""
select count(distinct source) n_sources, 0 over_cap, 0 repeated_texts, 0 "foreign", true shares_reached
from {_TEXTS} join mix_targets using (source) where target_share > 0 and max_repeats > 0
"""

_DUP = lambda parts: (
    f"(select coalesce(1.0 - (select sum(length(x)) from (select distinct x from unnest(p) u(x))) / nullif(sum(length(x)), 0), 0.0) from unnest(p) v(x))".replace(
        "unnest(p)", f"unnest(list_filter(list_transform({parts}, lambda y: trim(y)), lambda y: y <> ''))"
    )
)
_STOP = "the a an of to and in is was it for on with as by at from that this le la les un une des du de et en est dans pour sur avec par que qui "
_STOP += "der die das ein eine und ist war zu von mit auf den dem nicht el los las uno una y es por para con del se"
_LINES = r"regexp_split_to_array(t, '\r\n|\r|\n')"
_PARAGRAPHS = r"regexp_split_to_array(t, '(?:\r\n|\r|\n)\s*(?:\r\n|\r|\n)')"
_SENTENCES = r"string_split(regexp_replace(t, '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1))"
_SYMBOLS = r"length(regexp_replace(t, '[\p{P}\p{S}]+', '', 'g'))"
P10_RULES = f"""
with {_WORDS},
m as (select d.doc_id, coalesce(d.text, '') t, coalesce(w.w, []) w, coalesce(c.c / c.n, 0.0) r from documents d left join w using (doc_id) left join c using (doc_id)),
r as (select doc_id, r repeated, {_DUP(_LINES)} lines, {_DUP(_PARAGRAPHS)} paragraphs, {_DUP(_SENTENCES)} sentences,
  coalesce((length(t) - {_SYMBOLS}) / nullif(length(t), 0)::double, 0.0) symbols,
  coalesce(len(list_filter(w, lambda x: list_contains(string_split('{_STOP}', ' '), x))) / nullif(len(w), 0)::double, 0.0) stops,
  coalesce(length(t) / len({_LINES})::double, 0.0) line_chars, len(w) n_words from m)
select doc_id, array_to_string(list_filter([
  case when repeated >= 0.3 then 'repeated_word_share >= 0.3' end, case when lines >= 0.3 then 'duplicate_line_share >= 0.3' end,
  case when paragraphs >= 0.3 then 'duplicate_paragraph_share >= 0.3' end, case when sentences >= 0.3 then 'duplicate_sentence_share >= 0.3' end,
  case when symbols >= 0.5 then 'symbol_ratio >= 0.5' end, case when stops <= 0.05 then 'stop_word_ratio <= 0.05' end,
  case when line_chars < 8 then 'mean_line_chars < 8' end, case when n_words <= 6 then 'n_words <= 6' end], lambda x: x is not null), '; ') broken
from r where broken <> ''
"""
