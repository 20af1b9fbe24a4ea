"""Summaries, reports and surveys in plain SQL over whole tables."""

from __future__ import annotations

from itertools import permutations

from trackmeter.functions.stats import ERFC
from trackmeter.operators.conformance import CANON, MISSING
from trackmeter.operators.declare import FAMILIES
from trackmeter.operators.sheets import METHOD
from trackmeter.plans.bench_oracles import _AVG_RANK, _BLANKS, _PTS, _ISO, _dec, _rx, DATED, PAIRS, QUALITY, SAMPLES, SCAN, SHEETS, pairs, utm_sql
from trackmeter.plans.bench_queries import MERIDIAN
from trackmeter.plans.problem_oracles import _PARSED, dist
from trackmeter.plans.report_queries import LEAST_FIXES, LEAST_ROWS, STAR


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def _tail(z: str) -> str:
    fit = repr(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        fit = f"({fit} * tt + {c})"
    return f"(select case when {z} >= 0 then q when {z} < 0 then 1 - q end from (select tt * exp(-pow(abs({z}) / sqrt(2), 2) + {fit}) / 2 q from (select 1 / (1 + abs({z}) / sqrt(2) / 2) tt)))"


_RATES = f"""{DATED}, bg as (select a from tr group by 1 having count(*) >= 50), {pairs("(select * from tr where a in (select a from bg))")},
tp as (select *, ({dist("p2", "p1")} + d - {dist("p2", "")}) / 2 x from pr where p2la is not null),
yd as (select a, quantile_cont(d, 0.95) y from pr where d is not null group by a having quantile_cont(d, 0.95) > 0),
sr as (select a, 100 * sum((x > 10 * y)::int) / count(*) p from tp join yd using (a) group by 1),
sn as (select a, lower(sensor) s, count(*) n from tr group by 1, 2), mx as (select a, s from (select *, row_number() over (partition by a order by n desc, s desc) r from sn) where r = 1),
ql as (select p, s from sr join mx using (a))"""


def _labels(name: str, low: str) -> str:
    return f"""l_{name} as (select p, case when s in ({low}) then 0 when s = 'argos-doppler-shift' then 1 end h from ql where s in ({low}, 'argos-doppler-shift')),
k_{name} as (select *, {_AVG_RANK.format("p")} r, count(*) over (partition by p) c from l_{name}),
s_{name} as (select coalesce(sum(h), 0) n1, coalesce(sum(1 - h), 0) n2, sum(h * r) rs, sum((c * c - 1)::double) ties, quantile_cont(p, 0.5) filter (h = 1) m1, quantile_cont(p, 0.5) filter (h = 0) m2 from k_{name}),
z_{name} as (select *, rs - n1 * (n1 + 1) / 2 u, (rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))), 0) z from s_{name})"""


def _report(name: str, shown: str) -> str:
    return f"""select '{shown}' labels, n1 n_high, n2 n_low, round(m1, 6) median_high, round(m2, 6) median_low, u, round(z, 4) z, round({_tail("z")}, 6) p from z_{name}"""


def _det(rows: list[list[str]]) -> str:
    """The determinant of a matrix of SQL terms."""
    terms = []
    for order in permutations(range(len(rows))):
        swaps = sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order)))
        terms.append(("-" if swaps % 2 else "+") + "*".join(rows[i][j] for i, j in enumerate(order)))
    return "(0" + "".join(terms) + ")"


_M = [["4*xx", "4*xy", "4*xz", "2*x"], ["4*xy", "4*yy", "4*yz", "2*y"], ["4*xz", "4*yz", "4*zz", "2*z"], ["2*x", "2*y", "2*z", "n"]]
_V = ["2*xq", "2*yq", "2*zq", "q"]
_COLUMN = lambda k: _det([[_V[i] if j == k else _M[i][j] for j in range(4)] for i in range(4)])
CALIBRATION = f"""{SAMPLES},
cc as (select entity, avg(ax_mean) mx, avg(ay_mean) my, avg(az_mean) mz from mn group by 1 having count(*) >= 20),
cd as (select entity, mx, my, mz, ax_mean - mx x, ay_mean - my y, az_mean - mz z from mn join cc using (entity)),
cq as (select *, x * x + y * y + z * z q from cd),
cm as (select entity, count(*)::double n, sum(x) x, sum(y) y, sum(z) z, sum(x * x) xx, sum(y * y) yy, sum(z * z) zz, sum(x * y) xy, sum(x * z) xz, sum(y * z) yz, sum(q) q,
  sum(x * q) xq, sum(y * q) yq, sum(z * q) zq, max(mx) mx, max(my) my, max(mz) mz from cq group by 1),
cs as (select *, {_det(_M)} dt, {_COLUMN(0)} d0, {_COLUMN(1)} d1, {_COLUMN(2)} d2, {_COLUMN(3)} d3 from cm),
cf as (select entity, n::bigint n_bursts, d0 / dt + mx off_x, d1 / dt + my off_y, d2 / dt + mz off_z,
  sqrt(greatest(d3 / dt + pow(d0 / dt, 2) + pow(d1 / dt, 2) + pow(d2 / dt, 2), 1e-9)) counts_per_g from cs),
cr as (select entity, 100 * stddev_pop(sqrt(pow(ax_mean - off_x, 2) + pow(ay_mean - off_y, 2) + pow(az_mean - off_z, 2))) / max(counts_per_g) residual_pct from mn join cf using (entity) group by 1)
"""

_GRAIN = f"""{QUALITY}, gd as (select a entity, floor(quantile_cont({_dec("la")}, 0.5))::int decimals_lat from tr group by 1),
gs as (select a entity, min(abs(la - p1la)) * 111320 least_step_m from pr where abs(la - p1la) > 0 group by 1),
gp as (select a entity, quantile_cont(dt, 0.5) gap_median_s, quantile_cont(dt, 0.95) gap_p95_s from pr where dt > 0 group by 1),
gq as (select q.* exclude (decimals_lat), gd.decimals_lat, least_step_m, gap_median_s, gap_p95_s,
  case when least_step_m is null then 'unknown size' else printf('%.0f m', least_step_m) end metres from q join gd using (entity) left join gs using (entity) left join gp using (entity)),
gr as (select *, case when decimals_lat is null then 'not measured' when decimals_lat >= 6 then 'precision preserved' when decimals_lat = 5 then 'acceptable grain'
    else 'truncated at export, grid of about ' || metres end read_grain,
  case when pct_spikes is null then 'not measured' when pct_spikes < 0.01 then 'nothing notable' when pct_spikes < 0.05 then 'a few isolated outliers' else 'high rate' end read_spikes,
  case when pct_repeated is null then 'not measured' when pct_repeated < 1 then 'nothing notable' when pct_repeated < 5 then 'frequent repeats' else 'major share without a new position' end read_repeats,
  list_filter([case when decimals_lat <= 4 then 'Any analysis finer than ' || metres end, case when pct_repeated > 5 then 'Counts of fixes as a measure of effort' end,
    case when pct_spikes > 0.05 then 'Path length without a filter' end, case when regular_pct < 60 then 'Distances compared between individuals without resampling' end], lambda x: x is not null) lim from gq),
gl as (select *, case when len(lim) > 0 then lim else ['None found by these tests'] end limits from gr)
"""
_DUR = lambda s: f"case when {s} is null then 'unknown' when {s} < 90 then printf('%.0f s', round({s}::double)) when {s} < 5400 then printf('%.0f min', round({s} / 60)) when {s} < 172800 then printf('%.1f h', round({s} / 3600, 1)) else printf('%.1f d', round({s} / 86400, 1)) end"
_ROW = lambda name, value: f"'| {name} | ' || coalesce({value}, 'unknown') || ' |'"
_SHEET = [
    "'# ' || entity", "''", "'Source licence: not declared'", "chr(10) || '| Measure | Value |' || chr(10) || '|---|---|'",
    _ROW("Dominant sensor", "coalesce(sensor, 'not declared')"), _ROW("Fixes", "format('{:,}', n_fixes)"), _ROW("Individuals", "'1'"), _ROW("Span", "printf('%.0f', round(days)) || ' days'"),
    _ROW("Median cadence", _DUR("gap_median_s")), _ROW("Dominant cadence", _DUR("m")), _ROW("Regularity", "printf('%.0f', round(regular_pct)) || ' % of gaps at the dominant cadence'"),
    _ROW("95th percentile of gaps", _DUR("gap_p95_s")), _ROW("Position spikes", "printf('%.3f', pct_spikes) || ' %, ' || read_spikes"),
    _ROW("Repeated positions", "printf('%.2f', pct_repeated) || ' %, ' || read_repeats"), _ROW("Coordinate grain", "decimals_lat::varchar || ' decimals, ' || read_grain"),
    "chr(10) || 'Not supported:' || chr(10)", "'- ' || array_to_string(limits, chr(10) || '- ')", _text(METHOD),
]


def _conformance() -> str:
    places: dict[str, str] = {}
    for src, dst, _ in CANON:
        at = f"nullif(coalesce(list_position(h, '{src}'), 0), 0)"
        places[dst] = f"coalesce({places[dst]}, {at})" if dst in places else at
    gone = ", ".join(f"'{x}'" for x in MISSING)
    low = {dst: f"(case when lower(v[{at}]) in ({gone}) then null else nullif(trim(v[{at}]), '') end)" for dst, at in places.items()}
    number = "'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'"
    uncast = " + ".join(f"coalesce((not regexp_full_match(x_{d}, {number}))::int, 0)" for d in places if d not in ("ts", "device_id"))
    off = " or ".join(f"coalesce(abs(case when regexp_full_match(x_{d}, {number}) then x_{d}::double end) > {m}, false)" for d, m in (("lat", 90), ("lon", 180)))
    dated = "regexp_matches(x_ts, '^[0-9]{1,4}[-/]') and coalesce(try_cast(x_ts as timestamptz)::timestamp, try_strptime(x_ts, '%d/%m/%Y %H:%M:%S'), try_strptime(x_ts, '%d/%m/%Y %H:%M')) is not null"
    twice = " and ".join(f"len(list_filter(h, lambda x: x = '{src}')) < 2" for src, _, _ in CANON)
    return f"""{_PARSED},
    bx as (select b.file_id, len(v) lv, len(h) lh, {", ".join(f"{e} x_{d}" for d, e in low.items())} from (select l.file_id, l.line_no, {_cut("rtrim(line, chr(13)||chr(10))")} v, h from export_lines l join head using (file_id) where line_no > 0 and line is not null) b),
    by_ as (select file_id, sum((lv < lh)::int) short, sum((lv > lh)::int) long_, sum({uncast}) uncast, sum(coalesce((x_ts is not null and not ({dated}))::int, 0)) undated, sum(({off})::int) off_globe from bx group by 1),
    sz as (select file_id, sum((line_no > 0 and line is not null)::int) n_lines, bool_or(trim(coalesce(line, '')) <> '') usable from export_lines where file_id is not null group by 1),
    ls as (select file_id, max(n_records) n_records from export_files group by 1),
    hh as (select file_id, list_contains(h, 'timestamp') and list_contains(h, 'location-lat') and list_contains(h, 'location-long') in_scope, {twice} mapped from head),
    al as (select coalesce(sz.file_id, ls.file_id) file_id, coalesce(n_lines, 0) n_lines, coalesce(usable, false) usable, n_records, in_scope, mapped, coalesce(short, 0) short, coalesce(long_, 0) long_,
      coalesce(uncast, 0) uncast, coalesce(undated, 0) undated, coalesce(off_globe, 0) off_globe from sz full join ls on sz.file_id = ls.file_id
      left join hh on hh.file_id = coalesce(sz.file_id, ls.file_id) left join by_ on by_.file_id = coalesce(sz.file_id, ls.file_id)),
    er as (select *, case when in_scope then short + long_ + uncast + undated + off_globe else 0 end errors, n_lines >= coalesce(n_records, 0) intact from al),
    st as (select *, case when not (usable or not intact) then 'no usable file' when not intact then 'damaged archive' when in_scope is null then 'unreadable' when not in_scope then 'out of scope' when not mapped then 'mapping refused'
      when long_ + uncast + undated > 0 then 'conversion failed' when n_lines = 0 then 'validation failed' when errors > 0 then 'non-conformant' else 'conformant' end status,
      case when not intact then n_lines || ' of ' || n_records || ' lines' when not usable then 'no text' when in_scope is null then 'no header line' when not in_scope then 'neither time nor position among the columns'
      when not mapped then 'a column comes twice' when errors > 0 then array_to_string(list_filter([case when short > 0 then short || ' short lines' end, case when long_ > 0 then long_ || ' long lines' end,
        case when uncast > 0 then uncast || ' values that do not cast' end, case when undated > 0 then undated || ' unreadable times' end, case when off_globe > 0 then off_globe || ' points off the globe' end], lambda x: x is not null), ', ') end detail from er)
    """


def _cut(line: str) -> str:
    from trackmeter.plans.problem_oracles import _CUT

    return _CUT.replace("string_split(replace(line,", f"string_split(replace({line},")


_STATUS = _conformance()


def _ring() -> str:
    e, n = utm_sql("la", "lo")
    edges = list(zip(STAR, STAR[1:] + STAR[:1], strict=True))
    holds = f"abs(la) <= 84 and abs(lo - {MERIDIAN}) <= 80"
    return f"""eg as (select unnest({[a[0] for a, _ in edges]}) x1, unnest({[a[1] for a, _ in edges]}) y1, unnest({[b[0] for _, b in edges]}) x2, unnest({[b[1] for _, b in edges]}) y2),
    xy as (select e, case when {holds} then {e} end x, case when {holds} then {n} end n from tr),
    pd as (select e, x, n, x1, y1, x2, y2, least(1.0, greatest(0.0, ((x - x1) * (x2 - x1) + (n - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) t from xy, eg where x is not null),
    rg as (select e, sum(case when (y1 > n) <> (y2 > n) then (x < (x2 - x1) * (n - y1) / (y2 - y1) + x1)::int else 0 end) % 2 = 1 inside, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(n - (y1 + t * (y2 - y1)), 2))) metres from pd group by 1)"""


_FAM = tuple(FAMILIES)


def _passages(f: str) -> str:
    rx = _rx(f)
    upto = lambda a, n: " + ".join(["0", *[f"coalesce(length({a}[{j}]), 0)" for j in range(1, n + 1)]])
    seen = []
    for k in range(3):
        begin = f"({upto('btw', k + 1)} + {upto('fnd', k)})"
        first = f"greatest({begin} - 90, 0)"
        seen.append(f"case when len(fnd) > {k} then trim(regexp_replace(substr(own, {first} + 1, {begin} + length(fnd[{k + 1}]) + 90 - {first}), '[\\s\\p{{Z}}\\x0B]+', ' ', 'g')) end")
    return f"""(select case when len(fnd) > 0 then array_to_string(list_filter([{", ".join(seen)}], lambda x: x is not null), ' || ') end from
      (select own, regexp_extract_all(own, '{rx}') fnd, regexp_split_to_array(own, '{rx}') btw))"""


_FILES = f"""{_PARSED},
tt as (select distinct file_id, line_no::bigint e, lower(trim(max(x) filter (field = 'individual-local-identifier'))) a0, epoch_us(coalesce(try_cast(max(x) filter (field = 'timestamp') as timestamptz)::timestamp,
  try_strptime(max(x) filter (field = 'timestamp'), '%d/%m/%Y %H:%M:%S'), try_strptime(max(x) filter (field = 'timestamp'), '%d/%m/%Y %H:%M'))) t,
  max(replace(nullif(regexp_extract(x, '^([+-]?[0-9]*[.,]?[0-9]+)\\s*\\pL*(/\\pL+)?$', 1), ''), ',', '.')::double) filter (field = 'location-lat') la,
  max(replace(nullif(regexp_extract(x, '^([+-]?[0-9]*[.,]?[0-9]+)\\s*\\pL*(/\\pL+)?$', 1), ''), ',', '.')::double) filter (field = 'location-long') lo from cell group by 1, 2),
tr as (select file_id, e, file_id || chr(1) || a0 a, t, la, lo from tt where a0 is not null and t is not null and la is not null and lo is not null),
bg as (select a from tr group by 1 having count(*) >= {LEAST_FIXES}),
{pairs("tr", "pa")}, pr as (select * from pa where a in (select a from bg)),
tp as (select *, ({dist("p2", "p1")} + d - {dist("p2", "")}) / 2 x from pr where p2la is not null),
yd as (select a, quantile_cont(d, 0.95) y from pr where d is not null group by a having quantile_cont(d, 0.95) > 0),
f1 as (select file_id, count(*) n_fixes, count(distinct a) n_individuals, round((max(t) - min(t)) / 86400e6, 3) "days", floor(quantile_cont({_dec("la")}, 0.5))::int decimals_lat from tr group by 1),
f2 as (select file_id, round(100 * sum((d = 0)::int) / count(*), 6) pct_repeated from pr where d is not null group by 1),
f3 as (select file_id, count(*) n_triplets, 100 * sum((x > 10 * y)::int) / count(*) pct_spikes from tp join yd using (a) group by 1),
g as (select file_id, dt g from pr where dt > 0),
md as (select file_id, arg_max(g, row(c, -g)) m from (select file_id, g, count(*) c from g group by 1, 2) group by 1),
f4 as (select file_id, quantile_cont(g, 0.5) gap_median_s, any_value(m)::double gap_mode_s, round(quantile_cont(g, 0.95), 6) gap_p95_s, round(100 * sum((abs(g - m) <= greatest(0.1 * m, 1.0))::int) / count(*), 6) regular_pct
  from g join md using (file_id) group by 1),
f5 as (select file_id, round(min(dl) * 111320, 6) least_step_m from (select file_id, abs(la - lag(la) over (partition by file_id order by a, t, e)) dl from tr) where dl > 0 group by 1),
fm as (select f1.*, pct_repeated, coalesce(n_triplets, 0) n_triplets, pct_spikes, gap_median_s, gap_mode_s, gap_p95_s, regular_pct, least_step_m
  from f1 left join f2 using (file_id) left join f3 using (file_id) left join f4 using (file_id) left join f5 using (file_id))
"""

ORACLES = {
    "speed_gate_summary": f"""with {DATED}, {pairs("so", "sp")} select count(*) n_pairs, sum((d / greatest(dt, 1) > 7)::int) n_flagged, round(100.0 * sum((d / greatest(dt, 1) > 7)::int) / count(*), 6) pct,
      round(quantile_cont(d, 0.5) filter (d / greatest(dt, 1) > 7 and dt <= 15), 3) median_jump_m from sp where dt > 0""",
    "contaminated_jumps": f"""with {PAIRS}, j as (select d from ip where flagged and sr = 0) select count(*) n, round(max(d), 3) max_jump_m, round(quantile_cont(d, 0.5), 3) median_jump_m,
      round(quantile_cont(d, 0.9), 3) p90_jump_m, round(quantile_cont(d, 0.5) / 1200, 6) median_mps, round(quantile_cont(d, 0.9) / 1200, 6) p90_mps from j""",
    "four_fix_summary": f"""with {PAIRS}, bb as (select distinct a, island from ip where sr = 0 and flagged and sz = 4),
      f as (select a entity, island, {", ".join(f"max({c}) filter (rk = {k}) {c}{k}" for c in ("la", "lo") for k in range(4))} from bu join bb using (a, island) where sz = 4 group by 1, 2),
      g as (select la0 pla, lo0 plo, (la1 + la2 + la3) / 3 qla, (lo1 + lo2 + lo3) / 3 qlo, la1 rla, lo1 rlo, (la2 + la3) / 2 sla, (lo2 + lo3) / 2 slo from f), h as (select {dist("p", "q")} x, {dist("r", "s")} y from g)
      select count(*) n_bursts, round(quantile_cont(x, 0.5), 3) fix1_median_m, round(quantile_cont(y, 0.5), 3) fix2_median_m, round(100.0 * avg((x > y)::int), 6) fix1_is_outlier_pct from h""",
    "detector_report": f"""with {_RATES}, {_labels("a", "'gps'")}, {_labels("b", "'gps', 'gnss', 'solar-geolocator'")} {_report("a", "gps")} union all {_report("b", "gps+gnss+solar-geolocator")}""",
    "device_report": f"""with {DATED}, o as (select *, max(t) over (partition by a order by e rows between unbounded preceding and 1 preceding) pt from r1),
      c as (select a entity, count(*) n, sum((la is null or lo is null or isnan(la) or isnan(lo))::int) no_position, sum(coalesce(abs(la) > 90 or abs(lo) > 180, false)::int) off_globe,
      sum(coalesce(t < pt, false)::int) backwards, sum(coalesce(v < 0, false)::int) negative_speed from o group by 1) select *, no_position + off_globe + backwards + negative_speed = 0 ok from c""",
    "fence_large_ring": f"with {DATED}, {_ring()} select tr.e event_id, inside, round(metres, 1) metres from tr left join rg using (e)",
    "inventory_sizes": """with s as (select file_id, sum(length(line) + 1) b from export_lines group by 1), f as (select uuid, f.file_id, b, exported_at, row_number() over (partition by uuid order by exported_at, file_id) r from export_files f left join s using (file_id)),
      g as (select uuid, coalesce(sum(b), 0) bytes_published, string_agg(file_id || '.csv', ' | ' order by r) filter (r <= 6) fichiers from f where uuid is not null group by 1)
      select d.uuid, coalesce(g.bytes_published, 0) bytes_published, coalesce(g.fichiers, '') fichiers from deposits d left join g using (uuid)""",
    "metadata_lines": """select uuid, array_to_string(list_filter(['[dc.title] ' || nullif(titre, ''), '[dc.description] ' || nullif(description, ''), '[dc.subject] ' || nullif(taxon, ''),
      '[dc.date] ' || nullif(date_published, '')], lambda x: x is not null), chr(10)) metadata from deposits""",
    "property_counts": f"""with {SHEETS}, q as (select pct_repeated > 5 r, decimals_lat <= 4 t, pct_spikes > 0.05 s from ps)
      select count(*) sheets, coalesce(sum(r::int), 0) has_repetition, coalesce(sum(t::int), 0) has_truncation, coalesce(sum(s::int), 0) has_spikes, coalesce(sum((r or t or s)::int), 0) has_any from q""",
    "corpus_files": f"with {_FILES} select * exclude (pct_spikes), round(pct_spikes, 6) pct_spikes from fm",
    "corpus_items": f"""with {_FILES}, pl as (select h.file_id, count(*) filter (field in ('location-lat', 'location-long')) = 2 placed from head h left join col using (file_id) group by 1),
      fs as (select f.file_id, f.uuid, fm.n_fixes, fm.pct_spikes, case when placed is null then 'unreadable' when not placed then 'no position' when coalesce(n_fixes, 0) < {LEAST_ROWS} then 'unreadable' else 'ok' end status
        from export_files f left join pl using (file_id) left join fm using (file_id)),
      b as (select uuid, file_id, n_fixes, round(pct_spikes, 6) pct_spikes from (select *, row_number() over (partition by uuid order by n_fixes desc nulls last, file_id) r from fs) where r = 1),
      s as (select uuid, case when bool_or(status = 'ok') then 'ok' when bool_or(status = 'no position') then 'no position' else 'unreadable' end status, count(*) n_files from fs group by 1) select * from s join b using (uuid)""",
    "rest_and_move": f"""with {PAIRS}, c as (select a, island, avg(la) la0, avg(lo) lo0, avg(t // 1000000) t0 from bu where sz >= 4 group by 1, 2),
      f as (select *, radians(lo - lo0) * 6371008.8 * cos(radians(la0)) x, radians(la - la0) * 6371008.8 y, t // 1000000 - t0 tc,
        case when rk > 0 then sqrt(pow(radians(lo - p1lo) * cos(radians(la0)), 2) + pow(radians(la - p1la), 2)) * 6371008.8 end st from bu join c using (a, island)),
      g as (select (max(t // 1000000) - min(t // 1000000))::double span_s, sqrt(pow(regr_slope(x, tc), 2) + pow(regr_slope(y, tc), 2)) v,
        sqrt(greatest(regr_syy(x, tc) - coalesce(pow(regr_sxy(x, tc), 2) / regr_sxx(x, tc), 0) + regr_syy(y, tc) - coalesce(pow(regr_sxy(y, tc), 2) / regr_sxx(y, tc), 0), 0) / (2 * greatest(count(*) - 2, 1))) rs,
        sum(st) path, sqrt(pow(max_by(x, rk) - min_by(x, rk), 2) + pow(max_by(y, rk) - min_by(y, rk), 2)) chord from f group by a, island having max(t // 1000000) - min(t // 1000000) >= 5)
      select count(*) n_bursts, sum((v < 0.15)::int) n_rest, sum((v > 0.6)::int) n_move, quantile_cont(span_s, 0.5) median_span_s, round(quantile_cont(rs, 0.5) filter (v < 0.15), 3) resid_rest_m,
      round(quantile_cont(rs, 0.5) filter (v > 0.6), 3) resid_move_m, round(quantile_cont(v, 0.5) filter (v > 0.6), 3) v_move_mps, round(quantile_cont(path / greatest(chord, 1e-3), 0.5) filter (v > 0.6), 3) tortuosity from g""",
    "acc_calibration": f"""with {CALIBRATION} select entity, n_bursts, round(off_x, 1) off_x, round(off_y, 1) off_y, round(off_z, 1) off_z, round(counts_per_g, 1) counts_per_g, round(residual_pct, 2) residual_pct
      from cf join cr using (entity)""",
    "acc_calibration_spread": f"""with {CALIBRATION}, k as (select count(*) units, min(counts_per_g) lo, max(counts_per_g) hi, quantile_cont(counts_per_g, 0.5) m, max(off_x) - min(off_x) rx, max(off_y) - min(off_y) ry, max(off_z) - min(off_z) rz from cf)
      select units, round(lo, 2) min_gain, round(hi, 2) max_gain, round(rx, 2) range_x, round(ry, 2) range_y, round(rz, 2) range_z, round(m, 2) median_gain, round(100 * (hi - lo) / m, 2) spread_pct,
      round(100 * greatest(abs(hi - m), abs(lo - m)) / m, 2) pooling_error_pct from k""",
    "sheet_grains": f"with {_GRAIN} select entity, decimals_lat, round(least_step_m, 3) least_step_m, read_grain, len(limits)::int n_limits, array_to_string(limits, '; ') limit_texts from gl",
    "quality_sheets": f"""with {_GRAIN}, gn as (select a entity, count(*) n_fixes, (max(t) - min(t)) / 86400e6 "days" from tr group by 1),
      so_ as (select a entity, arg_max(sensor, row(k, sensor)) sensor from (select a, lower(sensor) sensor, count(*) k from tr where sensor is not null group by 1, 2) group by 1)
      select entity, concat_ws(chr(10), {", ".join(_SHEET)}) sheet from gl join gn using (entity) left join so_ using (entity)""",
    "file_conformance": f"with {_STATUS} select file_id, status, errors, n_lines from st",
    "conformance_counts": f"with {_STATUS} select status, count(*) n from st group by 1",
    "conformance_causes": f"""with {_STATUS}, c as (select status, substr(detail, 1, 90) detail, count(*) n from st where detail is not null group by 1, 2)
      select * from (select status, detail, n, row_number() over (partition by status order by n desc, detail)::int "rank" from c) where "rank" <= 3""",
    "declaration_passages": f"""with {SCAN}, p as (select doc_id, {", ".join(f"case when regexp_matches(own, '{_rx(f)}') then {_passages(f)} end passages_{f}" for f in _FAM)} from ow)
      select * from p where {" or ".join(f"passages_{f} is not null" for f in _FAM)}""",
    "export_geojson": f"""with {_PTS}, l as (select a entity, island::varchar seg, {_ISO.format("min(t)")} "start", {_ISO.format("max(t)")} "end", count(*) n_fix, round((max(t) - min(t)) / 3.6e9, 4) dur_h,
        round(100.0 * avg(flagged::int), 4) pct_flag, string_agg('[' || lo::varchar || ',' || la::varchar || ']', ', ' order by t, e) xy from sg group by 1, 2 having count(*) >= 2)
      select entity, seg, 0 part, '{{"type":"Feature","properties":' || to_json(struct_pack(entity := entity, seg := seg, part := 0, "start" := "start", "end" := "end", n_fix := n_fix, dur_h := dur_h, pct_flag := pct_flag))::varchar
        || ',"geometry":{{"type":"LineString","coordinates":[' || xy || ']}}}}' feature from l""",
}
