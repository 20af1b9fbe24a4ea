"""The bench's answers in plain SQL over whole tables."""

from __future__ import annotations

from trackmeter.plans.bench_queries import CADENCES, MERIDIAN, ORIGIN, PARK
from trackmeter.plans.problem_oracles import P7_VALUES, dist

_BLANKS = "chr(32)||chr(9)||chr(13)||chr(10)||chr(160)"
_KEY = f'lower(trim("individual-local-identifier", {_BLANKS}))'


def _flag(c: str) -> str:
    return f"case when trim({c}, {_BLANKS}) <> '' then lower(trim({c}, {_BLANKS})) = 'true' end"


DATED = f"""
r0 as (select "event-id" e, {_KEY} a, epoch_us("timestamp") t, "location-lat" la, "location-long" lo, "ground-speed" v, heading hd,
  "height-above-ellipsoid" alt, "eobs:horizontal-accuracy-estimate" acc, "external-temperature" temp, "eobs:battery-voltage" bat,
  "tag-local-identifier" tag, "sensor-type" sensor, "argos:lc" lc, {_flag('"manually-marked-outlier"')} marked, {_flag("visible")} vis,
  epoch_us(delivered_at) dlv from position_fixes
  where "event-id" is not null and "individual-local-identifier" is not null and "timestamp" is not null),
r1 as (select * from (select *, row_number() over (partition by e order by dlv nulls last, t, a, la, lo) rk0 from r0) where rk0 = 1),
tr as (select * from r1 where la is not null and lo is not null and not isnan(la) and not isnan(lo)),
so as (select * from tr where not coalesce(marked, false))
"""


def pairs(of: str = "tr", n: str = "pr") -> str:
    return f"""
{n}0 as (select *, lag(e) over w p1e, lag(t) over w p1t, lag(la) over w p1la, lag(lo) over w p1lo, lag(e, 2) over w p2e, lag(la, 2) over w p2la,
  lag(lo, 2) over w p2lo, row_number() over w rn from {of} window w as (partition by a order by t, e)),
{n} as (select *, t // 1000000 - p1t // 1000000 dt, case when p1la is not null then {dist("p1", "")} end d from {n}0)
"""


def runs(of: str, n: str, gap: float) -> str:
    return f"""
{n}0 as (select *, sum(case when dt <= {gap} then 0 else 1 end) over (partition by a order by t, e rows unbounded preceding) island from {of}),
{n} as (select *, row_number() over (partition by a, island order by t, e) - 1 rk, count(*) over (partition by a, island) sz from {n}0)
"""


BATCH = f"""
ba as (select lower(trim("animal-id", {_BLANKS})) a, coalesce(min(case when try_cast(substr("tag-id", 3) as int) < 100 then 'batch 2008'
  when try_cast(substr("tag-id", 3) as int) >= 100 then 'batch 2009' end), '?') batch from tag_reference where "animal-id" is not null group by 1)
"""
PAIRS = f"""{DATED}, {pairs("so", "sp")}, {runs("sp", "bu", 60)},
ip as (select a, p1e start_id, e end_id, p1t, t, dt, d, d / greatest(dt, 1) v, island, rk - 1 sr, sz - rk fe, sz, d / greatest(dt, 1) > 8 flagged
  from bu where dt between 5 and 60)
"""
_STEP = f"{DATED}, {pairs()}"
_TRIP = f"""{_STEP}, tp as (select *, ({dist("p2", "p1")} + d - {dist("p2", "")}) / 2 x from pr where p2la is not null),
yd as (select a, quantile_cont(d, 0.95) y from pr where d is not null group by a having quantile_cont(d, 0.95) > 0)
"""
_R = "count(*) pairs, sum(flagged::int) flagged, round(100 * sum(flagged::int) / count(*), 6) share_pct"
_CAD = "quantile_cont(g, 0.5) gap_median_s, round(quantile_cont(g, 0.05), 6) gap_p05_s, round(quantile_cont(g, 0.95), 6) gap_p95_s"


def _cadence(key: str, shown: str) -> str:
    by, on = (f"{key}, ", f"using ({key})") if key else ("", "on true")
    grp = f"group by {key}" if key else ""
    out = f"{key} entity, " if key else ""
    return f"""with {_STEP}, g as (select a, dt g from pr where dt > 0),
      c as (select {by}{shown} m, count(*) c from g group by all),
      md as (select {by} m from (select *, row_number() over ({f"partition by {key}" if key else ""} order by c desc, m) r from c) where r = 1)
      select {out}count(*) n_gaps, {_CAD}, any_value(m)::double gap_mode_s,
        round(100 * sum((abs(g - m) <= greatest(0.1 * m, 1.0))::int) / count(*), 6) regular_pct from g join md {on} {grp}"""


def _dec(c: str) -> str:
    """Digits behind the point of the shortest text; a whole number has one zero."""
    return f"greatest(length(split_part(({c})::varchar, '.', 2)), 1)"


def utm_sql(la: str, lo: str) -> tuple[str, str]:
    """Easting and northing as nested SQL, series to the third order of the third flattening."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    ecc = 2 * n**0.5 / (1 + n)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s = f"sin(radians({la}))"
    tau = f"sinh(atanh({s}) - {ecc!r} * atanh({ecc!r} * {s}))"
    lam = f"radians({lo} - {MERIDIAN})"
    xi, eta = f"atan2({tau}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + pow({tau}, 2)))"
    east = eta + "".join(f" + {a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(al, 1))
    north = xi + "".join(f" + {a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(al, 1))
    return f"(500000.0 + {scale!r} * ({east}))", f"({scale!r} * ({north}))"


def _park() -> str:
    e, n = utm_sql("la", "lo")
    edges = list(zip(PARK, PARK[1:] + PARK[:1], strict=True))
    hits = " + ".join(f"(case when ({y1} > n) <> ({y2} > n) then (x < ({x2 - x1}) * (n - {y1}) / ({y2 - y1}) + {x1})::int else 0 end)" for (x1, y1), (x2, y2) in edges)

    def seg(p, q):
        (x1, y1), (x2, y2) = p, q
        dx, dy = x2 - x1, y2 - y1
        t = f"least(1.0, greatest(0.0, ((x - {x1}) * ({dx}) + (n - {y1}) * ({dy})) / ({dx * dx + dy * dy})))"
        return f"sqrt(pow(x - ({x1} + {t} * ({dx})), 2) + pow(n - ({y1} + {t} * ({dy})), 2))"

    near = "least(" + ", ".join(seg(p, q) for p, q in edges) + ")"
    return f"""
      xy as (select *, case when abs(la) <= 84 and abs(lo - {MERIDIAN}) <= 80 then {e} end x, case when abs(la) <= 84 and abs(lo - {MERIDIAN}) <= 80 then {n} end n from tr),
      pk as (select *, case when x is not null then ({hits}) % 2 = 1 end inside, case when x is not null then {near} end near from xy)"""


PARKED = f"{DATED}, {_park()}"
_FIRST = "select distinct start_id e from ip where sr = 0 and flagged"
FENCED = f"""{PAIRS}, {_park()}, ff as ({_FIRST}),
fe as (select pk.*, ff.e is not null flagged, case when not inside then near end dm from pk left join ff using (e) where vis),
fr as (select *, lag(inside) over (partition by a order by t, e) pin from fe),
fi as (select *, sum(case when pin = inside then 0 else 1 end) over (partition by a order by t, e rows unbounded preceding) run from fr),
ex as (select a entity, run, first(e order by t, e) first_event_id, last(e order by t, e) last_event_id, min(t) start_us, max(t) end_us, count(*) n_fixes,
  sum(flagged::int) n_flagged, max(dm) max_d_m, max(dm) > 500 deep from fi where not inside group by 1, 2)
"""


def wilson(k: str, n: str) -> tuple[str, str]:
    z = 1.96
    half = f"{z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z * z} / (4.0 * {n} * {n}))"
    mid, den = f"({k} / {n} + {z * z} / (2 * {n}))", f"(1 + {z * z} / {n})"
    return f"({mid} - {half}) / {den}", f"({mid} + {half}) / {den}"


_LO, _HI = wilson("k", "nullif(n, 0)::double")
_XY = f"radians(lo - {ORIGIN[1]}) * 6371008.8 * cos(radians({ORIGIN[0]})) x, radians(la - {ORIGIN[0]}) * 6371008.8 y"
STILL = f"""{DATED}, sw as (select a entity, t // 600000000 * 600 window_s, count(*) n, sqrt((var_samp(x) + var_samp(y)) / 2) sigma_m,
  quantile_cont(acc, 0.5) acc_m, max(v) vmax from (select *, {_XY} from tr where v < 0.5::float) group by 1, 2 having count(*) >= 5)
"""
_CLASS = "case when acc_m <= 0 then null when acc_m <= 3 then '<3' when acc_m <= 5 then '3-5' when acc_m <= 8 then '5-8' when acc_m <= 12 then '8-12' when acc_m <= 20 then '12-20' when acc_m <= 40 then '20-40' else '>40' end"
_AVG_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"
_DAYS = f"""{DATED}, bd as (select a entity, (t // 86400000000)::int "day", null::double sag_mv, quantile_cont(bat, 0.5) rest_mv, count(*) n
  from tr where bat is not null group by 1, 2)"""

DENSE = f"""{DATED}, dn as (select a, e, t ts, la / 10 la, lo / 10 lo, alt, row_number() over (partition by a order by t, e) - 1 t,
  count(*) over (partition by a) c from tr),
vl as (select *, lag(t) over w p1t, coalesce(lag(alt) over w, -1e9) p1al, lag(la) over w p1la, lag(lo) over w p1lo, lag(la, 2) over w p2la, lag(lo, 2) over w p2lo
  from dn where c >= 100 window w as (partition by a order by ts, e)),
ve as (select *, radians(lo - p1lo) * 6371008.8 * cos(radians(p1la)) vx, radians(la - p1la) * 6371008.8 vy,
  radians(p1lo - p2lo) * 6371008.8 * cos(radians(p2la)) ux, radians(p1la - p2la) * 6371008.8 uy from vl),
tn as (select *, degrees(atan2(vx, vy)) - degrees(atan2(ux, uy)) + 180 dg from ve),
rt as (select *, case when p2la is not null then ((dg % 360) + 360) % 360 - 180 end rate from tn),
"""
_SIGN = "sign(rate)"
SPIRALS = f"""{DENSE}
tg as (select *, coalesce(abs(rate) > 3, false) turning, {_SIGN} way, lag({_SIGN}) over (partition by a order by ts, e) pway from rt),
is_ as (select *, sum(case when turning and way = pway then 0 else 1 end) over (partition by a order by ts, e rows unbounded preceding) island from tg),
gg as (select a entity, island, count(*) n_rates, sum(rate) turned, avg(ux) wind_east, avg(uy) wind_north, min(p1t) start_s, max(p1t) end_s,
  avg(p1la) lat, avg(p1lo) lon, arg_min(p1al, row(ts, e)) al0, arg_max(p1al, row(ts, e)) al1 from is_ where turning group by 1, 2 having count(*) >= 3 and abs(sum(rate)) >= 330 and max(p1t) > min(p1t)),
ar as (select g.entity, g.island, avg(sqrt(pow(ux - wind_east, 2) + pow(uy - wind_north, 2))) airspeed
  from is_ i join gg g on i.a = g.entity and i.island = g.island where turning group by 1, 2),
al as (select entity, island, avg(p1alt) altitude_m from (select i.a entity, i.island, i.turning, lag(alt) over (partition by a order by ts, e) p1alt from is_ i) where turning group by 1, 2),
sp as (select g.*, sqrt(pow(wind_east, 2) + pow(wind_north, 2)) wind, airspeed, altitude_m, end_s - start_s duration_s,
  case when al0 > -1e8 and al1 > -1e8 then (al1 - al0) / (end_s - start_s) end climb_mps, (degrees(atan2(wind_east, wind_north)) + 360) % 360 wind_from_deg
  from gg g join ar using (entity, island) join al using (entity, island) where sqrt(pow(wind_east, 2) + pow(wind_north, 2)) < 40 and airspeed between 2 and 30)
"""
SPAIRS = f"""{SPIRALS},
wp as (select p.entity a_entity, p.island a_island, q.entity b_entity, q.island b_island,
  sqrt(pow(radians(q.lon - p.lon) * 6371008.8 * cos(radians(p.lat)), 2) + pow(radians(q.lat - p.lat) * 6371008.8, 2)) / 1000 km,
  sqrt(pow(p.wind_east - q.wind_east, 2) + pow(p.wind_north - q.wind_north, 2)) gap
  from sp p join sp q on q.start_s - p.start_s between 0 and 30 and p.entity <> q.entity and (q.start_s > p.start_s or q.entity > p.entity)
  and abs(p.altitude_m - q.altitude_m) < 300)
"""


def _rx(family: str) -> str:
    from trackmeter.operators.declare import FAMILIES

    return "(?i)" + FAMILIES[family]


_FAM = ("repetition", "truncation", "spikes")
SCAN = f"""
tx as (select doc_id, uuid, replace(coalesce(text, ''), chr(13)||chr(10), chr(10)) x from documents),
md as (select *, instr(x, '===README===' || chr(10)) p from tx),
rm as (select *, case when p > 0 then substr(x, p + 13) else '' end rd, case when p > 0 then substr(x, 1, p - 1) else x end hd from md),
ow as (select *, concat_ws(chr(10), array_to_string(list_filter(string_split(hd, chr(10)), lambda l: regexp_matches(l, '^\\[(dc\\.description|dc\\.title\\]|dc\\.subject\\])')), chr(10)),
  (regexp_split_to_array(rd, '\\n-{{5,}}'))[1], array_to_string(regexp_extract_all(rd, '(?is)THIS DATASET:(.{{0,600}})', 1), chr(10))) own from rm),
sc as (select doc_id, uuid, length(x) n_chars, length(own) n_own, length(trim(rd, ' '||chr(10)||chr(9))) > 0 readme, contains(x, 'THIS DATASET') note,
  {", ".join(f"regexp_matches(own, '{_rx(f)}') says_{f}, regexp_matches(x, '{_rx(f)}') template_{f}" for f in _FAM)} from ow)
"""
_GET = lambda name, rx, kind: f"try_cast(nullif(regexp_extract(text, '\\| {name} \\| ({rx})', 1), '') as {kind})"
SHEETS = f"""ps as (select doc_id, uuid, {_GET("Repeated positions", "[0-9.]+", "double")} pct_repeated, {_GET("Position spikes", "[0-9.]+", "double")} pct_spikes,
  {_GET("Coordinate grain", "[0-9]+", "int")} decimals_lat, {_GET("Fixes", "[0-9]+", "bigint")} n_fixes, {_GET("Individuals", "[0-9]+", "bigint")} n_individuals
  from documents where source = 'quality_sheet' and text is not null)"""

INV = """iv as (select uuid, substr(titre, 1, 78) title, try_cast(substr(date_published, 1, 4) as int) "year", round(bytes_published / 1e6, 1) mb, bytes_published, taxon from deposits)"""

QUALITY = f"""{_TRIP},
qs as (select a, 100 * sum((x > 10 * y)::int) / count(*) pct_spikes from tp join yd using (a) group by a),
qr as (select a, 100 * sum((d = 0)::int) / count(*) pct_repeated from pr where d is not null group by a),
qd as (select a, max({_dec("la")}) decimals_lat from tr group by a),
qg as (select a, dt g, count(*) c from pr where dt > 0 group by 1, 2),
qm as (select a, g m from (select *, row_number() over (partition by a order by c desc, g) r from qg) where r = 1),
qp as (select qg.a, m, 100 * sum(case when abs(g - m) <= greatest(0.1 * m, 1.0) then c else 0 end) / sum(c) regular_pct from qg join qm using (a) group by 1, 2),
q as (select qd.a entity, decimals_lat, pct_repeated, pct_spikes, m, regular_pct from qd left join qr using (a) left join qs using (a) left join qp using (a))
"""

SAMPLES = f"""vv as ({P7_VALUES}),
va as (select event_id, list("value" order by pos) v, max(pos) mp from vv group by 1),
bz as (select "event-id" e, {_KEY} a, epoch_us("timestamp") t from acc_records where "event-id" is not null and "individual-local-identifier" is not null and "timestamp" is not null),
bq as (select e, a, t from (select *, row_number() over (partition by e order by t, a) r from bz) where r = 1),
xs as (select e, a, len(v) // 3 n, unnest(range(0, len(v) // 3)) i, v from bq join va on e = event_id where mp = len(v) and len(v) // 3 >= 3),
xyz as (select e, a, n, v[3 * i + 1]::double x, v[3 * i + 2]::double y, v[3 * i + 3]::double z from xs),
mn as (select e event_id, a entity, any_value(n)::int n_samples, avg(x) ax_mean, avg(y) ay_mean, avg(z) az_mean, stddev_pop(x) ax_std, stddev_pop(y) ay_std,
  stddev_pop(z) az_std, avg(sqrt(x * x + y * y + z * z)) norm_abs_mean from xyz group by 1, 2)
"""

ORACLES = {
    "steps_by_device": f"with {_STEP} select a entity, count(*) n_steps, round(max(d), 3) longest_m, max(dt) longest_s from pr where d is not null group by 1",
    "track_record": f"""with {DATED} select e event_id, a entity, t ts_us, la lat, lo lon, v speed_mps, hd heading_deg, alt altitude_gps_m, acc h_accuracy_m,
      temp x_external_temp_c, bat x_battery_mv, tag x_tag_id, marked x_manual_outlier, vis x_visible, sensor from tr""",
    "marked_and_hidden": f"with {DATED} select count(*) n, sum(coalesce(marked, false)::int) marked, sum(coalesce(vis, false)::int) visible, sum(coalesce(not vis, false)::int) hidden from tr",
    "spikes_by_device": f"""with {DATED}, bg as (select a from tr group by 1 having count(*) >= 50), {pairs("(select * from tr where a in (select a from bg))")},
      tp as (select *, ({dist("p2", "p1")} + d - {dist("p2", "")}) / 2 x from pr where p2la is not null),
      yd as (select a, quantile_cont(d, 0.95) y from pr where d is not null group by a having quantile_cont(d, 0.95) > 0)
      select a entity, count(*) triplets, sum((x > 10 * y)::int) spikes from tp join yd using (a) group by 1""",
    "spike_fixes": f"with {_TRIP} select a entity, p1e event_id, round(x, 2) excursion_m from tp join yd using (a) where x > 10 * y",
    "repeated_positions": f"with {_STEP} select a entity, count(*) steps, sum((d = 0)::int) repeats from pr where d is not null group by 1",
    "cadence_by_device": _cadence("a", "g"),
    "cadence_of_fleet": _cadence("", "round_even(g / 10, 0) * 10"),
    "corpus_measure": f"""with {DATED}, bg as (select a from tr group by 1 having count(*) >= 50), {pairs("(select * from tr where a in (select a from bg))")},
      tp as (select *, ({dist("p2", "p1")} + d - {dist("p2", "")}) / 2 x from pr where p2la is not null),
      yd as (select a, quantile_cont(d, 0.95) y from pr where d is not null group by a having quantile_cont(d, 0.95) > 0),
      g as (select dt g from pr where dt > 0), md as (select g m from g group by 1 order by count(*) desc, g limit 1),
      ad as (select abs(la - lag(la) over (order by a, t, e)) dl from tr)
      select (select count(*) from tr) n_fixes, (select count(distinct a) from tr) n_individuals, (select round((max(t) - min(t)) / 86400e6, 3) from tr) "days",
        (select round(100 * sum((d = 0)::int) / count(*), 6) from pr where d is not null) pct_repeated,
        (select count(*) from tp join yd using (a)) n_triplets, (select round(100 * sum((x > 10 * y)::int) / count(*), 6) from tp join yd using (a)) pct_spikes,
        (select quantile_cont(g, 0.5) from g) gap_median_s, (select m::double from md) gap_mode_s, (select round(quantile_cont(g, 0.95), 6) from g) gap_p95_s,
        (select round(100 * sum((abs(g - m) <= greatest(0.1 * m, 1.0))::int) / count(*), 6) from g, md) regular_pct,
        (select floor(quantile_cont({_dec("la")}, 0.5))::int from tr) decimals_lat, (select round(min(dl) * 111320, 6) from ad where dl > 0) least_step_m""",
    "capabilities": """select field, round(100.0 * k / n, 6) filled_pct, case when k is null then 'absent' when k > 0 then 'filled' else 'empty' end state from (
      select count(*) n, unnest(['location-lat', 'location-long', 'ground-speed', 'heading', 'external-temperature', 'eobs:battery-voltage', 'eobs:temperature', 'argos:lc']) field,
      unnest([count("location-lat"), count("location-long"), count("ground-speed"), count(heading), count("external-temperature"), count("eobs:battery-voltage"), null, count("argos:lc")]) k
      from position_fixes)""",
    **{
        name: f"""with c as (select lower(trim("{col}", {_BLANKS})) "value", count(*) n from position_fixes where "{col}" is not null group by 1)
          select "value", n, round(n / (select sum(n) from c), 6) share from c order by n desc, "value" limit 6"""
        for name, col in (("sensor_shares", "sensor-type"), ("argos_class_shares", "argos:lc"))
    },
    "fleet_health": f"with {PAIRS}, {BATCH} select ip.a entity, {_R}, coalesce(any_value(batch), '?') batch from ip left join ba using (a) group by 1",
    "fleet_summary": f"""with {PAIRS} select count(*) n_pairs, sum(flagged::int) n_flagged, round(100 * sum(flagged::int) / count(*), 6) pct,
      round(quantile_cont(d, 0.5) filter (flagged), 3) median_jump_m, round(quantile_cont(d, 0.99) filter (flagged), 3) p99_jump_m, round(max(d) filter (flagged), 3) max_jump_m from ip""",
    "fleet_by_batch": f"""with {PAIRS}, {BATCH}, h as (select a, coalesce(any_value(batch), '?') batch, 100 * sum(flagged::int) / count(*) p from ip left join ba using (a) group by 1)
      select batch, count(*) devices, round(min(p), 6) "min", round(quantile_cont(p, 0.5), 6) median, round(max(p), 6) "max" from h group by 1""",
    "rates_by_rank": f"with {PAIRS} select sr::int start_rank, {_R} from ip group by 1",
    "rates_by_rank_from_end": f"with {PAIRS} select fe::int from_end, {_R} from ip group by 1",
    "rates_by_batch_and_size": f"""with {PAIRS}, {BATCH} select coalesce(batch, '?') batch,
      {", ".join(f"round(100 * avg(flagged::int) filter (sz = {k}), 6) pct_{k}, sum(flagged::int) filter (sz = {k}) n_{k}" for k in (2, 3, 4, 5, 6))}
      from ip left join ba using (a) where sr = 0 group by 1""",
    "rates_by_year": f"""with {PAIRS}, {BATCH} select year(make_timestamp(p1t))::int "year", coalesce(batch, '?') batch, {_R} from ip left join ba using (a) where sr = 0 group by 1, 2""",
    "first_fix_delays": f"""with {PAIRS}, {BATCH}, f as (select *, p1t // 1000000 - lag(p1t // 1000000) over (partition by a order by p1t, start_id) - 300 dl from ip where sr = 0)
      select coalesce(batch, '?') batch, sz::int burst_size, count(*) n, quantile_cont(dl, 0.25) q25, quantile_cont(dl, 0.5) median, quantile_cont(dl, 0.75) q75
      from f left join ba using (a) where dl between -3600 and 86400 group by 1, 2""",
    "flagged_fixes": f"with {PAIRS} select a entity, start_id event_id, p1t ts_us, 1 rank_in_burst from ip where sr = 0 and flagged",
    "flagged_fixes_second": f"with {PAIRS} select a entity, end_id event_id, t ts_us, 2 rank_in_burst from ip where sr = 0 and flagged",
    "four_fix_bursts": f"""with {PAIRS}, bb as (select distinct a, island from ip where sr = 0 and flagged and sz = 4),
      f as (select a entity, island, {", ".join(f"max({c}) filter (rk = {k}) {c}{k}" for c in ("la", "lo") for k in range(4))} from bu join bb using (a, island) where sz = 4 group by 1, 2),
      g as (select entity, island, la0 pla, lo0 plo, (la1 + la2 + la3) / 3 qla, (lo1 + lo2 + lo3) / 3 qlo, la1 rla, lo1 rlo, (la2 + la3) / 2 sla, (lo2 + lo3) / 2 slo from f)
      select entity, island, round({dist("p", "q")}, 3) fix1_m, round({dist("r", "s")}, 3) fix2_m from g""",
    "subsampling": f"""with {PAIRS}, b as (select count(*) n_fixes, sum((rk = 0)::int) n_bursts from bu),
      f as (select count(*) n_pairs, sum(flagged::int) n_flagged, sum(flagged::int) filter (sr = 0) n_first, max(d) filter (sr = 0 and flagged) mx,
        {", ".join(f"sum((d / 1200 > {v})::int) filter (sr = 0 and flagged) above_{v}_mps" for v in (1, 2, 4, 8))} from ip)
      select n_fixes, n_bursts, n_pairs, n_flagged, n_first, round(mx, 3) max_jump_m, {", ".join(f"above_{v}_mps" for v in (1, 2, 4, 8))},
        round(100 * n_first / n_flagged, 6) first_pair_share_pct, round(100 * n_first / n_bursts, 6) contaminated_share_pct, n_flagged - n_first residue_after_targeted_remedy,
        round(100 * n_bursts / n_fixes, 6) blanket_remedy_pct, round(100 * n_first / n_fixes, 6) targeted_remedy_pct, n_bursts - n_first sound_positions_lost_if_blanket from b, f""",
    "speed_gate": f"""with {DATED}, {pairs("so", "sp")} select case when dt <= 15 then '<=15s' when dt <= 60 then '15-60s' when dt <= 300 then '1-5min' when dt <= 1800 then '5-30min'
      when dt <= 3600 then '30-60min' else '>1h' end gap_class, count(*) pairs, sum((d / greatest(dt, 1) > 7)::int) flagged from sp where dt > 0 group by 1""",
    "burst_sizes": f"with {_STEP}, {runs('pr', 'bu', 60)} select sz size, count(*) bursts from bu where rk = 0 group by 1",
    "burst_features": f"""with {PAIRS}, c as (select a, island, avg(la) la0, avg(lo) lo0, avg(t // 1000000) t0 from bu where sz >= 4 group by 1, 2),
      f as (select *, radians(lo - lo0) * 6371008.8 * cos(radians(la0)) x, radians(la - la0) * 6371008.8 y, t // 1000000 - t0 tc,
        case when rk > 0 then sqrt(pow(radians(lo - p1lo) * cos(radians(la0)), 2) + pow(radians(la - p1la), 2)) * 6371008.8 end st from bu join c using (a, island))
      select a entity, island, min(t // 1000000) start_s, count(*) n_fixes, (max(t // 1000000) - min(t // 1000000))::double span_s,
        round(sqrt(pow(regr_slope(x, tc), 2) + pow(regr_slope(y, tc), 2)), 3) v_mps,
        round(sqrt(greatest(regr_syy(x, tc) - coalesce(pow(regr_sxy(x, tc), 2) / regr_sxx(x, tc), 0) + regr_syy(y, tc) - coalesce(pow(regr_sxy(y, tc), 2) / regr_sxx(y, tc), 0), 0)
          / (2 * greatest(count(*) - 2, 1))), 3) resid_m, round(sum(st), 2) path_m,
        round(sqrt(pow(max_by(x, rk) - min_by(x, rk), 2) + pow(max_by(y, rk) - min_by(y, rk), 2)), 2) chord_m from f group by 1, 2 having max(t // 1000000) - min(t // 1000000) >= 5""",
    "gap_segments": f"with {_STEP}, {runs('pr', 'bu', 21600)} select a entity, max(island) segments, max(sz) longest from bu group by 1",
    "utm_positions": f"with {PARKED} select e event_id, round(x, 1) east, round(n, 1) north from pk",
    "fence_inside": f"with {PARKED} select count(*) n_fixes, sum(inside::int) n_inside, round(100 * avg(inside::int), 6) inside_pct from pk",
    "fence_crossings": f"""with {PARKED}, iv as (select unnest({list(CADENCES)}) iv),
      rs as (select iv, a, t, e, inside from (select iv, pk.*, row_number() over (partition by iv, a, case when iv > 0 then t // (iv::bigint * 1000000) else e end order by t, e) r from pk, iv) where r = 1),
      cr as (select iv, a, count(*) n, sum((inside <> p)::int) k from (select *, lag(inside) over (partition by iv, a order by t, e) p from rs) group by 1, 2 having count(*) >= 3),
      tt as (select iv interval_s, sum(coalesce(k, 0)) crossings, count(*) devices from cr group by 1)
      select interval_s, crossings, devices, round(100.0 * crossings / nullif((select crossings from tt where interval_s = 0), 0), 6) pct_of_native from tt""",
    "fence_excursions": f"with {FENCED} select entity, run, first_event_id, last_event_id, start_us, end_us, n_fixes, n_flagged, round(max_d_m, 1) max_d_m, deep from ex",
    "fence_rates": f"""with {FENCED}, k as (select flagged, count(*) n, sum((not inside)::int) k from fe where inside is not null group by 1)
      select flagged, n, k outside, round(k / n, 8) rate, round({_LO}, 8) low, round({_HI}, 8) high from k""",
    "fence_summary": f"""with {FENCED}, b as (select entity, sum(n_fixes) k from ex group by 1)
      select count(*) n_excursions, sum((n_fixes = 1)::int) n_single, sum((n_fixes = 1 and n_flagged = 1)::int) n_single_flagged, sum(deep::int) n_deep,
      (select round(max(k) / sum(k), 6) from b) top_share, (select count(*) from b) entities, round(quantile_cont(max_d_m, 0.75), 1) q75_max_d_m from ex""",
    "still_windows": f"with {STILL} select entity, window_s, n, round(sigma_m, 3) sigma_m, acc_m, round(vmax, 4) vmax from sw",
    "noise_by_device": f"""with {STILL} select entity, count(*) n_windows, round(quantile_cont(sigma_m, 0.5), 3) sigma_median_m, round(quantile_cont(sigma_m, 0.9), 3) sigma_p90_m,
      quantile_cont(acc_m, 0.5) acc_median_m, round(quantile_cont(sigma_m, 0.5) / nullif(quantile_cont(acc_m, 0.5), 0), 3) ratio from sw group by 1""",
    "declared_accuracy": f"""with {STILL} select {_CLASS} "class", count(*) n, quantile_cont(acc_m, 0.5) acc_m, round(quantile_cont(sigma_m, 0.5), 3) sigma_m,
      round(quantile_cont(sigma_m, 0.9), 3) sigma_p90_m, round(quantile_cont(sigma_m, 0.5) / quantile_cont(acc_m, 0.5), 3) ratio from sw where acc_m is not null and acc_m > 0 group by 1""",
    "declared_rank_correlation": f"""with {STILL}, rk as (select {_AVG_RANK.format("acc_m")} ra, {_AVG_RANK.format("sigma_m")} rb from (select acc_m, round(sigma_m, 6) sigma_m from sw) where acc_m is not null)
      select round(corr(ra, rb), 4) rho, count(*) n from rk""",
    "constant_fields": f"""with {DATED} select f field, n n_values, n = 1 "constant" from (select unnest(['sensor', 'argos_lc', 'x_type_of_fix']) f,
      unnest([count(distinct sensor) + max((sensor is null)::int), count(distinct lc) + max((lc is null)::int), 1]) n from tr)""",
    "battery_days": f"with {_DAYS} select * from bd",
    "battery_slopes": f"with {_DAYS} select entity, count(*) n_days, null::double sag_slope, round(regr_slope(rest_mv, \"day\"), 4) rest_slope from bd group by 1 having count(*) >= 7",
    "device_pairs": f"""with {DATED}, sx as (select a, s, {_XY} from (select *, t // 1000000 s, row_number() over (partition by a, t // 1000000 order by t, e) r from tr) where r = 1),
      m as (select p.a a, q.a b, p.s s, p.x - q.x rx, p.y - q.y ry, count(*) over (partition by p.a, q.a) c from sx p join sx q on p.s = q.s and p.a < q.a),
      n as (select *, sqrt(rx * rx + ry * ry) d from m where c >= 3 and sqrt(rx * rx + ry * ry) < 2e6),
      w2 as (select *, rx - 2 * lag(rx) over w + lag(rx, 2) over w dx, ry - 2 * lag(ry) over w + lag(ry, 2) over w dy from n window w as (partition by a, b order by s)),
      st as (select a, b, count(*) n_seconds, quantile_cont(d, 0.5) dm, sqrt((var_pop(dx) + var_pop(dy)) / 12) sg from w2 group by 1, 2 having count(*) >= 3)
      select a, b, n_seconds, round(dm, 1) dist_median_m, round(sg, 1) sigma_rel_m, round(sg / sqrt(2), 1) sigma_each_m from st""",
    "acc_features": f"""with {SAMPLES}, nm as (select x.e event_id, avg(sqrt(pow(x - ax_mean, 2) + pow(y - ay_mean, 2) + pow(z - az_mean, 2))) norm_mean from xyz x join mn on x.e = mn.event_id group by 1)
      select mn.event_id, entity, n_samples, {", ".join(f"round({c}, 3) {c}" for c in ("ax_mean", "ay_mean", "az_mean", "ax_std", "ay_std", "az_std", "norm_abs_mean", "norm_mean"))} from mn join nm using (event_id)""",
    "acc_resting": f"""with {SAMPLES}, g as (select entity, greatest(ax_std, ay_std, az_std) g from mn) select entity, count(*) bursts from g where round(g, 6) <= (select round(quantile_cont(g, 0.25), 6) from g) group by 1""",
    "speed_at_bursts": f"""with {DATED}, bz as (select "event-id" e, {_KEY} a, epoch_us("timestamp") t from acc_records where "event-id" is not null and "individual-local-identifier" is not null and "timestamp" is not null),
      bq as (select * from (select *, row_number() over (partition by e order by t, a) r from bz) where r = 1),
      fs as (select a, t // 1000000 s, first(v order by t, e) v from (select *, row_number() over (partition by a, t // 1000000 order by t, e) k from tr) where k = 1 group by 1, 2)
      select bq.a entity, count(*) bursts, count(fs.v) with_speed from bq left join fs on bq.a = fs.a and bq.t // 1000000 = s group by 1""",
    "burst_stretches": f"""with bz as (select distinct {_KEY} a, epoch_us("timestamp") // 1000000 s from acc_records where "event-id" is not null and "individual-local-identifier" is not null and "timestamp" is not null),
      k as (select *, s - row_number() over (partition by a order by s) g from bz), n as (select a, g, count(*) n from k group by 1, 2) select a entity, count(*) stretches, max(n) longest from n group by 1""",
    "turn_rates": f"with {DENSE} z as (select 1) select a entity, count(*) rates, sum((abs(rate) > 3)::int) turning from rt where rate is not null group by 1",
    "wind_spirals": f"""with {SPIRALS} select entity, island, n_rates, round(wind_east, 4) wind_east, round(wind_north, 4) wind_north, start_s, end_s, round(lat, 6) lat, round(lon, 6) lon,
      round(airspeed, 4) airspeed, round(wind, 4) wind, duration_s, round(altitude_m, 3) altitude_m, round(climb_mps, 4) climb_mps, round(wind_from_deg, 3) wind_from_deg from sp""",
    "wind_summary": f"""with {SPIRALS} select count(*) n_spirals, count(distinct entity) n_devices, quantile_cont(duration_s, 0.5) median_duration_s, round(quantile_cont(airspeed, 0.25), 3) airspeed_p25,
      round(quantile_cont(airspeed, 0.5), 3) airspeed_p50, round(quantile_cont(airspeed, 0.75), 3) airspeed_p75, round(quantile_cont(wind, 0.5), 3) wind_p50, round(quantile_cont(wind, 0.9), 3) wind_p90,
      round(quantile_cont(altitude_m, 0.5), 3) median_altitude_m, round(quantile_cont(climb_mps, 0.5), 3) median_climb_mps from sp""",
    "wind_pairs": f"with {SPAIRS} select a_entity, a_island, b_entity, b_island, round(km, 3) distance_km, round(gap, 3) wind_gap from wp where km < 20",
    "wind_structure": f"""with {SPAIRS} select case when km < 2 then 0 when km < 10 then 2 when km < 50 then 10 when km < 200 then 50 else 200 end d_min_km, count(*) n_pairs,
      round(quantile_cont(gap, 0.5), 3) median_gap, round(quantile_cont(gap, 0.75), 3) p75_gap from wp group by 1""",
    "declaration_scan": f"with {SCAN} select * exclude (uuid) from sc",
    "parsed_sheets": f"with {SHEETS} select * from ps",
    "declaration_rates": f"""with {SCAN}, {SHEETS}, q as (select uuid, max(pct_repeated) > 5 has_repetition, min(decimals_lat) <= 4 has_truncation, max(pct_spikes) > 0.05 has_spikes from ps where uuid is not null group by 1),
      s as (select uuid, {", ".join(f"max({k}_{f}::int) {k}_{f}" for f in _FAM for k in ("says", "template"))} from sc where uuid is not null group by 1),
      l as ({" union all ".join(f"select '{f}' family, has_{f} c, says_{f} s, template_{f} tt from q join s using (uuid)" for f in _FAM)}),
      g as (select family, sum(c::int) n_case, sum(c::int * s) k_case, sum(c::int * tt) k_template, sum((not c)::int) n_control, sum((not c)::int * s) k_control from l where c is not null group by 1)
      select family, n_case, k_case, k_template, n_control, k_control, {", ".join(f"round(k_{x} / nullif(n_{x}, 0), 6) rate_{x}, round({wilson(f'k_{x}', f'nullif(n_{x}, 0)::double')[0]}, 6) low_{x}, round({wilson(f'k_{x}', f'nullif(n_{x}, 0)::double')[1]}, 6) high_{x}" for x in ("case", "control"))} from g""",
    "detector_validation": f"""with {DATED}, bg as (select a from tr group by 1 having count(*) >= 50), {pairs("(select * from tr where a in (select a from bg))")},
      tp as (select *, ({dist("p2", "p1")} + d - {dist("p2", "")}) / 2 x from pr where p2la is not null),
      yd as (select a, quantile_cont(d, 0.95) y from pr where d is not null group by a having quantile_cont(d, 0.95) > 0),
      sr as (select a, 100 * sum((x > 10 * y)::int) / count(*) p from tp join yd using (a) group by 1),
      sn as (select a, lower(sensor) s, count(*) n from tr group by 1, 2), mx as (select a, s from (select *, row_number() over (partition by a order by n desc, s desc) r from sn) where r = 1),
      l as (select p, case when s = 'gps' then 0 when s = 'argos-doppler-shift' then 1 end h from sr join mx using (a) where s in ('gps', 'argos-doppler-shift')),
      rk as (select *, {_AVG_RANK.format("p")} r, count(*) over (partition by p) c from l),
      s as (select sum(h) n1, sum(1 - h) n2, sum(h * r) rs, sum((c * c - 1)::double) ties from rk)
      select n1 n_high, n2 n_low, rs - n1 * (n1 + 1) / 2 u, round((rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 4) z from s""",
    "inventory": f"with {INV} select * from iv",
    "inventory_totals": f"""with {INV} select count(*) items, sum((bytes_published > 0)::int) items_with_files, sum(bytes_published) bytes, min("year") first_year, max("year") last_year from iv""",
    "inventory_usable": f"with {INV} select uuid, mb from iv where bytes_published > 0 and mb < 50",
    "inventory_largest": f"""with {INV} select uuid, mb, "year" from iv order by bytes_published desc nulls last, uuid limit 25""",
    "inventory_largest_recent": f"""with {INV} select uuid, mb, "year" from iv where "year" >= 2020 order by bytes_published desc nulls last, uuid limit 15""",
    "inventory_files": """with n as (select uuid, lower(unnest(regexp_split_to_array(fichiers, '\\s*\\|\\s*'))) n from deposits)
      select regexp_extract(n, '\\.([a-z0-9]+)$', 1) suffix, count(*) files, count(distinct uuid) deposits from n where n <> '' and not contains(n, 'readme') and not contains(n, 'reference') group by 1""",
    "sheet_readings": f"""with {QUALITY} select entity,
      case when pct_spikes is null then 'not measured' when pct_spikes < 0.01 then 'nothing notable' when pct_spikes < 0.05 then 'a few isolated outliers' else 'high rate' end read_spikes,
      case when pct_repeated is null then 'not measured' when pct_repeated < 1 then 'nothing notable' when pct_repeated < 5 then 'frequent repeats' else 'major share without a new position' end read_repeats,
      case when m is null then 'unknown' when m < 90 then printf('%.0f s', m::double) when m < 5400 then printf('%.0f min', m / 60) when m < 172800 then printf('%.1f h', m / 3600) else printf('%.1f d', m / 86400) end pace,
      greatest(1, coalesce((decimals_lat <= 4)::int, 0) + coalesce((pct_repeated > 5)::int, 0) + coalesce((pct_spikes > 0.05)::int, 0) + coalesce((regular_pct < 60)::int, 0))::int n_limits from q""",
    "most_affected": f"with {QUALITY} select entity, round(pct_spikes, 6) pct_spikes from q order by q.pct_spikes desc nulls last, entity limit 15",
    "spike_rate_spread": f"with {QUALITY} select round(quantile_cont(pct_spikes, 0.25), 6) p25, round(quantile_cont(pct_spikes, 0.5), 6) p50, round(quantile_cont(pct_spikes, 0.75), 6) p75, round(max(pct_spikes), 6) \"max\" from q",
    "device_rules": f"""with {DATED}, c as (select a entity, count(*) n, sum((la is null or lo is null)::int) no_position, sum(coalesce(abs(la) > 90 or abs(lo) > 180, false)::int) off_globe,
      sum(coalesce(v < 0, false)::int) negative_speed from r1 group by 1) select *, no_position + off_globe + negative_speed = 0 ok from c""",
    "guard_flag_total": f"with {PAIRS} select sum(flagged::int) by_device, sum(flagged::int) by_rank from ip",
    "triplet_excursions": f"with {_TRIP} select a entity, count(*) triplets, round(max(x), 2) greatest_m from tp group by 1",
    "seconds_deduplicated": f"""with {DATED} select a entity, count(distinct t // 1000000) "seconds" from tr group by 1""",
    "devices_near_start": f"""with {DATED}, f as (select a, first(la order by t, e, la, lo) la, first(lo order by t, e, la, lo) lo, {ORIGIN[0]} qla, {ORIGIN[1]} qlo from tr group by 1)
      select a entity, round({dist("", "q")}, 2) metres from f""",
    "tag_batches": f"with {BATCH} select a entity, batch from ba",
    "devices_without_fixes": f"""with {DATED} select distinct {_KEY} entity from acc_records where "event-id" is not null and "individual-local-identifier" is not null
      and "timestamp" is not null and {_KEY} not in (select a from tr)""",
}

_PTS = f"""{PAIRS}, ff as ({_FIRST}), vz as (select tr.*, ff.e is not null flagged from tr left join ff using (e) where vis), {pairs("vz", "vp")}, {runs("vp", "sg", 21600)}"""
_ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S')"
ORACLES["export_points"] = f"with {_PTS} select a entity, e event_id, {_ISO.format('t')} ts, lo lon, la lat, flagged, island seg from sg"
for _n, _k in (("export_tracks", "island::varchar"), ("export_day_paths", "strftime(make_timestamp(t), '%Y-%m-%d')")):
    ORACLES[_n] = f"""with {_PTS} select a entity, {_k} seg, {_ISO.format("min(t)")} "start", {_ISO.format("max(t)")} "end", count(*) n_fix,
      round((max(t) - min(t)) / 3.6e9, 4) dur_h, round(100.0 * avg(flagged::int), 4) pct_flag, 0 part,
      md5('LINESTRING (' || string_agg(lo::varchar || ' ' || la::varchar, ', ' order by t, e) || ')') wkt_md5 from sg group by 1, 2 having count(*) >= 2"""
