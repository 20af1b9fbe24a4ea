"""The planted records and their answers in plain SQL."""

from __future__ import annotations

import math

from trackmeter.operators.accel import SPEED_EDGES, STANDARD_GRAVITY
from trackmeter.plans.bench_oracles import SPAIRS, SPIRALS
from trackmeter.plans.planted_queries import EAST, FLIGHT_S, GAITS, LEG_S, RATE_HZ, REST_S, START, THERMAL_S, WALK_S

_TURN, _RADIUS = 2 * math.pi / 20, 9.0 * 20 / (2 * math.pi)
FLIGHT = f"""fl as (select i, i % {len(EAST)} dev, i // {len(EAST)} s, (i // {len(EAST)}) % {LEG_S} u, (i // {len(EAST)}) // {LEG_S} k from range({FLIGHT_S * len(EAST)}) t(i)),
fx as (select i e, 'bird-' || dev a, s, ({START} + s + 7 * dev) * 1000000 ts, {START} + s + 7 * dev t,
  case when u < {THERMAL_S} then {_RADIUS!r} * sin({_TURN!r} * u) else 9.0 * (u - {THERMAL_S}) end + (2 + 0.25 * dev) * s + ({list(EAST)})[dev + 1] x,
  case when u < {THERMAL_S} then {_RADIUS!r} * (1 - cos({_TURN!r} * u)) else 0.0 end + (1 - 0.1 * k) * s y,
  (case when u < {THERMAL_S} then 300 + 1.2 * u else 420 - 1.5 * (u - {THERMAL_S}) end + 10 * dev)::double alt from fl),
dn as (select a, e, ts, t, 10 + y::double / 111195.0 la, 20 + x::double / 109506.0 lo, alt, {FLIGHT_S} c from fx),
"""


def _planted(sql: str) -> str:
    """The spirals' SQL over the planted flight, at the published constants."""
    return FLIGHT + sql[sql.index("vl as") :].replace("count(*) >= 3 and abs", "count(*) >= 20 and abs").replace("between 0 and 30 ", "between 0 and 300 ")


_SP, _WP = _planted(SPIRALS), _planted(SPAIRS)
_CLASS = " ".join(f"when v < {e} then {i}" for i, e in enumerate(SPEED_EDGES[1:]))
_EDGES = [float(e) for e in SPEED_EDGES]
_TWO_PI = repr(2 * math.pi)
_GAITS = f"""wk as (select i % {len(GAITS)} dev, i // {len(GAITS)} s from range({WALK_S * len(GAITS)}) t(i)),
sm as (select dev, s * {RATE_HZ} + j n, ({[g[0] for g in GAITS]})[dev + 1]::double v,
  1 + 0.3 * sin({_TWO_PI} * ({[g[1] for g in GAITS]})[dev + 1]::double * ((s * {RATE_HZ} + j) / {RATE_HZ})) + 0.1 * sin({_TWO_PI} * 4.9 * ((s * {RATE_HZ} + j) / {RATE_HZ})) x
  from (select *, unnest(range({RATE_HZ})) j from wk)),
fr as (select dev, f, n - f * 48 i, x, v from (select *, unnest([n // 48, n // 48 - 1]) f from sm) where f >= 0 and f * 48 + 96 <= {WALK_S * RATE_HZ}),
ce as (select *, (x - avg(x) over (partition by dev, f)) * (0.5 - 0.5 * cos({_TWO_PI} * i / 95)) w from fr),
po as (select dev, f, k, any_value(v) v, pow(sum(w * cos({_TWO_PI} * k * i / 96)), 2) + pow(sum(w * sin({_TWO_PI} * k * i / 96)), 2) p
  from ce, (select unnest(range(49)) k) group by 1, 2, 3),
pn as (select *, p / sum(p) over (partition by dev, f) q, case {_CLASS} end c from po),
ms as (select c, k, avg(q) q, count(*) n from pn group by 1, 2),
pk as (select c, any_value(n) n, arg_max(k, q) filter (k * {RATE_HZ} / 96.0 between 0.8 and 5.5) k, ({_EDGES}[c + 1] + {_EDGES}[c + 2]) / 2 m from ms group by c)
"""
_WOBBLE = lambda a, m: f"((i * {a}) % {m} / {m} - 0.5) * 10"
_REST = f"""rs as (select 'receiver-' || (i % 3) a, i e, {START} + i // 3 s, 3 + ({_WOBBLE(104729, 997)})::double / 111195.0 la,
  3 + ({_WOBBLE(7919, 1009)} + case when i % 3 = 2 then 900.0 else 40.0 * (i % 3) end)::double / 111195.0 lo, i % 37 / 250.0::double v, 2.0 + i % 5 acc from range({REST_S * 3}) t(i)),
rx as (select *, radians(lo - 3) * 6371008.8 * cos(radians(3)) x, radians(la - 3) * 6371008.8 y from rs)
"""

ORACLES = {
    "planted_spirals": f"""with {_SP} select entity, island, n_rates, round(wind_east, 4) wind_east, round(wind_north, 4) wind_north, start_s, end_s, round(lat, 6) lat, round(lon, 6) lon,
      round(airspeed, 4) airspeed, round(wind, 4) wind, duration_s, round(altitude_m, 3) altitude_m, round(climb_mps, 4) climb_mps, round(wind_from_deg, 3) wind_from_deg from sp""",
    "planted_wind_summary": f"""with {_SP} select count(*) n_spirals, count(distinct entity) n_devices, quantile_cont(duration_s, 0.5) median_duration_s, round(quantile_cont(airspeed, 0.25), 3) airspeed_p25,
      round(quantile_cont(airspeed, 0.5), 3) airspeed_p50, round(quantile_cont(airspeed, 0.75), 3) airspeed_p75, round(quantile_cont(wind, 0.5), 3) wind_p50, round(quantile_cont(wind, 0.9), 3) wind_p90,
      round(quantile_cont(altitude_m, 0.5), 3) median_altitude_m, round(quantile_cont(climb_mps, 0.5), 3) median_climb_mps from sp""",
    "planted_wind_pairs": f"with {_WP} select a_entity, a_island, b_entity, b_island, round(km, 3) distance_km, round(gap, 3) wind_gap from wp where km < 2",
    "planted_wind_agreement": f"""with {_WP} select count(*) n_pairs, round(quantile_cont(gap, 0.5), 3) median_gap, round(quantile_cont(gap, 0.75), 3) p75_gap, round(max(gap), 3) max_gap from wp where km < 2""",
    "planted_wind_structure": f"""with {_WP} select case when km < 2 then 0 when km < 10 then 2 when km < 50 then 10 when km < 200 then 50 else 200 end d_min_km, count(*) n_pairs,
      round(quantile_cont(gap, 0.5), 3) median_gap, round(quantile_cont(gap, 0.75), 3) p75_gap from wp group by 1""",
    "planted_gaits": f"""with {_GAITS} select c "class", n, k * {RATE_HZ} / 96.0 stride_hz, round(m * m / ({STANDARD_GRAVITY} * 0.4), 4) froude, round(m / (k * {RATE_HZ} / 96.0), 4) stride_m from pk where n > 300""",
    "planted_transition": f"""with {_GAITS} select c "class", {_EDGES}[c + 1] >= sqrt(0.5 * {STANDARD_GRAVITY} * 0.4) runs, round(sqrt(0.5 * {STANDARD_GRAVITY} * 0.4), 4) transition_mps from pk""",
    "planted_still_windows": f"""with {_REST} select a entity, s // 60 * 60 window_s, count(*) n, round(sqrt((var_samp(x) + var_samp(y)) / 2), 4) sigma_m, quantile_cont(acc, 0.5)::double acc_m, round(max(v), 4) vmax
      from rx where v < 0.1 group by 1, 2 having count(*) >= 20""",
    "planted_device_pairs": f"""with {_REST}, n as (select p.a a, q.a b, p.s s, p.x - q.x rx, p.y - q.y ry, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) d from rx p join rx q on p.s = q.s and p.a < q.a),
      w2 as (select *, rx - 2 * lag(rx) over w + lag(rx, 2) over w dx, ry - 2 * lag(ry) over w + lag(ry, 2) over w dy from n where d < 100 window w as (partition by a, b order by s))
      select a, b, count(*) n_seconds, round(quantile_cont(d, 0.5), 3) dist_median_m, round(sqrt((var_pop(dx) + var_pop(dy)) / 12), 3) sigma_rel_m,
      round(sqrt((var_pop(dx) + var_pop(dy)) / 24), 3) sigma_each_m from w2 group by 1, 2 having count(*) >= 5000""",
}
