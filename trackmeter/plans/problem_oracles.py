"""The same answers in plain SQL over whole tables, for the general problems."""

PLACED = """
animals as (select "event-id" e, lower(trim("individual-local-identifier", chr(32)||chr(9)||chr(13)||chr(10)||chr(160))) a,
    epoch_us("timestamp") t, "location-lat" la, "location-long" lo, epoch_us(delivered_at) d from position_fixes
    where "event-id" is not null and "individual-local-identifier" is not null and "timestamp" is not null),
dated as (select e, a, t, la, lo from (select *, row_number() over (partition by e order by d nulls last, t, a, la, lo) r from animals) where r = 1),
placed as (select * from dated where la is not null and lo is not null and not isnan(la) and not isnan(lo))
"""


def dist(a: str, b: str) -> str:
    """Great-circle metres between the points named by the prefixes a and b."""
    return (
        f"(2*6371008.8*asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians({b}la-{a}la)/2),2)"
        f"+cos(radians({a}la))*cos(radians({b}la))*pow(sin(radians({b}lo-{a}lo)/2),2))))))"
    )


def _lags(n: int, m: int, tie: str = "e") -> str:
    cols = [f"{f}({c},{k}) over w {p}{k}{c}" for f, p, k_ in (("lag", "p", n), ("lead", "n", m)) for k in range(1, k_ + 1) for c in ("e", "la", "lo")]
    return ", ".join(cols)


P1_FOUND = f"""
with {PLACED},
nb as (select *, {_lags(1, 3)} from placed window w as (partition by a order by t, e)),
st as (select *, case when p1la is not null then {dist("p1", "")} end d from nb),
yard as (select a, quantile_cont(d, 0.95) y, avg((d = 0)::int) z from st where d is not null group by a),
s as (select st.*, 10*y lim from st join yard using (a)),
hit as (
  select unnest([e]) event_id from s where {dist("p1", "")} > lim and {dist("n1", "")} > lim and {dist("p1", "n1")} <= lim
  union all select unnest([e, n1e]) from s where {dist("p1", "")} > lim and {dist("n2", "")} > lim and {dist("p1", "n1")} > lim and {dist("n2", "n1")} > lim
    and {dist("p1", "n2")} <= lim
  union all select unnest([e, n1e, n2e]) from s where {dist("p1", "")} > lim and {dist("n3", "")} > lim and {dist("p1", "n1")} > lim and {dist("n3", "n1")} > lim
    and {dist("p1", "n2")} > lim and {dist("n3", "n2")} > lim and {dist("p1", "n3")} <= lim),
brk as (select *, case when la = p1la and lo = p1lo then 0 else 1 end b from nb),
isl as (select *, sum(b) over (partition by a order by t, e rows unbounded preceding) g from brk),
frozen as (select e event_id from (select isl.e, count(*) over (partition by isl.a, g) n, z from isl join yard using (a)) where n >= 6 and z < 0.1)
select event_id from hit where event_id is not null
union select event_id from frozen
union select e from placed where abs(la) > 90 or abs(lo) > 180 or (la = 0 and lo = 0)
"""

P5_FOUND = f"""
with {PLACED},
g as (select *, case when t - lag(t) over w <= 3600000000 then 0 else 1 end b from dated window w as (partition by a order by t, e)),
s as (select *, sum(b) over (partition by a order by t, e rows unbounded preceding) k from g)
select first(e order by t, e) first_event_id, last(e order by t, e) last_event_id from s group by a, k
"""

P5_SESSIONS = f"""
with {PLACED},
g as (select *, case when t - lag(t) over w <= 3600000000 then 0 else 1 end b from dated window w as (partition by a order by t, e)),
s as (select *, sum(b) over (partition by a order by t, e rows unbounded preceding) k from g)
select a entity, k session_no, first(e order by t, e) first_event_id, last(e order by t, e) last_event_id, min(t) start_us, max(t) end_us,
  (max(t) - min(t)) / 1e6 duration_s, count(*) n_records from s group by a, k
"""

P6_FOUND = f"""
with {PLACED},
ok as (select e, a, la, lo from placed where abs(la) <= 90 and abs(lo) <= 180 and not (la = 0 and lo = 0)),
band as (select *, floor((la + 90) * 3000)::bigint cy from ok),
wide as (select *, unnest([cy - 1, cy, cy + 1]) ny from band)
select least(p.e, q.e) event_id_a, greatest(p.e, q.e) event_id_b
from wide p join band q on p.ny = q.cy and p.a < q.a and abs(p.la - q.la) < 0.0003
where {dist("p.", "q.")} <= 30
"""

_WHOLE = "[[12.5, -9.0], [14.5, -9.0], [14.5, -6.5], [13.75, -7.25], [13.5, -6.5], [12.5, -6.5]]"
P6_REGIONS = f"""
with {PLACED},
tile as (select i, 12.875 + (i % 9) / 8.0 x, -8.0 + (i // 9) / 8.0 y from range(90) t(i)),
shape as (select * from (values ('notched', [[0, 0], [8, 0], [8, 8], [3.53125, 2.28125], [0, 8]]), ('wedge', [[0, 8], [3.53125, 2.28125], [8, 8]]), ('square', [[3, 6], [5, 6], [5, 7], [3, 7]])) s(k, c)),
ring as (select k || '-' || i region_id, list_transform(c, lambda p: [(x + p[1] / 64.0)::double, (y + p[2] / 64.0)::double]) r from tile, shape
  union all select 'large', {_WHOLE}::double[][]),
edge as (select region_id, r[j][1] ax, r[j][2] ay, r[j % len(r) + 1][1] bx, r[j % len(r) + 1][2] b_y from (select *, unnest(range(1, len(r) + 1)) j from ring)),
crossed as (select e event_id, region_id, sum(case when (ay > la) <> (b_y > la) and lo < (bx - ax) * (la - ay) / (b_y - ay) + ax then 1 else 0 end) n,
  bool_or((bx - ax) * (la - ay) - (b_y - ay) * (lo - ax) = 0 and lo between least(ax, bx) and greatest(ax, bx) and la between least(ay, b_y) and greatest(ay, b_y)) b
  from placed, edge where abs(la) <= 90 and abs(lo) <= 180 group by 1, 2)
select event_id, region_id from crossed where n % 2 = 1 or b
"""

_B = "[\\s\\p{Z}\\x{200b}\\x{feff}]"
_M = "[,;|/:!?&*=~@#%^_<>(){}\\[\\]\\\\]"

_P7 = f"""
raw as (select "event-id" event_id, min("eobs:accelerations-raw") r from acc_records where "event-id" is not null group by 1),
odd as (select event_id, regexp_replace(r, '^{_B}+|{_B}+$', '', 'g') r from raw where not regexp_matches(r, '^[+-]?[0-9]+( [+-]?[0-9]+)*$')),
bare as (select event_id, case when regexp_matches(r, '^(\\[.*\\]|\\(.*\\)|\\{{.*\\}})$', 's') then r[2:-2] else r end r from odd),
unq as (select event_id, regexp_replace(regexp_replace(r, '^{_B}+|{_B}+$', '', 'g'), '"([+-]?[0-9]*),?([0-9]*)"', '\\1\\2', 'g') r from bare),
cut as (select event_id, regexp_replace(regexp_replace(r, '^{_M}{_B}*', ''), '{_B}*{_M}$', '') r from unq where r <> ''),
parts as (select event_id, regexp_split_to_array(r, '{_B}*{_M}{_B}*|{_B}+') p from cut),
vals as (select event_id, unnest(p) v, unnest(range(1, len(p) + 1)) pos from parts),
odd_values as (select event_id, pos, v::bigint "value" from vals where regexp_matches(v, '^[+-]?[0-9]+$'))
"""
P7_FOUND = f"with {_P7} select * from odd_values"
P7_VALUES = f"""
with {_P7},
plain as (select event_id, string_split(r, ' ') p from raw where regexp_matches(r, '^[+-]?[0-9]+( [+-]?[0-9]+)*$'))
select * from odd_values
union all select event_id, unnest(range(1, len(p) + 1)) pos, unnest(p)::bigint "value" from plain
"""

_ALIASES = {
    "ground-speed": ("speedoverground", "vitessesol"),
    "height-above-ellipsoid": ("heightellipsoid", "ellipsoidheight", "hauteurellipsoide"),
    "manually-marked-outlier": ("manualoutlier", "markedoutliermanually", "outlier", "aberrantmarquemain"),
    "heading": ("headingdegrees",),
    "external-temperature": ("exttemperature",),
}
_KEY = lambda x: f"regexp_replace(lower({x}), '\\(.*?\\)|\\[.*?\\]|^\\s*[a-z]+:|[^a-z0-9]', '', 'g')"
_CUT = (
    "list_transform(string_split(array_to_string(list_transform(string_split(replace(line, '\"\"', chr(2)), '\"'),"
    " lambda x, i: case when i % 2 = 0 then replace(x, d, chr(1)) else x end), ''), d),"
    " lambda x: case when x = chr(2) then '' else replace(replace(x, chr(1), d), chr(2), '\"') end)"
)
_PARSED = f"""
known as (select field, {_KEY("field")} k from field_dictionary
  {"".join(f" union all select '{f}', '{a}'" for f, ways in _ALIASES.items() for a in ways)}),
head0 as (select file_id, min(line) line from export_lines where line_no = 0 group by 1),
bare as (select *, regexp_replace(line, '"[^"]*"', 'q', 'g') b from head0),
cand as (select file_id, line, d, row_number() over (partition by file_id order by length(b) - length(replace(b, d, '')) desc, d desc) r
  from bare, (select unnest([',', ';', chr(9), '|']) d)),
head as (select file_id, d, list_transform({_CUT}, lambda x: lower(trim(x))) h from cand where r = 1),
cols as (select file_id, unnest(h) header, unnest(range(1, len(h) + 1)) i from head),
col as (select file_id, i, header, field from (select c.*, k.field, row_number() over (partition by c.file_id, k.field order by i) r
  from cols c join known k on {_KEY("c.header")} = k.k) where r = 1),
body as (select l.file_id, l.line_no, {_CUT} v from export_lines l join head using (file_id) where line_no > 0),
cell as (select * from (select b.file_id, b.line_no, c.field, nullif(trim(v[c.i]), '') x from body b join col c using (file_id)) where x is not null)
"""

P2_FOUND = f"""
with {_PARSED},
kind as (select file_id, field, case when bool_and(lower(x) in ('true', 'false')) then 'boolean'
  when bool_and(regexp_full_match(x, '[+-]?[0-9]+')) then 'integer'
  when bool_and(regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')) then 'decimal' else 'text' end k from cell group by 1, 2),
prof as (select c.file_id, c.field, c.header, kind.k from col c left join kind using (file_id, field)),
step as (select * from (select file_id, lag(file_id) over (partition by uuid order by exported_at, file_id) prev from export_files
  where uuid is not null and exported_at is not null) where prev is not null),
now as (select s.file_id, p.field, p.header, p.k from step s join prof p using (file_id)),
old as (select s.file_id, p.field, p.header, p.k from step s join prof p on p.file_id = s.prev),
both_ as (select coalesce(n.file_id, o.file_id) file_id, coalesce(n.field, o.field) field, n.header h1, o.header h0, n.k k1, o.k k0
  from now n full join old o on n.file_id = o.file_id and n.field = o.field)
select file_id, field, 'added' change_kind from both_ where h0 is null
union all select file_id, field, 'removed' from both_ where h1 is null
union all select file_id, field, 'renamed' from both_ where h0 <> h1
union all select file_id, field, 'retyped' from both_ where k0 <> k1
"""

_NUM = "try_cast(replace(nullif(regexp_extract(x, '^([+-]?[0-9]*[.,]?[0-9]+)\\s*\\pL*(/\\pL+)?$', 1), ''), ',', '.') as double)"
_TABLE = {
    "event-id": "case when regexp_full_match(x, '[+-]?[0-9]+') then x::bigint end",
    "eobs:battery-voltage": "case when regexp_full_match(x, '[+-]?[0-9]+') then x::bigint end",
    **{f: _NUM for f in ("location-lat", "location-long", "ground-speed", "height-above-ellipsoid", "heading", "external-temperature")},
    **{
        f: "case when lower(x) in ('true', 'yes', '1', 'outlier') then true when lower(x) in ('false', 'no', '0', 'ok') then false end"
        for f in ("manually-marked-outlier", "visible")
    },
    **{f: "x" for f in ("timestamp", "individual-local-identifier", "tag-local-identifier", "sensor-type", "eobs:status")},
}

_STRICT = """case d.value_type when 'boolean' then lower(x) in ('true', 'false')
  when 'integer' then regexp_full_match(x, '[+-]?[0-9]+') and try_cast(x as bigint) is not null
  when 'decimal' then regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') else true end"""
_NUMBER = "nullif(regexp_extract(x, '^([+-]?[0-9]*[.,]?[0-9]+)\\s*\\pL*(/\\pL+)?$', 1), '')"
_LENIENT = f"""case k.value_type when 'boolean' then lower(x) in ('true', 'yes', '1', 'outlier', 'false', 'no', '0', 'ok')
  when 'integer' then coalesce(regexp_full_match({_NUMBER}, '[+-]?[0-9]+'), false) when 'decimal' then {_NUMBER} is not null else true end"""
_CELLS = f"""
place as (select b.file_id, b.line_no, h, v, unnest(range(1, len(v) + 1)) i from body b join head using (file_id)),
named as (select file_id, line_no, i, nullif(trim(v[i]), '') x, h[i] "name", list_position(h, h[i]) first_at from place),
full_cell as (select n.*, coalesce(case when first_at < n.i then "name" || '_' || (n.i - 1) else "name" end, '_extra_' || (n.i - 1)) as "key",
  d.field is not null and {_STRICT} as typed, c.field is not null and {_LENIENT} as promoted
  from named n left join field_dictionary d on d.field = "name" and first_at = n.i
  left join col c on c.file_id = n.file_id and c.i = n.i left join field_dictionary k on k.field = c.field where x is not null)
"""
_JSON = """'{' || string_agg(to_json("key")::varchar || ':' || to_json(x)::varchar, ',' order by i) || '}'"""
P2_PRESERVED = f"with {_PARSED}, {_CELLS} select file_id, line_no, {_JSON} _rescued from full_cell where not typed group by 1, 2"
P2_RESCUED = f"with {_PARSED}, {_CELLS} select file_id, line_no, {_JSON} _rescued from full_cell where not typed and not promoted group by 1, 2"

P2_TABLE = f"""
with {_PARSED}, {_CELLS},
rest as (select file_id, line_no, {_JSON} r from full_cell where not typed and not promoted group by 1, 2)
select b.file_id, b.line_no, any_value(rest.r) _rescued, {", ".join(f'max(case when field = {chr(39)}{f}{chr(39)} then {e} end) "{f}"' for f, e in _TABLE.items())}
from body b left join cell c using (file_id, line_no) left join rest using (file_id, line_no) group by 1, 2
"""
