"""The registered queries in DuckDB SQL, written apart from the DataFrame code."""

from __future__ import annotations

PTS = """pts as (select lpad(lower(to_hex(10485760 + user_id)), 6, '0') as icao, event_id as seq, epoch_us(ts) // 60000000 as ts,
 round(30::double + (user_id % 40) * 0.25::double + (k % 20) * 0.01::double, 4) as lat, round(-100::double + (user_id * 7 % 60) * 0.5::double + (k * 3 % 20) * 0.01::double, 4) as lon,
 event_type = 'signup' as surface, case when event_type <> 'signup' then cast(floor(value * 100) as int) end as baro_ft,
 case when event_id % 7 <> 0 then cast(floor(value * 100) as int) + 50 end as geom_ft, (event_id * 37 % 480)::double as gs_kt, (event_id * 53 % 360)::double as track_deg,
 (event_id * 29 % 3000 - 1500)::double as rate_fpm, case when event_id % 97 = 0 then '7700' when event_id % 5 = 0 then '1200' else cast(1000 + k as varchar) end as squawk,
 case when event_id % 3 = 0 then 'N' || (user_id % 7 + 1) || (event_id % 2) end as callsign,
 case event_type when 'click' then 'adsb_icao' when 'view' then 'mlat' when 'purchase' then 'tisb_icao' when 'error' then 'mode_s' end as src,
 case when event_id % 3 <> 0 then 2 else 0 end as version, case when k < 12 then 0 else 3 end as sil, case when k % 2 = 0 then 0 else 8 end as nic, 'A' || (k % 4) as category,
 case when event_type <> 'signup' and event_id % 4 = 0 then cast(floor(value * 100) as int) + cast(event_id % 7 * 200 - 600 as int) end as mcp_ft
 from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""

SES = """ses as (select *, sum(case when since is null or abs(since) > 1800 then 1 else 0 end) over (partition by icao order by ts, seq rows unbounded preceding)::bigint as session
 from (select *, ts - lag(ts) over (partition by icao order by ts, seq) as since from pts))"""

PORTS = """ports as (select 'K' || lpad(cast(s_suppkey as varchar), 6, '0') as ident, round(30 + (s_suppkey * 13 % 400) * 0.025::double, 4) as lat, round(-100 + (s_suppkey * 29 % 600) * 0.05::double, 4) as lon,
 cast(s_suppkey * 17 % 3000 as int) as elevation_ft from supplier)"""

ENDS = """ends as (select ident, lat, lon, elevation_ft, r as runway, (cast(substr(ident, 2) as bigint) * 10 % 180 + case r when 'A' then 0 else 180 end)::double as heading from ports, (values ('A'), ('B')) v(r))"""

LOG = """log as (select lpad(lower(to_hex(10485760 + o_custkey % 50)), 6, '0') as icao, case o_orderstatus when 'F' then 'net_a' when 'O' then 'net_b' else 'net_c' end as source, cast(o_orderdate as date) as date,
 case substr(o_orderpriority, 1, 1) when '1' then 200 when '2' then 404 when '3' then 429 when '4' then 500 else 403 end as status, o_orderkey as fetched_at from orders)"""

VOTES = """votes as (select lpad(lower(to_hex(10485760 + c_custkey % 100)), 6, '0') as icao, case when c_custkey % 11 <> 0 then 'T' || (c_custkey % 3) end as type_code, case when c_custkey % 11 <> 0 then c_mktsegment end as description,
 'N' || c_custkey as registration, c_custkey as fetched_at from customer)"""


def km(a: str, b: str, c: str, d: str) -> str:
    """Kilometres between (a, b) and (c, d)."""
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742.0::double * asin(sqrt(case when {h} > 1 then 1 else {h} end)))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"(((degrees(atan2({y}, {x})) + 360) % 360 + 360) % 360)"


def angle(a: str, b: str) -> str:
    d = f"((({a} - {b}) % 360 + 360) % 360)"
    return f"least({d}, 360 - {d})"


STATE = """case when surface and geom_ft > 300 then 'airborne' when surface and gs_kt > 80 then 'airborne' when surface then 'ground' when baro_ft < 50 and (geom_ft is null or geom_ft < 200) then 'ground'
 when baro_ft >= 50 then 'airborne' when geom_ft >= 200 then 'airborne' when geom_ft < 200 then 'ground' else 'unknown' end"""
REASON = """case when surface and geom_ft > 300 then 'baro_error' when surface and gs_kt > 80 then 'speed_override' when surface then 'surface' when baro_ft < 50 and (geom_ft is null or geom_ft < 200) then 'low'
 when baro_ft >= 50 then 'baro' when geom_ft >= 200 then 'geom' when geom_ft < 200 then 'geom' else 'unknown' end"""
BUCKET = "case when src is null then null when src like 'adsb\\_%' escape '\\' then 'adsb' when src = 'mlat' then 'mlat' when src like 'tisb\\_%' escape '\\' then 'tisb' when src = 'adsc' then 'adsc' else 'other' end"

LEGS = f"""mov as (select *, {km("lag(lat) over w", "lag(lon) over w", "lat", "lon")} as step_km, {km("first(lat) over w", "first(lon) over w", "lat", "lon")} as away_km from ses window w as (partition by icao, session order by ts, seq)),
 legs as (select icao, session, min(ts) as takeoff_ts, max(ts) as landing_ts, count(*) as n_points, arg_min(lat, (ts, seq)) as takeoff_lat, arg_min(lon, (ts, seq)) as takeoff_lon, arg_max(lat, (ts, seq)) as landing_lat,
 arg_max(lon, (ts, seq)) as landing_lon, max(baro_ft) as max_alt_ft, max(gs_kt) as max_gs_kt, coalesce(sum(step_km), 0) as path_km, max(away_km) as max_km,
 coalesce(string_agg(distinct callsign, ',' order by callsign), '') as callsigns, max(case when squawk in ('7500', '7600', '7700') then squawk end) as emergency_squawk from mov group by icao, session)"""


def nearest(rows: str, key: str, lat: str, lon: str, small: float, large: float) -> str:
    """The nearest airport in the small box, or in the large one if the small one holds none."""
    box = f"abs({lat} - p.lat) <= {large}::double and abs({lon} - p.lon) <= {large}::double"
    far = f"not (abs({lat} - p.lat) <= {small}::double and abs({lon} - p.lon) <= {small}::double)"
    inner = f"select {', '.join('r.' + k.strip() for k in key.split(','))}, {far} as far, {km(lat, lon, 'p.lat', 'p.lon')} as km, p.ident as ident from {rows} r join ports p on {box}"
    return f"select {key}, arg_min(ident, (far, km, ident)) as ident, arg_min(km, (far, km, ident)) as km from ({inner}) group by {key}"


DAYS = "(select icao, ts // 86400 as day, count(*) filter (version = 2) as v2, count(*) filter (version = 2 and sil = 0) as sil0, count(*) filter (version = 2 and nic = 0) as nic0, coalesce(string_agg(distinct case when version = 2 then src end, ',' order by case when version = 2 then src end), '') as sources, min(ts) as first_ts, min(callsign) as callsign from pts group by icao, ts // 86400)"
SCORES = f"scores as (select *, round(case when v2 > 0 then 100 * sil0 / v2 else 0 end, 2) as sil0_pct, v2 >= 25 and case when v2 > 0 then 100 * sil0 / v2 else 0 end >= 10 as flagged from {DAYS})"


def lerp(x: str, low: float, high: float) -> str:
    v = f"(({x} - {low}) / {high - low}::double)"
    return f"(case when {v} < 0 then 0 when {v} > 1 then 1 else {v} end)"


def descent(inside: str, place: str) -> str:
    """Descent over the points inside a window."""
    rated = f"case when {inside} and rate_fpm is not null then {place} end"
    high = f"filter ({inside} and baro_ft is not null)"
    fell = f"(arg_max(baro_ft, (ts, seq)) {high} - arg_min(baro_ft, (ts, seq)) {high})"
    span = f"greatest(1, max(case when {inside} then ts end) - min(case when {inside} then ts end))"
    return f"(case when count({rated}) > 0 then {lerp(f'-(sum({rated} * rate_fpm) / sum({rated}))', 0, 800)} when count(*) {high} >= 2 then {lerp(f'(-{fell} / {span} * 60)', 0, 800)} else 0.5 end)::double"


#: The distance to the airport at each landing, where one matches; NO_PORT where none is asked for.
NO_PORT = "pk as (select icao, session, null::double as km from ses where false)"
PORT = f"pk as (select icao, session, km from ({nearest('legs', 'icao, session', 'r.landing_lat', 'r.landing_lon', 0.15, 0.5)}) where km <= 10)"

LAND = f"""cl as (select *, {STATE} as state, {REASON} as reason, row_number() over (partition by icao, session order by ts desc, seq desc) as back, max(ts) over (partition by icao, session) as fin,
 row_number() over (partition by icao, session order by ts, seq) as rn, 1000 * {km("lag(lat) over w", "lag(lon) over w", "lat", "lon")} as jump from ses window w as (partition by icao, session order by ts, seq)),
 la as (select *, max(case when state = 'airborne' then (ts, seq) end) over (partition by icao, session) as last_air from cl),
 dn as (select *, min(case when state = 'ground' and (last_air is null or (ts, seq) > last_air) then ts end) over (partition by icao, session) as down from la),
 wf as (select *, fin - ts <= 120 as tail, coalesce(ts between down - 180 and down - 30, false) as flare from dn),
 wt as (select *, rn - min(case when tail then rn end) over (partition by icao, session) + 1 as tail_at, rn - min(case when flare then rn end) over (partition by icao, session) + 1 as flare_at from wf),
 sig as (select icao, session, count(*) as n, (max(ts) - min(ts)) / 60 as minutes, {descent("tail", "tail_at")} as descent, case when count(*) filter (flare) > 0 then {descent("flare", "flare_at")} end as flare_descent,
 count(*) filter (back <= 5 and rate_fpm <= -200) as sinking, count(*) filter (reason in ('baro_error', 'speed_override')) as errors, count(*) filter (state = 'ground') as ground_points, max(case when state = 'ground' and back <= 5 then jump end) as jump_m,
 arg_max(baro_ft, (ts, seq)) filter (state = 'airborne' and baro_ft is not null) as last_alt, max(case when back = 1 then baro_ft end) as seen_alt, arg_max(gs_kt, (ts, seq)) as last_gs, max(baro_ft) as max_alt, arg_max(state, (ts, seq)) = 'ground' as landed from wt group by icao, session),
 typed as (select sig.*, pk.km, case when n >= 10 and errors / n > 0.2 then 'altitude_error'
  when not landed and (coalesce(last_alt, 0) > 2000 or coalesce(last_gs, 0) > 100 or coalesce(max_alt, 0) > 3000) and coalesce(last_alt, 0) < 5000 and sinking >= 3 then 'dropped'
  when not landed and (coalesce(last_alt, 0) > 2000 or coalesce(last_gs, 0) > 100 or coalesce(max_alt, 0) > 3000) then 'signal_lost' when not landed or minutes > 240 then 'uncertain'
  when ({lerp("coalesce(last_alt, 0)", 500, 5000)} * 3 + {lerp("coalesce(last_gs, 0)", 30, 180)} * 2.5 + (case ground_points when 0 then 1 when 1 then 0.3 when 2 then 0.1 else 0 end)::double * 3 + (1 - descent) * 2 + {lerp("coalesce(jump_m, 0)", 100, 500)} * 1.5) / 12 > 0.6 then 'signal_lost' else 'confirmed' end as landing_type from sig left join pk using (icao, session)),
 landings as (select icao, session, landing_type, round(case when landing_type in ('signal_lost', 'dropped') then 0 when landing_type = 'altitude_error' then 0.1 when landing_type = 'uncertain' then 0.15 else
  exp((2 * ln(greatest(0.01, coalesce(flare_descent, descent))) + 2 * ln(greatest(0.01, coalesce({lerp("last_gs", 180, 30)}, 0.5))) + 2 * ln(greatest(0.01, coalesce({lerp("last_alt", 5000, 500)}, 0.5))) + 2 * ln(greatest(0.01, coalesce(1 - case when km is not null then {lerp("km", 0, 10)} end, 0.3::double))) + ln(greatest(0.01, 1 - {lerp("coalesce(jump_m, 0)", 200, 500)}))
  + 1.5 * ln(greatest(0.01, (case ground_points when 0 then 0 when 1 then 0.5 else least(1, 0.5 + 0.25 * (ground_points - 1)) end)::double)) + 0.5 * ln((case when minutes < 1440 then 1 when minutes < 2880 then 0.5 else 0.1 end)::double)) / 11) end::double, 2) as confidence,
 round(descent, 3) + 0 as descent, ground_points, last_alt, seen_alt from typed)"""

FULL = f"""ori as (select icao, session, ident as origin from ({nearest("legs", "icao, session", "r.takeoff_lat", "r.takeoff_lon", 0.15, 0.5)}) where km <= 10), des as (select icao, session, ident as destination from ({nearest("legs", "icao, session", "r.landing_lat", "r.landing_lon", 0.15, 0.5)}) where km <= 10),
 fl as (select *, (landing_ts - takeoff_ts) / 60 as minutes, nullif(string_split(callsigns, ',')[1], '') as callsign from legs join (select icao, session, landing_type from landings) using (icao, session) left join ori using (icao, session) left join des using (icao, session))"""

MISSION = """ms as (select * exclude (callsign), case when session % 13 = 0 then 'NJE12' when session % 17 = 0 then 'N911AB' when session % 19 = 0 then 'CX7MT' when session % 23 = 0 then 'CX7LMT' else callsign end as callsign, case session % 4 when 0 then 'C172' when 1 then 'GLF5' end as kind from fl),
 mis as (select *, case when session % 29 = 0 then 'offshore' when callsign like 'N911%' then 'ems_hems' when callsign like 'NJE%' then 'exec_charter' when callsign like '%MT' and callsign not like '%LMT' then 'ems_hems' when max_km > 0 and path_km / (2 * max_km) > 3 and max_gs_kt < 120 and coalesce(kind, '') <> 'GLF5' then 'survey'
 when origin = destination and max_alt_ft < 5000 and kind = 'C172' then 'training' when origin = destination and max_alt_ft < 3000 and coalesce(kind, '') <> 'GLF5' then 'pattern' when origin <> destination then 'transport'
 when regexp_matches(callsign, '^N[0-9A-Z]+$') and (origin is not null or destination is not null) then 'transport' else 'unknown' end as mission from ms)"""

EVENTS = """ev as (select icao, session, takeoff_ts as ts, callsign, unnest([case when emergency_squawk is not null then {'type': 'emergency_squawk', 'severity': 'emergency', 'summary': 'squawk ' || emergency_squawk} end, case when n_points % 11 = 0 then {'type': 'emergency_flag', 'severity': 'emergency', 'summary': 'emergency flag: general'} end,
 case when landing_type = 'confirmed' and destination is null then {'type': 'off_airport_landing', 'severity': 'unusual', 'summary': 'confirmed landing, no airport or helipad match'} end, case when n_points % 3 = 0 then {'type': 'long_hover', 'severity': 'unusual', 'summary': 'hover 400s (6.7 min)'} end,
 case when n_points % 4 >= 2 then {'type': 'multiple_go_arounds', 'severity': 'unusual', 'summary': (n_points % 4) || ' go-arounds on this flight'} end]) as e from fl), evs as (select icao, session, ts, callsign, e.type as type, e.severity as severity, e.summary as summary from ev where e is not null)"""

SEGMENTS = "cut as (select *, sum(case when since is null or since > {gap} then 1 else 0 end) over (partition by {key} order by ts, seq rows unbounded preceding) as seg from (select *, ts - lag(ts) over (partition by {key} order by ts, seq) as since from kept))"


def daily() -> str:
    return f"with {PTS}, {SES}, {LEGS}, {SCORES}, d as (select icao, takeoff_ts // 86400 as day, count(*) as n, max(emergency_squawk is not null) as e from legs group by icao, takeoff_ts // 86400), c as (select icao, unnest(range(325, 365)) as day from (select distinct icao from legs)) select c.icao as icao, c.day as day, coalesce(n, 0) as flights, coalesce(e, false) or coalesce(s.flagged, false) as flagged from c left join d using (icao, day) left join (select icao, day, flagged from scores where flagged) s using (icao, day)"


def sql() -> dict[str, str]:
    p, s, legs = f"with {PTS}", f"with {PTS}, {SES}", f"with {PTS}, {SES}, {LEGS}"
    full = f"{legs}, {PORTS}, {NO_PORT}, {LAND}, {FULL}"
    out = {
        "w01_sessions": f"{legs} select icao, session, takeoff_ts, landing_ts, n_points, takeoff_lat, landing_lon, max_alt_ft, max_gs_kt, callsigns, emergency_squawk from legs",
        "w05_durations": f"{legs} select icao, session, round((landing_ts - takeoff_ts) / 60, 1) as minutes, ((landing_ts - takeoff_ts) // 3600) || 'h ' || ((landing_ts - takeoff_ts) // 60 % 60) || 'm' as label from legs",
        "w10_gaps": f"{p}, {PORTS}, q as (select * from (select *, (ts, round(lat, 5), round(lon, 5)) is not distinct from lag((ts, round(lat, 5), round(lon, 5))) over (partition by icao order by ts, seq) as same from pts) where not same), "
        "g as (select icao, lag(ts) over w as start_ts, ts as end_ts, ts - lag(ts) over w as gap_s, lag(lat) over w as lat, lag(lon) over w as lon, lag(case when not surface then baro_ft end) over w as alt_ft, "
        "sum(case when src like 'adsb%' then 1 else 0 end) over (partition by icao order by ts, seq rows between 10 preceding and 1 preceding) / count(*) over (partition by icao order by ts, seq rows between 10 preceding and 1 preceding) as pre_adsb, "
        "sum(case when src like 'adsb%' then 1 else 0 end) over (partition by icao order by ts, seq rows between current row and 9 following) / count(*) over (partition by icao order by ts, seq rows between current row and 9 following) as post_adsb from q window w as (partition by icao order by ts, seq)), "
        f"f as (select * from g where gap_s between 300 and 1800), n as ({nearest('f', 'icao, end_ts', 'r.lat', 'r.lon', 0.5, 2.0)}) "
        "select icao, start_ts, end_ts, gap_s, alt_ft, round(pre_adsb, 3) as pre_adsb, round(post_adsb, 3) as post_adsb, round(km * 0.539957::double, 2) as nearest_nm, case when alt_ft is null then 'unknown' when alt_ft < 3000 or km is null or round(km * 0.539957::double, 2) > 300 or (pre_adsb < 0.3 and post_adsb < 0.3) then 'coverage_hole' "
        "when alt_ft >= 15000 and pre_adsb >= 0.7 and post_adsb >= 0.7 and round(km * 0.539957::double, 2) <= 200 then 'likely_transponder_off' else 'unknown' end as gap_class from f left join n using (icao, end_ts)",
        "p03_ground_state": f"{p} select {STATE} as state, {REASON} as reason, case when src like 'adsb%' then 'adsb' when src like 'mlat%' then 'mlat' else 'other' end as kind, count(*) as n from pts group by 1, 2, 3",
        "a02_source_mix": f"{p} select icao, count(*) as n_points, " + ", ".join(f"round(100 * count(*) filter (b = '{b}') / count(*), 2) as {b}_pct" for b in ("adsb", "mlat", "tisb", "adsc", "other")) + f", count(*) filter (r in ('baro_error', 'speed_override')) as baro_error_points from (select *, {BUCKET} as b, {REASON} as r from pts) group by icao",
        "a03_spoof_scores": f"{p}, {SCORES} select icao, day, v2, sil0, nic0, sources, first_ts, callsign, sil0_pct, flagged from scores",
        "a06_fragments": f"{p}, c as (select *, sum(case when since is null or since > 300 then 1 else 0 end) over (partition by icao order by ts, seq rows unbounded preceding)::bigint as fragment from (select *, ts - lag(ts) over (partition by icao order by ts, seq) as since from pts)) "
        "select icao, fragment, count(*) as n, min(ts) as start_ts, max(ts) as end_ts, arg_min(lat, (ts, seq)) as first_lat, arg_max(lat, (ts, seq)) as last_lat, min(case when surface then 0 else baro_ft end) as alt_min, max(case when not surface then baro_ft end) as alt_max, min(gs_kt) as gs_min, max(gs_kt) as gs_max, "
        "count(*) filter (version = 2) as v2, count(*) filter (version = 2 and sil = 0) as v2_sil0, count(*) filter (version = 2 and nic = 0) as v2_nic0, string_agg(distinct squawk, ',' order by squawk) as squawks, count(*) filter (src = 'mlat') as mlat from c group by icao, fragment",
        "a19_weighted_mix": f"{s}, m as (select icao, session, count(*) as n_points, " + ", ".join(f"round(100 * count(*) filter (b = '{b}') / count(*), 2) as {b}_pct" for b in ("adsb", "mlat", "tisb", "other")) + f" from (select *, {BUCKET} as b from ses) group by icao, session) select icao, sum(n_points)::bigint as n_points, " + ", ".join(f"round(sum({b}_pct * n_points) / sum(n_points), 2) as {b}_pct" for b in ("adsb", "mlat", "tisb", "other")) + " from m group by icao",
        "a27_squawk_summary": f"{s}, t as (select * from (select icao, session, ts, seq, squawk, lag(squawk) over w as old, max(ts) over (partition by icao, session) as fin from ses window w as (partition by icao, session order by ts, seq)) where old is null or old <> squawk), "
        "h as (select *, coalesce(lead(ts) over (partition by icao, session order by ts, seq), fin) - ts as held from t), c as (select icao, session, squawk, sum(held)::bigint as s, count(*) as runs from h group by icao, session, squawk) "
        "select icao, session, string_agg(squawk, ',' order by squawk) as squawks, arg_min(squawk, (-s, squawk)) as primary_squawk, sum(s)::bigint as total_s, sum(case when squawk = '1200' then s else 0 end)::bigint as vfr_s, sum(runs)::bigint - 1 as changes, sum(s) > 0 and sum(case when squawk = '1200' then s else 0 end) >= 0.8 * sum(s) as vfr from c group by icao, session",
        "a29_category_mode": f"{p} select icao, arg_min(category, (-n, category)) as category from (select icao, category, count(*) as n from pts group by icao, category) group by icao",
        "a35_mean_heading": f"{p} select icao, round(((degrees(atan2(sum(sin(radians(track_deg))), sum(cos(radians(track_deg))))) + 360) % 360 + 360) % 360, 2) as heading from pts where gs_kt > 40 group by icao",
        "a37_path_metrics": f"{legs} select icao, session, round(path_km, 3) as path_km, round(max_km, 3) as max_km, case when max_km > 0 then round(path_km / (2 * max_km), 3) end as loiter, case when path_km > 1 then round(least(1.0::double, max_km / path_km), 3) end as efficiency from legs",
        "w04_carried_callsign": f"{p} select icao, ts, seq, last_value(callsign ignore nulls) over (partition by icao order by ts, seq rows unbounded preceding) as callsign from pts",
        "w08_turnarounds": f"{legs}, t as (select icao, session, takeoff_ts, (takeoff_ts - lag(landing_ts) over w) / 60 as m, row_number() over w = 1 as first, lead(session) over w is null as last from legs window w as (partition by icao order by takeoff_ts, session)), "
        "u as (select icao, session, takeoff_ts, case when m >= 0 and m <= 4320 then round(m, 1) end as turn_min, first, last from t) select *, case when first then 'first_observed' when turn_min is null then 'extended_gap' when turn_min < 30 then 'quick' when turn_min < 240 then 'medium' when turn_min < 1080 then 'overnight' else 'multi_day' end as category from u",
        "w13_squawk_changes": f"{p}, t as (select * from (select icao, ts, seq, squawk, lag(squawk) over w as old, max(ts) over (partition by icao) as fin from pts window w as (partition by icao order by ts, seq)) where old is null or old <> squawk) "
        "select icao, ts, squawk as value, coalesce(lead(ts) over (partition by icao order by ts, seq), fin) - ts as held_s from t",
        "w19_phase_seconds": f"{s}, r as (select icao, session, {STATE} as state, ts - lag(ts) over (partition by icao, session order by ts, seq) as dt, coalesce(rate_fpm, 0) as rate from ses) "
        "select icao, session, coalesce(sum(case when dt <= 60 and rate > 250 then dt end), 0)::bigint as climb_s, coalesce(sum(case when dt <= 60 and rate < -250 then dt end), 0)::bigint as descent_s, coalesce(sum(case when dt > 60 then least(dt, 1800) when abs(rate) <= 250 then dt end), 0)::bigint as level_s, count(*) filter (dt > 60) as gaps from r where state = 'airborne' and dt > 0 group by icao, session",
        "w26_slow_runs": f"{p}, f as (select *, gs_kt < 120 as i, lag(gs_kt < 120) over (partition by icao order by ts, seq) as b from pts), r as (select *, sum(case when i and not coalesce(b, false) then 1 else 0 end) over (partition by icao order by ts, seq rows unbounded preceding) as run from f) select icao, min(ts) as start_ts, max(ts) as end_ts, count(*) as n from r where i group by icao, run",
        "w30_map_points": f"{p}, m as (select icao, ts as t, round(lat, 4) as lat, round(lon, 4) as lon, arg_min(src, seq) filter (src is not null) as s0, min(seq) as seq from pts group by icao, ts, round(lat, 4), round(lon, 4)) select m.icao as icao, t, m.lat as lat, m.lon as lon, p.src as src, m.seq as seq, coalesce(lead(t) over (partition by m.icao order by t, m.seq) - t > 60, false) as dashed from m join pts p on p.seq = m.seq",
        "j04_nearest_airport": f"{legs}, {PORTS}, n as ({nearest('legs', 'icao, session', 'r.takeoff_lat', 'r.takeoff_lon', 0.15, 0.5)}) select icao, session, case when km <= 2 then ident end as airport, case when km > 2 then ident end as near_airport, round(km, 2) as km from n where km <= 10",
        "j11_hex_ranges": f"{p}, r as (select n_name as country, 10485760 + n_nationkey * 8 as low, 10485760 + n_nationkey * 8 + case when n_nationkey % 3 = 0 then 20 else 5 end as high from nation), a as (select distinct icao, ('0x' || icao)::bigint as n from pts) select icao, arg_min(country, (high - low, low)) as country from a left join r on n between low and high group by icao",
        "j14_interval_join": f"{legs} select p.icao as icao, p.seq as seq, p.ts as msg_ts, l.session as session from pts p join legs l on p.icao = l.icao and p.ts between l.takeoff_ts and l.landing_ts where p.squawk = '7700'",
        "j15_shipments_in_window": "select l_linenumber, count(*) as n, min(d) as least, max(d) as most from (select l_linenumber, (cast(l_shipdate as date) - cast(o_orderdate as date))::bigint as d from lineitem join orders on l_orderkey = o_orderkey) where d between 0 and 30 group by l_linenumber",
        "j18_identity": f"with {VOTES}, x as (select icao, max(registration) as r, max(type_code) as t from votes where fetched_at % 2 = 1 group by icao), y as (select icao, max(registration) as r, max(type_code) as t from votes where fetched_at % 2 = 0 group by icao) "
        "select v.icao as icao, coalesce(x.r, y.r) as registration, coalesce(x.t, y.t) as type_code, concat_ws(',', case when x.r <> y.r then 'registration' end, case when x.t <> y.t then 'type_code' end) as conflicts from (select distinct icao from votes) v left join x using (icao) left join y using (icao)",
        "j20_missing_crossref": f"{p}, {VOTES} select distinct icao from pts where icao not in (select icao from votes)",
        "j26_closest_approach": f"{p}, m as (select icao, ts, seq, baro_ft, {km('lat', 'lon', '34.0::double', '-90.0::double')} * 1000 as m from pts) select icao, round(m, 1) as metres, ts, baro_ft from (select *, row_number() over (partition by icao order by m, ts, seq) as r from m) where r = 1",
        "j27_prior_end": f"{legs} select icao, arg_max(landing_ts, takeoff_ts) as prev_end_ts from legs where takeoff_ts < 28420000 group by icao",
        "a07_registry_vote": f"with {VOTES}, c as (select icao, type_code, description, count(*) as n, max(fetched_at) as latest from votes where type_code is not null or description is not null group by icao, type_code, description), w as (select *, row_number() over (partition by icao order by n desc, latest desc) as r, sum(n) over (partition by icao) as every from c) "
        "select l.icao as icao, registration, type_code, description, coalesce(every - n, 0)::bigint as drift from (select icao, arg_max(registration, fetched_at) as registration from votes group by icao) l left join (select * from w where r = 1) w using (icao)",
        "a10_aircraft_stats": f"{full}, st as (select icao, unnest([origin, destination]) as airport from fl), v as (select icao, airport, count(*) as n, row_number() over (partition by icao order by count(*) desc, airport) as r from st where airport is not null group by icao, airport), "
        "b as (select icao, count(*) as airports, sum(n) as every, max(case when r = 1 then airport end) as home, max(case when r = 1 then n end) as hn, max(case when r = 2 then airport end) as second, max(case when r = 2 then n end) as sn from v group by icao), "
        "bd as (select icao, max(n) as busiest_count, arg_max(day, (n, day)) as busiest_day from (select icao, takeoff_ts // 86400 as day, count(*) as n from fl group by icao, takeoff_ts // 86400) group by icao), "
        "t as (select icao, min(takeoff_ts // 86400) as first_day, max(takeoff_ts // 86400) as last_day, count(*) as flights, count(*) filter (landing_type = 'confirmed') as confirmed, round(coalesce(sum(case when landing_ts > takeoff_ts then landing_ts - takeoff_ts end), 0) / 3600, 2) as hours, round(avg(case when landing_ts > takeoff_ts then landing_ts - takeoff_ts end) / 60, 1) as mean_minutes, count(distinct callsign) as callsigns from fl group by icao), "
        "u as (select *, round(confirmed / flights, 3) as confirmation_rate from t) select icao, first_day, last_day, flights, confirmed, hours, mean_minutes, callsigns, coalesce(airports, 0) as airports, home, round(hn / every, 3) as home_share, second, round(sn / every, 3) as second_share, busiest_day, busiest_count, confirmation_rate, "
        "case when confirmation_rate >= 0.5 then 'excellent' when confirmation_rate >= 0.3 then 'good' when confirmation_rate >= 0.1 then 'poor' else 'very_poor' end as tier from u left join b using (icao) left join bd using (icao)",
        "a12_quality_summary": f"{legs}, {PORTS}, {PORT}, {LAND} select landing_type, count(*) as n, round(avg(confidence), 3) as confidence from landings group by landing_type",
        "a13_top_airports": f"{full} select airport, count(*) as visits from (select unnest([origin, destination]) as airport from fl) where airport is not null group by airport order by visits desc, airport limit 10",
        "a15_fetched_dates": f"with {LOG} select icao, source, date from log group by icao, source, date having bool_or(not (status in (403, 429) or status >= 500)) union select icao, source, date from log where fetched_at % 97 = 0",
        "a16_resume_starts": f"with {LOG}, d as (select icao, source, max(case when not (status in (403, 429) or status >= 500) then date end) as last from log group by icao, source) select icao, source, cast(coalesce(last, min(last) over (partition by icao)) + 1 as date) as start from d",
        "p23_source_health": f"with {LOG}, r as (select * from (select *, row_number() over (partition by source order by fetched_at desc) as rank from log) where rank <= 30), f as (select source, coalesce(min(case when not (status in (403, 429) or status >= 500) then rank end) - 1, max(rank)) as failing from r group by source) select source, failing, failing >= 2 as unhealthy from f",
        "a18_mission_breakdown": f"{full}, {MISSION} select mission, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 2) as pct from mis group by mission",
        "c09_missions": f"{full}, {MISSION} select icao, session, mission from mis",
        "a22_daily_activity": daily(),
        "a43_activity_ramp": f"with daily as ({daily()}) select icao, day, case when flights > 0 then least(7, 1 + round_even(flights / max(flights) over (partition by icao) * 6, 0)::int) else 0 end as step from daily",
        "c01_landings": f"{legs}, {PORTS}, {PORT}, {LAND} select * from landings",
        "c10_events": f"{full}, {EVENTS} select icao, session, ts, callsign, type, severity, summary from evs",
        "o04_events_per_aircraft": f"{full}, {EVENTS} select icao, session, ts, callsign, type, severity, summary from (select *, row_number() over (partition by icao order by ts desc, session, type) as r from evs) where r <= 5",
        "p09_spoof_gate": f"{full}, {SCORES}, g as (select fl.icao as icao, session, v2, sil0, case when v2 >= 3 and 100 * sil0 / v2 >= 60 then 'hard_sil0' when v2 >= 3 and 100 * sil0 / v2 >= 10 and max_gs_kt * 2.2 > 900 then 'sil0_plus_teleport' when max_alt_ft < 500 and origin is null and destination is null and regexp_matches(fl.callsign, '^EK[0-9]+$') then 'crude_heuristic' end as why from fl join scores s on s.icao = fl.icao and s.day = takeoff_ts // 86400) select icao, session, why, v2, sil0 from g where why is not null",
        "f04_octal_addresses": "select o_orderkey as k, lpad(lower(to_hex(o_orderkey + 10485760)), 6, '0') as icao from orders",
        "g06_runway_alignment": f"{p}, {PORTS}, {ENDS}, pr as (select p.icao, p.ts, p.seq, e.ident as p_ident, e.runway as p_runway, e.heading, {km('p.lat', 'p.lon', 'e.lat', 'e.lon')} as km, {bearing('p.lat', 'p.lon', 'e.lat', 'e.lon')} as b, p.track_deg, p.baro_ft, e.elevation_ft from pts p join ends e on abs(p.lat - e.lat) <= 0.5 and abs(p.lon - e.lon) <= 0.5), "
        f"kept as (select *, km * 1000 * radians({angle('b', 'heading')}) as off from pr where coalesce(baro_ft, 0) <= elevation_ft + 30000 and cos(radians(b - track_deg)) > 0 and km * 1000 * radians({angle('b', 'heading')}) < 6000), {SEGMENTS.format(gap=200000, key='icao, p_ident, p_runway')} "
        "select icao, p_ident, p_runway, min(ts) as start_ts, max(ts) as end_ts, count(*) as n, round(min(off), 1) as offset_m, round(min(km), 1) as km from cut group by icao, p_ident, p_runway, seg having max(ts) - min(ts) >= 30",
        "g15_takeoff_runway": f"{p}, {PORTS}, {ENDS}, pr as (select p.*, e.ident as p_ident, e.runway as p_runway, e.heading, e.elevation_ft, {km('p.lat', 'p.lon', 'e.lat', 'e.lon')} * 1000 as m, radians({bearing('e.lat', 'e.lon', 'p.lat', 'p.lon')} - e.heading) as t from pts p join ends e on abs(p.lat - e.lat) <= 0.1 and abs(p.lon - e.lon) <= 0.1), "
        f"kept as (select * from pr where coalesce(baro_ft, 0) <= elevation_ft + 60000 and (coalesce(rate_fpm, 0) > 256 or gs_kt > 80) and m * cos(t) between 0 and 6000 and abs(m * sin(t)) <= 25 + m * cos(t) * tan(radians(40.0::double))), {SEGMENTS.format(gap=200000, key='icao, p_ident, p_runway')}, "
        "r as (select icao, p_ident, p_runway, max(ts) - min(ts) as d, max(gs_kt) as gs from cut group by icao, p_ident, p_runway, seg) select icao, p_ident, arg_min(p_runway, (-d, p_runway)) as runway, max(d) as run_s from r where gs >= 80 group by icao, p_ident",
        "t03_reactivations": f"{legs}, {LOG}, d as (select distinct icao, date as day from log where status = 200), b as (select icao, max(day) as last_day from d where day < date '1997-01-01' group by icao), n as (select icao, last_day, min(day) as first_new from d join b using (icao) where day > last_day group by icao, last_day) "
        "select icao, last_day, first_new from n where first_new - last_day >= 5 and exists (select 1 from log where log.icao = n.icao and status = 404 and log.date > last_day and log.date < first_new)",
        "t04_new_emergencies": f"{legs}, b as (select icao, max(takeoff_ts) as last_takeoff from legs where takeoff_ts < 28420000 group by icao) select icao, session, takeoff_ts, emergency_squawk from legs join b using (icao) where takeoff_ts > last_takeoff and emergency_squawk is not null",
        "t05_new_spoofs": f"{p}, {SCORES} select icao, day from scores where sil0_pct >= 10 and day >= 329",
        "t09_hourly_windows": f"{p} select icao, ts // 3600 * 3600 as start_ts, count(*) as n, round(avg(gs_kt), 3) as gs from pts group by icao, ts // 3600",
        "t10_live_sessions": f"{p}, c as (select *, sum(case when since is null or since > 1800 then 1 else 0 end) over (partition by icao order by ts, seq rows unbounded preceding) as s from (select *, ts - lag(ts) over (partition by icao order by ts, seq) as since from pts)) select icao, min(ts) as start_ts, max(ts) + 1800 as end_ts, count(*) as n, max(baro_ft) as max_alt_ft from c group by icao, s",
        "s06_latest_wins": f"with {LOG} select icao, source, date, arg_max(status, fetched_at) as status, max(fetched_at) as fetched_at from log group by icao, source, date",
        "o02_newest_legs": f"{legs} select icao, session, takeoff_ts, n_points from legs order by takeoff_ts desc, icao, session limit 50",
        "w20_peak_rates": f"{s}, r as (select icao, session, ts, rate_fpm from (select *, {STATE} as state from ses) where state = 'airborne'), q as (select icao, session, list(rate_fpm) over w as l, ts - min(ts) over w as span from r window w as (partition by icao, session order by ts range between 3600 preceding and current row)), "
        "m as (select icao, session, list_filter(l, lambda x: abs(x - list_median(l)) <= 3 * greatest(1, abs(list_median(l))) + 500) as k from q where len(l) >= 4 and span >= 30), b as (select icao, session, max(list_avg(k)) as up, min(list_avg(k)) as down from m where len(k) >= 4 group by icao, session) "
        "select icao, session, case when up > 0 then round(least(up, 10000)) end as peak_climb, case when down < 0 then round(greatest(down, -10000)) end as peak_descent from b",
        "a34_go_arounds": f"{s}, t as (select * from (select *, max(ts) over (partition by icao, session) as fin from ses where baro_ft is not null) where fin - ts <= 7200), n as (select *, min(baro_ft) over w as lo, max(baro_ft) over w as hi, count(*) over (partition by icao, session) as n from t window w as (partition by icao, session order by ts range between 600 preceding and 600 following)), "
        "k as (select icao, session, ts, seq, baro_ft, case when baro_ft = lo then 'low' else 'high' end as kind from n where hi - lo >= 50 and (baro_ft = lo or baro_ft = hi) and n >= 3), f as (select * from (select *, lag(kind) over (partition by icao, session order by ts, seq) as b from k) where b is null or b <> kind), "
        "c as (select icao, session, kind = 'low' and lead(baro_ft) over (partition by icao, session order by ts, seq) - baro_ft >= 400 as up from f) select icao, session, count(*) filter (up) as go_arounds from c group by icao, session",
        "w21_autopilot_target": f"{s}, r as (select *, {STATE} as state from ses), q as (select *, max(baro_ft) over w as top, coalesce(max(case when state = 'airborne' and rate_fpm < -500 then 1 else 0 end) over (partition by icao, session order by ts, seq rows between unbounded preceding and 1 preceding), 0) as sank from r window w as (partition by icao, session order by ts, seq rows unbounded preceding)) "
        "select icao, session, arg_max(mcp_ft, (ts, seq)) as target_ft from q where mcp_ft is not null and state = 'airborne' and sank = 0 and baro_ft >= 0.85 * top and abs(mcp_ft - baro_ft) < 500 and (rate_fpm is null or rate_fpm > -250) group by icao, session",
        "c02_takeoff_confidence": f"{legs}, {PORTS}, n as ({nearest('legs', 'icao, session', 'r.takeoff_lat', 'r.takeoff_lon', 0.15, 0.5)}), r as (select icao, session, ts, seq, {STATE} as state, {REASON} as reason from ses), f as (select *, min(case when state = 'airborne' then (ts, seq) end) over (partition by icao, session) as air from r), "
        "g as (select icao, session, count(*) filter (state = 'ground' and (air is null or (ts, seq) < air)) as gp, arg_min(state, (ts, seq)) = 'airborne' as mid, count(*) >= 10 and count(*) filter (reason in ('baro_error', 'speed_override')) / count(*) > 0.2 as bad from f group by icao, session), "
        f"j as (select g.*, case when km <= 10 then km end as km from g left join n using (icao, session)), s as (select *, case when gp = 0 then 0.2 when gp = 1 then 0.5 when gp = 2 then 0.7 else 1 end::double as q from j) select icao, session, round(case when mid then 0.3 else case when km is null then q else (2 * q + 1.5 * (1 - {lerp('km', 0, 10)})) / 3.5 end end::double * case when bad then 0.3::double else 1 end, 2) as confidence from s",
        "w16_implied_speeds": f"{s}, r as (select *, ts - lag(ts) over w as dt, {km('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} as km, last_value(callsign ignore nulls) over (partition by icao, session order by ts, seq rows between unbounded preceding and 1 preceding) as said from ses window w as (partition by icao, session order by ts, seq)) "
        "select icao, session, round(max(case when dt >= 10 then km / 1.852::double / (dt / 3600) end), 1) as implied_kt, count(*) filter (callsign <> said) as callsign_changes from r group by icao, session",
        "g16_landing_anchor": f"{s}, r as (select *, row_number() over (partition by icao, session order by ts desc, seq desc) as back, max(ts) over (partition by icao, session) as fin from ses), q as (select *, row_number() over (partition by icao, session order by coalesce(baro_ft, 1 << 30), back) as pick from r where back <= 240 and fin - ts <= 600) select icao, session, lat, lon, baro_ft as alt_ft from q where pick = 1",
        "p22_routes": f"{full} select icao, string_agg(destination || ' (' || case when minutes < 1 then '<1m' else floor(minutes)::bigint || 'm' end || ')', ' -> ' order by takeoff_ts, session) as route from fl where destination is not null group by icao",
        "a17_status": f"{legs} select icao, count(*) as legs, count(distinct takeoff_ts // 86400) as days, count(emergency_squawk) as emergencies, coalesce(string_agg(distinct emergency_squawk, ',' order by emergency_squawk), '') as codes, max(max_alt_ft) as max_alt_ft, sum(n_points)::bigint as points from legs group by icao",
        "p16_aircraft_search": f"{legs} select icao, max(takeoff_ts) as last_takeoff, count(*) as legs from legs where contains(icao, 'n51') or contains(lower(callsigns), 'n51') group by icao",
        "a26_global_counts": f"{p} select src, count(distinct icao) as aircraft, count(*) as points, count(distinct ts // 86400) as days from pts group by src",
        "a24_long_gaps": f"{p}, q as (select * from (select *, (ts, round(lat, 5), round(lon, 5)) is not distinct from lag((ts, round(lat, 5), round(lon, 5))) over (partition by icao order by ts, seq) as same from pts) where not same), g as (select icao, lag(ts) over w as start_ts, ts - lag(ts) over w as gap_s from q window w as (partition by icao order by ts, seq)) select icao, start_ts, gap_s from g where gap_s between 601 and 1800 order by gap_s desc, icao, start_ts limit 50",
        "a23_off_airport": f"{full} select icao, count(*) as n from fl where landing_type = 'confirmed' and destination is null group by icao order by n desc, icao limit 20",
        "t07_incremental_legs": f"{legs} select icao, session, takeoff_ts, landing_ts, n_points, max_alt_ft from legs",
        "p13_legs_between": f"{full} select icao, session, takeoff_ts, origin, destination from fl where takeoff_ts // 86400 = 328",
        "p19_shown_ends": f"{legs}, {PORTS}, {NO_PORT}, {LAND}, o as ({nearest('legs', 'icao, session', 'r.takeoff_lat', 'r.takeoff_lon', 0.15, 0.5)}), e as ({nearest('legs', 'icao, session', 'r.landing_lat', 'r.landing_lon', 0.15, 0.5)}) "
        "select l.icao as icao, l.session as session, case when o.km <= 2 then o.ident when o.km <= 10 then '~' || o.ident end as from, case when e.km <= 2 then e.ident when e.km <= 10 then '~' || e.ident when landing_type in ('signal_lost', 'dropped') then 'sig lost' end as to from landings l left join o on o.icao = l.icao and o.session = l.session left join e on e.icao = l.icao and e.session = l.session",
        "p21_links": f"{p}, i as (select distinct icao from pts) select icao, 'map' as site, 'https://map.example/?icao=' || icao as url from i union all select icao, 'photo', 'https://photo.example/' || icao from i",
        "f12_mix_labels": f"{p}, m as (select icao, count(*) filter (src like 'adsb%') as ad, count(*) filter (src like 'mlat%') as ml, count(*) as n from pts group by icao) select icao, cast(100 * ad // n as varchar) as adsb, cast(100 * ml // n as varchar) as mlat, cast(100 * (n - ad - ml) // n as varchar) as other from m",
        "a42_layers": f"{p}, c as (select icao, case when src in ('adsb_icao', 'mlat') then src else 'other' end as layer, count(*) as n from pts group by 1, 2) select icao, layer, n, round(100 * n / sum(n) over (partition by icao), 1) as pct from c",
        "f19_retention": f"with {LOG}, d as (select icao, source, max(case when not (status in (403, 429) or status >= 500) then date end) as last from log group by icao, source), s as (select icao, source, cast(coalesce(last, min(last) over (partition by icao)) + 1 as date) as start from d), m as (select *, (date '2002-01-01' - case source when 'net_a' then 30 when 'net_b' then 3650 end - start)::int as missing_days from s) select icao, source, start, missing_days from m where missing_days > 0",
        "w33_refused_sources": f"with {LOG}, e as (select source || '-' || icao as source, date, bool_and(status = 403) as refused from log group by 1, 2), r as (select *, row_number() over (partition by source order by date desc) as rank from e) select source, bool_and(refused) as tripped, count(*) as days from r where rank <= 2 group by source",
        "g08_climbs_between": f"{p}, f as (select *, gs_kt < 120 as i, lag(gs_kt < 120) over (partition by icao order by ts, seq) as b from pts), r as (select *, sum(case when i and not coalesce(b, false) then 1 else 0 end) over (partition by icao order by ts, seq rows unbounded preceding) as run from f), s as (select icao, min(ts) as start_ts, max(ts) as end_ts from r where i group by icao, run), "
        "g as (select * from (select *, lead(start_ts) over (partition by icao order by start_ts) as nxt from s) where nxt > end_ts + 1) select g.icao as icao, end_ts + 1 as a, max(baro_ft) - 1000 > 500 as climbed from g join pts p on p.icao = g.icao and p.ts between end_ts + 1 and nxt - 1 group by g.icao, end_ts + 1",
        "a39_promoted_types": f"{legs}, q as (select icao, session, n_points > 12 as overridden, count(*) filter (n_points > 12) over (partition by icao) as n from legs) select icao, session, overridden, true as promoted from q where icao like 'a0000%' and n >= 3",
        "o07_all_aircraft": f"{p}, {LOG} select icao from pts union select icao from log",
    }
    from .oracle_flights import sql as of_flights
    from .oracle_read import more

    out |= more(out)
    return out | of_flights(out)
