"""The flight state machine and its stitching in DuckDB SQL: a recursion over the points of all sessions at once."""

from __future__ import annotations

from .oracle import LEGS, PTS, SES, STATE, km

#: One state a point. s: the state after it, f: its fragment, opens: it opens that one, shared: it also ends the one before.
MACHINE = f"""o as (select * exclude (since), row_number() over (partition by icao, session order by ts, seq) as n, {STATE} as st, coalesce(last_value(callsign ignore nulls) over (partition by icao order by ts, seq rows between unbounded preceding and current row), null) as said from ses),
 m(icao, session, n, s, f, opens, shared, within, landing, since, landed, lone, g_ts, g_lat, g_lon, from_ts, from_lat, from_lon, mid_air) as (
 select distinct icao, session, 0::bigint, 'none', 0, false, false, false, false, 0::bigint, 0, false, null::bigint, null::double, null::double, null::bigint, null::double, null::double, false from o
 union all
 select o.icao, o.session, o.n,
  case when m.s = 'air' then case when st = 'ground' and not (gs_kt is null and not lone) then 'post' else 'air' end when st = 'airborne' then 'air'
   when m.s = 'post' then case when o.ts - since > 60 or landed + case when st = 'ground' then 1 else 0 end >= 5 then 'ground' else 'post' end when st = 'ground' then 'ground' else m.s end,
  f + case when m.s <> 'air' and st = 'airborne' then 1 else 0 end, m.s <> 'air' and st = 'airborne', m.s = 'post' and st = 'airborne', m.s in ('air', 'post') or st = 'airborne',
  m.s = 'air' and st = 'ground' and not (gs_kt is null and not lone),
  case when m.s = 'air' and st = 'ground' and not (gs_kt is null and not lone) then o.ts else since end,
  case when m.s = 'air' and st = 'ground' and not (gs_kt is null and not lone) then 1 when m.s = 'post' and st = 'ground' then landed + 1 else landed end,
  m.s = 'air' and st = 'ground' and gs_kt is null and not lone,
  case when st = 'ground' and not (m.s = 'air' and gs_kt is null and not lone) then o.ts else g_ts end, case when st = 'ground' and not (m.s = 'air' and gs_kt is null and not lone) then o.lat else g_lat end,
  case when st = 'ground' and not (m.s = 'air' and gs_kt is null and not lone) then o.lon else g_lon end,
  case when m.s = 'none' then o.ts else g_ts end, case when m.s = 'none' then o.lat else g_lat end, case when m.s = 'none' then o.lon else g_lon end, m.s = 'none'
 from m join o on o.icao = m.icao and o.session = m.session and o.n = m.n + 1)"""

FRAGMENTS = f"""rec as (select m.*, o.ts, o.seq, o.lat, o.lon, st, said, coalesce(baro_ft, geom_ft) as h, baro_ft, gs_kt from m join o using (icao, session, n) where within),
 both_ as (select *, f as fragment, opens as own from rec union all select *, f - 1, false from rec where shared),
 frag as (select icao, session, fragment, max(from_ts) filter (own) as takeoff_ts, max(from_lat) filter (own) as takeoff_lat, max(from_lon) filter (own) as takeoff_lon, bool_or(mid_air) filter (own) as mid_air, max(said) filter (own) as callsign,
  min(ts) as first_ts, max(ts) as last_ts, max(ts) filter (landing) as landing_ts, max(lat) filter (landing) as landing_lat, max(lon) filter (landing) as landing_lon, count(*) as n_points,
  count(*) filter (landing or (st = 'ground' and not own and s in ('post', 'ground'))) as landing_points, arg_max(lat, (ts, seq)) as last_lat, arg_max(lon, (ts, seq)) as last_lon, arg_max(h, (ts, seq)) filter (h is not null) as seen_alt_ft,
  arg_max(h, (ts, seq)) filter (h is not null and st = 'airborne') as last_alt_ft, arg_min(h, (ts, seq)) filter (h is not null and st = 'airborne') as first_alt_ft, max(h) filter (st = 'airborne') as peak_ft, max(baro_ft) as max_alt_ft, max(gs_kt) as max_gs_kt
  from both_ group by icao, session, fragment),
 kept as (select *, row_number() over (partition by icao order by session, fragment) as i from frag where n_points > 1 and not coalesce(landing_ts is not null and round((last_ts - first_ts) / 60, 1) < 5 and {km("takeoff_lat", "takeoff_lon", "landing_lat", "landing_lon")} < 5, false))"""

STITCHED = f"""pair as (select a.icao, a.i, coalesce(a.landing_ts is null and b.mid_air and b.first_ts - a.last_ts between 0 and greatest(90, 0.4 * 240) * 60
  and {km("a.last_lat", "a.last_lon", "b.takeoff_lat", "b.takeoff_lon")} <= greatest(b.first_ts - a.last_ts, 60) / 3600 * 300 * 1.852 * 1.2 and coalesce(abs(b.last_alt_ft - a.seen_alt_ft) <= 3000, true)
  and not coalesce(b.first_ts - a.last_ts > 900 and b.first_alt_ft < 8000 and coalesce(b.peak_ft, 0) - b.first_alt_ft > 2000, false), false) as joins from kept a left join kept b on a.icao = b.icao and b.i = a.i + 1),
 walk(icao, i, taken) as (select icao, 1::bigint, false from pair where i = 1 union all select p.icao, p.i, q.joins and not w.taken from walk w join pair q on q.icao = w.icao and q.i = w.i join pair p on p.icao = w.icao and p.i = w.i + 1),
 named as (select k.*, case when taken then k.i - 1 else k.i end as flight from kept k join walk using (icao, i)),
 fl as (select icao, count(*) as fragments, arg_min(takeoff_ts, i) as takeoff_ts, arg_min(takeoff_lat, i) as takeoff_lat, arg_min(takeoff_lon, i) as takeoff_lon, arg_min(mid_air, i) as mid_air, min(first_ts) as first_ts,
  arg_min(first_alt_ft, i) filter (i = flight) as first_alt_ft, coalesce(max(callsign) filter (i = flight), max(callsign) filter (i > flight)) as callsign, max(last_ts) as last_ts,
  max(case when i = last_i then landing_ts end) as landing_ts, max(case when i = last_i then landing_lat end) as landing_lat, max(case when i = last_i then landing_lon end) as landing_lon, max(case when i = last_i then last_lat end) as last_lat, max(case when i = last_i then last_lon end) as last_lon,
  max(case when i = last_i then landing_points end) as landing_points, max(case when i = last_i then seen_alt_ft end) as seen_alt_ft, max(case when i = last_i then last_alt_ft end) as last_alt_ft,
  sum(n_points)::bigint as n_points, max(peak_ft) as peak_ft, max(max_alt_ft) as max_alt_ft, max(max_gs_kt) as max_gs_kt from (select *, max(i) over (partition by icao, flight) as last_i from named) group by icao, flight)"""

#: The same points over more days: every two hours begin one or three days after the two before.
SPREAD = PTS.replace("pts as", "raw as", 1) + ", pts as (select * replace (ts + (2 * (ts // 7200) - ts // 7200 % 2) * 86400 as ts) from raw)"

FLIGHTS = f"with recursive {PTS}, {SES}, {MACHINE}, {FRAGMENTS}, {STITCHED}"


def clusters(eps: float, least: int) -> str:
    """Density clusters of the rows of src (id, lat, lon, ts): all pairs, and what core points reach."""
    near = f"select a.id as u, b.id as v from src a join src b on abs(a.lat - b.lat) <= {eps} / 100 where {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {eps}"
    return f"""np as materialized ({near}), core as (select u from np group by u having count(*) >= {least}), cl as materialized (select np.u, np.v from np join core a on a.u = np.u join core b on b.u = np.v),
 reach(u, v) as (select u, v from cl union select r.u, c.v from reach r join cl c on c.u = r.v), lab as (select u, min(v) as cluster from reach group by u),
 of as (select src.*, coalesce(l.cluster, (select min(m.cluster) from np join lab m on m.u = np.v where np.u = src.id)) as cluster from src left join lab l on l.u = src.id),
 pads as (select cluster, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(*) as landings, min(ts) as first_ts, max(ts) as last_ts from of where cluster is not null group by cluster)"""


def of_flights(enriched: str) -> str:
    """The SQL of enriched sessions, over the points and places of flights instead."""
    ses, machine = SES.replace("ses as", "ses0 as", 1), MACHINE.replace("from ses)", "from ses0)", 1)
    named = STITCHED.split(",\n fl as")[0]
    flown = """flown as materialized (select o.* exclude (session, n, st, said), dense_rank() over (partition by icao order by k.flight) as session from both_ b join named k using (icao, session, fragment) join o using (icao, session, n)),
 flx as materialized (select icao, dense_rank() over (partition by icao order by flight) as session, count(*) as fragments, arg_min(mid_air, i) as mid_air, bool_or(i = last_i and landing_ts is not null) as landed, arg_min(takeoff_lat, i) as takeoff_lat, arg_min(takeoff_lon, i) as takeoff_lon,
  max(case when i = last_i then coalesce(landing_lat, last_lat) end) as landing_lat, max(case when i = last_i then coalesce(landing_lon, last_lon) end) as landing_lon from (select *, max(i) over (partition by icao, flight) as last_i from named) group by icao, flight)"""
    placed = "takeoff_lat takeoff_lon landing_lat landing_lon".split()
    legs = LEGS.replace("legs as (", "legs_ as (", 1) + f", legs as (select l.* exclude ({', '.join(placed)}), {', '.join('f.' + x for x in placed)} from legs_ l join flx f using (icao, session))"
    body = enriched.replace(PTS, "pts as (select * from flown)").replace(SES, "ses as (select * from flown)").replace(LEGS, legs)
    body, _, columns = body.removeprefix("with pts as (select * from flown)").rpartition(" select icao, session, takeoff_ts,")
    shown = f"select icao, session, takeoff_ts, landing_ts, {columns.removesuffix(' from fin')}, mid_air, fragments, fragments - 1 as signal_gaps, landed from fin join flx using (icao, session)"
    return f"with recursive {PTS.replace('pts as', 'raw as', 1)}, {(ses + ', ' + machine + ', ' + FRAGMENTS + ', ' + named).replace('from pts', 'from raw')}, {flown}, pts as (select * from flown){body} {shown}"


def sql(known: dict[str, str]) -> dict[str, str]:
    shown = "*, round((last_ts - first_ts) / 60, 1) as minutes, landing_ts is not null as landed, fragments - 1 as signal_gaps"
    whole = f"{FLIGHTS} select {shown} from fl"
    end = "lag(coalesce(landing_ts, last_ts)) over (partition by icao order by first_ts, takeoff_ts)"
    kept = f"with recursive {SPREAD}, {SES}, {MACHINE}, {FRAGMENTS}, {STITCHED} select {shown}, round((takeoff_ts - {end}) / 60, 1) as ground_min, date '1970-01-01' + (takeoff_ts // 86400)::int as day from fl"
    listed = lambda what: f"coalesce(string_agg(distinct {what}, ',' order by {what}), '')"
    counts = "count(*) as n_points, count(*) filter (version = 2) as v2, count(*) filter (version = 2 and sil = 0) as sil0, count(*) filter (version = 2 and nic = 0) as nic0"
    days = f"select icao, date '1970-01-01' + (ts // 86400)::int as day, {counts}, {listed('case when version = 2 then src end')} as sources, {listed('src')} as all_sources, min(ts) as first_ts, min(callsign) as callsign from pts group by 1, 2"
    scored = f"with {SPREAD}, d as ({days}) select *, round(case when v2 > 0 then 100 * sil0 / v2 else 0 end, 2) as sil0_pct, v2 >= 25 and case when v2 > 0 then 100 * sil0 / v2 else 0 end >= 10 as flagged from d"
    surface = "src as (select seq as id, lat, lon, ts from pts where surface)"
    number = "('0x' || icao)::bigint * 100000 + session * 2"
    ends = f"src as (select {number} as id, takeoff_lat as lat, takeoff_lon as lon, takeoff_ts as ts from legs union all select {number} + 1, landing_lat, landing_lon, landing_ts from legs)"
    named = "*, case when lat < 20 or (lon < -85 and lat < 30) then 'offshore_platform_' else 'helipad_' end || cluster as name"
    pad = lambda end: f"(select arg_min(cluster, (d, -cluster)) from (select cluster, {km(f'fl.{end}_lat', f'fl.{end}_lon', 'pads.lat', 'pads.lon')} as d from pads) where d <= 0.2)"
    pads = {
        "g17_helipads": f"with recursive {PTS}, {surface}, {clusters(1.2, 4)} select * from pads",
        "g18_discovered_pads": f"with recursive {PTS}, {SES}, {LEGS}, {ends}, {clusters(1.2, 4)} select {named} from pads",
        "j16_helipad_backfill": f"{FLIGHTS}, {surface}, {clusters(1.2, 4)} select icao, first_ts, {pad('takeoff')} as origin_pad, {pad('landing')} as destination_pad from fl",
    }
    heard = "h as (select icao, ts, arg_max(squawk, seq) as squawk from pts where squawk is not null group by icao, ts)"
    fresh = "case when l.takeoff_ts - h.ts <= 7200 then {} end"
    pads["j27_squawk_as_of"] = f"with {PTS}, {SES}, {LEGS}, {heard} select l.icao, l.session, l.takeoff_ts as ts, {fresh.format('h.ts')} as as_of, {fresh.format('h.squawk')} as squawk from legs l asof left join h on l.icao = h.icao and l.takeoff_ts > h.ts"
    pads["c14_enriched_flights"] = of_flights(known["a38_enriched"])
    return pads | {"w03_flights": whole, "t09_live_flights": whole, "t07_incremental_extract": kept, "s06_trace_store": scored, "s13_backfill": scored}
