"""The registered queries in DuckDB SQL, continued: corrected rules and the read surface."""

from __future__ import annotations

import math

from .oracle import BUCKET, ENDS, EVENTS, FULL, LAND, LEGS, LOG, MISSION, NO_PORT, PORTS, PTS, REASON, SCORES, SEGMENTS, SES, STATE, VOTES, angle, bearing, km, nearest


def more(known: dict[str, str]) -> dict[str, str]:
    s, legs = f"with {PTS}, {SES}", f"with {PTS}, {SES}, {LEGS}"
    full = f"{legs}, {PORTS}, {NO_PORT}, {LAND}, {FULL}"
    bins = ("c", "d", "l", "z")
    out = {
        "w14_persisted_maxima": f"{s}, k as (select *, case when ({STATE}) = 'airborne' then coalesce(baro_ft, geom_ft) end as raw from ses), q as (select *, case when abs(raw - mcp_ft) <= 5000 then raw end as sure from k), "
        "r as (select icao, session, raw, gs_kt, case when count(sure) over w >= 3 then min(sure) over w end as a, case when count(gs_kt) over w >= 3 then min(gs_kt) over w end as g from q window w as (partition by icao, session order by ts range between 3600 preceding and current row)) "
        "select icao, session, coalesce(max(a), max(raw)) as alt_ft, coalesce(max(g), max(gs_kt)) as gs_kt from r group by icao, session",
        "w29_safe_boundary": f"with {LOG}, d as (select distinct icao, date from log), g as (select icao, date, date - lag(date) over (partition by icao order by date) as gap, min(case when date >= date '1995-06-01' then date end) over (partition by icao) as first from d) select icao, max(date) as boundary from g where (gap is null or (gap > 2 and (gap - 1) * 1440 > 96)) and date <= first group by icao",
        "j10_probable_destination": f"{legs}, {PORTS}, {NO_PORT}, {LAND}, an as ({known['g16_landing_anchor']}), lo as (select l.icao, l.session, l.descent, l.seen_alt, an.lat, an.lon from landings l join an using (icao, session) where landing_type in ('signal_lost', 'dropped')), n as ({nearest('lo', 'icao, session', 'r.lat', 'r.lon', 0.5, 0.5)}) "
        "select icao, session, ident as probable, round(km, 2) as km, round(0.4::double * greatest(0, least(1, (5000 - case when coalesce(seen_alt, 0) = 0 then 5000 else seen_alt end) / 4500)) + 0.4::double * greatest(0, 1 - km / 46.3::double) + 0.2::double * descent, 2) as confidence from n join lo using (icao, session) where km <= 46.3",
        "g09_navaid_alignment": f"with {PTS}, nv as (select 'V' || p_partkey as ident, round(30 + (p_partkey * 7 % 1000) * 0.01::double, 4) as lat, round(-100 + (p_partkey * 11 % 3000) * 0.01::double, 4) as lon from part), "
        f"ps as (select distinct p.icao as icao, e.ident as ident, e.lat as elat, e.lon as elon from (select distinct icao, lat, lon from pts) p join nv e on abs(p.lat - e.lat) <= 1.4 where {km('p.lat', 'p.lon', 'e.lat', 'e.lon')} <= 80 * 1.852::double), "
        f"pr as (select p.icao, p.ts, p.seq, ident as p_ident, {km('p.lat', 'p.lon', 'elat', 'elon')} / 1.852::double as nm from pts p join ps using (icao) where {angle(bearing('p.lat', 'p.lon', 'elat', 'elon'), 'track_deg')} < 5), kept as (select * from pr where nm <= 500), {SEGMENTS.format(gap=200000, key='icao, p_ident')} "
        "select icao, p_ident, min(ts) as start_ts, max(ts) as end_ts, count(*) as n, round(min(nm), 2) as nm from cut group by icao, p_ident, seg having max(ts) - min(ts) >= 30 and round(min(nm), 2) < 80",
        "a31_phase_budget": f"{s}, r as (select *, {STATE} as state, ts - lag(ts) over (partition by icao, session order by ts, seq) as dt, max(baro_ft) over (partition by icao, session) as top, max(gs_kt) over (partition by icao, session) as fast, max(ts) over (partition by icao, session) - min(ts) over (partition by icao, session) as len from ses), "
        "q as (select *, case when dt <= 60 and rate_fpm > 250 then 'climb' when dt <= 60 and rate_fpm < -250 then 'descent' when baro_ft >= 0.7 * top then 'cruise' else 'level' end as phase, case when dt <= 60 then dt else least(dt, 1800) end as s from r where state = 'airborne' and dt > 0), "
        "v as (select *, avg(case when phase = 'cruise' then gs_kt end) over (partition by icao, session) as mg, greatest(5, coalesce(stddev_samp(case when phase = 'cruise' then gs_kt end) over (partition by icao, session), 5)) as dg from q), "
        "u as (select icao, session, sum(case when phase = 'climb' then s else 0 end) as c, sum(case when phase = 'descent' then s else 0 end) as d, sum(case when phase = 'level' then s else 0 end) as l, sum(case when phase = 'cruise' then s else 0 end) as z, max(len) as len, max(top) as top, max(fast) as fast, "
        "sum(case when phase = 'cruise' then baro_ft * s end) / sum(case when phase = 'cruise' and baro_ft is not null then s end) as alt, list_median(flatten(list(case when phase = 'cruise' and abs(gs_kt - mg) <= 2 * dg then list_transform(range(greatest(1, s)), lambda i: gs_kt) else [] end))) as gs from v group by icao, session), "
        "t as (select *, (c + d + l + z)::double as every, case when len > 0 then least(c + d + l + z, len) else c + d + l + z end::double as active, top >= 500 and len >= 120 and l + z > 0 as enough from u), "
        f"f as (select *, {', '.join(f'{b} * active / nullif(every, 0) as s{b}' for b in bins)} from t), h as (select *, round_even(active, 0) - ({' + '.join(f'floor(s{b})' for b in bins)}) as lack, {', '.join(f's{b} - floor(s{b}) as r{b}' for b in bins)} from f) select icao, session, "
        + ", ".join(
            f"case when enough and every > 0 then (floor(s{b}) + case when {' + '.join(f'(r{o} > r{b} or (r{o} = r{b} and {j > i}))::int' for j, o in enumerate(bins))} < abs(lack) then sign(lack) else 0 end)::bigint else {plain} end as {name}_s"
            for i, (b, plain, name) in enumerate(zip(bins, ("c::bigint", "d::bigint", "(l + z)::bigint", "null::bigint"), ("climb", "descent", "level", "cruise"), strict=True))
        )
        + ", case when enough then least(round_even(alt, 0), top::double) end as cruise_alt, case when enough then least(round_even(gs, 0), fast) end as cruise_gs from h",
    }
    out["p11_type_caps"] = (
        f"{legs}, {VOTES}, c as (select icao, type_code, count(*) as n, max(fetched_at) as latest from votes where type_code is not null or description is not null group by icao, type_code, description), w as (select icao, arg_max(type_code, (n, latest)) as rt from c group by icao), x as (select icao, max(type_code) as xt from votes where fetched_at % 2 = 0 group by icao), "
        f"ap as ({known['w21_autopilot_target']}), ph as ({out['a31_phase_budget']}), t as (select l.*, coalesce(rt, xt) as type_code, target_ft, cruise_alt, cruise_gs from legs l left join w using (icao) left join x using (icao) left join ap using (icao, session) left join ph using (icao, session)), "
        "k as (select *, case type_code when 'T0' then 2000 when 'T1' then 30000 else 60000 end as ceiling, floor(case type_code when 'T0' then 200 when 'T1' then 400 else 800 end * 1.1::double) as gcap from t), "
        "m as (select *, case when max_alt_ft is not null then least(max_alt_ft, case when abs(max_alt_ft - target_ft) <= 5000 then floor(ceiling * 1.1::double) else ceiling end)::int end as alt from k) "
        "select icao, session, type_code, alt as max_alt_ft, least(max_gs_kt, gcap) as max_gs_kt, case when cruise_alt is not null then least(cruise_alt, alt::double) end as cruise_alt, case when cruise_gs is not null then least(cruise_gs, gcap) end as cruise_gs from m"
    )
    return out | read(known | out) | more_functions()


#: A type for each aircraft, by the last digit of its address.
TYPES = "ty as (select distinct icao, case when substr(icao, 6, 1) in ('0', '1', '2', '3') then 'C172' when substr(icao, 6, 1) in ('4', '5', '6', '7') then 'GLF5' end as type_code from pts)"
TRACE = f"{LOG}, td as (select * from log where status = 200)"
LOST = "landing_type in ('signal_lost', 'dropped')"
SPOOF = "why is not null"

#: Points as messages with block times: out in its own hour, in three hours on.
SAID = """msg as (select icao, ts, seq, case seq % 4 when 0 then '14' when 1 then '44' when 2 then 'H1' else 'QQ' end as label, (ts // 86400) * 86400 + (ts // 3600 % 24) * 3600 + seq % 60 * 60 as o0, (ts // 86400) * 86400 + ((ts // 3600 + 3) % 24) * 3600 + seq % 60 * 60 as i0 from pts where seq % 3 = 0),
 tim as (select *, case when label <> 'QQ' then o0 - case when o0 - ts > 43200 then 86400 when o0 - ts < -43200 then -86400 else 0 end end as o_out, case when label <> 'QQ' then i0 - case when i0 - ts > 43200 then 86400 when i0 - ts < -43200 then -86400 else 0 end end as o_in from msg)"""

VOTED = "{name} as (select l.icao as icao, registration, type_code, description from (select icao, arg_max(registration, fetched_at) as registration from votes where {where} group by icao) l left join (select * from (select *, row_number() over (partition by icao order by n desc, latest desc) as r from (select icao, type_code, description, count(*) as n, max(fetched_at) as latest from votes where (type_code is not null or description is not null) and {where} group by icao, type_code, description)) where r = 1) w using (icao))"
CROSS = "cx as (select icao, max(registration) as registration, max(type_code) as type_code, icao like '%3' as military from votes where fetched_at % 2 = 0 group by icao)"


def enrichment(known: dict[str, str]) -> str:
    """Tables up to ``fin``: all legs that are no noise, with everything derived."""
    land = LAND.replace("minutes > 240", "minutes > case when substr(icao, 6, 1) in ('4', '5', '6', '7') then 780 else 240 end")
    port = f"pk as (select icao, session, km from ({nearest('legs', 'icao, session', 'r.landing_lat', 'r.landing_lon', 0.15, 0.5)}) where km <= 10)"
    likely = known["j10_probable_destination"].replace("minutes > 240", "minutes > case when substr(icao, 6, 1) in ('4', '5', '6', '7') then 780 else 240 end")
    segments = known["g06_runway_alignment"].replace("since > 200000", "since > 1800")
    mission = "case when callsign like 'N911%' then 'ems_hems' when callsign like '%MT' then 'ems_hems' when max_km > 0 and path_km / (2 * max_km) > 3 and cruise_gs < 120 and coalesce(type_code, '') <> 'GLF5' then 'survey' when origin = destination and max_alt_ft < 5000 and type_code = 'C172' then 'training' when origin = destination and max_alt_ft < 3000 and coalesce(type_code, '') <> 'GLF5' then 'pattern' when origin <> destination then 'transport' when regexp_matches(callsign, '^N[0-9A-Z]+$') and (origin is not null or destination is not null) then 'transport' else 'unknown' end"
    return (
        f"with {PTS}, {SES}, {LEGS}, {PORTS}, {port}, {land}, {TYPES}, nn as (select l.*, x.landing_type, x.confidence, x.last_alt, round((landing_ts - takeoff_ts) / 60, 1) as minutes from legs l join landings x using (icao, session)), "
        "kp as (select * from nn where not ((landing_type in ('signal_lost', 'dropped', 'uncertain') and minutes < 3 and n_points < 10) or (path_km < 0.5 and max_km < 0.5 and coalesce(max_alt_ft, 0) < 1000 and coalesce(max_gs_kt, 0) < 15))), "
        f"eo as ({nearest('kp', 'icao, session', 'r.takeoff_lat', 'r.takeoff_lon', 0.15, 0.5)}), ee as ({nearest('kp', 'icao, session', 'r.landing_lat', 'r.landing_lon', 0.15, 0.5)}), a31 as ({known['a31_phase_budget']}), w21 as ({known['w21_autopilot_target']}), lik as ({likely}), sgm as ({segments}), "
        f"en as (select kp.*, type_code, cruise_alt, cruise_gs, target_ft, case when eo.km <= 2 then eo.ident end as origin, case when eo.km > 2 and eo.km <= 10 then eo.ident end as near_origin, case when not {LOST} and ee.km <= 2 then ee.ident end as destination, case when not {LOST} and ee.km > 2 and ee.km <= 10 then ee.ident end as near_destination, nullif(string_split(callsigns, ',')[1], '') as callsign "
        "from kp left join eo using (icao, session) left join ee using (icao, session) left join ty using (icao) left join a31 using (icao, session) left join w21 using (icao, session)), "
        f"mi as (select *, {mission} as mission0 from en), "
        "cp as (select *, case when max_alt_ft is not null then least(max_alt_ft, case when abs(max_alt_ft - target_ft) <= 5000 then floor(ceiling * 1.1::double) else ceiling end)::int end as alt, floor(case type_code when 'C172' then 160 when 'GLF5' then 590 else 800 end * 1.1::double) as gcap from (select *, case type_code when 'C172' then 14000 when 'GLF5' then 51000 else 60000 end as ceiling from mi)), "
        "lk as (select cp.*, lik.probable as probable, coalesce(destination, near_destination, lik.probable) as likely from cp left join lik using (icao, session)), "
        "bst as (select lk.icao as icao, lk.session as session, count(*) as n, max(end_ts - start_ts) as s, arg_max(p_runway, (end_ts - start_ts, -start_ts, p_runway)) as runway from lk join sgm on sgm.icao = lk.icao and sgm.p_ident = likely and start_ts >= takeoff_ts and end_ts <= landing_ts group by lk.icao, lk.session), "
        "fin as (select lk.* exclude (landing_type, confidence, max_alt_ft, max_gs_kt, cruise_alt, cruise_gs), alt as max_alt_ft, least(max_gs_kt, gcap) as max_gs_kt, case when cruise_alt is not null then least(cruise_alt, alt::double) end as cruise_alt, case when cruise_gs is not null then least(cruise_gs, gcap) end as cruise_gs, runway as aligned_runway, s as aligned_s, coalesce(n, 0) as pattern_cycles, "
        "case when s >= 60 then round(least(1, confidence + 0.25::double), 2) when s >= 30 then round(least(1, confidence + 0.15::double), 2) else confidence end as confidence, case when landing_type = 'signal_lost' and s >= 60 and last_alt < coalesce(elevation_ft, 0) + 30000 then 'dropped' else landing_type end as landing_type, "
        "case when origin = destination and coalesce(n, 0) >= 2 and mission0 in ('unknown', 'transport', 'pattern') then 'pattern' else mission0 end as mission from lk left join bst using (icao, session) left join ports on ports.ident = likely)"
    )


def read(known: dict[str, str]) -> dict[str, str]:
    p, s, legs = f"with {PTS}", f"with {PTS}, {SES}", f"with {PTS}, {SES}, {LEGS}"
    full = f"{legs}, {PORTS}, {NO_PORT}, {LAND}, {FULL}"
    fin = enrichment(known)
    spoofed = f"{full}, {SCORES}, sp as (select fl.*, v2, sil0, case when v2 >= 3 and 100 * sil0 / v2 >= 60 then 'hard_sil0' when v2 >= 3 and 100 * sil0 / v2 >= 10 and max_gs_kt * 2.2 > 900 then 'sil0_plus_teleport' when max_alt_ft < 500 and origin is null and destination is null and regexp_matches(fl.callsign, '^EK[0-9]+$') then 'crude_heuristic' end as why from fl left join scores s on s.icao = fl.icao and s.day = takeoff_ts // 86400)"
    scored = SCORES.replace("v2 >= 25", "v2 >= 3")
    spoofs = "se as (select icao, null::bigint as session, first_ts as ts, callsign, 'spoof_bimodal_integrity' as type, 'unusual' as severity, format('pooled v2 samples with sil=0: {:.1f}% ({} v2 samples across {} source(s))', round_even(1000 * sil0 / v2, 0) / 10, v2, case when sources = '' then 0 else len(string_split(sources, ',')) end) as summary, day from scores where flagged)"
    listed = f"{full.replace('with ', '', 1)}, {VOTES}, {VOTED.format(name='rg', where='fetched_at % 3 = 0')}, {CROSS}, {SCORES}, st as ({known['a10_aircraft_stats']}), sn as (select icao, count(*) as n from scores where sil0_pct >= 10 and v2 >= 3 group by icao), hv as (select distinct icao from pts where gs_kt < 30), li as (select st.icao as icao, coalesce(rg.registration, cx.registration) as registration, coalesce(rg.type_code, cx.type_code) as type_code, rg.description as description, flights, hours, home, last_day, coalesce(sn.n, 0) as spoofs, coalesce(cx.military, false) as military, "
    listed += "concat_ws(' ', case when cx.military then 'MIL' end, case when sn.n > 0 then 'SPF' end, case when hv.icao is not null then 'HOVER' end, case when cx.type_code <> rg.type_code then 'TYP' end) as flags from st left join rg using (icao) left join cx using (icao) left join sn using (icao) left join hv using (icao))"
    raw = "rm as (select lower(coalesce(case when c_custkey % 3 = 0 then lpad(to_hex(c_custkey + 10485760), 6, '0') end, case when c_custkey % 5 <> 0 then lpad(to_hex(c_custkey + 10485760), 6, '0') end)) as icao, cast(c_custkey as varchar) as n_number, c_name as name, case when c_custkey % 4 <> 0 then c_mktsegment end as city, null::varchar as street from customer where c_custkey % 3 = 0 or c_custkey % 5 <> 0)"
    return {
        "a38_enriched": f"{fin} select icao, session, takeoff_ts, minutes, origin, near_origin, destination, near_destination, landing_type, confidence, mission, max_alt_ft, max_gs_kt, cruise_alt, cruise_gs, probable, aligned_runway, aligned_s, pattern_cycles from fin",
        "p24_trips": f"{fin}, {SAID}, sq as ({known['a27_squawk_summary']}), ms as (select f.icao as icao, f.session as session, count(*) as said, bool_or(coalesce(o_out, o_in) is not null) as oooi from fin f join tim m on m.icao = f.icao and m.ts between takeoff_ts and landing_ts group by f.icao, f.session) "
        "select fin.icao as icao, fin.session as session, make_date((takeoff_ts // 86400)::int) as date, coalesce(origin, '~' || near_origin, format('({:.2f}, {:.2f})', takeoff_lat, takeoff_lon)) as from, case when destination is not null then destination when landing_type in ('dropped', 'signal_lost') and probable is not null then '~' || probable when landing_type = 'signal_lost' then 'signal lost' else format('({:.2f}, {:.2f})', landing_lat, landing_lon) end as to, "
        "case when minutes > 0 then case when minutes >= 60 then floor(minutes / 60)::bigint || 'h ' else '' end || floor(minutes % 60)::bigint || 'm' else '' end as duration, coalesce(callsign, '') as callsign, case mission when 'ems_hems' then 'EMS' when 'offshore' then 'OFFSH' when 'exec_charter' then 'CHRT' when 'training' then 'TRAIN' when 'survey' then 'SRVY' when 'pattern' then 'PATRN' when 'transport' then 'XFER' else '' end as mission, "
        "floor(confidence * 100)::bigint || '%' as conf, case landing_type when 'confirmed' then 'OK' when 'signal_lost' then 'SIG LOST' when 'dropped' then 'DROP' when 'uncertain' then 'UNCERT' when 'altitude_error' then 'ALT ERR' end as landing, case when oooi then said || ' OOOI' else coalesce(said::varchar, '--') end as acars, primary_squawk from fin left join ms using (icao, session) left join sq using (icao, session)",
        "j01_aircraft_list": f"with {listed} select * from li",
        "p16_search_listed": f"with {listed} select icao, registration, type_code, description from li where contains(icao, 'n10') or contains(lower(coalesce(registration, '')), 'n10') or contains(lower(coalesce(type_code, '')), 'n10') or contains(lower(coalesce(description, '')), 'n10')",
        "o02_paged_legs": f"{legs} select icao, session, takeoff_ts, total, least(total, 3) as returned, total > 3 as truncated from (select *, count(*) over (partition by icao) as total, row_number() over (partition by icao order by takeoff_ts desc, session) as r from legs) where r <= 3",
        "p10_spoof_split": f"{spoofed} select coalesce(why, 'kept') as sink, count(*) as n, sum(n_points)::bigint as points from sp group by 1",
        "o03_spoof_list": f"{spoofed} select icao, session, takeoff_ts, why, v2, sil0 from sp where why is not null order by takeoff_ts desc, icao, session limit 500",
        "c11_unusual_events": f"{full}, {EVENTS}, {scored}, {spoofs} select icao, session, ts, callsign, type, severity, summary from evs where ts >= 28400000 and severity = 'unusual' union all select icao, session, ts, callsign, type, severity, summary from se where day >= 28400000 // 86400",
        "c13_event_feed": f"{full}, {EVENTS}, {scored}, {spoofs} select * from (select icao, session, ts, callsign, type, severity, summary from evs union all select icao, session, ts, callsign, type, severity, summary from se) order by ts desc, icao, type, session nulls last limit 500",
        "a05_spoof_events": f"{p}, {scored}, {spoofs} select icao, ts, callsign, type, severity, summary from se",
        "a08_registry_metadata": f"with {VOTES}, {VOTED.format(name='v5', where='fetched_at % 5 = 0')}, f as (select icao, arg_min(type_code, fetched_at) filter (type_code is not null) as t from votes group by icao) select f.icao as icao, coalesce(case when f.icao not like '%5' then v5.type_code end, f.t) as type_code from f left join v5 using (icao)",
        "a09_drift_warnings": f"with {VOTES}, v as ({known['a07_registry_vote']}), o as (select votes.icao as icao, v.type_code as type_code, drift, votes.type_code as other, count(*) as n from votes join v using (icao) where drift > 3 and votes.type_code <> v.type_code group by 1, 2, 3, 4) select icao, type_code, drift, string_agg(other || '(' || n || ')', ', ' order by other) as conflicts from o group by icao, type_code, drift",
        "a16_clamped_starts": f"with r as ({known['a16_resume_starts']}) select icao, source, greatest(start, date '1998-08-01' - 90) as start from r",
        "a17_behaviour": f"{legs}, q as ({known['a27_squawk_summary']}), g as ({known['a34_go_arounds']}), r as (select l.*, changes, go_arounds from legs l left join q using (icao, session) left join g using (icao, session)), c as (select icao, emergency_squawk as e, count(*) as n from r where emergency_squawk is not null group by 1, 2), t as (select icao, string_agg(n || ' (' || e || ')', ', ' order by e) as emergencies from c group by icao) "
        "select icao, round(avg(changes), 2) as squawk_changes, count(*) filter (go_arounds > 0) as go_around_legs, any_value(emergencies) as emergencies from r left join t using (icao) group by icao",
        "j15_block_times": f"{legs}, {SAID} select l.icao as icao, l.session as session, min(o_out) as out_ts, null::bigint as off_ts, null::bigint as on_ts, max(o_in) as in_ts from legs l join tim m on m.icao = l.icao and m.ts between takeoff_ts and landing_ts group by l.icao, l.session having coalesce(min(o_out), max(o_in)) is not null",
        "a20_message_status": f"{legs}, {SAID}, b as (select l.icao as icao, l.session as session from legs l join tim m on m.icao = l.icao and m.ts between takeoff_ts and landing_ts group by l.icao, l.session having coalesce(min(o_out), max(o_in)) is not null), t as (select icao, count(*) as t from b group by icao), k as (select icao, label, count(*) as n, row_number() over (partition by icao order by count(*) desc, label) as r from tim group by icao, label), y as (select icao, string_agg(label || '(' || n || ')', ', ' order by r) as top_labels from k where r <= 6 group by icao) "
        "select m.icao as icao, count(*) as messages, coalesce(any_value(t), 0) as timed_legs, any_value(top_labels) as top_labels from tim m left join t using (icao) left join y using (icao) group by m.icao",
        "a21_status_snapshot": f"{fin}, ga as ({known['a34_go_arounds']}), mx as ({known['a19_weighted_mix']}), h as (select icao, count(*) as n from ({spoofed} select icao from sp where why is not null) group by icao), c as (select icao, mission, count(*) as n, row_number() over (partition by icao order by count(*) desc, mission) as r from fin group by icao, mission), m as (select icao, string_agg(mission || ' ' || n, ', ' order by r) as missions from c where r <= 6 group by icao), "
        "g as (select fin.icao as icao, count(*) as legs, count(emergency_squawk) as emergencies, count(*) filter (go_arounds > 0) as go_arounds, count(*) filter (n_points % 3 = 0) as long_hovers, count(*) filter (landing_type = 'confirmed') as confirmed, count(*) filter (landing_type = 'signal_lost') as signal_lost, count(*) filter (landing_type = 'confirmed' and destination is null) as off_airport from fin left join ga using (icao, session) group by fin.icao) "
        "select g.*, missions, mx.* exclude (icao), coalesce(h.n, 0) as held_back from g join m using (icao) left join mx using (icao) left join h using (icao)",
        "a25_emergency_legs": f"{full} select icao, session, takeoff_ts, emergency_squawk, case when n_points % 11 = 0 then 'general' end as emergency_flag, round(minutes, 1) as minutes from fl where emergency_squawk is not null or n_points % 11 = 0 order by takeoff_ts desc, icao, session limit 100",
        "a28_callsigns": f"{s}, c as (select icao, session, list_sort(list(distinct callsign)) as c from ses where callsign is not null group by icao, session), m as ({known['w16_implied_speeds']}) select icao, session, '[\"' || array_to_string(c, '\",\"') || '\"]' as callsigns, least(callsign_changes, greatest(0, len(c) - 1)) as changes from c join m using (icao, session)",
        "a30_signal_budget": f"{legs}, w as ({known['w19_phase_seconds']}) select icao, session, round(least(climb_s + descent_s + level_s, landing_ts - takeoff_ts) / 60, 1) as active_min, greatest(0, landing_ts - takeoff_ts - least(climb_s + descent_s + level_s, landing_ts - takeoff_ts)) as gap_s, gaps from w join legs using (icao, session)",
        "a33_hover_stats": f"{legs}, {TYPES}, f as (select *, gs_kt < 120 as i, lag(gs_kt < 120) over (partition by icao, session order by ts, seq) as b from ses), r as (select *, sum(case when i and not coalesce(b, false) then 1 else 0 end) over (partition by icao, session order by ts, seq rows unbounded preceding) as run from f), h as (select icao, session, run, max(ts) - min(ts) as s from r where i group by icao, session, run), x as (select icao, session, count(*) as n, max(s) as s from h group by icao, session) "
        "select l.icao as icao, l.session as session, case when type_code = 'C172' then coalesce(s, 0) end as max_hover_s, case when type_code = 'C172' then coalesce(n, 0) end as episodes from legs l left join ty using (icao) left join x on x.icao = l.icao and x.session = l.session",
        "j12_military_activity": f"{legs}, h as ({known['j11_hex_ranges']}) select icao, country, count(*) as legs, max(takeoff_ts) as last_takeoff from legs join h using (icao) where country is not null and takeoff_ts >= 28400000 group by icao, country",
        "j13_top_aircraft": f"{legs}, {VOTES}, {VOTED.format(name='rg', where='true')}, c as (select icao, count(*) as legs, min(takeoff_ts // 86400) as first_day, max(takeoff_ts // 86400) as last_day from legs group by icao order by legs desc, icao limit 10) select c.*, registration, type_code from c left join rg using (icao)",
        "j17_named_helipads": f"with hp as (select * from (select 'K' || lpad(cast(s_suppkey as varchar), 6, '0') as ident, round(30 + (s_suppkey * 13 % 400) * 0.025::double, 4) as lat, round(-100 + (s_suppkey * 29 % 600) * 0.05::double, 4) as lon, s_suppkey from supplier) where s_suppkey % 5 = 0), pd as (select 'V' || p_partkey as ident, round(30 + (p_partkey * 7 % 1000) * 0.01::double, 4) as lat, round(-100 + (p_partkey * 11 % 3000) * 0.01::double, 4) as lon, case when p_partkey % 10 = 0 then 'a known place' else 'helipad_V' || p_partkey end as name from part), "
        f"n as (select pd.ident as ident, arg_min(hp.ident, ({km('pd.lat', 'pd.lon', 'hp.lat', 'hp.lon')}, hp.ident)) as h from pd join hp on abs(pd.lat - hp.lat) <= 0.01 and abs(pd.lon - hp.lon) <= 0.01 where pd.name like 'helipad%' and {km('pd.lat', 'pd.lon', 'hp.lat', 'hp.lon')} < 0.5 group by pd.ident) "
        f"select pd.ident as ident, case when name like 'helipad%' then coalesce('Heliport ' || h, case when {km('lat', 'lon', '30.5::double', '-99.5::double')} < 1 then 'Place A' when {km('lat', 'lon', '34.0::double', '-90.0::double')} < 1 then 'Place B' end, name) else name end as name from pd left join n using (ident)",
        "j21_orphan_requests": f"with {TRACE} select icao, source, date, fetched_at from td where not exists (select 1 from td t where t.icao = td.icao and t.date = td.date and t.source = td.source and t.fetched_at % 4 <> 1)",
        "j23_registry_lookup": f"with {VOTES}, {VOTED.format(name='rg', where='fetched_at % 3 = 0')}, {CROSS}, q as (select lower(registration) as query from votes where fetched_at % 7 = 0 union select upper(icao) from votes where fetched_at % 11 = 0), b as (select upper(registration) as r, min(icao) as a from (select registration, icao from rg union all select registration, icao from cx) where registration is not null group by 1), m as (select query, case when regexp_matches(query, '^[0-9a-fA-F]{{6}}$') then lower(query) else a end as icao from q left join b on upper(query) = r) "
        "select query, m.icao as icao, coalesce(rg.registration, cx.registration) as registration, coalesce(rg.type_code, cx.type_code) as type_code from m left join rg on rg.icao = m.icao left join cx on cx.icao = m.icao",
        "s07_days_since": f"with {TRACE} select icao, source, date, fetched_at from td where date >= date '1997-06-01'",
        "s10_earliest_new_day": f"with {TRACE} select icao, min(date) as date from td where fetched_at >= 5000 group by icao",
        "s29_flights_sink": f"{legs} select icao, takeoff_ts, landing_ts, session, n_points from legs where landing_ts > takeoff_ts",
        "s31_window_deleted": f"with {TRACE}, d as (select distinct icao, date from td), g as (select icao, date, date - lag(date) over (partition by icao order by date) as gap, min(case when date >= date '1995-06-01' then date end) over (partition by icao) as first from d), b as (select icao, max(date) as boundary from g where (gap is null or (gap > 2 and (gap - 1) * 1440 > 96)) and date <= first group by icao) select d.icao as icao, d.date as day from d left join b using (icao) where boundary is null or d.date < boundary",
        "s32_flying_registry": f"{legs}, v as ({known['a07_registry_vote']}) select * from v where icao in (select icao from legs where session > 1)",
        "s04_path_points": f"{p} select icao, row_number() over (partition by icao order by seq) - 1 as seq, ts::double as ts, lat, lon, surface, case when not surface and coalesce(baro_ft, 0) <> 0 then round_even(baro_ft / 2.0::double * 3.28084::double, 0)::int end as baro_ft from pts",
        "s18_registered": f"with {raw} select * from rm",
        "s19_deregistered": "select lower(lpad(to_hex(c_custkey + 10485760), 6, '0')) as icao, cast(c_custkey as varchar) as n_number, case when c_custkey % 2 = 0 then c_name else c_mktsegment end as city, '20200101' as expiration_date, null::varchar as unique_id from customer",
        "s20_aircraft_reference": "select cast(p_partkey as varchar) as code, p_brand as mfr, p_type as model, null::varchar as type_acft, null::varchar as type_eng from part where p_partkey % 9 <> 0",
        "j24_by_number": f"with {raw} select 'n' || k as tail, icao, n_number, name from (select distinct o_custkey as k from orders) join rm on n_number = cast(k as varchar)",
        "g10_boxes": f"{s}, b as (select icao, session, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from ses group by icao, session), d as (select *, (50 / 60.0::double) / greatest(0.01::double, cos(radians(greatest(abs(s), abs(n))))) as dx from b) select icao, session, round(s - 50 / 60.0::double, 5) as min_lat, round(n + 50 / 60.0::double, 5) as max_lat, round(w - dx, 5) as min_lon, round(e + dx, 5) as max_lon from d",
        "w22_emergency_flags": f"{s}, e as (select *, case when seq % 13 = 0 then 'general' when seq % 17 = 0 then 'nordo' end as em from ses) select icao, session, arg_max(em, (ts, seq)) filter (em is not null) as emergency_flag from e group by icao, session",
        "w23_buffers": f"{s}, r as (select *, {STATE} as state, row_number() over w as n, row_number() over (partition by icao, session order by ts desc, seq desc) as back, ts - min(ts) over (partition by icao, session) as ago from ses window w as (partition by icao, session order by ts, seq)), l as (select *, max(case when state = 'airborne' then (ts, seq) end) over (partition by icao, session) as la from r), d as (select *, coalesce(state = 'ground' and (ts, seq) > la, false) as down from l), k as (select *, row_number() over (partition by icao, session, down order by ts, seq) as dn from d) "
        "select icao, session, count(*) filter (n <= 240 and ago <= 600) as takeoff_buffer, count(*) filter (state = 'airborne' and ago <= 60) as takeoff_track, count(*) filter (back <= 240) as landing_track, count(*) filter (down and dn <= 5) as touchdown from k group by icao, session",
        "f15_source_rates": f"{p}, c as (select icao, src, count(*) as n, sum(count(*)) over (partition by icao) as every from pts where src is not null group by icao, src) select icao, string_agg(src || ' ' || (100 * n // every)::bigint || '%', ' · ' order by src) as rates from c group by icao",
        "t02_watch_baseline": f"{legs}, {TRACE}, a as (select icao, max(date) as last_day from td where date < date '1996-01-01' group by icao), b as (select icao, max(takeoff_ts) as last_takeoff from legs where takeoff_ts < 28420000 group by icao), n as (select icao, count(*) as n from legs join b using (icao) where takeoff_ts > last_takeoff and emergency_squawk is not null group by icao) select l.icao as icao, last_day is null as baseline, case when last_day is null then 0 else coalesce(n, 0) end as alerts from (select distinct icao from legs) l left join a using (icao) left join n using (icao)",
        "t07_refusals": f"{legs}, h as (select icao, count(*) as n, count(*) filter (session % 5 = 0) as stale from legs where session > 1 group by icao) select i.icao as icao, case when i.icao like 'ae69%' then 'promotion votes across the whole history' when n is null then 'no flights extracted yet' when stale > 0 then stale || ' flights from another extractor version' end as why from (select distinct icao from pts) i left join h using (icao)",
        "t08_carried_state": f"{legs}, a as (select icao, coalesce(string_agg(distinct src, ',' order by src), '') as sources, arg_max(callsign, (ts, seq)) filter (callsign is not null and ts < 28410000) as callsign from pts group by icao), b as (select icao, arg_max(landing_ts, takeoff_ts) as prev_end_ts from legs where takeoff_ts < 28410000 group by icao) select a.icao as icao, sources, callsign, prev_end_ts from a left join b using (icao)",
        "o06_dates_newest_first": f"with {TRACE} select distinct icao, date from td",
        "o11_first_rows": f"with {TRACE} select icao, date, source, fetched_at from (select *, row_number() over (partition by icao order by date, source, fetched_at) as r from td) where r = 1",
        "p18_badges": f"{p}, {SCORES}, sc as (select icao, count(*) filter (flagged) as n from scores group by icao), sl as (select distinct icao from pts where gs_kt < 30), h as ({known['j11_hex_ranges']}) select h.icao as icao, concat_ws(' ', case when country in ('NATION_3', 'NATION_4') then 'MIL' end, case when sc.n > 0 then 'SPF' end, case when sl.icao is not null then 'HOVER' end, case when h.icao like '%f' then 'TYP' end) as flags from h join sc using (icao) left join sl using (icao)",
        "j22_resolve_tails": f"with {VOTES} select distinct v.tail as tail, case when regexp_matches(v.tail, '^N[1-9][0-9]*$') and v.tail not like 'N______%' then lpad(lower(to_hex(10485761 + {tail_number('v.tail')})), 6, '0') end as icao from (select distinct registration as tail from votes) v",
        "s34_snapshot": f"{legs} select icao, '[' || string_agg('{{\"takeoff_ts\":' || takeoff_ts || ',\"session\":' || session || ',\"n_points\":' || n_points || ',\"callsigns\":\"' || callsigns || '\"}}', ',' order by takeoff_ts desc, session desc) || ']' as legs from legs group by icao",
    }


def solar(name: str, rows: str, ts: str, lat: str, lon: str) -> str:
    """A table ``name`` with the sun's altitude at each row of ``rows``, by the almanac's series."""
    steps = [
        ("t", f"(({ts}) / 86400.0::double + 2440587.5::double - 2451545.0::double) / 36525.0::double"),
        ("l0d", "(((280.46646::double + t * (36000.76983::double + t * 0.0003032::double)) % 360) + 360) % 360"),
        ("m", "radians(357.52911::double + t * (35999.05029::double - 0.0001537::double * t))"),
        ("e", "0.016708634::double - t * (0.000042037::double + 0.0000001267::double * t)"),
        ("c", "sin(m) * (1.914602::double - t * (0.004817::double + 0.000014::double * t)) + sin(2 * m) * (0.019993::double - 0.000101::double * t) + sin(3 * m) * 0.000289::double"),
        ("om", "radians(125.04::double - 1934.136::double * t)"),
        ("la", "radians(l0d + c - 0.00569::double - 0.00478::double * sin(om))"),
        ("ep", "radians(23 + (26 + (21.448::double - t * (46.815::double + t * (0.00059::double - t * 0.001813::double))) / 60) / 60 + 0.00256::double * cos(om))"),
        ("de", "asin(sin(ep) * sin(la))"),
        ("yy", "pow(tan(ep / 2), 2)"),
        ("l0", "radians(l0d)"),
        ("eq", "4 * degrees(yy * sin(2 * l0) - 2 * e * sin(m) + 4 * e * yy * sin(m) * cos(2 * l0) - 0.5::double * yy * yy * sin(4 * l0) - 1.25::double * e * e * sin(2 * m))"),
        ("mi", f"((((({ts}) % 86400) / 60 + eq + 4 * ({lon})) % 1440) + 1440) % 1440"),
        ("up", f"sin(radians({lat})) * sin(de) + cos(radians({lat})) * cos(de) * cos(radians(mi / 4 - 180))"),
        ("high", "90 - degrees(acos(greatest(-1.0::double, least(1.0::double, up))))"),
    ]
    inner = rows
    for column, formula in steps:
        inner = f"(select *, {formula} as {column} from {inner})"
    return f"{name} as (select icao, session, high from {inner})"


def more_functions() -> dict[str, str]:
    """Codes, times, corners, the sun and headings."""
    p, s, legs = f"with {PTS}", f"with {PTS}, {SES}", f"with {PTS}, {SES}, {LEGS}"
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZ"
    grid = lambda x: f"round_even({x} / 0.1::double, 0) * 0.1::double"
    at = lambda k: f"((ts // 3600 + {k}) % 24) * 3600 + seq % 60 * 60"
    near = lambda k: f"(ts // 86400 * 86400 + {at(k)} - case when ts // 86400 * 86400 + {at(k)} - ts > 43200 then 86400 when ts // 86400 * 86400 + {at(k)} - ts < -43200 then -86400 else 0 end)"

    def ahead(lat: str, lon: str, deg: str, metres: float) -> tuple[str, str]:
        d = f"{metres!r}::double / 6371000.0::double"
        end = f"asin(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos(radians({deg})))"
        east = f"atan2(sin(radians({deg})) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * sin({end}))"
        return f"degrees({end})", f"((({lon} + degrees({east}) + 540) % 360) + 360) % 360 - 180"

    far = 25 + 6000 * math.tan(math.radians(5))
    y, x = ahead("lat", "lon", "heading", 6000)
    corners = {"near_left": ahead("lat", "lon", "heading - 90", 25), "near_right": ahead("lat", "lon", "heading + 90", 25), "far_right": ahead("flat", "flon", "heading + 90", far), "far_left": ahead("flat", "flon", "heading - 90", far)}
    mean = lambda held, n: f"case when count(track_deg) filter ({held}) >= {n} then ((degrees(atan2(sum(sin(radians(track_deg))) filter ({held}), sum(cos(radians(track_deg))) filter ({held}))) + 360) % 360 + 360) % 360 end"
    ends = [mean(f"fin - ts <= {sec} and coalesce(gs_kt, 0) >= {kt}", n) for sec, kt, n in ((60, 40, 3), (120, 10, 3), (240, 10, 3), (600, 10, 3), (600, 0, 1))]
    return {
        "f01_tail_numbers": f"with l as (select unnest(string_split('{','.join(letters)}', ',')) as x), q as (select '' as s union all select x from l union all select a.x || b.x from l a, l b), t as (select 'N' || n || s as tail from (select unnest(range(1, 1000)) as n), q union all select 'N' || n || s from (select unnest(range(1000, 10000)) as n), (select '' as s union all select x from l union all select unnest(range(10))::varchar)), "
        f"o as (select tail, row_number() over (order by translate(tail, '{letters}0123456789', '0123456789:;<=>?@ABCDEFGHIJKLMNOPQ')) - 1 as nr from t) select lower(to_hex(nr + 10485761)) as icao, tail, lower(to_hex(nr + 10485761)) as back from orders join o on nr = o_orderkey * 7919 % 915399",
        "f05_oooi_times": f"{p} select icao, min(case when seq % 5 < 4 then {near(0)} end)::bigint as out_ts, min(case when seq % 5 = 2 then {near(1)} when seq % 5 in (0, 1, 3) then {near(22)} end)::bigint as off_ts, max(case when seq % 5 = 2 then {near(2)} end)::bigint as on_ts, max(case when seq % 5 = 2 then {near(23)} when seq % 5 in (0, 1, 3) then {near(3)} end)::bigint as in_ts from pts group by icao",
        "g12_departure_wedges": f"with {PORTS}, {ENDS}, f as (select *, {y} as flat, {x} as flon from ends) select ident, runway, " + ", ".join(f"round({v}, 5) as {c}_{n}" for c, pair in corners.items() for n, v in zip(("lat", "lon"), pair, strict=True)) + " from f",
        "g21_solar": f"{legs}, {solar('s0', 'legs', 'takeoff_ts', 'takeoff_lat', 'takeoff_lon')}, {solar('s1', 'legs', 'takeoff_ts // 300 * 300', grid('takeoff_lat'), grid('takeoff_lon'))}, {solar('s2', 'legs', 'landing_ts // 300 * 300', grid('landing_lat'), grid('landing_lon'))} select s0.icao as icao, s0.session as session, round(s0.high, 3) as altitude, s1.high < -6 or s2.high < -6 as night from s0 join s1 using (icao, session) join s2 using (icao, session)",
        "a36_headings": f"{s}, r as (select *, ts - min(ts) over (partition by icao, session) as ago, max(ts) over (partition by icao, session) as fin, lag(lat) over w as blat, lag(lon) over w as blon from ses window w as (partition by icao, session order by ts, seq)), m as (select *, 1000 * {km('blat', 'blon', 'lat', 'lon')} > 50 as far, {bearing('blat', 'blon', 'lat', 'lon')} as brg from r) "
        f"select icao, session, round({mean('ago <= 60 and (gs_kt is null or gs_kt > 40)', 1)}, 1) as takeoff_deg, round(coalesce({', '.join(ends)}, arg_max(brg, (ts, seq)) filter (far)), 1) as landing_deg from m group by icao, session",
        "w02_deduplicated": f"{s}, d as (select *, coalesce(ts = lag(ts) over w and abs(lat - lag(lat) over w) < 0.001 and abs(lon - lag(lon) over w) < 0.001, false) as near from ses window w as (partition by icao, session order by ts, seq)) select icao, count(*) as n, sum(seq)::bigint as seqs from d where not near group by icao",
    }


def tail_number(tail: str) -> str:
    """Place of a tail number of one to five digits among all tail numbers: each digit opens a block of all that follow it."""
    d = [f"try_cast(nullif(substr({tail}, {i}, 1), '') as bigint)" for i in range(2, 7)]
    return f"(({d[0]} - 1) * 101711 + coalesce(601 + {d[1]} * 10111, 0) + coalesce(601 + {d[2]} * 951, 0) + coalesce(601 + {d[3]} * 35, 0) + coalesce(25 + {d[4]}, 0))"
