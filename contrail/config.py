"""Thresholds, in one place; captured into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    session_gap_min: float = 30
    day_gap_days: int = 2
    min_flight_min: float = 5
    min_flight_km: float = 5
    landing_speed_kt: float = 80
    baro_error_geom_ft: float = 300
    post_landing_s: float = 60
    post_landing_points: int = 5
    dedupe_s: float = 1
    dedupe_deg: float = 0.001
    stitch_gap_min: float = 90
    stitch_alt_ft: float = 3000
    stitch_speed_kt: float = 300
    stitch_slack: float = 1.2
    stitch_endurance_ratio: float = 0.4
    stitch_ground_s: float = 900
    stitch_fresh_ft: float = 8000
    stitch_climb_ft: float = 2000
    endurance_min: float = 240
    viable_min: float = 3
    viable_points: int = 10
    still_km: float = 0.5
    still_ft: float = 1000
    still_kt: float = 15
    agree_ft: float = 5000
    tail_s: float = 120
    flare_from_s: float = 180
    flare_to_s: float = 30
    probable_km: float = 46.3
    aligned_short_s: float = 30
    aligned_long_s: float = 60
    aligned_short_bonus: float = 0.15
    aligned_long_bonus: float = 0.25
    resume_days: int = 90
    spoof_pct: float = 10
    spoof_min_v2: int = 25
    on_field_km: float = 2
    match_km: float = 10
    persist_s: float = 30
    persist_points: int = 3
    gap_min_s: float = 300
    gap_max_s: float = 1800
    gap_context: int = 10
    hover_gs_kt: float = 5
    hover_rate_fpm: float = 100
    hover_min_s: float = 20
    phase_rate_fpm: float = 250
    phase_gap_s: float = 60
    phase_gap_cap_s: float = 1800
    fragment_gap_s: float = 300
    helipad_eps_km: float = 0.2
    helipad_min_points: int = 3
    night_deg: float = -6

    def updated(self, values: dict) -> Config:
        """A copy with other values; unknown names are refused."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **values)


DEFAULT = Config()
