import math

import pytest
from pyspark.sql import functions as F

from contrail.config import DEFAULT
from contrail.functions.geo import bearing_deg, destination, exact_turn, haversine_km, lerp, smallest_angle_deg
from contrail.functions.identity import hex_to_tail, octal_to_hex, tail_to_hex
from contrail.functions.solar import is_night, solar_altitude_deg
from contrail.functions.text import duration_label, oooi, percent_floor, pick
from contrail.operators import derived


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return [F.lit(v) for v in values]


def test_tail_numbers_both_ways(spark):
    known = {"N1": "a00001", "N512WB": "a66ad3", "N99999": "adf7c7", "N1A": "a00002", "N1AA": "a00003", "N10": "a0025a"}
    rows = spark.createDataFrame(list(known.items()), "tail string, icao string").select("tail", "icao", tail_to_hex(F.col("tail")).alias("h"), hex_to_tail(F.col("icao")).alias("t")).collect()
    for r in rows:
        assert (r.h, r.t) == (r.icao, r.tail)


def test_invalid_tails_and_addresses(spark):
    bad = [(x,) for x in ("N", "N0", "NI", "N1I", "N12345A", "N1AAA", "X1", "", None, "N1234AB")]
    assert [r[0] for r in spark.createDataFrame(bad, "t string").select(tail_to_hex(F.col("t"))).collect()] == [None] * len(bad)
    assert one(spark, *(hex_to_tail(F.lit(x)) for x in ("000000", "adf7c8", "zz", "a00000"))) == (None,) * 4


def test_every_hundredth_address_round_trips(spark):
    rows = spark.range(0, 915_399, 97).select(F.lower(F.hex(F.col("id") + 0xA00001)).alias("h"))
    assert rows.where(~tail_to_hex(hex_to_tail(F.col("h"))).eqNullSafe(F.col("h"))).count() == 0


def test_turns_are_those_of_the_c_library(spark):
    rows = spark.range(361).select(F.when(F.col("id") < 360, F.col("id").cast("double")).alias("d")).select("d", exact_turn(F.col("d")).alias("t")).collect()
    assert all((r.t.sin, r.t.cos) == ((math.sin(math.radians(r.d)), math.cos(math.radians(r.d))) if r.d is not None else (None, None)) for r in rows)


def test_headings_that_cancel_are_those_of_sql(spark):
    rows = [("a", i, 100 + i, float(t), 300.0, 10.0, 20.0) for i, t in enumerate((117, 297))]
    points = spark.createDataFrame(rows, "icao string, seq long, ts long, track_deg double, gs_kt double, lat double, lon double")
    found = derived.headings(points).first()
    y, x = (sum(f(math.radians(t)) for t in (117, 297)) for f in (math.sin, math.cos))
    assert found.takeoff_deg == found.landing_deg == round(math.degrees(math.atan2(y, x)) % 360, 1)


def test_octal(spark):
    assert one(spark, octal_to_hex(F.lit("50000001")), octal_to_hex(F.lit("8"))) == ("a00001", None)


def test_octal_codes_wider_than_an_address_are_cut_as_in_sql(spark):
    assert one(spark, octal_to_hex(F.lit("77777777")), octal_to_hex(F.lit("100000000")), octal_to_hex(F.lit("123456701"))) == ("ffffff", "100000", "14e5dc")


def test_geometry(spark):
    km, b, a, null = one(spark, haversine_km(*lits(0.0, 0.0, 0.0, 1.0)), bearing_deg(*lits(0.0, 0.0, 1.0, 0.0)), smallest_angle_deg(*lits(350.0, 10.0)), haversine_km(F.lit(None).cast("double"), *lits(0.0, 0.0, 1.0)))
    assert math.isclose(km, 111.194927, rel_tol=1e-6) and b == 0 and a == 20 and null is None
    lat, lon = one(spark, *destination(*lits(10.0, 20.0, 90.0, 100_000.0)))
    back = one(spark, haversine_km(*lits(10.0, 20.0, lat, lon)))[0]
    assert math.isclose(back, 100, rel_tol=1e-9)


@pytest.mark.parametrize(("x", "low", "high", "y"), [(5.0, 0, 10, 0.5), (-1.0, 0, 10, 0.0), (11.0, 0, 10, 1.0), (180.0, 180, 30, 0.0), (None, 0, 1, None)])
def test_lerp(spark, x, low, high, y):
    assert one(spark, lerp(F.lit(x).cast("double"), low, high))[0] == y


def test_sun(spark):
    noon, night = 1_718_971_200.0, 1_718_928_000.0  # 21 June 2024, 12:00 and 00:00 UTC
    up, down, dark, light = one(spark, solar_altitude_deg(*lits(noon, 23.44, 0.0)), solar_altitude_deg(*lits(night, 23.44, 0.0)), is_night(*lits(night, 23.44, 0.0)), is_night(*lits(noon, 23.44, 0.0)))
    assert up > 89 and -44 < down < -42 and dark and not light


def test_times_and_text(spark):
    ref = 1_700_000_000  # 22:13:20 UTC
    t = one(spark, oooi(*lits("14", "OUT 2210 off: 2355 ON 0105 in x", ref)))[0]
    day = ref - ref % 86400
    assert (t.out, t.off, t.on, t["in"]) == (day + 79800, day + 86100, day + 86400 + 3900, None)
    t = one(spark, oooi(*lits("4T", "AGFSR X/0001/0002/0003/2559", ref)))[0]
    assert (t.out, t.off, t.on, t["in"]) == (day + 86400 + 60, day + 86400 + 120, day + 86400 + 180, None)
    assert one(spark, oooi(*lits("QQ", "OUT 2210", ref)))[0].out is None
    assert one(spark, duration_label(F.lit(125.9)), percent_floor(*lits(2, 3)), percent_floor(*lits(2, 0)), pick(*lits(" ", " a "))) == ("2h 5m", "66", "-", "a")


def test_unknown_settings_are_refused():
    assert DEFAULT.updated({"gap_min_s": 9}).gap_min_s == 9
    with pytest.raises(ValueError, match="unknown"):
        DEFAULT.updated({"nope": 1})
