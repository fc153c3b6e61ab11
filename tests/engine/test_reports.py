from pyspark.sql import functions as F

from contrail.operators import reports


def test_identity_dump(spark):
    dump = spark.createDataFrame([('{"A00001": ["N1", "C172", "10"], "zz": ["x"], "a00002": ["", "B738"]}',), ("not json",), (None,)], "json string")
    assert sorted(map(tuple, reports.parse_identity_dump(dump).collect())) == [("a00001", "N1", "C172", True), ("a00002", None, "B738", False)]


def test_messages_are_kept_once(spark):
    rows = [('{"id":"1","tail":" N1 ","label":"14","text":"b","timestamp":"2024-01-01T00:00:10Z"}',), ('{"id":"1","tail":"N1","text":"a","timestamp":"2024-01-01T00:00:00Z"}',), ('{"tail":"N2"}',), (None,)]
    found = reports.flatten_messages(spark.createDataFrame(rows, "json string")).collect()
    assert [(r.id, r.tail, r.text, r.ts) for r in found] == [("1", "N1", "a", 1704067200)]


def test_owner_search_and_address(spark):
    rows = [("a", "Acme Air", "1 Main", None, "Reno", "NV", "1"), ("b", "Other", None, "Box 2", "Ely", None, " ")]
    df = spark.createDataFrame(rows, "icao string, name string, street string, street2 string, city string, state string, zip string")
    assert [r.icao for r in reports.find_owner(df, name="acme", state="nv").collect()] == ["a"]
    assert sorted(map(tuple, reports.address_lines(df).collect())) == [("a", "1 Main", "Reno, NV 1"), ("b", "Box 2", "Ely")]


def test_tails_resolve_by_code_then_registry(spark):
    asked = spark.createDataFrame([("N1",), ("G-ABCD",), ("X",)], "tail string")
    registry = spark.createDataFrame([("400001", "g-abcd", 1), ("400002", "G-ABCD", 2)], "icao string, registration string, fetched_at long")
    assert {r.tail: r.icao for r in reports.resolve_tail(asked, registry).collect()} == {"N1": "a00001", "G-ABCD": "400002", "X": None}


def test_stale_is_null_safe(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "extractor_version string")
    assert reports.stale(df, "2").count() == 2


def test_refused_sources_need_every_day(spark):
    rows = [("a", f"2024-01-0{d}", 403) for d in (1, 2, 3)] + [("b", f"2024-01-0{d}", 403 if d > 1 else 200) for d in (1, 2, 3)]
    log = spark.createDataFrame(rows, "source string, d string, status int").withColumn("date", F.col("d").cast("date"))
    assert {r.source: r.tripped for r in reports.refused_sources(log).collect()} == {"a": True, "b": False}
