"""Archive members through spark.read, the registry's refresh from one, and a backfill that is stopped after each batch."""

import gzip
import io
import json
import random
import tarfile
import zipfile
from datetime import date, timedelta

import pytest

from pyspark.sql import functions as F

from contrail.sources import archives, backfill, registry, store, traces

MASTER = "﻿N-NUMBER,SERIAL NUMBER,MODE S CODE,NAME , MODE S CODE HEX,\n1AB  ,77,50000001,\"ACME, INC\" ,A00001,\n2CD,78,50000002,É\n\n"
DEREG = "N-NUMBER,MODE-S-CODE,NAME,CANCEL-DATE\n9ZZ,50000003,GONE,20200101\n"
REFERENCE = "CODE,MFR,MODEL\n1152,CESSNA,172\n,NONE,X\n"


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(f"Folder/{name}", text.encode("utf-8" if text.startswith("﻿") else "latin-1"))
    return str(path)


def test_a_registry_bundle_is_refreshed_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "registry")
    good = zipped(tmp_path / "good.zip", **{"Master.TXT": MASTER, "DEREG.txt": DEREG, "ACFTREF.txt": REFERENCE, "README.txt": "x"})
    registry.refreshed_from(spark, good, folder)
    rows = {r.n_number: (r.name, r.icao) for r in registry.current(spark, folder, "master").collect()}
    assert rows["1AB"] == ("ACME, INC", "a00001") and rows["2CD"][1] == "a00002"
    assert [r.expiration_date for r in registry.current(spark, folder, "deregistered").collect()] == ["20200101"]
    assert [(r.code, r.mfr) for r in registry.current(spark, folder, "aircraft_reference").collect()] == [("1152", "CESSNA")]
    for bad in (
        zipped(tmp_path / "missing.zip", **{"MASTER.txt": MASTER, "DEREG.txt": DEREG}),
        zipped(tmp_path / "drifted.zip", **{"MASTER.txt": MASTER, "DEREG.txt": DEREG, "ACFTREF.txt": REFERENCE.replace("MODEL", "MDL")}),
    ):
        with pytest.raises(Exception, match="has no"):
            registry.refreshed_from(spark, bad, folder)
    assert spark.read.parquet(f"{folder}/versions").count() == 1 and registry.current(spark, folder, "master").count() == 2


def test_a_task_a_member(spark, tmp_path):
    archives.register(spark)
    path = zipped(tmp_path / "many.zip", **{f"part{i}.bin": "x" * i for i in range(5)})
    rows = spark.read.format("archive").load(path)
    assert rows.rdd.getNumPartitions() == 5
    assert sorted((r.member, len(r.content), r.status) for r in rows.collect()) == [(f"Folder/part{i}.bin", i, 200) for i in range(5)]
    with pytest.raises(Exception, match="no archive"):
        spark.read.format("archive").load()


def daily(path, files, broken=False):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    path.write_bytes(out.getvalue()[: len(out.getvalue()) // 2 if broken else None])
    return str(path)


def test_trace_files_of_daily_archives(spark, tmp_path):
    body = json.dumps({"timestamp": 86400.0, "trace": [[0, 1.0, 2.0, 3000, 100.0, 90.0, 0, 0, None]]}).encode()
    noise = random.Random(1).randbytes(300_000)
    one = daily(tmp_path / "1970-01-02.tar.gz", {"traces/01/trace_full_a00001.json": gzip.compress(body), "traces/99/trace_full_zz.json": b"{}", "traces/02/trace_full_a00002.json": body})
    two = daily(tmp_path / "1970-01-03.tar.gz", {"traces/01/trace_full_a00001.json": b'{"trace": []}'})
    bad = daily(tmp_path / "1970-01-04.tar.gz", {"traces/01/trace_full_a00001.json": body, "x": noise, "traces/02/trace_full_a00002.json": body}, broken=True)
    rows = archives.trace_members(spark, [one, two, bad], ["a00001", "a00002"])
    found = sorted((r.archive[-17:-7], r.icao or "", r.status) for r in rows.collect())
    assert found == [("1970-01-02", "a00001", 200), ("1970-01-02", "a00002", 200), ("1970-01-03", "a00001", 200), ("1970-01-03", "a00002", 404), ("1970-01-04", "", 500), ("1970-01-04", "a00001", 200)]
    bodies = traces.bodies(rows.where("status = 200").withColumn("day", F.to_date(F.regexp_extract("archive", "(\\d{4}-\\d\\d-\\d\\d)", 1))))
    assert sorted((r.icao, str(r.day)) for r in traces.parsed_body(bodies).where("trace_json <> '[]'").collect()) == [("a00001", "1970-01-02"), ("a00001", "1970-01-04"), ("a00002", "1970-01-02")]


POINT = "icao string, seq long, ts double, lat double, lon double, callsign string, src string, version int, sil int, nic int"


def decoded(raw):
    kept = F.from_json("body", "array<struct<ts:double,lat:double,lon:double>>")
    rows = raw.select("icao", F.posexplode(kept).alias("seq", "p")).select("icao", F.col("seq").cast("long").alias("seq"), "p.*")
    return rows.withColumns({"callsign": F.lit("X"), "src": F.lit("mlat"), "version": F.lit(2), "sil": F.lit(0), "nic": F.lit(8)})


def test_a_backfill_stopped_after_each_batch(spark, tmp_path):
    day = lambda d: date(1970, 1, 1) + timedelta(days=d)
    body = lambda d, n: json.dumps([{"ts": d * 86400.0 + k, "lat": 1.0 * k, "lon": 2.0} for k in range(n)])
    rows = [(i, day(d), body(d, 2 + d % 3)) for i in ("a", "b") for d in range(1, 9)] + [("c", day(3), "not json"), ("d", None, "[]")]
    raw = spark.createDataFrame(rows, "icao string, day date, body string")
    schema = spark.createDataFrame([], POINT).schema

    def opened(name):
        return store.TraceStore(spark, f"fill_{name}_{tmp_path.name.replace('-', '_')}", f"file://{tmp_path}/{name}", 2).open(schema)

    shown = lambda s: (sorted(map(str, s.points().collect())), sorted(map(str, s.days().collect())))
    whole = opened("whole")
    made = backfill.backfill(raw, decoded, whole, f"file://{tmp_path}/progress_whole", rows=5)
    assert made == {"batches": 3, "raw_rows": 17, "malformed": 1, "points": whole.points().count()}
    parts, folder = opened("parts"), f"file://{tmp_path}/progress_parts"
    steps = 0
    while backfill.backfill(raw, decoded, parts, folder, rows=5, most=1)["batches"]:
        steps += 1
        if steps == 2:  # killed after the days were put, before progress was written: as if that row had never been
            kept = sorted((tuple(r) for r in backfill.progress(spark, folder).collect()), key=lambda r: r[0][0])[:-1]
            folder = f"file://{tmp_path}/progress_again"
            spark.createDataFrame(kept, backfill.PROGRESS).write.parquet(folder)
    assert steps == 4 and shown(parts) == shown(whole)
    assert backfill.backfill(raw, decoded, parts, folder)["batches"] == 0
    late = raw.unionByName(spark.createDataFrame([("a", day(0), body(0, 4))], raw.schema))
    assert backfill.backfill(late, decoded, parts, folder) == {"batches": 1, "raw_rows": 1, "malformed": 0, "points": 4}
