"""The registry's three files, and what cross-references say: projections to one shape, and a refresh that readers see whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import octal_to_hex
from ..functions.text import clean, pick
from .archives import text_table

#: Column names of the files, and ours.
MASTER = {
    "N-NUMBER": "n_number", "SERIAL NUMBER": "serial_number", "MFR MDL CODE": "mfr_mdl_code", "ENG MFR MDL": "eng_mfr_mdl", "YEAR MFR": "year_mfr",
    "TYPE REGISTRANT": "type_registrant", "NAME": "name", "STREET": "street", "STREET2": "street2", "CITY": "city", "STATE": "state", "ZIP CODE": "zip_code",
    "REGION": "region", "COUNTY": "county", "COUNTRY": "country", "LAST ACTION DATE": "last_action_date", "CERT ISSUE DATE": "cert_issue_date",
    "CERTIFICATION": "certification", "TYPE AIRCRAFT": "type_aircraft", "TYPE ENGINE": "type_engine", "STATUS CODE": "status_code", "MODE S CODE": "mode_s_code",
    "FRACT OWNER": "fract_owner", "AIR WORTH DATE": "air_worth_date", "EXPIRATION DATE": "expiration_date", "UNIQUE ID": "unique_id", "KIT MFR": "kit_mfr", "KIT MODEL": "kit_model",
}
DEREGISTERED = {
    "n_number": ["N-NUMBER"], "serial_number": ["SERIAL-NUMBER"], "mfr_mdl_code": ["MFR-MDL-CODE"], "eng_mfr_mdl": ["ENG-MFR-MDL"], "year_mfr": ["YEAR-MFR"],
    "name": ["NAME"], "street": ["STREET-PHYSICAL", "STREET-MAIL"], "street2": ["STREET2-PHYSICAL", "STREET2-MAIL"], "city": ["CITY-PHYSICAL", "CITY-MAIL"],
    "state": ["STATE-ABBREV-PHYSICAL", "STATE-ABBREV-MAIL"], "zip_code": ["ZIP-CODE-PHYSICAL", "ZIP-CODE-MAIL"], "region": ["REGION"],
    "county": ["COUNTY-PHYSICAL", "COUNTY-MAIL"], "country": ["COUNTRY-PHYSICAL", "COUNTRY-MAIL"], "last_action_date": ["LAST-ACT-DATE"],
    "cert_issue_date": ["CERT-ISSUE-DATE"], "certification": ["CERTIFICATION"], "status_code": ["STATUS-CODE"], "mode_s_code": ["MODE-S-CODE"],
    "air_worth_date": ["AIR-WORTH-DATE"], "expiration_date": ["CANCEL-DATE"], "kit_mfr": ["KIT MFR"], "kit_model": ["KIT MODEL"],
}
AIRCRAFT = {"CODE": "code", "MFR": "mfr", "MODEL": "model", "TYPE-ACFT": "type_acft", "TYPE-ENG": "type_eng"}


def _field(raw: DataFrame, name: str) -> Column:
    return clean(F.col(f"`{name}`")) if name in raw.columns else F.lit(None).cast("string")


def master(raw: DataFrame) -> DataFrame:
    """Registered aircraft with their address, from its own column else from the octal code; rows with neither are dropped."""
    icao = F.coalesce(F.lower(_field(raw, "MODE S CODE HEX")), octal_to_hex(_field(raw, "MODE S CODE")))
    return raw.select(*(_field(raw, c).alias(n) for c, n in MASTER.items()), icao.alias("icao")).where("icao is not null")


def deregistered(raw: DataFrame) -> DataFrame:
    """Aircraft struck off, in the shape of ``master``: physical addresses before mail ones, the cancel date as expiration."""
    named = {n: pick(*(_field(raw, c) for c in cs)) for n, cs in DEREGISTERED.items()}
    columns = [named.get(n, F.lit(None).cast("string")).alias(n) for n in MASTER.values()]
    return raw.select(*columns, octal_to_hex(_field(raw, "MODE-S-CODE")).alias("icao")).where("icao is not null")


def aircraft_reference(raw: DataFrame) -> DataFrame:
    """Makes and models by code; rows without a code are dropped."""
    return raw.select(*(_field(raw, c).alias(n) for c, n in AIRCRAFT.items())).where("code is not null")


def refreshed(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes all tables under a new version of ``folder`` and only then the row that names it: readers see the old or the new version, whole."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{folder}/versions")
    return version


#: The registry bundle: its members, the columns each must have, and the shape each gets.
BUNDLE = {
    "master": ("MASTER.txt", ["N-NUMBER", "MODE S CODE", "NAME"], master),
    "deregistered": ("DEREG.txt", ["N-NUMBER", "MODE-S-CODE", "NAME"], deregistered),
    "aircraft_reference": ("ACFTREF.txt", ["CODE", "MFR", "MODEL"], aircraft_reference),
}


def refreshed_from(spark: SparkSession, archive: str, folder: str) -> str:
    """A new version of all three tables from one zip archive. A missing member or a header without its columns
    fails before anything is written, and readers keep the version they have."""
    tables = {name: shape(text_table(spark, archive, member, required)) for name, (member, required, shape) in BUNDLE.items()}
    return refreshed(tables, folder)


def current(spark, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the newest version."""
    version = spark.read.parquet(f"{folder}/versions").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{folder}/{version}/{name}")


def by_number(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """Registry rows by tail number, with or without its leading N, in any case. asked: tail."""
    bare = lambda c: F.regexp_replace(F.upper(F.trim(c)), "^N+", "")
    return asked.join(registry.withColumn("_n", bare(F.col("n_number"))), bare(F.col("tail")) == F.col("_n")).drop("_n")


def lookup(asked: DataFrame, registry: DataFrame, crossref: DataFrame) -> DataFrame:
    """asked (query) to address, registration and type: six hexadecimal digits are an address, all else a registration in any case."""
    q = F.trim("query")
    known = registry.select(F.upper("registration").alias("_r"), F.col("icao").alias("_a")).unionByName(crossref.select(F.upper("registration").alias("_r"), F.col("icao").alias("_b")).withColumnRenamed("_b", "_a"))
    first = known.where("_r is not null").groupBy("_r").agg(F.min("_a").alias("_a"))
    met = asked.join(first, F.upper(q) == F.col("_r"), "left").withColumn("icao", F.when(q.rlike("^[0-9a-fA-F]{6}$"), F.lower(q)).otherwise(F.col("_a")))
    r = registry.select("icao", F.col("registration").alias("_rr"), F.col("type_code").alias("_rt"))
    x = crossref.select("icao", F.col("registration").alias("_xr"), F.col("type_code").alias("_xt"))
    out = met.join(r, "icao", "left").join(x, "icao", "left")
    return out.select("query", "icao", F.coalesce("_rr", "_xr").alias("registration"), F.coalesce("_rt", "_xt").alias("type_code"))


def service_payloads(landed: DataFrame) -> DataFrame:
    """Answers of the lookup service (icao, json) as cross-reference rows; an answer that holds a 404 status is a miss."""
    schema = "Registration string, ICAOTypeCode string, Type string, Manufacturer string, RegisteredOwners string, status string"
    rows = landed.select(F.lower("icao").alias("icao"), F.from_json("json", schema).alias("p")).where("p is not null and coalesce(p.status, '') <> '404'")
    return rows.select("icao", pick(F.col("p.Registration")).alias("registration"), pick(F.col("p.ICAOTypeCode")).alias("type_code"), pick(F.col("p.Type"), F.col("p.Manufacturer")).alias("type_description"), pick(F.col("p.RegisteredOwners")).alias("operator"))


def with_type_names(identities: DataFrame, types: DataFrame) -> DataFrame:
    """Identity rows with the description of their type. types: type_code, description."""
    return identities.join(types.select("type_code", F.col("description").alias("type_description")), "type_code", "left")


def with_military(identities: DataFrame, held: DataFrame) -> DataFrame:
    """Identity rows overlaid with military ranges. held: icao, country (null where no range holds it)."""
    return identities.join(held.where("country is not null").select("icao", F.col("country").alias("mil_country")), "icao", "left").withColumn("military", F.col("mil_country").isNotNull())


def flattened_flights(landed: DataFrame) -> DataFrame:
    """Flight records (json) as columns, first and last seen from their messages, else from the record's own times."""
    schema = "id string, flight string, departingAirport string, destinationAirport string, createdAt string, updatedAt string, messages array<struct<timestamp:string>>"
    rows = landed.select(F.from_json("json", schema).alias("f")).where("f.id is not null").select("f.*")
    seen = F.array_compact(F.transform(F.coalesce("messages", F.array().cast("array<struct<timestamp:string>>")), lambda m: F.nullif(m["timestamp"], F.lit(""))))
    return rows.select(F.col("id").alias("flight_id"), pick(F.col("flight")).alias("flight_number"), F.col("departingAirport").alias("departing_airport"), F.col("destinationAirport").alias("destination_airport"), F.coalesce(F.array_min(seen), "createdAt").alias("first_seen"), F.coalesce(F.array_max(seen), "updatedAt").alias("last_seen"), F.size(F.coalesce("messages", F.array().cast("array<struct<timestamp:string>>"))).alias("messages"))
