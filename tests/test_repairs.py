"""Answers that were wrong once: time zones, address components, the end of a text; and what no query shows."""

from pyspark.sql import functions as F

from tallygrid.functions import text
from tallygrid.operators import integrity, records


def test_records_are_saved_in_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    photo = F.struct(F.lit(True).alias("selected"), F.lit("a.png").alias("name"), F.lit("").alias("type"), F.lit(1).alias("size"), F.lit(True).alias("preview"), F.lit("").alias("error"))
    none = spark.createDataFrame([], records.RECORD.removeprefix("struct<").removesuffix(">"))
    try:
        for other in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            at = F.timestamp_millis(F.lit(1704067200500))
            given = spark.range(1).select(F.lit(" Ann ").alias("name"), F.lit("x").alias("worksheet"), photo.alias("photo"), F.lit(None).cast(records.DEVICE).alias("device"), at.alias("at"))
            row = records.append(none, given).first()
            assert (row["id"], row["savedAt"], row["studentName"]) == ("legacy-1704067200500", "2024-01-01T00:00:00.500Z", "Ann")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_payload_urls_are_address_components(spark):
    raw = "SG1:a b~!'()*+&:1:c"
    row = spark.range(1).select(integrity.payload_url(F.lit("u/"), F.lit(raw)).alias("u")).select("u", integrity.read_payload(F.col("u")).alias("p")).first()
    assert row["u"] == "u/?sg=SG1%3Aa%20b~!'()*%2B%26%3A1%3Ac"
    assert (row["p"]["template"], row["p"]["version"]) == ("a b~!'()*+&", 1)
    assert spark.range(1).select(integrity.read_payload(F.lit("u?sg=SG1:a+b:1:c")).alias("p")).first()["p"]["template"] == "a+b"


def test_trim_keeps_what_no_script_trims(spark):
    got = spark.createDataFrame([("a \x85",), (" a\n",), ("\u3000b c\r\n",), (None,)], "s string").select(text.trim(F.col("s"))).collect()
    assert [r[0] for r in got] == ["a \x85", "a", "b c", None]


def test_no_records(spark):
    none = spark.createDataFrame([], records.RECORD.removeprefix("struct<").removesuffix(">"))
    assert records.cards(none, ["worksheet"]).count() == 0 and records.headline(none).first()["message"] == records.NO_RECORDS
    assert records.cleared(none).count() == 0
