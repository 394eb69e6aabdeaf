import pytest
from pyspark.sql import functions as F

from tallygrid.functions import text
from tallygrid.operators import answers, geometry, integrity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("answer, slots, want", [
    (7, 1, ["7"]), (12, 2, ["12"]), (7, 2, ["_7", "07", "7_"]), (75, 3, ["_75", "075", "75_"]), (123, 3, ["123"]), (123, 2, None),
])
def test_accepted_labels(spark, answer, slots, want):
    assert one(spark, answers.accepted_labels(F.lit(answer), F.lit(slots))) == want


def test_policy_rejects_a_trailing_zero(spark):
    for label, right in (("_7", True), ("7_", True), ("07", True), ("70", False), ("__", False)):
        assert one(spark, answers.is_right(answers.digits_of(F.lit(label)), F.lit(7), F.lit(2))) is right


def test_canonical_and_places(spark):
    assert one(spark, answers.digits_of(answers.canonical_label(F.lit(75), F.lit(3)))) == [None, 7, 5]
    assert [one(spark, answers.place_names(F.lit(3), F.lit(i))) for i in range(3)] == ["hundreds", "tens", "ones"]
    assert one(spark, answers.slots_of(F.array(F.lit(2), F.lit(2)))) == "2"
    assert one(spark, answers.slots_of(F.array(F.lit(2), F.lit(1)))) == "variable"


@pytest.mark.parametrize("key, text_", [([None, 7, 5], "_,7,5"), ([None, None], "_,_"), ([], ""), ([4], "4")])
def test_key_checksum(spark, key, text_):
    import hashlib

    column = F.array(*[F.lit(k).cast("int") for k in key]) if key else F.array().cast("array<int>")
    assert one(spark, integrity.key_checksum(column)) == hashlib.sha256(text_.encode()).hexdigest()[:12]


def test_payload_round_trip(spark):
    url = integrity.payload_url(F.lit("https://example.org/"), integrity.payload(F.lit("sheet 1/a"), F.lit(3), F.lit("abcdef012345")))
    assert tuple(one(spark, integrity.read_payload(url))) == ("SG1", "sheet 1/a", 3, "abcdef012345")
    assert tuple(one(spark, integrity.read_payload(F.lit("https://example.org/?sg=%ZZ")))) == (None,) * 4
    assert tuple(one(spark, integrity.read_payload(F.lit("https://example.org/?sg=SG1:a:x:c")))) == ("SG1", "a", None, "c")


@pytest.mark.parametrize("size, want", [
    (None, "0 B"), (0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "2 KB"), (1048575, "1024 KB"), (1048576, "1.0 MB"), (1310720, "1.3 MB"),
])
def test_human_bytes(spark, size, want):
    assert one(spark, text.human_bytes(F.lit(size).cast("long"))) == want


def test_small_text_functions(spark):
    assert one(spark, text.trim(F.lit("   a b﻿\n"))) == "a b"
    assert one(spark, text.escape_html(F.lit("<a&\"'>"))) == "&lt;a&amp;&quot;'&gt;"
    assert one(spark, text.escape_html(F.lit(None).cast("string"))) == "null"
    assert one(spark, text.escape_html(F.lit(None).cast("string"), "")) == ""
    assert one(spark, text.system_version(F.lit("(iPad; CPU OS 9_3_5 like Mac OS X)"))) == "9.3.5"
    assert one(spark, text.system_version(F.lit("other"))) == "not detected"
    assert [one(spark, text.tri_state(F.lit(x).cast("boolean"))) for x in (True, False, None)] == ["OK", "No", "Check"]
    assert one(spark, text.has_path(F.lit('{"a": {"b": null, "c": 0}}'), "a.c")) and not one(spark, text.has_path(F.lit('{"a": {"b": null}}'), "a.b"))
    assert one(spark, text.prompt_shape(F.lit("12 + 3"))) == "N + N"


def test_catalog_audit(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "layout_id string, n int")
    b = spark.createDataFrame([("y", "t")], "layout_id string, tier string")
    assert integrity.catalog([a, b]).columns == ["layout_id", "n", "tier"]
    assert [r[0] for r in integrity.without(a, "layout_id", b, "layout_id").collect()] == ["x"]
    assert integrity.one_copy(a.union(a), ["layout_id"]).count() == 2
    c = spark.createDataFrame([("x", 1), ("y", 3)], "layout_id string, n int")
    assert {r[0]: r[1] for r in integrity.differing_fields(a, c, "layout_id").collect()} == {"x": [], "y": ["n"]}


def test_geometry(spark):
    boxes = spark.createDataFrame([(1, 0, 0.2, 0.5, 0.1, 0.2), (1, 1, 0.4, 0.5, 0.1, 0.2), (2, 0, 0.9, 0.9, 0.1, 0.1)], "q int, i int, x double, y double, width double, height double")
    lines = geometry.guide_lines(boxes, ["q"], ["i"]).collect()
    assert len(lines) == 1 and lines[0]["guide_x"] == pytest.approx(0.25) and lines[0]["y1"] == pytest.approx(0.3)
    region = {"x": F.lit(0.05), "y": F.lit(0.25), "width": F.lit(0.4), "height": F.lit(0.3)}
    inside = boxes.select(geometry.box_in_region({c: F.col(c) for c in ("x", "y", "width", "height")}, region).alias("in")).collect()
    assert [r[0] for r in inside] == [True, True, False]
