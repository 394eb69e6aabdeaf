import json

from pyspark.sql import functions as F

from tallygrid.operators import records
from tallygrid.sources import layouts, store


def layout(**changes):
    def box(i, q, d, digit):
        kind = "digit" if digit is not None else "optional_blank_or_digit"
        return {"id": i, "question_num": q, "digit_index": d, "digit_place": "ones", "x": 0.2 + d / 10, "y": 0.3, "width": 0.05, "height": 0.06, "expected_type": kind, "expected_digit": digit}

    def group(q, answer, ids, digits, labels):
        return {"question_num": q, "problem": f"{q} + {q}", "answer": answer, "digit_box_ids": ids, "canonical_digits": digits, "accepted_digit_responses": [{"label": x, "digits": [None if c == "_" else int(c) for c in x], "meaning": ""} for x in labels]}

    return {
        "layout_id": "one", "version": 1, "answer_key": [None, 7, 1, 2], "boxes": [box(0, 1, 0, None), box(1, 1, 1, 7), box(2, 2, 0, 1), box(3, 2, 1, 2)],
        "question_groups": [group(1, 7, [0, 1], [None, 7], ["_7", "07", "7_"]), group(2, 12, [2, 3], [1, 2], ["12"])],
        "work_regions": [{"question_num": 1, "x": 0, "y": 0, "width": 1, "height": 1, "graded": False}],
        "metadata": {"human_code": "T-1", "total_questions": 2, "answer_box_count": 4, "answer_slots_per_question": "variable", "grading_policy": {"answer_slots_per_question": 2}},
    } | changes


def read(spark, folder, *docs):
    for i, doc in enumerate(docs):
        (folder / f"{i}.json").write_text(json.dumps(doc, indent=1))
    return layouts.read_layouts(spark, str(folder))


def test_layout_reads_and_flattens(spark, tmp_path):
    got = read(spark, tmp_path, layout(), {"generated_at": "2026", "templates": [{"layout_id": "one"}]})
    assert got.count() == 1
    assert got.select("metadata.grading_policy.answer_slots_per_question").first()[0] == "2"
    assert layouts.boxes(got).count() == 4 and layouts.questions(got).count() == 2 and layouts.responses(got).count() == 4
    assert [tuple(r) for r in layouts.teacher_key(got).collect()] == [("T-1", "A", "1 + 1", 7), ("T-1", "B", "2 + 2", 12)]
    assert [tuple(r) for r in layouts.optional_slots(got).collect()] == [("one", 1, [0])]
    assert layouts.graded_regions(got).count() == 0
    assert layouts.violations(got).count() == 0


def test_violations_are_named(spark, tmp_path):
    bad = layout(answer_key=[None, 7, 1, 3])
    bad["question_groups"][1]["answer"] = 13
    bad["metadata"]["total_questions"] = 5
    got = read(spark, tmp_path, bad)
    assert set(layouts.violations(got).first()["broken"]) == {"digits", "answer", "responses", "counts"}


def test_minimal_layout_breaks_nothing(spark, tmp_path):
    small = {"layout_id": "old", "version": 1, "answer_key": [1], "boxes": [{"id": 0, "question_num": 1, "x": 0.1, "y": 0.1, "width": 0.1, "height": 0.1}]}
    assert layouts.violations(read(spark, tmp_path, small)).count() == 0


def test_catalog_has_one_checksum_column(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"generated_at": "x", "templates": [{"layout_id": "a", "qr_payload": {"answer_key_checksum": "c1"}}, {"layout_id": "b", "answer_key_checksum": "c2"}]}))
    got = {r["layout_id"]: r["answer_key_checksum"] for r in layouts.read_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a": "c1", "b": "c2"}


def captures(spark):
    return spark.createDataFrame([(" Ann ", "sheet-a-addition", True), ("  ", "sheet-a-addition", True), ("Bo", "other", False), ("Cy", "other", True)], "name string, worksheet string, chosen boolean").select(
        "name", "worksheet", F.struct(F.col("chosen").alias("selected"), F.lit("").alias("name"), F.lit("image/png").alias("type"), F.lit(2048).cast("bigint").alias("size"), F.lit(True).alias("preview"), F.lit("").alias("error")).alias("photo"),
        F.lit(None).cast(layouts_device()).alias("device"), F.to_timestamp(F.lit("2024-01-01 00:00:00.5")).alias("at"),
    )


def layouts_device():
    return records.DEVICE


def test_records(spark, tmp_path):
    empty = spark.range(1).select(F.explode(records.load(F.lit("not json"))).alias("r")).select("r.*")
    assert empty.count() == 0
    saved = records.append(empty, captures(spark))
    rows = {r["studentName"]: r for r in saved.collect()}
    assert set(rows) == {"Ann", "Cy"}
    assert rows["Ann"]["worksheetLabel"] == "Sheet A - Addition Within 20" and rows["Cy"]["worksheetLabel"] == "other"
    assert rows["Ann"]["id"] == "legacy-1704067200500" and rows["Ann"]["savedAt"] == "2024-01-01T00:00:00.500Z"
    assert store.replace(saved, str(tmp_path / "r")).saved
    again = store.load(spark, str(tmp_path / "r"), saved.schema)
    assert {tuple(r) for r in records.cards(again, ["worksheetLabel"]).select("name", "photo").collect()} == {("Ann", "selected image (2 KB)"), ("Cy", "selected image (2 KB)")}
    left = records.without_position(again.withColumn("g", F.lit(1)), ["g"], ["studentName"], 0)
    assert [r["studentName"] for r in left.collect()] == ["Cy"]
    assert records.cleared(again).count() == 0
    stored = json.dumps([json.loads(x) for x in again.toJSON().collect()])
    assert spark.range(1).select(F.size(records.load(F.lit(stored)))).first()[0] == 2
    report = json.loads(records.report(again.withColumn("g", F.lit(1)), ["g"], F.lit("here")).first()["report"])
    assert report["page"] == "here" and len(report["records"]) == 2


def test_rejections(spark):
    got = captures(spark).select("name", records.rejection(F.col("name"), F.col("photo.selected")).alias("why")).collect()
    assert [r["why"] for r in got] == [None, "name", "photo", None]
