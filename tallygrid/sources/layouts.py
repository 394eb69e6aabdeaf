"""Reading worksheet layouts and catalogs, and the rows they hold.

Layouts come in several generations without a schema, so one superset is declared
and every field may be null; nothing is inferred. Convert layouts to Parquet once:
multi-line JSON is read whole, Parquet only in the columns and fields asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.answers import accepted_labels, canonical_label, digits_of
from tallygrid.operators.decode import digit_limit
from tallygrid.operators.integrity import key_checksum

RECT = "x: double, y: double, width: double, height: double"
POLICY = (
    "struct<answer_slots_per_question: string, answer_slot_counts: array<int>, printed_digit_split_guide: string, blank_digit_value: int, graded_region: string, "
    "work_space_graded: boolean, shorter_answers_accept_left_or_right_placement: boolean, single_digit_two_slot_accepts: array<string>, single_digit_two_slot_rejects: array<string>>"
)
LAYOUT = (
    "layout_id string, version int, answer_key array<int>, page struct<aspect_ratio: double, units: string>, "
    f"boxes array<struct<id: int, question_num: int, digit_index: int, digit_place: string, {RECT}, expected_type: string, expected_digit: int>>, "
    "question_groups array<struct<question_num: int, problem: string, answer: int, max_handwritten_digits: int, digit_box_ids: array<int>, canonical_digits: array<int>, "
    "guide_line: struct<type: string, slot_count: int, printed: boolean, x: double, x_values: array<double>, y1: double, y2: double>, "
    "accepted_digit_responses: array<struct<label: string, digits: array<int>, meaning: string>>>>, "
    f"question_regions array<struct<question_num: int, layout_family: string, {RECT}, letter_bubble: struct<x: double, y: double>>>, "
    f"work_regions array<struct<question_num: int, {RECT}, graded: boolean>>, "
    "homography struct<anchors: array<struct<id: string, x: double, y: double>>, marker_size: double>, "
    "metadata struct<title: string, human_code: string, grade_level: int, total_questions: int, answer_box_count: int, layout_family: string, curriculum_tier: string, curriculum_note: string, "
    "curriculum_probe: boolean, curriculum_probe_v2: boolean, classroom_test_packet: boolean, classroom_test_packet_date: string, answer_slots_per_question: string, answer_slot_counts: array<int>, "
    f"test_variant: string, printed_text_font_family: string, required_font_files: array<string>, digit_box_width_mm: double, digit_box_height_mm: double, marker_size_mm: double, qr_position: struct<{RECT}>, grading_policy: {POLICY}>"
)
TEMPLATE = (
    "template_id: string, layout_id: string, human_code: string, title: string, filename: string, worksheet_url: string, layout_url: string, probe_layout_url: string, packet_layout_url: string, "
    "qr_payload: struct<schema_version: int, template_id: string, template_version: int, sheet_instance_id: string, layout_id: string, answer_key_checksum: string>, qr_payload_url: string, "
    "answer_key_checksum: string, grade_level: int, total_questions: int, answer_box_count: int, layout_family: string, curriculum_tier: string, curriculum_note: string, answer_slots_per_question: string, answer_slot_counts: array<int>"
)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """One row a layout file; files without a layout id, such as a registry beside them, are left out."""
    return spark.read.schema(LAYOUT).json(path, multiLine=True).filter(F.col("layout_id").isNotNull())


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row a template of all registry and manifest files; the checksum from the payload where it stands there."""
    files = spark.read.schema(f"generated_at string, templates array<struct<{TEMPLATE}>>").json(path, multiLine=True)
    rows = files.select("generated_at", F.inline("templates"))
    return rows.withColumn("answer_key_checksum", F.coalesce("answer_key_checksum", "qr_payload.answer_key_checksum"))


def boxes(layouts: DataFrame) -> DataFrame:
    return layouts.select("layout_id", F.inline("boxes"))


def questions(layouts: DataFrame) -> DataFrame:
    return layouts.select("layout_id", F.inline("question_groups"))


def responses(layouts: DataFrame) -> DataFrame:
    own = ("layout_id", "question_num", "answer")
    return questions(layouts).select(*own, F.posexplode("accepted_digit_responses").alias("position", "response")).select(*own, "position", "response.*")


def optional_slots(layouts: DataFrame) -> DataFrame:
    """(layout_id, question_num, slots): the slots that may stay blank."""
    open_ = boxes(layouts).filter(F.col("expected_type") == "optional_blank_or_digit")
    return open_.groupBy("layout_id", "question_num").agg(F.array_sort(F.collect_list("digit_index")).alias("slots"))


def graded_regions(layouts: DataFrame) -> DataFrame:
    return layouts.select("layout_id", F.inline("work_regions")).filter(F.col("graded"))


def item_letters(number: Column) -> Column:
    """A, B, ... Z, AA, AB, ...: the name of the question by its number from 1."""
    n = number.cast("int") - 1
    last = F.char(F.lit(65) + F.pmod(n, F.lit(26)))
    return F.when(n < 26, last).otherwise(F.concat(F.char(F.lit(64) + F.floor(n / 26)), last))


def teacher_key(layouts: DataFrame, numbered: bool = False) -> DataFrame:
    """(human_code, item, prompt, answer): a letter for each question, in order.

    ``numbered``: the question's number instead, and the prompt as an equation to complete.
    """
    rows = layouts.select(F.col("metadata.human_code").alias("human_code"), F.inline("question_groups"))
    item = F.col("question_num").cast("string") if numbered else item_letters(F.col("question_num"))
    prompt = F.concat("problem", F.lit(" =")) if numbered else F.col("problem")
    return rows.orderBy("human_code", "question_num").select("human_code", item.alias("item"), prompt.alias("prompt"), "answer")


def family_counts(layouts: DataFrame) -> DataFrame:
    """(curriculum_tier, layout_family, layouts): how many layouts there are of each."""
    kind = [F.col(f"metadata.{c}").alias(c) for c in ("curriculum_tier", "layout_family")]
    return layouts.groupBy(*kind).agg(F.count(F.lit(1)).alias("layouts"))


def digit_caps(layouts: DataFrame) -> DataFrame:
    """(layout_id, question_num, slots, limit, optional): the contract that each question's answer is read under."""
    slots = F.size("digit_box_ids")
    asked = questions(layouts).select("layout_id", "question_num", slots.alias("slots"), digit_limit(F.coalesce("max_handwritten_digits", slots).cast("double")).alias("limit"))
    blank = optional_slots(layouts).withColumnRenamed("slots", "optional")
    return asked.join(blank, ["layout_id", "question_num"], "left").withColumn("optional", F.coalesce("optional", F.array().cast("array<int>")))


def placements(layouts: DataFrame) -> DataFrame:
    """(layout_id, question_num, label): the accepted placements; only the exact one where the policy's flag is off."""
    flag = F.coalesce("metadata.grading_policy.shorter_answers_accept_left_or_right_placement", F.lit(True))
    rows = layouts.select("layout_id", flag.alias("flag"), F.inline("question_groups"))
    slots = F.size("digit_box_ids")
    every, exact = accepted_labels(F.col("answer"), slots), F.array_compact(F.array(canonical_label(F.col("answer"), slots)))
    return rows.select("layout_id", "question_num", F.explode(F.when(F.col("flag"), every).otherwise(exact)).alias("label"))


def disagreements(catalog: DataFrame, layouts: DataFrame) -> DataFrame:
    """(layout_id, fields): the catalog's fields that the layout of that id doesn't confirm; null if there is no layout.

    Fields that the catalog leaves out agree.
    """
    names = ("total_questions", "answer_box_count", "layout_family", "curriculum_tier", "grade_level", "human_code", "title")
    own = layouts.select(F.col("layout_id").alias("_id"), "metadata", key_checksum(F.col("answer_key")).alias("_sum")).dropDuplicates(["_id"])
    differs = [F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"metadata.{c}")), F.lit(c)) for c in names if c in catalog.columns]
    if "answer_key_checksum" in catalog.columns:
        differs.append(F.when(F.col("answer_key_checksum") != F.col("_sum"), F.lit("answer_key_checksum")))
    pairs = catalog.join(own, F.col("layout_id") == F.col("_id"), "left")
    return pairs.select("layout_id", F.when(F.col("_id").isNotNull(), F.array_compact(F.array(*differs))).alias("fields"))


def _all(values: Column) -> Column:
    return F.forall(values, lambda ok: F.coalesce(ok, F.lit(False)))


def violations(layouts: DataFrame) -> DataFrame:
    """(layout_id, broken): which rules between a layout's own parts don't hold.

    ids: the boxes' ids are their places, and there are as many as key digits.
    digits: expected digits, where given, are the key's. optional: a digit is missing
    just where the slot is optional. boxes_of_question, canonical, answer: a question's
    boxes are its own, give its canonical digits, and those its answer. responses:
    the accepted placements are the ones the answer allows. counts: the metadata's
    numbers of questions and boxes.
    """
    key, box, group = F.col("answer_key"), F.col("boxes"), F.coalesce("question_groups", F.array())

    def own(q: Column) -> Column:
        return F.transform(q["digit_box_ids"], lambda i: F.get(box, i))

    checks = {
        "ids": (F.size(key) == F.size(box)) & _all(F.transform(box, lambda b, i: b["id"] == i)),
        "digits": ~F.exists(box, lambda b: b["expected_type"].isNotNull()) | _all(F.transform(box, lambda b, i: b["expected_digit"].eqNullSafe(F.get(key, i)))),
        "optional": _all(F.transform(box, lambda b: b["expected_type"].isNull() | (b["expected_digit"].isNull() == (b["expected_type"] == "optional_blank_or_digit")))),
        "boxes_of_question": _all(F.transform(group, lambda q: _all(F.transform(own(q), lambda b: b["question_num"] == q["question_num"])))),
        "canonical": _all(F.transform(group, lambda q: q["canonical_digits"] == F.transform(own(q), lambda b: b["expected_digit"]))),
        "answer": _all(F.transform(group, lambda q: digits_of(canonical_label(q["answer"], F.size(q["digit_box_ids"]))) == q["canonical_digits"])),
        "responses": _all(F.transform(group, lambda q: accepted_labels(q["answer"], F.size(q["digit_box_ids"])) == F.transform(q["accepted_digit_responses"], lambda r: r["label"]))),
        "counts": F.col("metadata.total_questions").isNull() | (F.col("metadata.total_questions") == F.size(group)) & (F.col("metadata.answer_box_count") == F.size(box)),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return layouts.select("layout_id", broken.alias("broken")).filter(F.size("broken") > 0)
