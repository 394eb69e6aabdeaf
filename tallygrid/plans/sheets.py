"""Registered queries over answer-sheet layouts and capture records, with their SQL.

The tables hold no layouts or records, so each query builds its own from a whole
table: a part is a layout of two questions (its size in two slots, the last digit of
its key in one), an event a capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import text
from tallygrid.operators import answers, decode, geometry, integrity, records
from tallygrid.plans.catalog import _read, query
from tallygrid.sources import layouts, photos


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    size, last = F.col("p_size"), (F.col("p_partkey") % 10).cast("int")
    tens, ones, none = F.when(size >= 10, F.floor(size / 10).cast("int")), (size % 10).cast("int"), F.lit(None).cast("int")

    def box(i: int, question: int, index: int, digit) -> F.Column:
        kind = F.when(digit.isNull(), F.lit("optional_blank_or_digit")).otherwise(F.lit("digit"))
        return F.struct(F.lit(i).alias("id"), F.lit(question).alias("question_num"), F.lit(index).alias("digit_index"), kind.alias("expected_type"), digit.alias("expected_digit"))

    def group(question: int, problem, answer, cap, boxes: list[int], digits: list) -> F.Column:
        slots = F.lit(len(boxes))
        accepted = F.transform(answers.accepted_labels(answer, slots), lambda x: F.struct(x.alias("label"), answers.digits_of(x).alias("digits")))
        return F.struct(
            F.lit(question).alias("question_num"), problem.alias("problem"), answer.alias("answer"), cap.alias("max_handwritten_digits"),
            F.array(*map(F.lit, boxes)).alias("digit_box_ids"), F.array(*digits).alias("canonical_digits"), accepted.alias("accepted_digit_responses"),
        )

    tier = F.when(size < 20, F.lit("supported")).when(size < 40, F.lit("stress")).otherwise(F.lit("future"))
    policy = F.struct((F.col("p_partkey") % 4 != 0).alias("shorter_answers_accept_left_or_right_placement"))
    work = [F.struct(F.lit(q).alias("question_num"), (F.lit(q == 2) & (F.col("p_partkey") % 2 == 0)).alias("graded")) for q in (1, 2)]
    return part.select(
        F.col("p_partkey").cast("string").alias("layout_id"),
        F.array(tens, ones, last).alias("answer_key"),
        F.array(box(0, 1, 0, tens), box(1, 1, 1, ones), box(2, 2, 0, last)).alias("boxes"),
        F.array(
            group(1, F.col("p_name"), size.cast("int"), F.when(F.col("p_partkey") % 3 == 0, F.lit(3)), [0, 1], [tens, ones]),
            group(2, F.lit("How many?"), last, none, [2], [last]),
        ).alias("question_groups"),
        F.array(*work).alias("work_regions"),
        F.struct(
            F.col("p_brand").alias("human_code"), tier.alias("curriculum_tier"), F.col("p_type").alias("layout_family"),
            F.when(F.col("p_partkey") % 5 == 0, F.lit(3)).otherwise(F.lit(2)).alias("total_questions"), F.lit(3).alias("answer_box_count"), policy.alias("grading_policy"),
        ).alias("metadata"),
    )


_Q = "p_partkey::varchar as layout_id"


@query(f"""
select {_Q}, 0 as id, 1 as question_num, 0 as digit_index, case when p_size < 10 then 'optional_blank_or_digit' else 'digit' end as expected_type, case when p_size >= 10 then (p_size // 10)::varchar end as expected_digit from part
union all select {_Q}, 1, 1, 1, 'digit', (p_size % 10)::varchar from part union all select {_Q}, 2, 2, 0, 'digit', (p_partkey % 10)::varchar from part""")
def layout_boxes(spark, sf_dir):
    return layouts.boxes(_sheets(spark, sf_dir)).withColumn("expected_digit", F.col("expected_digit").cast("string"))


@query(f"select {_Q}, 1 as question_num, p_name as problem, p_size as answer from part union all select {_Q}, 2, 'How many?', p_partkey % 10 from part")
def layout_questions(spark, sf_dir):
    return layouts.questions(_sheets(spark, sf_dir)).select("layout_id", "question_num", "problem", "answer")


_PLACES = """select {0}, 1 as question_num, p_size as answer, unnest(case when p_size >= 10 then [p_size::varchar] else ['_' || p_size, '0' || p_size, p_size || '_'] end) as label from part
union all select {0}, 2, p_partkey % 10, (p_partkey % 10)::varchar from part"""


@query(f"select layout_id, question_num, answer, label, replace(label, '_', '') as shown from ({_PLACES.format(_Q)})")
def layout_responses(spark, sf_dir):
    got = layouts.responses(_sheets(spark, sf_dir))
    return got.select("layout_id", "question_num", "answer", "label", F.array_join("digits", "").alias("shown"))


@query(f"""
select {_Q}, 1 as question_num, unnest(case when p_size >= 10 then [p_size::varchar] when p_partkey % 4 = 0 then ['_' || p_size] else ['_' || p_size, '0' || p_size, p_size || '_'] end) as label from part
union all select {_Q}, 2, (p_partkey % 10)::varchar from part""")
def placement_flag(spark, sf_dir):
    return layouts.placements(_sheets(spark, sf_dir))


@query(f"select {_Q}, 1 as question_num, '0' as slots from part where p_size < 10")
def optional_slot_lists(spark, sf_dir):
    return layouts.optional_slots(_sheets(spark, sf_dir)).select("layout_id", "question_num", F.array_join("slots", ",").alias("slots"))


@query(f"select {_Q}, 2 as question_num from part where p_partkey % 2 = 0")
def graded_work(spark, sf_dir):
    return layouts.graded_regions(_sheets(spark, sf_dir)).select("layout_id", "question_num")


@query(f"""
select {_Q}, 1 as question_num, 2 as slots, case when p_partkey % 3 = 0 then 3.0::double else 2.0::double end as "limit", case when p_size < 10 then '0' else '' end as optional from part
union all select {_Q}, 2, 1, 1.0::double, '' from part""")
def digit_caps(spark, sf_dir):
    return layouts.digit_caps(_sheets(spark, sf_dir)).withColumn("optional", F.array_join("optional", ","))


@query("select p_brand as human_code, 'A' as item, p_name as prompt, p_size as answer from part union all select p_brand, 'B', 'How many?', p_partkey % 10 from part")
def teacher_key(spark, sf_dir):
    return layouts.teacher_key(_sheets(spark, sf_dir))


@query("select p_brand as human_code, '1' as item, p_name || ' =' as prompt, p_size as answer from part union all select p_brand, '2', 'How many? =', p_partkey % 10 from part")
def numbered_key(spark, sf_dir):
    return layouts.teacher_key(_sheets(spark, sf_dir), numbered=True)


@query("select n_nationkey, case when k <= 26 then chr(64 + k) else chr(64 + (k - 1) // 26) || chr(65 + (k - 1) % 26) end as item from (select n_nationkey, n_nationkey * 5 + 1 as k from nation)")
def item_letters(spark, sf_dir):
    return _read(spark, sf_dir, "nation").select("n_nationkey", layouts.item_letters(F.col("n_nationkey") * 5 + 1).alias("item"))


@query("""
select case when p_size < 20 then 'supported' when p_size < 40 then 'stress' else 'future' end as curriculum_tier, p_type as layout_family, count(*) as layouts from part group by 1, 2""")
def family_counts(spark, sf_dir):
    return layouts.family_counts(_sheets(spark, sf_dir))


@query(f"select {_Q}, 'counts' as broken from part where p_partkey % 5 = 0")
def layout_violations(spark, sf_dir):
    return layouts.violations(_sheets(spark, sf_dir)).select("layout_id", F.array_join("broken", ",").alias("broken"))


@query("""
select (p_partkey * 2)::varchar as layout_id, case when p_partkey * 2 <= m then concat_ws(',', case when p_partkey * 2 % 5 = 0 then 'total_questions' end, case when p_partkey % 7 = 0 then 'answer_box_count' end) end as fields
from part, (select max(p_partkey) as m from part)""")
def catalog_agreement(spark, sf_dir):
    """A catalog that lists every second layout, and as many that don't exist."""
    part = _read(spark, sf_dir, "part")
    boxes = F.when(F.col("p_partkey") % 7 == 0, F.lit(4)).otherwise(F.lit(3))
    listed = part.select((F.col("p_partkey") * 2).cast("string").alias("layout_id"), F.lit(2).alias("total_questions"), boxes.alias("answer_box_count"))
    return layouts.disagreements(listed, _sheets(spark, sf_dir)).select("layout_id", F.array_join("fields", ",").alias("fields"))


@query("select p_partkey, lpad(p_size::varchar, 3, '_') as label, len(p_size::varchar) as digits from part")
def canonical_digits(spark, sf_dir):
    label = answers.canonical_label(F.col("p_size"), F.lit(3))
    digits = F.size(F.filter(answers.digits_of(label), lambda x: x.isNotNull())).cast("long")
    return _read(spark, sf_dir, "part").select("p_partkey", label.alias("label"), digits.alias("digits"))


@query("""
select s_suppkey, 1 as schema_version, s_name as template_id, 2 as template_version, s_name || '-classroom-set' as sheet_instance_id, 'l' || s_suppkey as layout_id, left(sha256(s_suppkey::varchar), 12) as answer_key_checksum from supplier""")
def payload_struct(spark, sf_dir):
    checksum = integrity.key_checksum(F.array(F.col("s_suppkey")))
    payload = integrity.payload_struct(F.col("s_name"), F.lit(2), F.concat(F.lit("l"), F.col("s_suppkey").cast("string")), checksum)
    return _read(spark, sf_dir, "supplier").select("s_suppkey", payload.alias("p")).select("s_suppkey", "p.*")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_quantity, case when l_quantity = 25 then 4.0::double else least(4.0::double, greatest(1.0::double, l_quantity - 25)) end as digits from lineitem""")
def digit_limits(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", decode.digit_limit(F.col("l_quantity") - 25).alias("digits"))


_STEP = "1 / list_sum(list_transform(s{0}, lambda x: exp(x - list_max(s{0}))))"
_STEPS = ", ".join(_STEP.format(i) for i in range(4))


@query(f"""
with s as (select vec_id, {', '.join(f'embedding[{16 * i + 1}:{16 * i + 16}]::double[] as s{i}' for i in range(4))} from embeddings)
select vec_id, round(list_min([{_STEPS}]), 10) as least, round(list_avg([{_STEPS}]), 10) as mean from s""")
def sequence_confidence(spark, sf_dir):
    """An embedding's quarters as four decoding steps."""
    steps = F.array(*[decode.greedy_step(F.slice("embedding", 16 * i + 1, 16))["probability"] for i in range(4)])
    sure = _read(spark, sf_dir, "embeddings").select("vec_id", decode.confidence(steps).alias("c"))
    return sure.select("vec_id", F.round("c.least", 10).alias("least"), F.round("c.mean", 10).alias("mean"))


@query("select vec_id, case when vec_id % 3 = 0 then 'other' else 'given' end as used from embeddings")
def prepared_pixels(spark, sf_dir):
    given = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    used = decode.pixels_or(given, F.array().cast("array<float>"), 64)
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.size(used) == 64, F.lit("given")).otherwise(F.lit("other")).alias("used"))


@query("""
select p_partkey, round(p_size / 127.5::double - 1, 9) as r0, round((p_size + 1) / 127.5::double - 1, 9) as r1, round(100 / 127.5::double - 1, 9) as g0, round(p_partkey % 256 / 127.5::double - 1, 9) as b1 from part""")
def pixel_planes(spark, sf_dir):
    rgba = F.array(F.col("p_size"), F.lit(100), F.lit(7), F.lit(255), F.col("p_size") + 1, F.lit(101), (F.col("p_partkey") % 256).cast("int"), F.lit(255))
    at = lambda i: F.round(F.get("p", F.lit(i)), 9)
    planes = _read(spark, sf_dir, "part").select("p_partkey", decode.planes(rgba).alias("p"))
    return planes.select("p_partkey", at(0).alias("r0"), at(1).alias("r1"), at(2).alias("g0"), at(5).alias("b1"))


@query("select p_partkey, round(10 + 2 * p_size, 6)::double as x, round(20 + 3 * (p_retailprice / 100), 6) as y from part")
def rectified_points(spark, sf_dir):
    """Four anchors that a photo shows as a rectangle: the projective map is a scaling."""
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    corners = F.array(corner(10, 20), corner(210, 20), corner(210, 320), corner(10, 320))
    x, y = geometry.seen_at(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (0.0, 0.0, 100.0, 100.0), corners)
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""
select page_id, case when page_id % 4 = 0 then 'missing id' when page_id % 4 = 1 then 'missing image' end as error, case when page_id % 4 > 1 then url end as result from pages""")
def frame_requests(spark, sf_dir):
    key, image = F.when(F.col("page_id") % 4 != 0, F.col("page_id")), F.when(F.col("page_id") % 4 != 1, F.col("url"))
    replies = _read(spark, sf_dir, "pages").select("page_id", photos.reply(key, image, photos.request_error(key, image)).alias("r"))
    return replies.select("page_id", "r.error", "r.result")


@query("""
select doc_id, case when doc_id % 2 = 0 then coalesce(source, '') else '' end as name, case when doc_id % 2 = 0 then n_chars else 0 end as size, doc_id % 2 = 0 as selected, false as preview from documents""")
def photo_defaults(spark, sf_dir):
    lacking = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit(True).alias("selected"), F.col("source").alias("name"), F.lit(None).cast("string").alias("type"), F.col("n_chars").alias("size"), F.lit(None).cast("boolean").alias("preview"), F.lit(None).cast("string").alias("error")))
    full = _read(spark, sf_dir, "documents").select("doc_id", photos.photo_or_default(lacking).alias("p"))
    return full.select("doc_id", "p.name", "p.size", "p.selected", "p.preview")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved captures: of the events, those whose number isn't a multiple of 3 have a photo."""
    events = _read(spark, sf_dir, "events")
    photo = F.struct((F.col("event_id") % 3 != 0).alias("selected"), F.lit("").alias("name"), F.lit("").alias("type"), F.col("event_id").alias("size"), F.lit(True).alias("preview"), F.lit("").alias("error"))
    sheet = F.when(F.col("event_id") % 2 == 0, F.lit("sheet-c-mixed")).otherwise(F.lit("other"))
    given = events.select(F.concat(F.lit(" "), "event_type").alias("name"), sheet.alias("worksheet"), photo.alias("photo"), F.lit(None).cast(records.DEVICE).alias("device"), F.col("user_id").alias("device_id"), F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("at"))
    none = spark.createDataFrame([], "device_id long, " + records.RECORD.removeprefix("struct<").removesuffix(">"))
    return records.append(none, given)


_SAVED = """select 'legacy-' || (epoch_us(ts) // 1000) as id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0') || 'Z' as saved, event_type as name,
       case when event_id % 2 = 0 then 'Sheet C - Mixed Within 50' else 'other' end as worksheet, event_id as size, user_id as device_id from events where event_id % 3 <> 0"""


@query(f"select id, saved, name, worksheet, size from ({_SAVED})")
def saved_captures(spark, sf_dir):
    """Captures appended, written as JSON and loaded again."""
    stored = _captures(spark, sf_dir).select(F.to_json(F.array(F.struct("*"))).alias("stored"))
    return stored.select(F.inline(records.load(F.col("stored")))).select("id", F.col("savedAt").alias("saved"), F.col("studentName").alias("name"), F.col("worksheetLabel").alias("worksheet"), "photo.size")


_SIZE = "case when size < 1024 then size || ' B' when size < 1048576 then floor(size / 1024 + 0.5)::bigint || ' KB' else printf('%.1f MB', floor(size / 1048576 * 10 + 0.5) / 10) end"


_PLACE = "row_number() over (partition by device_id order by saved, id)::int - 1"


@query(f"select device_id, {_PLACE} as place, name, worksheet, 'selected image (' || {_SIZE} || ')' as photo, saved from ({_SAVED})")
def capture_cards(spark, sf_dir):
    """Each device's own cards."""
    return records.cards(_captures(spark, sf_dir), ["device_id"])


@query(f"select device_id, count(*)::int as cards, max(saved) as last, 'No saved records yet.' as otherwise from ({_SAVED}) group by device_id")
def card_order(spark, sf_dir):
    """A device's last card is the record that it saved last; without records there is a message."""
    saved = _captures(spark, sf_dir)
    last = records.cards(saved, ["device_id"]).groupBy("device_id").agg((F.max("place") + 1).alias("cards"), F.max_by("saved", "place").alias("last"))
    return last.join(F.broadcast(records.headline(records.cleared(saved)).select(F.col("message").alias("otherwise"))), F.lit(True))


@query(f"""
select device_id, '2024-01-01T00:00:00.000Z' as generated, 'p' as page, 2.0::double as ratio, count(*)::int as records, min(saved) as first, max(saved) as last from ({_SAVED}) group by device_id""")
def capture_report(spark, sf_dir):
    """The report of each device."""
    device = F.from_json(F.lit('{"devicePixelRatio": 2}'), records.DEVICE)
    report = records.report(_captures(spark, sf_dir), ["device_id"], F.lit("p"), device, at=F.timestamp_seconds(F.lit(1704067200)))
    field = lambda path: F.get_json_object("report", path)
    listed = F.from_json(field("$.records"), "array<struct<savedAt: string>>")
    return report.select(
        "device_id", field("$.generatedAt").alias("generated"), field("$.page").alias("page"), field("$.device.devicePixelRatio").cast("double").alias("ratio"),
        F.size(listed).alias("records"), F.get(listed, F.lit(0))["savedAt"].alias("first"), F.element_at(listed, -1)["savedAt"].alias("last"),
    )


@query("""
select doc_id, case when doc_id % 2 = 0 then '17.4' else 'not detected' end as version, coalesce(lang, '') as platform, 'unknown' as screen, n_chars > 100 as fetch, false as canvas, 1.0::double as ratio from documents""")
def device_report(spark, sf_dir):
    agent = F.when(F.col("doc_id") % 2 == 0, F.lit("Mozilla/5.0 (iPad; CPU OS 17_4 like Mac OS X)"))
    report = text.device_report({"userAgent": agent, "platform": F.col("lang")}, {"fetch": F.col("n_chars") > 100}, F.lit(None).cast(records.PHOTO))
    found = _read(spark, sf_dir, "documents").select("doc_id", report.alias("r"))
    return found.select("doc_id", F.col("r.iosVersion").alias("version"), "r.platform", "r.screen", "r.features.fetch", "r.features.canvas", F.col("r.devicePixelRatio").alias("ratio"))
