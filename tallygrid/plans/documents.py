"""Registered queries over whole documents, printed keys, readings and pictures, with their SQL.

Layouts are made of parts, as in ``sheets``; embeddings stand for pictures, and documents
for JSON texts of one content.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.operators import decode, integrity
from tallygrid.plans.catalog import _read, query
from tallygrid.plans.sheets import _sheets
from tallygrid.sources import keys

_LAYOUT = "p_partkey::varchar as layout_id"


@query(f"""
select {_LAYOUT}, 'boxes' as part, '1' as id, 'both' as side, 'expected_digit' as fields from part where p_partkey % 3 = 0
union all select {_LAYOUT}, 'boxes', '2', 'left', '' from part where p_partkey % 4 = 0
union all select {_LAYOUT}, 'boxes', '9', 'right', '' from part where p_partkey % 6 = 0
union all select {_LAYOUT}, 'question_groups', '1', 'both', 'problem,answer' from part where p_partkey % 2 = 0""")
def variant_elements(spark, sf_dir):
    """Two variants of all layouts, compared box by box and question by question, whatever their order."""
    key = F.col("layout_id").cast("long")
    a = _sheets(spark, sf_dir)
    boxes = F.transform("boxes", lambda b: b.withField("expected_digit", F.when((key % 3 == 0) & (b["id"] == 1), b["expected_digit"] + 1).otherwise(b["expected_digit"])))
    fewer = F.filter(boxes, lambda b: ~((key % 4 == 0) & (b["id"] == 2)))
    more = F.when(key % 6 == 0, F.array_append(fewer, F.get("boxes", F.lit(0)).withField("id", F.lit(9)))).otherwise(fewer)
    changed = lambda q: q.withField("problem", F.concat(q["problem"], F.lit("?"))).withField("answer", q["answer"] + 1)
    other = F.transform("question_groups", lambda q: F.when((key % 2 == 0) & (q["question_num"] == 1), changed(q)).otherwise(q))
    b = a.withColumn("question_groups", F.reverse(other)).withColumn("boxes", F.when(key % 5 == 0, F.reverse(more)).otherwise(more))
    found = integrity.element_differences(a, b, "layout_id", {"boxes": "id", "question_groups": "question_num"})
    return found.withColumn("fields", F.array_join("fields", ","))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text, lang, source")
def document_copies(spark, sf_dir):
    """Documents as JSON, every second one with its keys in another order: one row for each content."""
    docs = _read(spark, sf_dir, "documents")
    inner = F.struct(F.struct("lang", "source").alias("about"), "text")
    turned = F.struct("text", F.struct("source", "lang").alias("about"))
    json = F.when(F.col("doc_id") % 2 == 0, F.to_json(inner)).otherwise(F.to_json(turned, {"pretty": "true"}))
    return integrity.distinct_documents(docs.select("doc_id", json.alias("json")), "json", ["doc_id"]).select("doc_id", "copies")


_ITEM = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(rf"""
with u as (select page_id, unnest(regexp_extract_all(html, '(?is)<ul\b[^>]*>(.*?)</ul\s*>', 1)) as ul, generate_subscripts(regexp_extract_all(html, '(?is)<ul\b[^>]*>(.*?)</ul\s*>', 1), 1) as k from pages),
i as (select page_id, k, list_transform(regexp_extract_all(ul, '(?is)<li\b[^>]*>(.*?)</li\s*>', 1), lambda x: {_ITEM}) as items from u)
select page_id, row_number() over (partition by page_id order by k)::int - 1 as list, len(items)::int as items, sha256(array_to_string(items, '|')) as texts,
       left(sha256(array_to_string(list_transform(items, lambda x: array_to_string(string_split(lpad(len(x)::varchar, 3, '_'), ''), ',')), ',')), 12) as checksum
from i where len(items) > 0""")
def listed_keys(spark, sf_dir):
    """The lists of all pages as tables of one cell a row; the lengths of a list's items as a key in slots of three, and its checksum."""
    lists = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(keys.cells(F.col("html"), "ul", "li")).alias("list", "items"))
    lengths = F.transform("items", lambda x: F.length(x))
    checksum = integrity.key_checksum(keys.key_of(lengths, F.lit(3)))
    return lists.select("page_id", "list", F.size("items").alias("items"), F.sha2(F.array_join("items", "|"), 256).alias("texts"), checksum.alias("checksum"))


_ANSWERS = "[{k}, {k} * 7 % 100, {k} * 3 % 10]"


@query(f"""
select p_partkey, 'Sheet ' || p_name as title, 3 as questions, left(sha256(array_to_string(list_transform({_ANSWERS.format(k='p_size')},
       lambda x: array_to_string(string_split(lpad(x::varchar, 3, '_'), ''), ',')), ',')), 12) as checksum from part""")
def printed_keys(spark, sf_dir):
    """A printed key for each part, as HTML, read back and its checksum rebuilt."""
    cell = lambda x: F.concat(F.lit('<td class="a">'), x.cast("string"), F.lit("</td>"))
    answers = (F.col("p_size"), F.col("p_size") * 7 % 100, F.col("p_size") * 3 % 10)
    rows = [F.concat(F.lit("\n<tr>"), cell(F.lit("ABC"[i])), cell(F.lit("4 &lt; 5 &amp; 6")), cell(a), F.lit("</tr>")) for i, a in enumerate(answers)]
    head = F.concat(F.lit('<section class="sheet"><h2 id="x">Sheet <b>'), "p_name", F.lit("</b></h2><table><thead><tr><th>Item</th><th>Prompt</th><th>Answer</th></tr></thead><tbody>"))
    pages = _read(spark, sf_dir, "part").select("p_partkey", F.concat(head, *rows, F.lit("</tbody></table></section>")).alias("html"))
    return keys.rebuilt_checksums(keys.read_keys(pages, "html", ["p_partkey"]), ["p_partkey"]).drop("sheet")


def _area(given: int, wanted: int, at: str, cell: str) -> str:
    """SQL: of the given cell k's stretch, how much the wanted cell ``at`` covers."""
    return f"greatest(0, least(({at} + 1) * {given} / {wanted}.0::double, {cell} + 1) - greatest({at} * {given} / {wanted}.0::double, {cell}))"


def _resampled(size: int) -> str:
    x, y = _area(8, size, "c", "j"), _area(8, size, "r", "i")
    return f"""
    select vec_id, {size} as size, r::int as "row", c::int as col, round(sum(embedding[i * 8 + j + 1]::double * {x} * {y}) * {size} * {size} / 64.0::double, 6) as pixel
    from embeddings, range({size}) rr(r), range({size}) cc(c), range(8) ii(i), range(8) jj(j) where {x} > 0 and {y} > 0 group by all"""


@query(f"{_resampled(5)} union all {_resampled(24)}".replace("from embeddings", "from (select * from embeddings where embedding is not null)"))
def resampled_pixels(spark, sf_dir):
    """Embeddings as pictures of 8 by 8 pixels, shrunk to 5 by 5 and stretched to 24 by 24."""
    rows, parts = _read(spark, sf_dir, "embeddings"), []
    for size in (5, 24):
        pixels = rows.select("vec_id", F.posexplode(decode.resampled(F.col("embedding"), 8, 8, size)).alias("at", "pixel"))
        place = {"row": F.floor(F.col("at") / size), "col": F.col("at") % size}
        parts.append(pixels.select("vec_id", F.lit(size).alias("size"), *[e.cast("int").alias(n) for n, e in place.items()], F.round("pixel", 6).alias("pixel")))
    return parts[0].unionByName(parts[1])


_DIGITS = dict(enumerate(decode.DIGIT_TOKENS))
_WIDE = 600
_SMALL = sorted((t, n) for n, t in _DIGITS.items() if t < _WIDE)


@query(f"""
with t(n, token) as (values {', '.join(f'({n}, {t})' for t, n in _SMALL)}),
p as (select p_partkey, p_partkey % {len(_SMALL)} as i, p_size % {len(_SMALL)} as j, p_partkey % 5 as kind, 4 + (p_partkey % 10) / 10.0::double as s1, 5 + (p_size % 10) / 10.0::double as s2 from part),
o as (select n, row_number() over (order by token) - 1 as k from t),
w as (select p.*, a.n::varchar as x, b.n::varchar as y, exp(s1) / (exp(s1) + {_WIDE - 1}) as p1, exp(s2) / (exp(s2) + {_WIDE - 1}) as p2 from p join o a on a.k = i join o b on b.k = j),
r as (select *, case kind when 0 then x || y when 1 then x when 2 then '' when 3 then '' else x || y || x || y end as said,
             case kind when 0 then [p1, p2, p1] when 1 then [p1, p2] when 2 then [p2] when 3 then [p1, p2, p2] else [p1, p2, p1, p2] end as chances from w),
c as (select *, case when p_partkey % 3 = 0 then 2 else 4 end as most from r)
select p_partkey, said as text, kind = 2 as blank, kind = 2 or (kind <> 3 and len(said) <= most) as valid,
       case when kind = 3 then 'unknown-nonnumeric-token' when len(said) > most then 'layout-length-contract' end as reason,
       round(list_min(chances), 10) as least, round(list_avg(chances), 10) as mean, len(chances)::int as steps, most::double as "limit",
       case when p_partkey % 2 = 0 then 'money' else 'unknown' end as layout_family,
       case when kind = 2 then '0,1' when kind <> 3 and len(said) <= most and len(said) = 2 then '0' when kind <> 3 and len(said) <= most and len(said) = 1 then '0,1' else '' end as blank_slots
from c""")
def recognized_answers(spark, sf_dir):
    """Readings of up to four steps: two tokens, one, none, an unknown one, and no end in sight; under contracts of two or four digits."""
    ids, names = F.array(*[F.lit(t) for t, _ in _SMALL]), len(_SMALL)
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("kind"))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # few bytes a row, so few splits, but much to read
    x, y = F.get(ids, (F.col("p_partkey") % names).cast("int")), F.get(ids, (F.col("p_size") % names).cast("int"))
    high, higher = 4 + (F.col("p_partkey") % 10) / 10.0, 5 + (F.col("p_size") % 10) / 10.0
    end, odd = F.lit(decode.END), F.lit(7)

    def scores(token: F.Column, best: F.Column) -> F.Column:
        return F.concat(F.array_repeat(F.lit(0.0), token), F.array(best), F.array_repeat(F.lit(0.0), _WIDE - 1 - token))

    one, other = scores(x, high), scores(y, higher)
    steps = (
        F.when(F.col("kind") == 0, F.array(one, other, scores(end, high), other)).when(F.col("kind") == 1, F.array(one, scores(end, higher), one, one))
        .when(F.col("kind") == 2, F.array(scores(end, higher), one)).when(F.col("kind") == 3, F.array(one, scores(odd, higher), scores(end, higher)))
        .otherwise(F.array(one, other, one, other, scores(end, high)))
    )
    family = F.when(F.col("p_partkey") % 2 == 0, F.lit("money")).otherwise(F.lit(""))
    contract = F.struct(
        family.alias("layout_family"), F.lit(3).alias("slots"), F.when(F.col("p_partkey") % 3 == 0, F.lit(2.0)).otherwise(F.lit(0.0)).alias("max_digits"),
        F.array(F.lit(1.0), F.lit(0.0)).alias("optional"),
    )
    read = decode.recognize(parts.withColumn("steps", steps).withColumn("contract", contract), "steps", "contract")
    said = F.when(F.col("reading.decoded.valid") | (F.col("reading.decoded.reason") == "layout-length-contract"), F.col("reading.decoded.text")).otherwise(F.lit(""))
    return read.select(
        "p_partkey", said.alias("text"), "reading.decoded.blank", "reading.decoded.valid", "reading.decoded.reason",
        F.round("reading.least", 10).alias("least"), F.round("reading.mean", 10).alias("mean"),
        F.size("reading.probabilities").alias("steps"), "reading.limit", "reading.layout_family", F.array_join("reading.blank_slots", ",").alias("blank_slots"),
    )
