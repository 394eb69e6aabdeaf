"""The registered queries and their SQL.

Each applies an operator to a whole table. The columns stand in for the operator's
own data (a price list's sizes for answers, embeddings for token scores): they
exercise it, and give the tables no new meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.functions import text
from tallygrid.operators import answers, decode, geometry, integrity, records


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


PROBABILITY = "1 / list_sum(list_transform(embedding::double[], lambda x: exp(x - list_max(embedding)::double)))"


@query(f"select vec_id, list_position(embedding, list_max(embedding))::int - 1 as token, round({PROBABILITY}, 10) as probability from embeddings")
def greedy_argmax(spark, sf_dir):
    step = _read(spark, sf_dir, "embeddings").select("vec_id", decode.greedy_step(F.col("embedding")).alias("s"))
    return step.select("vec_id", "s.token", F.round("s.probability", 10).alias("probability"))


@query("select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: round(x / 127.5 - 1, 9))), 6) as total, round(list_max(embedding)::double / 127.5 - 1, 9) as most from embeddings")
def affine_pixels(spark, sf_dir):
    scaled = _read(spark, sf_dir, "embeddings").select("vec_id", decode.affine_pixels(F.col("embedding")).alias("v"))
    total = F.aggregate(F.transform("v", lambda x: F.round(x, 9)), F.lit(0.0), lambda s, x: s + x)
    return scaled.select("vec_id", F.round(total, 6).alias("total"), F.round(F.array_max("v"), 9).alias("most"))


_TOKENS = ", ".join(f"({n}, {t})" for n, t in enumerate(decode.DIGIT_TOKENS))


@query(f"""
with ids(n, token) as (values {_TOKENS}),
p as (select p_partkey, p_size, p_partkey % 5 as kind from part),
d as (select p_partkey, case kind when 0 then p_size::varchar when 1 then p_size::varchar || (p_size + 37)::varchar when 2 then p_size::varchar || p_size::varchar || '5' when 3 then '' else '' end as digits, kind from p)
select p_partkey, case when kind = 4 then '' else digits end as text, kind = 3 as blank, kind <> 4 and len(digits) <= 4 as valid,
       case when kind = 4 then 'unknown-nonnumeric-token' when len(digits) > 4 then 'layout-length-contract' end as reason
from d""")
def digit_decode(spark, sf_dir):
    """Sequences of tokens for a part's size: alone, with another number, three at a time, none, and an unknown one."""
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("kind"))
    ids = F.array(*map(F.lit, decode.DIGIT_TOKENS))
    one, other, end = F.get(ids, F.col("p_size")), F.get(ids, F.col("p_size") + 37), F.lit(decode.END)
    tokens = F.when(F.col("kind") == 0, F.array(end, one, end)).when(F.col("kind") == 1, F.array(end, one, end, other)).when(F.col("kind") == 2, F.array(end, one, one, F.lit(decode.DIGIT_TOKENS[5]))).when(F.col("kind") == 3, F.array(end, end)).otherwise(F.array(end, one, F.lit(7)))
    return parts.select("p_partkey", decode.decode(tokens, decode.digit_limit(F.lit(0))).alias("d")).select("p_partkey", "d.*")


@query("""
with p as (select p_partkey, p_size::varchar as t, p_partkey % 7 = 0 as blank from part)
select p_partkey, case when blank then '0,1' when len(t) = 2 then '0' when len(t) = 1 then '0,1' else '' end as left_blank from p""")
def optional_slots(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").withColumn("blank", F.col("p_partkey") % 7 == 0)
    read = F.struct(F.when(F.col("blank"), F.lit("")).otherwise(F.col("p_size").cast("string")).alias("text"), F.col("blank").alias("blank"), F.lit(True).alias("valid"))
    slots = decode.blank_slots(read, F.lit(3), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, -1.0, 7.0, 0.5)]))
    return parts.select("p_partkey", F.array_join(slots.cast("array<string>"), ",").alias("left_blank"))


@query("""
with p as (select p_partkey, p_size::varchar as a, n from part, (values (2), (3)) s(n))
select p_partkey, n as slots, 0 as position, lpad(a, n, '_') as label from p
union all select p_partkey, n, 1, lpad(a, n, '0') from p where len(a) < n
union all select p_partkey, n, 2, rpad(a, n, '_') from p where len(a) < n""")
def accepted_responses(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(2), F.lit(3))).alias("slots"))
    return answers.responses(parts, "p_size", "slots").select("p_partkey", "slots", "position", "label")


@query("""
select l_orderkey, l_linenumber, l_partkey, rpad(l_quantity::int::varchar, 2, '_') as response,
       l_quantity::int = p_size and len(p_size::varchar) <= 2 as correct
from lineitem join part on l_partkey = p_partkey""")
def grade_responses(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.rpad(F.col("l_quantity").cast("int").cast("string"), 2, "_").alias("response"))
    keys = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    graded = lines.join(keys, F.col("l_partkey") == F.col("p_partkey"))
    return graded.select("l_orderkey", "l_linenumber", "l_partkey", "response", answers.is_right(answers.digits_of(F.col("response")), F.col("p_size"), F.lit(2)).alias("correct"))


@query("select l_orderkey, left(sha256(string_agg(l_quantity::int::varchar, ',' order by l_linenumber, l_partkey, l_quantity)), 12) as checksum from lineitem group by l_orderkey")
def group_checksum(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    return lines.select("l_orderkey", integrity.key_checksum(F.transform("x", lambda v: v["l_quantity"].cast("int"))).alias("checksum"))


@query("""
select s_suppkey, 'https://example.org/draft/?sg=' || url_encode('SG1:' || s_name || ':1:' || left(sha256(s_suppkey::varchar), 12)) as url,
       s_name as template, 1 as version, left(sha256(s_suppkey::varchar), 12) as checksum from supplier""")
def payload_codec(spark, sf_dir):
    checksum = integrity.key_checksum(F.array(F.col("s_suppkey")))
    urls = _read(spark, sf_dir, "supplier").select("s_suppkey", integrity.payload_url(F.lit("https://example.org/draft/"), integrity.payload(F.col("s_name"), F.lit(1), checksum)).alias("url"))
    return urls.select("s_suppkey", "url", integrity.read_payload(F.col("url")).alias("p")).select("s_suppkey", "url", "p.template", "p.version", "p.checksum")


_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"select page_id, sha256({_ESCAPED.format('html')}) as escaped, {_ESCAPED.format("coalesce(case when page_id % 2 = 0 then url end, 'null')")} as a, {_ESCAPED.format("coalesce(case when page_id % 2 = 0 then url end, '')")} as b from pages")
def escape_html(spark, sf_dir):
    half = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("escaped"), text.escape_html(half).alias("a"), text.escape_html(half, "").alias("b"))


@query("""
select doc_id, case when v = 0 then '0 B' when v < 1024 then v::varchar || ' B' when v < 1048576 then floor(v / 1024 + 0.5)::bigint::varchar || ' KB'
       else printf('%.1f MB', floor(v / 1048576 * 10 + 0.5) / 10) end as size
from (select doc_id, case doc_id % 3 when 0 then 0 when 1 then n_chars else n_chars * 1024 end as v from documents)""")
def humanize_bytes(spark, sf_dir):
    value = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).when(F.col("doc_id") % 3 == 1, F.col("n_chars")).otherwise(F.col("n_chars") * 1024)
    return _read(spark, sf_dir, "documents").select("doc_id", text.human_bytes(value).alias("size"))


_WHITE = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@query(f"""
select conv_id, turn, role, t as name, case when t = '' then 'name' when turn % 3 = 0 then 'photo' end as rejected
from (select *, regexp_replace(case when turn % 4 = 1 then ' ' || chr(160) else chr(160) || ' ' || text || chr(12288) end, '^{_WHITE}+|{_WHITE}+$', '', 'g') as t from conversations)""")
def trim_and_validate(spark, sf_dir):
    raw = F.when(F.col("turn") % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit("  "), "text", F.lit("　")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.trim(raw).alias("name"), records.rejection(raw, F.col("turn") % 3 != 0).alias("rejected"))


@query("""
select conv_id, turn, role, case when turn % 2 = 0 then replace((conv_id % 17 + 1)::varchar || '_' || turn::varchar, '_', '.') else 'not detected' end as version from conversations""")
def regex_version(spark, sf_dir):
    agent = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Mozilla/5.0 (iPad; CPU OS "), (F.col("conv_id") % 17 + 1).cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(" like Mac OS X) "), "text")).otherwise(F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.system_version(agent).alias("version"))


@query("""select event_id, json_extract_string(props, '$.k') is not null as has_k, json_extract_string(props, '$.k.x') is not null as has_kx, json_extract_string(props, '$.none') is not null as has_none from events""")
def json_path_probe(spark, sf_dir):
    props = F.col("props")
    return _read(spark, sf_dir, "events").select("event_id", text.has_path(props, "k").alias("has_k"), text.has_path(props, "k.x").alias("has_kx"), text.has_path(props, "none").alias("has_none"))


@query("""
select d.doc_id, case when toxic = 0 then 'OK' when toxic = 1 then 'No' else 'Check' end as state,
       case when n_chars > 100 and quality = 1 and toxic = 0 and lang is not null and source is not null then 'modern'
            when n_chars > 10 and lang is not null and source is not null then 'fallback' else 'bad' end as path
from documents d left join labels l on d.doc_id = l.doc_id""")
def states_and_paths(spark, sf_dir):
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    rows = docs.select("doc_id", "n_chars", "lang", "source").join(labels, F.col("doc_id") == F.col("l_id"), "left")
    flags = {"promise": F.col("n_chars") > 100, "fetch": F.col("quality") == 1, "wasm": F.col("toxic") == 0, "modules": F.col("lang").isNotNull(), "camera": F.col("source").isNotNull()}
    flags |= {"fileReader": F.col("n_chars") > 10, "fileInput": F.col("lang").isNotNull(), "canvas": F.col("source").isNotNull()}
    return rows.select("doc_id", text.tri_state(F.col("toxic") == 0).alias("state"), text.capability(flags).alias("path"))


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'Sheet 1' when '2-HIGH' then 'Sheet 2' else o_orderpriority end as label from orders")
def enum_label(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.label_of(F.col("o_orderpriority"), {"1-URGENT": "Sheet 1", "2-HIGH": "Sheet 2"}).alias("label"))


@query("select o_orderkey, l_linenumber, l_partkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def nested_explode(spark, sf_dir):
    """Orders as documents of lines, flattened again."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    documents = _read(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return documents.select("o_orderkey", F.inline("lines"))


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def missing_reference(spark, sf_dir):
    """Documents without a label."""
    return integrity.without(_read(spark, sf_dir, "documents"), "doc_id", _read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("select c_custkey as template_id, c_name as title, c_mktsegment as family, null::double as balance from customer union all select s_suppkey, s_name, null, s_acctbal from supplier")
def catalog_union(spark, sf_dir):
    a = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("template_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("family"))
    b = _read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("template_id"), F.col("s_name").alias("title"))
    return integrity.catalog([a, b])


@query("select distinct sha256(text) as content from documents")
def dedup_copies(spark, sf_dir):
    return integrity.one_copy(_read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content")), ["content"])


@query("""
with o as (select l_orderkey, count(*) as lines from lineitem group by l_orderkey),
c as (select o_custkey, count(*) as orders, min(lines) as lo, max(lines) as hi from orders join o on o_orderkey = l_orderkey group by o_custkey)
select o_custkey, orders, case when lo = hi then lo::varchar else 'variable' end as slots from c""")
def slot_counts(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    sheets = _read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.collect_list("lines").alias("lines"))
    return sheets.select("o_custkey", F.size("lines").cast("long").alias("orders"), answers.slots_of(F.col("lines")).alias("slots"))


@query("select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k <> 3")
def positional_delete(spark, sf_dir):
    return records.without_position(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 2)


@query("""
select p_partkey, p_size / 50.0::double - 0.05::double >= 0.1::double - 0.002::double and p_size / 50.0::double <= 0.1::double + 0.6::double + 0.002::double
       and p_retailprice / 2000 - 0.05::double >= 0.2::double - 0.002::double and p_retailprice / 2000 <= 0.2::double + 0.5::double + 0.002::double as inside from part""")
def box_containment(spark, sf_dir):
    box = {"x": F.col("p_size") / 50.0, "y": F.col("p_retailprice") / 2000, "width": F.lit(0.05), "height": F.lit(0.05)}
    region = {"x": F.lit(0.1), "y": F.lit(0.2), "width": F.lit(0.6), "height": F.lit(0.5)}
    return _read(spark, sf_dir, "part").select("p_partkey", geometry.box_in_region(box, region).alias("inside"))


@query("""
select l_orderkey, k, round(guide_x, 6) as guide_x, round(y - h, 6) as y1, y as y2 from (
  select *, (x + lead(x - w) over (partition by l_orderkey order by k)) / 2 as guide_x from (
    select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as k, l_quantity as x, l_discount as w, l_tax as h, l_extendedprice as y from lineitem))
where guide_x is not null""")
def guide_midpoint(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).cast("long")
    boxes = _read(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("width"), F.col("l_tax").alias("height"), F.col("l_extendedprice").alias("y"))
    return geometry.guide_lines(boxes, ["l_orderkey"], ["k"]).select("l_orderkey", "k", F.round("guide_x", 6).alias("guide_x"), F.round("y1", 6).alias("y1"), "y2")


@query("select sha256(regexp_replace(text, '[0-9]+', 'N', 'g')) as shape, count(*) as many from documents group by 1")
def prompt_shape(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy(F.sha2(text.prompt_shape(F.col("text")), 256).alias("shape")).agg(F.count(F.lit(1)).alias("many"))


@query("""
select l_orderkey, l_linenumber, l_partkey, case n - 1 - i when 0 then 'ones' when 1 then 'tens' when 2 then 'hundreds' end as place
from (select *, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as i from lineitem)""")
def digit_places(spark, sf_dir):
    own = Window.partitionBy("l_orderkey")
    place = F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.count(F.lit(1)).over(own).cast("int").alias("n"), place.alias("i"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", answers.place_names(F.col("n"), F.col("i")).alias("place"))


@query(f"""
with e as (select vec_id, label, embedding, list_position(embedding, list_max(embedding))::int - 1 as token, {PROBABILITY} as p from embeddings)
select vec_id, round(p, 10) as least, label = 3 as two_slots, case when token = 2 then '' else 'unknown-nonnumeric-token' end as reason, token = 2 as blank from e""")
def recognition(spark, sf_dir):
    """One scoring step a row, read as an answer under a contract."""
    contract = F.struct(F.lit("").alias("layout_family"), F.when(F.col("label") == 3, F.lit(2)).otherwise(F.lit(3)).alias("slots"), F.lit(2.0).alias("max_digits"), F.array(F.lit(0.0)).alias("optional"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(F.col("embedding").cast("array<double>")).alias("steps"), contract.alias("contract"))
    read = decode.recognize(rows, "steps", "contract")
    return read.select("vec_id", F.round("reading.least", 10).alias("least"), (F.col("label") == 3).alias("two_slots"), F.coalesce("reading.decoded.reason", F.lit("")).alias("reason"), "reading.decoded.blank")


@query("""
select p_partkey, case when p_partkey % 2 = 1 then 'p_size' else '' end || case when p_partkey % 3 = 0 then case when p_partkey % 2 = 1 then ',p_type' else 'p_type' end else '' end as fields from part""")
def variant_fields(spark, sf_dir):
    """Two variants of one catalog, compared column by column."""
    a = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    b = a.withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 2).cast("int")).withColumn("p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")))
    return integrity.differing_fields(a, b, "p_partkey").select("p_partkey", F.array_join("fields", ",").alias("fields"))


from tallygrid.plans import documents, pages, sheets, stores  # noqa: E402, F401 (register their queries here)
