"""Documents by content, variants by element, keys read back from printed tables."""

from pyspark.sql import functions as F

from tallygrid.operators import integrity
from tallygrid.sources import keys

ELEMENT = "array<struct<id: int, v: int, deep: struct<w: double>>>"


def test_copies_collapse_whatever_their_key_order(spark):
    texts = [
        '{"a": 1, "b": {"c": [1, {"x": null, "y": "é"}], "d": true}}', '{"b":{"d":true,"c":[1,{"y":"\\u00e9","x":null}]},"a":1}', '{"a": 1, "b": {"c": [{"x": null, "y": "é"}, 1], "d": true}}',
        "not json", "not json", " not json", None, None, "{}", "[ ]", "[]", '{"k": "not json"}', '{"a": 1, "a": 2}', '{"a": 1, "a": 2}',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, doc string").withColumn("first", F.lit("clash"))
    got = sorted((r["i"], r["copies"]) for r in integrity.distinct_documents(rows, "doc", ["i"]).collect())
    assert got == [(0, 2), (2, 1), (3, 2), (5, 1), (6, 2), (8, 1), (9, 2), (11, 1), (12, 2)]
    assert integrity.distinct_documents(rows.limit(0), "doc", ["i"]).count() == 0
    made = spark.createDataFrame([('{"b": 1, "a": {"z": 0, "y": [2, 1]}}',)], "d string").select(integrity.canonical_json(F.col("d"))).first()[0]
    assert made == '{"a":{"y":[2,1],"z":0},"b":1}'


def test_elements_are_compared_by_id(spark):
    left = [("k", [(1, 5, (0.5,)), (2, 6, None), (3, 7, (1.0,)), (None, 1, None), (1, 9, None)]), ("n", None), ("only", [(1, 1, None)])]
    right = [("k", [(3, 7, (1.5,)), (2, 6, None), (4, 1, None), (1, 8, None)]), ("n", [(1, 1, None)])]
    a, b = (spark.createDataFrame(x, f"layout string, boxes {ELEMENT}") for x in (left, right))
    got = sorted(tuple(r) for r in integrity.element_differences(a, b, "layout", {"boxes": "id"}).collect())
    assert got == [("k", "boxes", "1", "both", ["v", "deep"]), ("k", "boxes", "3", "both", ["deep"]), ("k", "boxes", "4", "right", []), ("n", "boxes", "1", "right", [])]


PAGE = """<body><section class="sheet"><h2>SG-1 A &amp; B</h2><p>Grade 1</p><table><thead><tr><th>Item</th><th>Prompt</th><th>Answer</th></tr></thead><tbody>
 <tr>
  <td>A</td>
  <td>4 &lt; __,
     5</td>
  <td>9</td>
 </tr>
 <TR><td class="num">B</td><td>10 - <b>4</b></td><td>126</td></TR></tbody></table></section>
<section><h2 id="x">Empty</h2></section>
<section aria-labelledby="y"><h2 id="y">Worksheet C</h2><table><tr><td>1</td><td>8 + 7 =</td><td>15</td></tr><tr><td>2</td><td>?</td><td>1234</td></tr><tr><td>short</td></tr></table></section></body>"""


def test_printed_keys_are_read_back(spark):
    pages = spark.createDataFrame([("p", PAGE), ("none", None), ("bare", "<p>no key</p>")], "page string, html string")
    rows = keys.read_keys(pages, "html", ["page"])
    assert [tuple(r) for r in rows.orderBy("sheet", "position").collect()] == [
        ("p", 0, "SG-1 A & B", 0, "A", "4 < __, 5", 9), ("p", 0, "SG-1 A & B", 1, "B", "10 - 4", 126),
        ("p", 2, "Worksheet C", 0, "1", "8 + 7 =", 15), ("p", 2, "Worksheet C", 1, "2", "?", 1234),
    ]
    sums = {r["title"]: (r["questions"], r["checksum"]) for r in keys.rebuilt_checksums(rows, ["page"]).collect()}
    blank = F.lit(None).cast("int")
    want = spark.range(1).select(integrity.key_checksum(F.array(blank, blank, F.lit(9), F.lit(1), F.lit(2), F.lit(6)))).first()[0]
    assert sums == {"SG-1 A & B": (2, want), "Worksheet C": (2, None)}
