"""Answer-key checksums, sheet payloads and catalog audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD_KIND = "SG1"
CHECKSUM_DIGITS = 12


def key_checksum(key: Column) -> Column:
    """Of an array of nullable digits: the first 12 hex digits of the sha256 of the comma-joined key, ``_`` for null."""
    text = F.array_join(F.transform(key, lambda x: F.coalesce(x.cast("string"), F.lit("_"))), ",")
    return F.substring(F.sha2(text, 256), 1, CHECKSUM_DIGITS)


def payload(template: Column, version: Column, checksum: Column) -> Column:
    return F.concat_ws(":", F.lit(PAYLOAD_KIND), template, version.cast("string"), checksum)


def payload_struct(template: Column, version: Column, layout: Column, checksum: Column, instance: Column | None = None) -> Column:
    """The payload as a registry lists it; the sheet instance is the template's classroom set unless given."""
    sheet = F.concat(template, F.lit("-classroom-set")) if instance is None else instance
    return F.struct(
        F.lit(1).alias("schema_version"), template.alias("template_id"), version.cast("int").alias("template_version"),
        sheet.alias("sheet_instance_id"), layout.alias("layout_id"), checksum.alias("answer_key_checksum"),
    )


# What form encoding escapes and an address component doesn't, and the space.
COMPONENT = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def payload_url(base: Column, text: Column) -> Column:
    encoded = F.url_encode(text)
    for form, component in COMPONENT:
        encoded = F.replace(encoded, F.lit(form), F.lit(component))
    return F.concat(base, F.lit("?sg="), encoded)


def read_payload(url: Column) -> Column:
    """struct(kind, template, version, checksum) of a payload URL; nulls where it isn't one."""
    # in a component a plus is itself
    text = F.try_url_decode(F.replace(F.regexp_extract(url, r"[?&]sg=([^&#]*)", 1), F.lit("+"), F.lit("%2B")))
    parts = F.split(text, ":")
    good = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == PAYLOAD_KIND)
    names = ("kind", "template", "version", "checksum")
    fields = [F.when(good, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]
    fields[2] = F.when(good, F.get(parts, F.lit(2)).try_cast("int")).alias("version")
    return F.struct(*fields)


def catalog(parts: list[DataFrame]) -> DataFrame:
    """All catalogs as one, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def without(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """The rows whose key the others lack: missing assets, or unlisted ones."""
    return rows.join(others.select(F.col(other_key).alias("_other")).distinct(), F.col(key) == F.col("_other"), "left_anti")


def one_copy(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.dropDuplicates(key)


def differing_fields(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, fields): which columns differ between the rows of one key; the A/B comparison."""
    names = [c for c in left.columns if c != key and c in right.columns]
    pair = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"))
    differs = [F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in names]
    return pair.select(F.col(f"l.{key}").alias(key), F.array_compact(F.array(*differs)).alias("fields"))


def element_differences(left: DataFrame, right: DataFrame, key: str, parts: dict[str, str]) -> DataFrame:
    """(key, part, id, side, fields): the elements of nested arrays that differ between the rows of one key.

    ``parts`` names the arrays of structs to compare, each with the field that tells its
    elements apart. Elements are aligned by it, in whatever order they stand. side is both
    where an element has other ``fields`` (by name, in the left one's order), left or right
    where only that row has it; equal elements give no row. A null array is empty,
    elements without id are left out, and of several with one id the first counts. Keys
    that only one side has are ``without``'s business.
    """
    kinds = {c: (left.schema[c].dataType.elementType.names, right.schema[c].dataType.elementType.names) for c in parts}
    pair = left.select(F.col(key), *[F.col(c).alias(f"l_{c}") for c in parts]).join(right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"r_{c}") for c in parts]), F.col(key) == F.col("_key"))
    def by_id(array: Column, own: str) -> Column:
        ids = F.transform(array, lambda e: e[own])
        firsts = F.filter(array, lambda e, i: F.array_position(ids, e[own]) == i + 1)
        return F.map_from_entries(F.transform(firsts, lambda e: F.struct(e[own], e)))

    def given(array: str, own: str) -> Column:
        none = F.array().cast(pair.schema[array].dataType)
        return F.filter(F.coalesce(F.col(array), none), lambda e: e[own].isNotNull())

    for c, own in parts.items():
        for name in (f"l_{c}", f"r_{c}"):
            pair = pair.withColumn(name, by_id(given(name, own), own))

    def compared(c: str) -> Column:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        names = [n for n in kinds[c][0] if n in kinds[c][1]]

        def row(i: Column) -> Column:
            x, y = F.try_element_at(a, i), F.try_element_at(b, i)
            differs = F.array_compact(F.array(*[F.when(~x[n].eqNullSafe(y[n]), F.lit(n)) for n in names]))
            side = F.when(y.isNull(), F.lit("left")).when(x.isNull(), F.lit("right")).otherwise(F.lit("both"))
            fields = F.when(side == "both", differs).otherwise(F.array().cast("array<string>"))
            return F.struct(F.lit(c).alias("part"), i.cast("string").alias("id"), side.alias("side"), fields.alias("fields"))

        return F.transform(F.array_union(F.map_keys(a), F.map_keys(b)), row)

    found = pair.select(F.col(key), F.inline(F.concat(*map(compared, parts))))
    return found.filter((F.col("side") != "both") | (F.size("fields") > 0))


def canonical_json(document: Column) -> Column:
    """A JSON text with the keys of all objects in one order and no white space; null for null and what isn't JSON.

    So texts of one document are equal, however they were written. Arrays keep their order,
    numbers their value; an object with a key twice isn't one document, so it gives null.
    """
    return F.to_json(F.try_parse_json(document))


def document_hash(document: Column) -> Column:
    """The sha256 of the canonical document; of the text itself, marked, where it isn't JSON; null for null."""
    canonical = canonical_json(document)
    return F.sha2(F.coalesce(canonical, F.concat(F.lit("\u0000"), document)), 256)


def distinct_documents(rows: DataFrame, document: str, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each document, with ``content`` (its hash) and ``copies`` (how many rows have it).

    Rows without a document are copies of each other. Copies are merged before the
    shuffle, so a document in very many of them is no burden.
    """
    hashed = rows.withColumn("content", document_hash(F.col(document)))
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("first")
    return hashed.groupBy("content").agg(first, F.count(F.lit(1)).alias("copies")).select("first.*", "content", "copies")
