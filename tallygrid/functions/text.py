"""Small text functions of reports and capture records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as scripts in browsers trim it.
WHITE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# The features that a device report tells of.
FEATURES = (
    "promise", "fetch", "fileReader", "fileInput", "canvas", "webAssembly", "mediaDevices", "getUserMedia", "localStorage", "serviceWorker", "moduleScripts",
)


def trim(value: Column) -> Column:
    # \z: the very end, as $ also stands before a last line's end
    return F.regexp_replace(value, rf"\A{WHITE}+|{WHITE}+\z", "")


def escape_html(value: Column, null_as: str = "null") -> Column:
    """Markup characters as references. ``null_as`` is what null becomes: the word, or nothing."""
    text = F.coalesce(value.cast("string"), F.lit(null_as))
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def human_bytes(size: Column) -> Column:
    """A size in B, whole KB, or MB with one decimal, halves up; nothing is 0 B."""
    mb = F.floor(size / 1048576 * 10 + 0.5) / 10
    return (
        F.when(size.isNull() | (size == 0) | F.isnan(size.cast("double")), F.lit("0 B"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1048576, F.concat(F.floor(size / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.format_string("%.1f MB", mb))
    )


def tri_state(good: Column) -> Column:
    """OK for true, No for false, Check for neither."""
    return F.when(good, F.lit("OK")).when(~good, F.lit("No")).otherwise(F.lit("Check"))


def system_version(agent: Column) -> Column:
    """The dotted system version in a tablet's user agent, or ``not detected``."""
    return F.coalesce(F.translate(F.nullif(F.regexp_extract(agent, r"OS ([0-9_]+) like Mac OS X", 1), F.lit("")), "_", "."), F.lit("not detected"))


def has_path(document: Column, path: str) -> Column:
    """Whether a JSON text has something other than null at a dotted path."""
    return F.get_json_object(document, f"$.{path}").isNotNull()


def label_of(value: Column, labels: dict[str, str]) -> Column:
    """The label of a known value; any other passes."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in labels.items() for v in pair]), value), value)


def prompt_shape(prompt: Column) -> Column:
    """A prompt with each number as N."""
    return F.regexp_replace(prompt, r"[0-9]+", "N")


def device_report(facts: dict[str, Column], features: dict[str, Column], photo: Column) -> Column:
    """struct of what a page finds out about its device, with the system version, ``features`` (FEATURES) and a photo.

    ``facts`` may lack any; texts are then empty, sizes unknown, the pixel ratio 1 and
    switches off. A feature that isn't given isn't there.
    """
    def fact(name: str, default) -> Column:
        given = facts.get(name)
        return (F.lit(default) if given is None else F.coalesce(given, F.lit(default))).alias(name)

    agent = fact("userAgent", "")
    here = [F.coalesce(features.get(c, F.lit(False)), F.lit(False)).alias(c) for c in FEATURES]
    return F.struct(
        fact("url", ""), fact("loadedAt", ""), agent, fact("platform", ""), fact("vendor", ""), system_version(agent).alias("iosVersion"),
        fact("online", False), fact("cookieEnabled", False), fact("screen", "unknown"), fact("devicePixelRatio", 1.0), fact("viewport", ""),
        F.struct(*here).alias("features"), photo.alias("photo"),
    )


def capability(features: Column) -> Column:
    """modern, fallback or bad by a struct of feature booleans."""
    modern = features["promise"] & features["fetch"] & features["wasm"] & features["modules"] & features["camera"]
    fallback = features["fileReader"] & features["fileInput"] & features["canvas"]
    return F.when(modern, F.lit("modern")).when(fallback, F.lit("fallback")).otherwise(F.lit("bad"))
