"""Capture records: loading, validated appending, deleting, and their cards and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions.text import escape_html, human_bytes, label_of, trim

# Worksheets by the names that captures carry.
WORKSHEETS = {
    "sheet-a-addition": "Sheet A - Addition Within 20",
    "sheet-b-subtraction": "Sheet B - Subtraction Within 20",
    "sheet-c-mixed": "Sheet C - Mixed Within 50",
}
PHOTO = "struct<selected: boolean, name: string, type: string, size: bigint, preview: boolean, error: string>"
DEVICE = "struct<userAgent: string, platform: string, online: boolean, screen: string, viewport: string, devicePixelRatio: double, localStorage: boolean, fileReader: boolean, canvas: boolean>"
RECORD = f"struct<id: string, savedAt: string, studentName: string, worksheet: string, worksheetLabel: string, photo: {PHOTO}, device: {DEVICE}>"


def iso(at: Column) -> Column:
    """An instant as text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def load(stored: Column) -> Column:
    """The records in a stored JSON array; missing or malformed text has none."""
    return F.coalesce(F.from_json(stored, f"array<{RECORD}>", {"mode": "PERMISSIVE"}), F.array().cast(f"array<{RECORD}>"))


def rejection(name: Column, photo_selected: Column) -> Column:
    """Why a capture can't be saved: no name first, then no photo; null if it can."""
    return F.when(F.coalesce(trim(name), F.lit("")) == "", F.lit("name")).when(~F.coalesce(photo_selected, F.lit(False)), F.lit("photo"))


def append(records: DataFrame, captures: DataFrame) -> DataFrame:
    """The records with all acceptable captures (name, worksheet, photo, device, at) added.

    Captures may have ``device_id``, the device whose store they go to; records keep it.
    """
    good = captures.filter(rejection(F.col("name"), F.col("photo.selected")).isNull())
    added = good.select(
        F.concat(F.lit("legacy-"), F.unix_millis(F.col("at").cast("timestamp")).cast("string")).alias("id"),
        iso(F.col("at").cast("timestamp")).alias("savedAt"),
        trim(F.col("name")).alias("studentName"),
        "worksheet",
        label_of(F.col("worksheet"), WORKSHEETS).alias("worksheetLabel"),
        "photo",
        "device",
        *(["device_id"] if "device_id" in captures.columns else []),
    )
    return records.unionByName(added, allowMissingColumns=True)


def without_position(records: DataFrame, group: list[str], order: list[str], position: int) -> DataFrame:
    """Every group's records but the one at ``position``, counted from 0 in order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return records.withColumn("_place", place).filter(F.col("_place") != position + 1).drop("_place")


def cleared(records: DataFrame) -> DataFrame:
    return records.limit(0)


#: What a store's user can do.
APPEND, DELETE, CLEAR = "append", "delete", "clear"


def replayed(actions: DataFrame, device: str = "device_id", order: str = "seq") -> DataFrame:
    """(device, place, seq): which appends each device's store still has after all actions, and where, from 0.

    ``actions`` have ``kind`` (append, delete or clear), ``position`` (what a delete takes
    out of the list as it then stands) and an ``order`` that is unique for the device.
    A position that the list doesn't have, or a null one, takes nothing out; other kinds
    do nothing. What came before a device's last clear is left out before anything is
    gathered, and of the rest only numbers are: join the appended records by ``seq``.
    A group is what one device's user did since; actions without device or order are left out.
    """
    named = actions.filter(F.col(device).isNotNull() & F.col(order).isNotNull())
    given = named.select(F.col(device).alias("_device"), F.col(order).alias("_seq"), "kind", F.col("position").cast("int").alias("position"))
    cleared = given.filter(F.col("kind") == CLEAR).groupBy("_device").agg(F.max("_seq").alias("_clear"))
    since = given.filter(F.col("kind").isin(APPEND, DELETE)).join(cleared, "_device", "left").filter(F.col("_clear").isNull() | (F.col("_seq") > F.col("_clear")))
    done = since.groupBy("_device").agg(F.array_sort(F.collect_list(F.struct("_seq", "kind", "position"))).alias("done"))
    kind = actions.schema[order].dataType.simpleString()

    def step(kept: Column, action: Column) -> Column:
        at = action["position"]
        there = (action["kind"] == DELETE) & (at >= 0) & (at < F.size(kept))
        less = F.concat(F.slice(kept, F.lit(1), at), F.slice(kept, at + 2, F.size(kept)))
        return F.when(action["kind"] == APPEND, F.array_append(kept, action["_seq"])).when(there, less).otherwise(kept)

    left = done.select("_device", F.aggregate("done", F.array().cast(f"array<{kind}>"), step).alias("left"))
    return left.select(F.col("_device").alias(device), F.posexplode("left").alias("place", order))


NO_RECORDS = "No saved records yet."


def cards(records: DataFrame, group: list[str], order: list[str] | None = None) -> DataFrame:
    """(group, place, name, worksheet, photo, saved): what each record's card shows, escaped, with defaults.

    ``group`` is whose store it is: a device shows its own records. ``place`` counts from
    0 in ``order`` (by time of saving, then id), which is that of appending; it is what a
    record is deleted by.
    """
    def shown(value: Column, default: str = "") -> Column:
        return escape_html(F.coalesce(F.nullif(value, F.lit("")), F.lit(default)))

    photo = F.concat(shown(F.col("photo.name"), "selected image"), F.lit(" ("), human_bytes(F.col("photo.size")), F.lit(")"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*(order or ["savedAt", "id"]))) - 1
    return records.select(
        *group, place.alias("place"), shown(F.col("studentName"), "Unnamed student").alias("name"), shown(F.col("worksheetLabel")).alias("worksheet"),
        photo.alias("photo"), shown(F.col("savedAt")).alias("saved"),
    )


def headline(records: DataFrame) -> DataFrame:
    """(message): one row that says so if there is no record, else null."""
    return records.agg(F.when(F.count(F.lit(1)) == 0, F.lit(NO_RECORDS)).alias("message"))


def report(records: DataFrame, group: list[str], page: Column, device: Column | None = None, photo: Column | None = None, at: Column | None = None) -> DataFrame:
    """One JSON text for each group: when, the page, the device, the current photo, and the group's records in order.

    A group is what one device has stored, so its records fit in one text.
    """
    own = [c for c in records.columns if c not in group]
    listed = F.sort_array(F.collect_list(F.struct(*[c for c in ("savedAt", "id") if c in own], *[c for c in own if c not in ("savedAt", "id")])))
    body = F.struct(
        iso(F.current_timestamp() if at is None else at).alias("generatedAt"), page.alias("page"),
        (F.lit(None).cast(DEVICE) if device is None else device).alias("device"),
        (F.lit(None).cast(PHOTO) if photo is None else photo).alias("currentPhoto"), listed.alias("records"),
    )
    return records.groupBy(*group).agg(F.to_json(body, {"pretty": "true"}).alias("report"))
