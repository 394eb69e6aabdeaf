"""Photo files as rows, and the requests that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.text import label_of

# Picture types by file ending.
TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic"}


def read_photos(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(photo, [content]): selected, name, type, size, preview and error of every file below ``path``.

    Without ``content`` only the files' names and sizes are read. The source lists no
    empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending.isin(*TYPES), label_of(ending, TYPES)).otherwise(F.lit(""))
    photo = F.struct(F.lit(True).alias("selected"), F.url_decode(name).alias("name"), kind.alias("type"), F.col("length").alias("size"), F.lit(True).alias("preview"), F.lit("").alias("error"))
    return files.select(photo.alias("photo"), *(["content"] if content else []))


def photo_or_default(photo: Column) -> Column:
    """A photo's metadata with every missing field filled in."""
    return F.struct(
        F.coalesce(photo["selected"], F.lit(False)).alias("selected"),
        *[F.coalesce(photo[c], F.lit("")).alias(c) for c in ("name", "type")],
        F.coalesce(photo["size"], F.lit(0)).alias("size"),
        F.coalesce(photo["preview"], F.lit(False)).alias("preview"),
        F.coalesce(photo["error"], F.lit("")).alias("error"),
    )


def request_error(request_id: Column, image: Column) -> Column:
    """What is wrong with a request for a frame: an id and a picture address are needed; null if nothing."""
    given = F.coalesce(request_id.cast("string"), F.lit(""))
    return F.when(given.isin("", "0"), F.lit("missing id")).when(F.coalesce(image, F.lit("")) == "", F.lit("missing image"))


def reply(request_id: Column, result: Column, error: Column) -> Column:
    """struct(id, result, error) with either a result or an error: one bad request never fails the others."""
    return F.struct(request_id.alias("id"), F.when(error.isNull(), result).alias("result"), error.alias("error"))
