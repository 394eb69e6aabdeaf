"""From per-step token scores to digits, slots and confidences, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = END = 2
MOST_DIGITS = 4

# The token ids of the texts "0" to "99", in order.
DIGIT_TOKENS = (
    1596, 267, 252, 271, 319, 331, 467, 531, 539, 641,
    274, 580, 496, 836, 847, 565, 811, 895, 877, 1258,
    449, 1304, 1539, 1707, 1221, 909, 1860, 1827, 1850, 2142,
    557, 2374, 3240, 3783, 3964, 2462, 3716, 4300, 4209, 4692,
    1136, 4951, 4549, 5236, 4797, 2464, 5694, 5514, 4117, 3892,
    934, 5921, 5203, 6563, 6617, 4574, 6813, 6291, 6272, 6523,
    1694, 7112, 6849, 7192, 5863, 3926, 6590, 6679, 7373, 6935,
    2260, 7880, 5949, 7424, 8689, 4075, 6240, 7850, 8137, 9017,
    2408, 8591, 7955, 9175, 8797, 6472, 9164, 8946, 8965, 10281,
    2330, 9879, 9383, 9982, 9671, 6734, 10407, 10020, 10224, 6655,
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where it is used for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def greedy_step(scores: Column) -> Column:
    """struct(token, probability) of the best score: the first of equals, NaN never.

    The probability is the softmax of the best; 0 where the sum isn't a positive
    number (NaN or infinite scores, no scores). Null scores give null.
    """
    lowest = F.lit(float("-inf"))

    def best(scores: Column) -> Column:
        """The greatest number; NaN counts as greater than any, so only arrays with one are filtered."""
        numbers = F.filter(scores, lambda x: ~F.isnan(x))
        return bound(F.array_max(scores), lambda top: F.when(F.isnan(top), F.array_max(numbers)).otherwise(top))

    def picked(scores: Column, top: Column) -> Column:
        token = F.when(top.isNull() | (top == lowest), F.lit(0)).otherwise(F.array_position(scores, top).cast("int") - 1)
        total = bound(F.coalesce(top, lowest), lambda most: F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - most)))
        probability = bound(total, lambda t: F.when(F.isnan(t) | ~(t > 0), F.lit(0.0)).otherwise(1 / t))
        return F.struct(token.alias("token"), probability.alias("probability"))

    def step(scores: Column) -> Column:
        return bound(best(scores), lambda top: picked(scores, top))

    return F.when(scores.isNotNull(), bound(scores.cast("array<double>"), step))


def digit_of(token: Column) -> Column:
    """The digits that a token id stands for; null for any other id."""
    return F.try_element_at(F.create_map(*[F.lit(v) for n, t in enumerate(DIGIT_TOKENS) for v in (t, str(n))]), token)


def digit_limit(asked: Column) -> Column:
    """A digit limit between 1 and 4; missing, zero and NaN mean 4."""
    asked = asked.cast("double")
    given = F.when(asked.isNull() | F.isnan(asked) | (asked == 0), F.lit(float(MOST_DIGITS))).otherwise(asked)
    return F.least(F.lit(float(MOST_DIGITS)), F.greatest(F.lit(1.0), given))


def decode(tokens: Column, limit: Column | None = None, end: int = END) -> Column:
    """struct(text, blank, valid, reason) of a token sequence.

    The first token and every end token are left out. Nothing left is a blank
    answer. A token without digits, or more digits than ``limit``, makes it invalid.
    """
    limit = F.lit(float(MOST_DIGITS)) if limit is None else limit
    kept = F.filter(F.coalesce(tokens, F.array().cast("array<int>")), lambda x, i: (i > 0) & F.coalesce(x != end, F.lit(True)))
    digits = F.transform(kept, digit_of)
    text = F.array_join(digits, "")

    def result(text: Column, blank: bool, valid: bool, reason: str | None) -> Column:
        return F.struct(text.alias("text"), F.lit(blank).alias("blank"), F.lit(valid).alias("valid"), F.lit(reason).cast("string").alias("reason"))

    return (
        F.when(F.size(kept) == 0, result(F.lit(""), True, True, None))
        .when(F.exists(digits, lambda x: x.isNull()), result(F.lit(""), False, False, "unknown-nonnumeric-token"))
        .when(F.length(text) > limit, result(text, False, False, "layout-length-contract"))
        .otherwise(result(text, False, True, None))
    )


def blank_slots(decoded: Column, slots: Column, optional: Column) -> Column:
    """Which optional slots an answer leaves blank.

    A blank answer leaves all; one that is ``d`` digits short of the slots leaves the
    first ``d``, if there are so many optional ones; an invalid answer says nothing.
    """
    slots = F.greatest(F.coalesce(slots.cast("int"), F.lit(0)), F.lit(0))
    numbers = F.transform(F.coalesce(optional.cast("array<double>"), F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    usable = F.filter(numbers, lambda x: (x == F.floor(x)) & (x >= 0) & (x < slots))
    usable = F.array_sort(F.array_distinct(usable.cast("array<int>")))
    short = slots - F.length(F.coalesce(decoded["text"], F.lit("")))
    none = F.array().cast("array<int>")
    return (
        F.when(~F.coalesce(decoded["valid"], F.lit(False)) | (F.size(usable) == 0), none)
        .when(decoded["blank"], usable)
        .when((short > 0) & (short <= F.size(usable)), F.slice(usable, F.lit(1), F.greatest(short, F.lit(0))))
        .otherwise(none)
    )


def confidence(probabilities: Column) -> Column:
    """struct(least, mean) of the step probabilities; 0 for none."""
    n = F.size(probabilities)
    total = F.aggregate(probabilities.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return F.struct(F.when(n > 0, F.array_min(probabilities).cast("double")).otherwise(F.lit(0.0)).alias("least"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("mean"))


def recognize(rows: DataFrame, steps: str, contract: str) -> DataFrame:
    """``rows`` with the whole reading of one answer from its per-step scores.

    Column ``steps`` is an array of score arrays (what a model would give; four are
    read at most, up to the first end token); ``contract`` has the fields
    layout_family, slots, max_digits and optional. Adds ``reading``. Stages are
    columns of their own, so that no step is computed for each of its uses.
    """
    given = F.slice(F.coalesce(F.col(steps), F.array().cast("array<array<double>>")), 1, MOST_DIGITS)
    read = rows.withColumn("_picked", F.transform(given, greedy_step))
    ended = F.array_position(F.transform("_picked", lambda p: p["token"]), END).cast("int")
    read = read.withColumn("_picked", F.when(ended > 0, F.slice("_picked", F.lit(1), F.greatest(ended, F.lit(0)))).otherwise(F.col("_picked")))
    read = read.withColumn("_tokens", F.concat(F.array(F.lit(START)), F.transform("_picked", lambda p: p["token"])))
    read = read.withColumn("_chances", F.transform("_picked", lambda p: p["probability"])).withColumn("_limit", digit_limit(F.col(contract)["max_digits"]))
    read = read.withColumn("_decoded", decode(F.col("_tokens"), F.col("_limit"))).withColumn("_sure", confidence(F.col("_chances")))
    family = F.coalesce(F.nullif(F.col(contract)["layout_family"], F.lit("")), F.lit("unknown"))
    blanks = blank_slots(F.col("_decoded"), F.col(contract)["slots"], F.col(contract)["optional"])
    reading = F.struct(
        F.col("_decoded").alias("decoded"), F.col("_tokens").alias("tokens"), F.col("_chances").alias("probabilities"), F.col("_sure.least").alias("least"),
        F.col("_sure.mean").alias("mean"), family.alias("layout_family"), F.col("_limit").alias("limit"), blanks.alias("blank_slots"),
    )
    return read.withColumn("reading", reading).drop("_picked", "_tokens", "_chances", "_limit", "_decoded", "_sure")


def affine_pixels(values: Column) -> Column:
    """Byte values 0 to 255 as -1 to 1."""
    return F.transform(values.cast("array<double>"), lambda x: x / 127.5 - 1)


def planes(rgba: Column) -> Column:
    """Interleaved RGBA bytes as the red plane, then green, then blue, alpha left out, scaled."""
    def plane(channel: int) -> Column:
        return F.filter(rgba, lambda x, i: F.pmod(i, F.lit(4)) == channel)

    return affine_pixels(F.concat(*map(plane, range(3))))


def pixels_or(given: Column, otherwise: Column, size: int = 3 * 384 * 384) -> Column:
    """Pixels that came prepared, if they are of the right number; else the other ones."""
    return F.when(F.size(given) == size, given).otherwise(otherwise)


def _shares(given: int, wanted: int) -> list[tuple[int, list[float]]]:
    """For each wanted cell of a line, the first given cell that it covers and how much of it each covered one makes up."""
    out = []
    for i in range(wanted):
        low, high = i * given / wanted, (i + 1) * given / wanted
        first = int(low)
        covered = [min(high, k + 1) - max(low, k) for k in range(first, given) if k < high]
        out.append((first, [c / (high - low) for c in covered]))
    return out


def resampled(pixels: Column, width: int, height: int, size: int) -> Column:
    """One plane of pixels, row by row, stretched or shrunk to a square of ``size``, row by row.

    The kernel is this library's choice, as pages leave it to the browser: each new pixel
    is the mean of the area it covers, first along the rows and then down. Planes of
    another number of pixels are null.
    """
    def taps(given: int) -> Column:
        pairs = [F.struct(F.lit(first).alias("first"), F.array(*map(F.lit, shares)).alias("shares")) for first, shares in _shares(given, size)]
        return F.array(*pairs)

    def mixed(values: Column, shares: Column) -> Column:
        return F.aggregate(F.zip_with(values, shares, lambda v, s: v * s), F.lit(0.0), lambda total, x: total + x)

    def across(row: Column) -> Column:
        return F.transform(taps(width), lambda t: mixed(F.slice(row, t["first"] + 1, F.size(t["shares"])), t["shares"]))

    def down(rows: Column) -> Column:
        def line(near: Column, shares: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: mixed(F.transform(near, lambda r: F.get(r, c)), shares))

        return F.flatten(F.transform(taps(height), lambda t: bound(F.slice(rows, t["first"] + 1, F.size(t["shares"])), lambda near: line(near, t["shares"]))))

    def whole(plane: Column) -> Column:
        lines = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: bound(F.slice(plane, r * width + 1, F.lit(width)), across))
        return F.when(F.size(plane) == width * height, bound(lines, down))

    return bound(pixels.cast("array<double>"), whole)


def over_white(rgba: Column, channel: int) -> Column:
    """One plane (0 red, 1 green, 2 blue) of interleaved RGBA bytes as it looks on white."""
    def plane(rgba: Column) -> Column:
        at = lambda i, c: F.get(rgba, i * 4 + c).cast("double")
        pixel = F.sequence(F.lit(0), F.floor(F.size(rgba) / 4).cast("int") - 1)
        return F.when(F.size(rgba) >= 4, F.transform(pixel, lambda i: 255 + (at(i, channel) - 255) * at(i, 3) / 255)).otherwise(F.array().cast("array<double>"))

    return bound(rgba, plane)


def prepared_picture(rgba: Column, width: int, height: int, size: int = 384) -> Column:
    """A picture as a model takes it: on a white square of ``size``, red, green and blue planes, from -1 to 1."""
    return affine_pixels(F.concat(*[resampled(over_white(rgba, c), width, height, size) for c in range(3)]))
