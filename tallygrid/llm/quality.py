"""Quality classifier: Bradley-Terry ranking of documents by pairwise preferences.

Features describe the form of a text (symbols, case, lines, repetition, lengths).
A labelled good document is preferred to a bad one; the weights minimise the
logistic loss on feature differences of all such pairs, so they learn an order, not
a label. The threshold is the quantile of the labelled scores at the share of bad
ones, and a logistic slope around it turns scores into probabilities.

All labelled rows that may be learnt from count in all three. Features are computed
where the rows are. The loss of all pairs needs no pairs: rows meet by bins of their
scores, ``WIDTH`` wide, and a bin's rows count at their mean score. Each Newton step is
one pass over the features, whose tasks give sums by bin; the threshold is exact, from
counts in narrowing ranges. The driver gets bins, never rows.

Defined results: null and empty texts have zero features and a score; each row
gives one row, repeated rows equal ones; rows without label, or with a null id,
are not learnt from; with no pair to learn from every score is the share of good
labels (1 without labels); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import remainder, settle
from tallygrid.llm.words import filled, per_text, raw_bytes, slices, split_words, text_of

FEATURES = (
    "log_words", "word_chars", "long_words", "distinct", "short_words", "upper", "digit", "symbol", "bang", "pipe", "stop", "other_punct",
    "non_ascii", "symbol_words", "lines_per_word", "dup_lines", "bare_lines", "same_pairs",
)


def _share(data: np.ndarray, chars: bytes, at: np.ndarray) -> np.ndarray:
    listed = np.zeros(256, bool)
    listed[list(chars)] = True
    return per_text(listed[data], at)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, at = raw_bytes(texts)
    size = np.maximum(np.diff(at), 1)
    ids, ends, distinct = split_words(texts)
    own = text_of(ends)
    n = np.maximum(np.diff(ends), 1)
    lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[ids]
    marked = pc.match_substring_regex(distinct, r"[#$%&*|<>!]").to_numpy(zero_copy_only=False)[ids]
    pairs = own * (len(distinct) + 1) + ids

    def new(keys: np.ndarray) -> np.ndarray:
        """Distinct keys by text; a key has its text in ``own``'s order."""
        _, first = np.unique(keys, return_index=True)
        return np.bincount(own[first], minlength=len(texts))

    seen = new(pairs) if len(ids) else np.zeros(len(texts))
    if len(ids) > 1:
        two = np.flatnonzero(own[1:] == own[:-1])
        keys = pairs[two] * np.int64(len(distinct) + 1) + ids[two + 1]
        _, first = np.unique(keys, return_index=True)
        twos = np.bincount(own[two], minlength=len(texts)) - np.bincount(own[two][first], minlength=len(texts))
    else:
        twos = np.zeros(len(texts))
    lines = [[x for x in t.as_buffer().to_pybytes().split(b"\n") if x and not x.isspace()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    dup = np.array([len(x) - len(set(x)) for x in lines])
    bare = np.array([sum(x.rstrip()[-1:] not in (b".", b"!", b"?") for x in ls) for ls in lines])
    some = np.maximum(n_lines, 1)
    columns = [
        np.log1p(np.diff(ends)),
        per_text(lengths, ends) / n / 10,
        per_text(lengths > 20, ends) / n,
        seen / n,
        per_text(lengths < 4, ends) / n,
        _share(data, bytes(range(65, 91)), at) / size,
        _share(data, b"0123456789", at) / size,
        _share(data, b"#$%&*<>", at) / size,
        _share(data, b"!", at) / size,
        _share(data, b"|", at) / size,
        _share(data, b".", at) / n,
        _share(data, b",;:?'\"()-_/\\@", at) / size,
        per_text(data > 127, at) / size,
        per_text(marked, ends) / n,
        n_lines / n,
        dup / some,
        bare / some,
        twos / n,
    ]
    return np.column_stack(columns).astype(np.float64) if len(texts) else np.zeros((0, len(FEATURES)))


class Ranker:
    """Weights, threshold and slope of the fitted order."""

    def __init__(self, mean, scale, weights, threshold, slope):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.threshold), -500, 500)))


#: Bins of scores in the loss, and how many of them to each side of zero.
WIDTH, MOST_BINS = 0.125, 800
#: The weight of the squared weights in the loss.
DECAY = 1e-3
#: Bins of a narrowing range, distinct scores that are listed, and bins by unit of the slope's loss.
PARTS, LISTED, SLOPE_BINS = 1024, 10_000, 1024


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums): by bin of the score and label, the rows' number and sums of features and of their products."""
    keys = (np.clip(np.floor(z @ w / WIDTH), -MOST_BINS, MOST_BINS).astype(np.int64) + MOST_BINS) * 2 + y
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    i, j = np.triu_indices(z.shape[1])
    z = z[order]
    return found, np.add.reduceat(np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]]), first) if len(z) else np.zeros((0, 1 + z.shape[1] + len(i)))


def merged(keys: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of several tasks by key."""
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(found), parts.shape[1]))
    np.add.at(out, at, parts)
    return found, out


def pairwise(keys: np.ndarray, by_bin: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean logistic loss of all pairs of a good and a bad row, with its gradient and second derivatives."""
    d = len(w)
    i, j = np.triu_indices(d)

    def side(label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = by_bin[keys % 2 == label]
        return mine[:, 0], mine[:, 1 : 1 + d], mine[:, 1 + d :]

    def squares(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((d, d))
        out[i, j] = out[j, i] = rows
        return out

    (n1, x1, xx1), (n0, x0, xx0) = side(1), side(0)
    apart = np.clip((x1 @ w / n1)[:, None] - (x0 @ w / n0)[None], -500, 500)
    wrong, pairs = 1 / (1 + np.exp(apart)), n1.sum() * n0.sum()
    curve = wrong * (1 - wrong)
    loss = n1 @ np.logaddexp(0, -apart) @ n0 / pairs + DECAY / 2 * w @ w
    slope = ((n1 @ wrong) @ x0 - (wrong @ n0) @ x1) / pairs + DECAY * w
    cross = x1.T @ curve @ x0
    bend = (squares((curve @ n0) @ xx1 + (n1 @ curve) @ xx0) - cross - cross.T) / pairs + DECAY * np.eye(d)
    return float(loss), slope, bend


def weights(totals: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, rounds: int = 40) -> np.ndarray:
    """The weights of least loss by Newton's steps, halved where they overshoot; ``totals`` gives all rows' sums under given weights."""
    w, best, least = np.zeros(d), np.zeros(d), np.inf
    for _ in range(rounds):
        loss, slope, bend = pairwise(*totals(w), w)
        if loss > least + 1e-4:
            w = (w + best) / 2
            continue
        step = np.linalg.solve(bend, slope)
        best, least = w, loss
        if slope @ step < 1e-7:
            break
        w = w - step
    return best


def place(good: np.ndarray, bad: np.ndarray, each: tuple[float, float], below: float, least: float) -> tuple[int, float, bool]:
    """Where in ascending groups of rows their weight, on ``below``, reaches ``least``: the group, the weight before it, and whether its last row is the one."""
    upto = below + np.cumsum(good) * each[1] + np.cumsum(bad) * each[0]
    at = min(int(np.searchsorted(upto, least)), len(upto) - 1)
    last = each[1] if good[at] else each[0]
    return at, float(upto[at - 1]) if at else below, bool(good[at] + bad[at] == 1 or upto[at] - last < least)


def steepness(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, each: tuple[float, float], threshold: float) -> float:
    """The slope alone, by the weighted logistic loss of groups of rows."""
    slope, away, right, weight = 1.0, scores - threshold, good * each[1], good * each[1] + bad * each[0]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * away, -50, 50)))
        step = np.sum((right - weight * p) * away) - 0.01 * slope
        curve = np.sum(weight * p * (1 - p) * away**2) + 0.01
        slope = max(slope + np.clip(step / curve, -1, 1), 1e-3)
    return float(slope)


def fit(x: np.ndarray, y: np.ndarray, share_good: float) -> Ranker | float:
    """The ranker of rows at hand, or a constant score where one label is missing."""
    n_good, n_bad = int((y == 1).sum()), int((y == 0).sum())
    if not n_good or not n_bad:
        return share_good
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = standard(x, mean, scale)
    w = weights(lambda w: sums(z, y, w), x.shape[1])
    # weighed to the labels' shares, should the rows have others
    each = (1 - share_good) / n_bad, share_good / n_good
    found, at = np.unique(z @ w, return_inverse=True)
    good = np.bincount(at, y == 1)
    bad = np.bincount(at) - good
    k, _, ends = place(good, bad, each, 0.0, (1 - share_good) * (1 - 1e-9))
    threshold = float((found[k] + found[min(k + ends, len(found) - 1)]) / 2)
    return Ranker(mean, scale, w, threshold, steepness(found, good, bad, each, threshold))


def fit_rows(rows: DataFrame, share_good: float) -> Ranker | float:
    """``fit`` of all rows of (label, x), which should be settled; the driver gets sums and counts by bin."""
    columns = [F.get("x", F.lit(k)) for k in range(len(FEATURES))]
    held = rows.agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1)), *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    n_good, n_bad = held[0], held[1]
    if not n_good or not n_bad:
        return share_good
    mean, scale = np.array(held[2 : 2 + len(FEATURES)], np.float64), np.array(held[2 + len(FEATURES) :], np.float64)
    scale[scale == 0] = 1

    def standard_of(batch: pa.RecordBatch) -> np.ndarray:
        return standard(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)), mean, scale)

    def packed(keys: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["key", "parts"])

    def totals(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for batch in batches:
                one = sums(standard_of(batch), batch.column("label").to_numpy().astype(np.int64), w)
                got = one if got is None else merged(np.concatenate([got[0], one[0]]), np.vstack([got[1], one[1]]))
            if got is not None:
                yield packed(*got)

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for batch in batches:
                keys, parts = batch.column("key").to_numpy(), batch.column("parts").flatten().to_numpy(zero_copy_only=False)
                if len(keys):
                    parts = parts.reshape(len(keys), -1)
                    got = merged(keys, parts) if got is None else merged(np.concatenate([got[0], keys]), np.vstack([got[1], parts]))
            if got is not None:
                yield packed(*got)

        form = "key long, parts array<double>"
        got = rows.mapInArrow(summed, form).repartition("key").mapInArrow(joined, form).toArrow()
        keys = got.column("key").to_numpy()
        return keys, got.column("parts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)

    w = weights(totals, len(FEATURES))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(standard_of(batch) @ w)], names=["label", "s"])

    scores = settle(rows.mapInArrow(scored, "label int, s double"), "quality-scores")
    each = (1 - share_good) / n_bad, share_good / n_good
    threshold = quantile(scores, each, (1 - share_good) * (1 - 1e-9))
    bins = scores.groupBy(F.floor(F.col("s") * SLOPE_BINS).alias("bin")).agg(F.avg("s").alias("s"), F.sum("label").alias("good"), F.count("s").alias("n")).toPandas()
    good, n = bins["good"].to_numpy(np.float64), bins["n"].to_numpy(np.float64)
    return Ranker(mean, scale, w, threshold, steepness(bins["s"].to_numpy(), good, n - good, each, threshold))


def quantile(scores: DataFrame, each: tuple[float, float], least: float) -> float:
    """The middle between the first score up to which (label, s) rows weigh ``least``, and the next; a row weighs ``each[label]``."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    below, counts = 0.0, (F.sum("label").alias("good"), F.count("s").alias("n"))
    while True:
        within = scores.filter(F.col("s").between(low, high))
        listed = within.groupBy("s").agg(*counts).limit(LISTED + 1).toPandas().sort_values("s")
        good = listed["good"].to_numpy(np.int64)
        if len(listed) <= LISTED:
            at, _, ends = place(good, listed["n"].to_numpy(np.int64) - good, each, below, least)
            found = float(listed["s"].iloc[at])
            following = scores.filter(F.col("s") > found).agg(F.min("s")).first()[0] if ends else found
            return (found + (found if following is None else following)) / 2
        part = F.least(F.floor((F.col("s") - low) / ((high - low) / PARTS)), F.lit(PARTS - 1))
        parts = within.groupBy(part.alias("part")).agg(*counts, F.min("s").alias("low"), F.max("s").alias("high")).toPandas().sort_values("part")
        good = parts["good"].to_numpy(np.int64)
        at, below, _ = place(good, parts["n"].to_numpy(np.int64) - good, each, below, least)
        low, high = float(parts["low"].iloc[at]), float(parts["high"].iloc[at])


def featured(rows: DataFrame) -> DataFrame:
    """(doc_id, x) for every row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features(filled(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def marked(labels: DataFrame, label: str, id_col: str, modulus: int, held: int) -> DataFrame:
    """(l_id, label) of the labelled ids that may be learnt from. An id with several labels has the greatest."""
    marks = labels.select(F.col(id_col).alias("l_id"), F.col(label).cast("int").alias("label"))
    marks = marks.filter(F.col("l_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("l_id"), modulus) != held))
    return marks.groupBy("l_id").agg(F.max("label").alias("label"))


def labelled(rows: DataFrame, labels: DataFrame, label: str, id_col: str, modulus: int, held: int, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of about ``sample`` labelled rows per label that may be learnt from, and all labels' counts.

    Rows are chosen by a hash of the id against a rate from the counts.
    """
    marks = marked(labels, label, id_col, modulus, held)
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, sample / max(counts.get(1, 0), 1)))).otherwise(F.lit(min(1.0, sample / max(counts.get(0, 0), 1))))
    chosen = marks.filter(F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(1_000_003)) < rate * 1_000_003)
    # the sample parameter bounds what is broadcast: ids and labels of two samples
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "label"), counts


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker | float:
    """The ranker of all labelled rows that may be learnt from.

    Features are made before the join, so that no text is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = marked(labels, label_col, id_col, 3, 1)
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    total = sum(counts.values())
    share_good = counts.get(1, 0) / total if total else 1.0
    if len(counts) < 2:
        return share_good
    made = featured(rows.filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1)))
    return fit_rows(settle(made.join(marks, F.col("doc_id") == F.col("l_id")).select("label", "x"), "quality-features"), share_good)


def score_column(model: Ranker | float, text: Column) -> Column:
    """The score of a text column, for use beside other columns."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [model.score(features(filled(x.column("text")))) if isinstance(model, Ranker) else np.full(x.num_rows, float(model)) for x in slices([batch])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(text.cast("string"))


def score(docs: DataFrame, model: Ranker | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
