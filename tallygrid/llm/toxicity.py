"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are unit vectors of term frequency (logarithmic) times inverse document
frequency times the term's label weight, and one block-max index holds them. Terms are
the words of every example and their beginnings of 4, 5 and 6 bytes; none is cut by its
count, its label or its rank. The documents that hold a term are counted over all
documents. The label weight is log(1 + r), with r the log-likelihood ratio between the
term and the labels of the examples: terms that come with one label count for more, and
all others still count. So vectors are label-weighted TF-IDF, and their cosine is exact.
A term that no example has carries no label, so it has no weight.

The terms fall in two: those in few examples are added up from posting lists for every
example, and the ``FREQUENT`` most common ones have blocks of examples with the
largest weight of each term. A block's best such sum and its largest weights bound its
best cosine; the blocks with the best bounds are scored exactly, then all whose
bound reaches the ``NEAREST``-th cosine found.

The nearest vote for their labels with squared cosine, against a prior vote. As the
label weights know the examples' labels, the logistic curve that makes the vote a
probability is fitted to votes on examples that the weights and the index don't know:
the examples fall in ``FOLDS`` parts by turns, and each part is scored by an index of
the others. The examples found are the evidence.

The driver gets at most about ``sample`` labelled texts per label, chosen by a hash
of the id, and one count for each of their terms.

Defined results: a text without terms of the index, empty and null ones included, has
no neighbours and gets the curve's score for the prior; each row
gives one row, repeated rows equal ones; ties in cosine go to the smaller id; rows without label
or with a null id are not learnt from; with one label missing every score is the
share of toxic labels (0 without labels); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import remainder
from tallygrid.llm.quality import labelled
from tallygrid.llm.words import Runs, filled, mixed, raw_bytes, slices

BLOCK = 32
NEAREST = 15
#: Texts whose terms weigh nothing have zeros for vectors.
TINY = 1e-12
#: Parts of the examples whose votes fit the curve, each by an index of the others.
FOLDS = 3
#: The index's most frequent terms, which are blocked; texts and postings scored together;
#: blocks scored first. Speed and memory only.
FREQUENT, TOGETHER, ROOM, FIRST_BLOCKS = 512, 256, 1 << 20, 8
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6)

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[:48], _FOLDED[58:97], _FOLDED[123:128] = 32, 32, 32
_FOLDED[65:91] = np.arange(97, 123)


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in slices, each with the index of its first."""
    start = 0
    for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        yield start, part.column("text")
        start += part.num_rows


def whole_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term, index of the text): words and their beginnings, as 64-bit hashes taken as exact."""
    end, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    data, at = raw_bytes(pc.binary_join_element_wise(end, pc.utf8_lower(texts), end, space))
    data = _FOLDED[data]
    full = np.concatenate(([False], data != 32, [False]))
    start, stop = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(full[:-1] & ~full[1:])
    own = np.searchsorted(at, start, side="right") - 1
    runs = Runs(mixed(data.astype(np.uint64)))
    codes, owners = [mixed(runs.hash(start, stop))], [own]
    for n in BEGINNINGS:
        long = stop - start > n
        codes.append(runs.hash(start[long], start[long] + n))
        owners.append(own[long])
    return np.concatenate(codes), np.concatenate(owners)


def frequencies(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place of the term in the codes, frequency, distinct codes), for parts of the texts."""
    for start, part in _parts(texts):
        code, own = whole_terms(part)
        if len(code):
            coded = pa.array(code).dictionary_encode()
            pair = np.sort(coded.indices.to_numpy().astype(np.int64) * len(part) + own)
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            yield pair[first] % len(part) + start, pair[first] // len(part), np.diff(np.append(first, len(pair))), coded.dictionary.to_numpy()


def numbers(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted code in the sorted codes, or -1."""
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def ties(positive: np.ndarray, count: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio between each term and the labels, from how many examples (and positive ones) have it."""
    rows, good = len(labels), labels.sum()

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    cells = (
        (positive, count * good / rows), (count - positive, count * (rows - good) / rows),
        (good - positive, (rows - count) * good / rows), (rows - good - count + positive, (rows - count) * (rows - good) / rows),
    )
    return np.maximum(sum(part(seen, expected) for seen, expected in cells), 0)


class Whole:
    """The index of all terms of the examples, which stand by id."""

    def __init__(self, texts: pa.Array, labels: np.ndarray, frequency: Callable[[np.ndarray], tuple[np.ndarray, int]] | None = None):
        self.rows = len(texts)
        self.codes = np.zeros(0, np.uint64)
        for *_, code in frequencies(texts):
            self.codes = np.union1d(self.codes, code)
        count, positive = np.zeros(len(self.codes), np.int64), np.zeros(len(self.codes))
        parts, squares = [], np.zeros(self.rows)
        for row, at, n, code in frequencies(texts):
            term = numbers(self.codes, code)[at].astype(np.int32)
            count += np.bincount(term, minlength=len(count))
            positive += np.bincount(term, labels[row], len(count))
            parts.append((row.astype(np.int32), term, (1 + np.log(n)).astype(np.float32)))
        df, total = frequency(self.codes) if frequency else (count, self.rows)
        self.scale = ((np.log((1 + total) / (1 + df)) + 1) * np.log1p(ties(positive, count, labels))).astype(np.float32)
        for row, term, weight in parts:
            weight *= self.scale[term]
            squares += np.bincount(row, weight.astype(float) ** 2, self.rows)
        for row, _, weight in parts:
            weight /= np.sqrt(np.maximum(squares, TINY))[row]
        term = np.concatenate([x[1] for x in parts])
        by = np.argsort(term, kind="stable").astype(np.int32)
        del term
        self.example = np.concatenate([x[0] for x in parts])[by]
        self.weight = np.concatenate([x[2] for x in parts])[by]
        self.ends = np.concatenate(([0], np.cumsum(count)))
        self._build()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "order", "slot", "matrix", "bounds")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._build()

    def _build(self) -> None:
        count = np.diff(self.ends)
        top = np.sort(np.argsort(-count, kind="stable")[:FREQUENT])
        self.place = np.full(len(count), -1, np.int32)
        self.place[top] = np.arange(len(top))
        weight = np.zeros((len(top), self.rows), np.float32)
        for i, t in enumerate(top):
            at = slice(self.ends[t], self.ends[t + 1])
            weight[i, self.example[at]] = self.weight[at]
        # examples alike in their heaviest frequent term share a block, which keeps its bounds low
        self.order = np.argsort(weight.argmax(0), kind="stable")
        self.slot = np.argsort(self.order).astype(np.int32)
        blocks = -(-self.rows // BLOCK)
        self.matrix = np.zeros((blocks, len(top), BLOCK), np.float32)
        self.matrix[self.slot // BLOCK, :, self.slot % BLOCK] = weight.T
        self.bounds = self.matrix.max(2).T.copy()

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, weight) of the texts' terms that examples have, by text."""
        found, squares = [], np.zeros(len(texts))
        for row, at, n, code in frequencies(texts):
            number = numbers(self.codes, code)
            known = number[at] >= 0
            row, term = row[known], number[at[known]]
            weight = (1 + np.log(n[known])) * self.scale[term]
            squares += np.bincount(row, weight**2, len(texts))
            found.append((row, term, weight))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        row, term, weight = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(row.astype(np.uint16) if len(texts) < 1 << 16 else row, kind="stable")
        row, term = row[by], term[by]
        return row, term, (weight[by] / np.sqrt(np.maximum(squares, TINY))[row]).astype(np.float32)

    def cosines(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first text, cosines of some texts from it on with the examples).

        A cosine is 0 where the block's bound is below the text's ``NEAREST``-th.
        """
        place = self.place[term]
        many = np.where(place < 0, self.ends[term + 1] - self.ends[term], 0)
        cut = np.searchsorted(row, np.arange(rows + 1))
        load = np.concatenate(([0], np.cumsum(many)))[cut]
        width = len(self.matrix) * BLOCK
        start = 0
        while start < rows:
            end = max(start + 1, min(start + TOGETHER, rows, int(np.searchsorted(load, load[start] + ROOM, "right")) - 1))
            k = np.arange(cut[start], cut[end])
            frequent, k = k[place[k] >= 0], k[place[k] < 0]
            query = np.zeros((end - start, len(self.bounds)), np.float32)
            query[row[frequent] - start, place[frequent]] = weight[frequent]
            long = many[k]
            at = np.repeat(self.ends[term[k]] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            pair = np.repeat((row[k] - start) * width, long) + self.slot[self.example[at]]
            rare = np.bincount(pair, np.repeat(weight[k], long) * self.weight[at], (end - start) * width)
            yield start, self._blocks(query, rare.reshape(end - start, -1, BLOCK))[:, self.slot]
            start = end

    def _blocks(self, query: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Cosines by slot, from the frequent terms' weights and the sums of the others."""
        bound = query @ self.bounds + rare.max(2)
        found, scored = np.zeros(rare.shape, np.float32), np.zeros(bound.shape, bool)

        def exact(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(0)):
                who = np.flatnonzero(wanted[:, block])
                found[who, block] = query[who] @ self.matrix[block] + rare[who, block]
            scored[wanted] = True

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, 1, kind="stable")[:, :FIRST_BLOCKS], True, 1)
        exact(first & (bound > 0))
        flat = found.reshape(len(found), -1)
        floor = np.partition(flat, -NEAREST, 1)[:, -NEAREST] if flat.shape[1] > NEAREST else np.zeros(len(flat))
        # float32 sums in different orders differ in the last bits
        exact((bound >= floor[:, None] - 1e-5) & (bound > 0) & ~scored)
        return flat

    def nearest(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of each text's nearest with a positive cosine, best first."""
        row, term, weight = self.vectors(texts)
        for _, found in self.cosines(row, term, weight, len(texts)):
            found = np.round(found, 6)
            least = np.partition(found, -NEAREST, 1)[:, -NEAREST] if self.rows > NEAREST else np.zeros(len(found))
            for one, floor in zip(found, least):
                use = np.flatnonzero((one >= floor) & (one > 0))
                best = use[np.lexsort((use, -one[use]))[:NEAREST]]
                yield best, one[best]


class Neighbours:
    """The examples' index, by id, and the calibrated vote."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, labels: np.ndarray, prior: float, frequency: Callable[[np.ndarray], tuple[np.ndarray, int]] | None = None):
        self.ids, self.labels, self.prior = ids, labels.astype(float), prior
        if frequency:  # counted once, for the whole index and those of the folds
            codes = np.zeros(0, np.uint64)
            for *_, code in frequencies(texts):
                codes = np.union1d(codes, code)
            frequency = _among(codes, frequency(codes))
        self.whole, votes = Whole(texts, self.labels, frequency), np.zeros(len(ids))
        for fold in range(min(FOLDS, len(ids))):
            own = np.arange(len(ids)) % FOLDS == fold
            if len(set(self.labels[~own].tolist())) < 2:
                votes[own] = prior
                continue
            others = Whole(texts.filter(pa.array(~own)), self.labels[~own], frequency)
            near = others.nearest(texts.filter(pa.array(own)))
            votes[own] = [self.vote(self.labels[~own][at], cosine) for at, cosine in near]
        self.curve = _curve(votes, self.labels, prior)

    def vote(self, labels: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine.astype(float) ** 2
        return float((weight @ labels + 0.1 * self.prior) / (weight.sum() + 0.1))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """(scores, evidence) of the texts; evidence is (id, label, cosine) of the examples that voted."""
        votes, evidence = np.zeros(len(texts)), []
        for i, (near, cosine) in enumerate(self.whole.nearest(texts)):
            votes[i] = self.vote(self.labels[near], cosine)
            evidence.append([{"id": d, "label": int(y), "cosine": float(c)} for d, y, c in zip(self.ids[near].tolist(), self.labels[near], cosine)])
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * votes + b, -500, 500))), evidence


def _among(codes: np.ndarray, counted: tuple[np.ndarray, int]) -> Callable[[np.ndarray], tuple[np.ndarray, int]]:
    """Document frequencies of some of the sorted codes that were counted."""
    return lambda wanted: (counted[0][np.searchsorted(codes, wanted)], counted[1])


def _curve(votes: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve over votes, examples weighed back to their shares."""
    weight = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))
    x, w = np.column_stack((votes, np.ones(len(votes)))), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (weight * (p - y)) + 1e-4 * w * [1, 0]
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-9])
        w -= np.clip(np.linalg.solve(bend, slope), -3, 3)
    return float(w[0]), float(w[1])


def fit(texts: pa.Array, ids: np.ndarray, y: np.ndarray, prior: float, frequency: Callable[[np.ndarray], tuple[np.ndarray, int]] | None = None) -> Neighbours | float:
    """``frequency``: how many documents have each of some sorted codes, and how many there are; by default the examples'."""
    if not len(y) or y.min() == y.max():
        return prior
    if next(frequencies(texts), None) is None:
        return prior
    by = np.argsort(ids, kind="stable")
    texts, ids, y = texts.take(pa.array(by)), ids[by], y[by]
    return Neighbours(texts, ids, y, prior, frequency)


def document_frequencies(rows: DataFrame, codes: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows have each of the sorted codes as a term, and how many rows there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(codes), np.int64), 0
        for batch in slices(batches):
            total += batch.num_rows
            for _, at, _, code in frequencies(filled(batch.column("text"))):
                number = numbers(codes, code)
                found = number >= 0
                count[number[found]] += np.bincount(at, minlength=len(code))[found]
        some = np.flatnonzero(count)
        for a in range(0, len(some), 1 << 16):
            part = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[part])], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], names=["term", "n"])

    got = rows.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").cast("bigint").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(len(codes), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1_200) -> Neighbours | float:
    """Fits on at most about ``sample`` labelled texts per label."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen, counts = labelled(rows, labels, label_col, id_col, 5, 0, sample)
    got = chosen.toPandas().sort_values(["doc_id", "label"])
    total = sum(counts.values())
    texts = filled(pa.array(got["text"].tolist(), pa.string()))
    return fit(texts, got["doc_id"].to_numpy(), got["label"].to_numpy(dtype=np.int64), counts.get(1, 0) / total if total else 0.0, lambda codes: document_frequencies(rows, codes))


def score(docs: DataFrame, model: Neighbours | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if isinstance(model, Neighbours):
                s, why = model.score(filled(batch.column("text")))
            else:
                s, why = np.full(batch.num_rows, float(model)), [[]] * batch.num_rows
            evidence = pa.list_(pa.struct([("id", batch.column("doc_id").type), ("label", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(why, evidence)], names=["doc_id", "score", "predicted", "evidence"])

    found = rows.mapInArrow(run, f"doc_id {key}, score double, predicted int, evidence array<struct<id: {key}, label: int, cosine: double>>")
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "evidence")
