"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is its byte n-grams inside words (a space marks a word's start and end),
hashed into a table of embeddings that are averaged over the whole text; a linear
layer and a softmax give a probability for every language. Table and layer are
trained together by stochastic gradient descent in numpy. The temperature of the
softmax, and the score under which a prediction is rejected, come from rows that
training left out.

The driver gets at most about ``sample`` training texts per language, chosen by a
hash of the id. For scoring, table times layer is one small table (32,768 rows of a
number per language), so a text costs one lookup an n-gram.

Defined results: null texts, and texts without a letter, are ``und`` with score 0;
each row gives one row, repeated rows equal ones; a row with a null id, text or
language is not learnt from; with no language to learn from every text is ``und``;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import remainder
from tallygrid.llm.words import filled, raw_bytes, slices

BUCKET_BITS = 15
WIDTH = 16
ORDERS = (2, 3, 4)
HASHER = np.uint32(2654435761)
UNDETERMINED = "und"

#: ASCII without letters becomes a space.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 32
_LETTERS[65:91], _LETTERS[97:123] = np.arange(65, 91), np.arange(97, 123)


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (bucket, index of the text) of the n-grams inside words."""
    end, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    data, at = raw_bytes(pc.binary_join_element_wise(end, pc.utf8_lower(texts), end, space))
    data = _LETTERS[data]
    own = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
    blank = data == 32
    for n in ORDERS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        code, inner = data[:count].astype(np.uint32), np.zeros(count, bool)
        for i in range(1, n):
            code |= data[i : i + count].astype(np.uint32) << np.uint32(8 * i)
            if i < n - 1:
                inner |= blank[i : i + count]
        good = ~inner
        if n == 2:
            good &= ~(blank[:count] & blank[1 : 1 + count])
        code = code[good] * HASHER + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        yield (code ^ (code >> np.uint32(15))) * HASHER >> np.uint32(32 - BUCKET_BITS), own[:count][good]


class Identifier:
    """Languages, per-bucket logits, bias, temperature and rejection threshold."""

    def __init__(self, languages, table, bias, temperature, least):
        self.languages, self.table, self.bias, self.temperature, self.least = languages, table, bias, temperature, least

    def logits(self, texts: pa.Array) -> np.ndarray:
        sums, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bucket, own in ngrams(texts):
            count += np.bincount(own, minlength=len(texts))
            rows = self.table[bucket]
            for j in range(len(self.languages)):
                sums[:, j] += np.bincount(own, rows[:, j], len(texts))
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if x else UNDETERMINED for b, x in zip(best, lettered)], np.where(lettered, p.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], languages: list[str], rounds: int = 6, rate: float = 0.5, batch: int = 16, held: float = 0.2, seed: int = 7) -> Identifier | None:
    """Trains on a list of texts with languages; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    y = np.array([names.index(x) for x in languages])
    bags = []  # (distinct buckets, share of the text's n-grams)
    for text in texts:
        parts = [b for b, _ in ngrams(filled(pa.array([text], pa.string())))]
        bucket, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True)
        bags.append((bucket.astype(np.int64), (n / max(n.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = int(len(y) * held) if len(y) >= 20 else 0
    out, into = order[:cut], order[cut:]
    table = rng.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = max(1, rounds * len(into) // batch), 0
    for _ in range(rounds):
        into = rng.permutation(into)
        for part in np.array_split(into, max(1, len(into) // batch)):
            now = rate * (1 - min(done / steps, 0.95))
            hidden = np.stack([bags[i][1] @ table[bags[i][0]] for i in part])
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(part)), y[part]] -= 1
            back = error @ layer.T
            layer -= now * hidden.T @ error
            bias -= now * 0.1 * error.mean(0)
            for i, g in zip(part, back):
                # shares of single n-grams are small: each moves by its share of the largest
                table[bags[i][0]] -= (now * bags[i][1] / bags[i][1].max(initial=1e-9))[:, None] * g
            done += 1
    merged = (table @ layer).astype(np.float32)
    if not cut:
        return Identifier(names, merged, bias, 1.0, 0.5)
    raw = np.stack([bags[i][1] @ merged[bags[i][0]] for i in out]) + bias
    temperatures = np.geomspace(0.02, 5, 60)
    losses = [-np.log(softmax(raw / t)[np.arange(cut), y[out]] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    p = softmax(raw / temperature)
    right, top = p.argmax(1) == y[out], p.max(1)
    wrong = np.sort(top[~right])
    return Identifier(names, merged, bias, temperature, float(max(0.5, wrong[-1] if len(wrong) and len(wrong) < 0.01 * cut else np.quantile(top, 0.005))))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 400) -> Identifier | None:
    """Fits on about ``sample`` texts per language of rows whose id may be learnt from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    rate = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, sample / n))]), F.col("lang"))
    got = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_003)) < rate * 1_000_003).toPandas().sort_values(["doc_id", "lang", "text"])
    return fit(got["text"].tolist(), got["lang"].tolist())


def identify(docs: DataFrame, model: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score = model.predict(filled(batch.column("text"))) if model else ([UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows))
            rejected = score < (model.least if model else 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
