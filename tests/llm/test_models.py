"""What the language and quality models compute, against plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import language, quality
from tallygrid.llm.words import filled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = 0xFFFFFFFF
TEXTS = [
    "the cat and the dog", "der hund und die katze", "naïve café, s'il vous plaît", "12 !? 34", "", None, "a", "the the the",
    "Ωmega\nΩmega\n\nline.", "x" * 5_000, "Über " * 2_000, "BUY NOW!!! $$$ | <b> #1",
]


def trained():
    english, german = "the cat and the dog sat on a mat with this and that", "der hund und die katze auf der matte mit dem und das"
    return language.fit([english, german] * 20, ["en", "de"] * 20)


def plain_language(model, text):
    """(language, probability) by a loop over the n-grams inside words."""
    data = [b if b > 127 or chr(b).isalpha() else 32 for b in f" {text or ''} ".lower().encode()]
    sums, count = [0.0] * len(model.languages), 0
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if 32 in gram[1:-1] or gram == [32, 32]:
                continue
            x = int.from_bytes(bytes(gram), "little") * 2654435761 + n * 0x9E3779B1 & WORDS
            x = (x ^ x >> 15) * 2654435761 & WORDS
            count += 1
            sums = [s + float(v) for s, v in zip(sums, model.table[x >> 17])]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    logits = [(s / max(count, 1) + float(b)) / model.temperature for s, b in zip(sums, model.bias)]
    powers = [math.exp(x - max(logits)) for x in logits]
    best = max(range(len(powers)), key=powers.__getitem__)
    return model.languages[best], powers[best] / sum(powers)


def test_language_against_plain_python(spark):
    model = trained()
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[1])], "doc_id long, text string")
    got = language.identify(docs, model).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        lang, score = plain_language(model, TEXTS[1 if r["doc_id"] is None else r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-5)
        assert r["rejected"] == (r["score"] < model.least)


def plain_features(text):
    words, data = WORD.findall(text), text.encode()
    n, size = max(len(words), 1), max(len(data), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))

    def share(chars):
        return sum(b in chars for b in data)

    return [
        math.log1p(len(words)),
        sum(len(w.encode()) for w in words) / n / 10,
        sum(len(w.encode()) > 20 for w in words) / n,
        len(set(words)) / n,
        sum(len(w.encode()) < 4 for w in words) / n,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        share(b"0123456789") / size,
        share(b"#$%&*<>") / size,
        share(b"!") / size,
        share(b"|") / size,
        share(b".") / n,
        share(b",;:?'\"()-_/\\@") / size,
        sum(b > 127 for b in data) / size,
        sum(any(c in "#$%&*|<>!" for c in w) for w in words) / n,
        len(lines) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum(x.rstrip()[-1:] not in (b".", b"!", b"?") for x in lines) / max(len(lines), 1),
        (len(pairs) - len(set(pairs))) / n,
    ]


def test_quality_features_against_plain_python():
    got = quality.features(filled(pa.array(TEXTS)))
    assert np.allclose(got, [plain_features(t or "") for t in TEXTS])
    for text in TEXTS:
        assert np.allclose(quality.features(filled(pa.array([text], pa.string())))[0], plain_features(text or ""))


def ranked(rows=300, share_good=0.6):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(rows, 4))
    y = (x @ [1.0, -0.7, 0.3, 0.0] + rng.normal(size=rows) > 0).astype(np.int64)
    return x, y, share_good, quality.fit(x, y, share_good)


def test_quality_weights_come_near_the_least_pairwise_loss():
    x, y, _, model = ranked()
    z = (x - x.mean(0)) / x.std(0)
    apart = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])

    def loss(w):
        return np.mean(np.log1p(np.exp(-apart @ w))) + 0.5e-3 * w @ w

    best = np.zeros(4)
    for _ in range(2_000):
        best += apart.T @ (1 / (1 + np.exp(apart @ best))) / len(apart) - 1e-3 * best
    assert loss(best) <= loss(model.weights) <= 1.01 * loss(best) < loss(np.zeros(4))


def test_quality_threshold_is_the_quantile_of_the_bad_share():
    x, y, share_good, model = ranked()
    strength = (np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights).tolist()
    each = {1: share_good / int(y.sum()), 0: (1 - share_good) / int((1 - y).sum())}
    running, order = 0.0, sorted(zip(strength, y.tolist()))
    for at, (_, label) in enumerate(order):
        running += each[label]
        if running >= (1 - share_good) * (1 - 1e-9):
            break
    assert model.threshold == pytest.approx((order[at][0] + order[at + 1][0]) / 2)
    score = model.score(x)
    assert [s >= 0.5 for s in score] == [s >= model.threshold for s in strength]
    assert np.all(np.diff(score[np.argsort(strength)]) >= 0) and 0 <= score.min() and score.max() <= 1


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(quality, "LISTED", 50)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(300, len(quality.FEATURES))), 2, axis=0)
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=len(x)) > 0).astype(np.int64)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, x array<double>").repartition(5)
    here, there = quality.fit(x, y, 0.6), quality.fit_rows(rows, 0.6)
    for name in ("mean", "scale", "weights", "threshold"):
        assert np.allclose(getattr(here, name), getattr(there, name), atol=1e-9), name
    assert here.slope == pytest.approx(there.slope, rel=1e-4)
    keys, by_bin = quality.sums(quality.standard(x, here.mean, here.scale), y, here.weights)
    assert by_bin[:, 0].sum() == len(x)


def test_quality_counts_more_than_a_sample_of_rows(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('w', id % 7) as text")
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda rows, share: seen.append(rows.count()) or share)
    quality.learn(docs, labels)
    assert seen == [docs.where("crc32(cast(doc_id as string)) % 3 <> 1").count()] and seen[0] > 16_000
