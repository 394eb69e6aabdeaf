"""Operators that SQL can't express, against plain Python, and their handling of odd rows."""

import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import SF
from tallygrid.llm import common, extraction, language, ngramjoin, quality, repetition, toxicity
from tallygrid.llm.words import filled
from tests_llm_plain import classes_of

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
MID = SF.replace("0.001", "0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "one", "ONE", "one two", "a a a a a a a a a a a a a a", "é\x85x nbsp\xa0y", "<p>x", "x" * 300_000, "w " * 120_000]


def frame(spark, texts, **more):
    clash = {c: F.lit("clash") for c in ("tag", "n", "h1", "keys", "key", "label", "x", "score", "class", "root", "node", "l_id", "page", "held_out")}
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(clash | more)


# ---- n-gram join


def classes(texts, k, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, groups, copies, chain):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([12, 25, 60, 150]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t[rng.randrange(2) :]))
    t = [rng.choice(words) for _ in range(90)]
    for _ in range(chain):
        t = list(t)
        t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("k, percent, leaf, rounds", [(3, 90, 128, 2), (5, 80, 4, 1), (5, 80, 2, 0)])
def test_join_finds_every_class(spark, monkeypatch, k, percent, leaf, rounds):
    """Without rounds, every link between different sets is the descent's; small leaves make trees of many levels."""
    monkeypatch.setattr(ngramjoin, "LEAF", leaf)
    monkeypatch.setattr(ngramjoin, "FAN", 2 if leaf < 128 else 8)
    monkeypatch.setattr(ngramjoin, "ROUNDS", rounds)
    monkeypatch.setattr(common, "HOT_ROWS", 20 if leaf < 128 else 1000)
    texts = ODD[:8] + near_copies(k, 6, 12, 25)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.link(frame(spark, texts), k=k, percent=percent).collect()}
    assert got == classes(texts, k, percent)


def test_roles_of_a_pair_fit_together():
    for percent in (80, 90):
        for a in range(1, 220):
            smaller = ngramjoin.roles(np.array([a]), percent)[0]
            for b in range(a, a * 100 // percent + 1):
                apart = (a + b) * (100 - percent) // (100 + percent)
                if not apart:
                    continue
                match = [r for r in ngramjoin.roles(np.array([b]), percent) if r.number[0] == smaller.number[0]]
                assert len(match) == 1, (a, b)
                for x, y in ((smaller, match[0]), (match[0], smaller)):
                    assert x.number[0] >= x.named[0] and x.differ[0] >= apart
                    assert min(x.named[0], y.named[0]) - apart >= x.shared[0] >= 1, (a, b)


def test_join_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text), (3, None)], "doc_id long, text string")
    got = sorted([tuple(r) for r in ngramjoin.link(rows).collect()], key=repr)
    assert got == sorted([(5, 38, 5), (5, 38, 5), (None, 38, None), (7, 38, 5), (3, 0, 3)], key=repr)
    assert ngramjoin.link(rows.limit(0)).count() == 0


def test_join_of_an_id_with_several_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    rows = spark.createDataFrame([(1, one), (5, one), (5, two), (5, None), (7, two + " more"), (9, "alone")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in ngramjoin.link(rows).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (5, 1), (7, 1), (9, 9)]


# ---- repetition


def measures(t, span):
    w = WORD.findall(t or "")
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)

    def cover(least):
        return len({p for i in range(n) if longest[i] >= least for p in range(i, i + longest[i])})

    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = {p for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated), cover(span), max(longest, default=0))


def test_repetition_measures(spark):
    rng = random.Random(2)
    texts = ODD[:9] + ["".join(rng.choice(" \n\t") + f"w{rng.randrange(rng.choice([2, 4, 30]))}" for _ in range(rng.randrange(90))) for _ in range(80)]
    got = {r["doc_id"]: tuple(r)[1:] for r in repetition.measure(frame(spark, texts)).collect()}
    assert got == {i: measures(t, 10) for i, t in enumerate(texts)}


def test_repetition_verdicts(spark):
    plain = " ".join(f"w{i}" for i in range(1000))
    texts = [plain, plain + " " + " ".join(f"w{i}" for i in range(60)), "few words", "same line of words\n" * 30, None, ODD[-1]]
    got = [(r["base_failed"], r["kept"]) for r in repetition.judge(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [(False, True), (False, False), (True, False), (True, False), (True, False), (True, False)]
    assert repetition.judge(frame(spark, texts).limit(0)).count() == 0


# ---- extraction

ARTICLE = "A paragraph that is long enough to weigh something in any window of lines."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<!-- open", ""), ("only words", "only words"),
    (f"<nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>T &amp; t</h1><p>{ARTICLE}</p><p>Of.</p></article><footer>f</footer>", f"T & t\n{ARTICLE}\nOf."),
    (f"<div class=menu>open<article><p>{ARTICLE}<br>more <b>bold</b></article>", f"{ARTICLE} more bold"),
    (f"<main><p>{ARTICLE}</p><section id='comments'><article class='comment'><p>First!</p></article></section></main>", ARTICLE),
    (f"<article><script>if (a < b) {{ '</p>' }}</script><style>p{{}}</style><p>{ARTICLE}</p><form>f<input></form><aside>s</aside></article>", ARTICLE),
    (f"<div class='topbar'>{ARTICLE}</div><div><h2>Head</h2><p>{ARTICLE}</p><p>Short.</p></div><div class='cookie-notice'>{ARTICLE}</div><p>© 2020 X</p>", f"Head\n{ARTICLE}\nShort."),
    (f"<ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><p>{ARTICLE}</p>", ARTICLE),
    (f"<article><table><tr><td>a</td><td>b</td></tr></table><p hidden>x</p><p style='display: none'>y</p><p>{ARTICLE}  \n z&nbsp;&#65;</p></article>", f"a b\n{ARTICLE} z A"),
    (f"<article class='post comments-open tag-popular'><div class='entry-header'><h1>T</h1></div><div class='post-with-sidebar'><p>{ARTICLE}</p></div><div class='post-comments'>c</div></article>", f"T\n{ARTICLE}"),
    (f"<body class='has-sidebar'><div id='page-content'><div class='elementor-widget'><p>{ARTICLE}</p></div></div><div role='navigation'>{ARTICLE}</div><ol class='commentlist'><li>{ARTICLE}</ol>", ARTICLE),
])
def test_extraction(spark, page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><article><p>Card.</p></article>", f"{ARTICLE}\n{ARTICLE}\nCard."),
    (f"<article><p>{ARTICLE}</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></article>", ARTICLE),
    (f"<article><p>{ARTICLE}</p><p><a>A link</a></p><p>{ARTICLE}</p></article><p>Outside.</p>", f"{ARTICLE}\nA link\n{ARTICLE}"),
    (f"<article><p>Print</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{ARTICLE}</p></article>", ARTICLE),
])
def test_extraction_of_marked_pages_weighs_text(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<p>{ARTICLE}</p><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>Short end.</p>", f"{ARTICLE}\nShort end."),
    (f"<p>{ARTICLE}</p><p>Copyright law: {ARTICLE}</p><p>{ARTICLE}</p><p>Copyright X</p>", f"{ARTICLE}\nCopyright law: {ARTICLE}\n{ARTICLE}"),
])
def test_extraction_of_unmarked_pages_loses_no_body(page, text):
    assert extraction.main_text(page) == text


def test_spans_of_the_distribution(monkeypatch):
    rng = random.Random(9)
    for _ in range(300):
        weights = [rng.choice([0, 0, 1, 9, 25, 60, 300]) for _ in range(rng.randrange(14))]
        sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
        surge = min(120, max(sums, default=0))
        begins = [i for i, s in enumerate(sums) if s >= surge > 0 and weights[i] * 12 >= surge]
        want, at = set(), 0
        for begin in begins:
            if begin >= at:
                at = next((i for i in range(begin, len(sums)) if sums[i] * 12 < surge), len(sums))
                want |= set(range(begin, at))
        assert [i for i, x in enumerate(extraction.spans(weights)) if x] == sorted(want)
    page = f"<div><p>Menu of it</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>{ARTICLE}</p><p>{ARTICLE}</p></div>"
    assert extraction.main_text(page) == f"{ARTICLE}\n{ARTICLE}"
    for name, value in (("WINDOW", 6), ("SURGE", 20)):
        with monkeypatch.context() as patch:
            patch.setattr(extraction, name, value)
            assert extraction.main_text(page).startswith("Menu of it")


def test_parts_set_apart_are_weighed_and_never_pass():
    long = " ".join(["words of a reader"] * 400)
    page = f"<article><p>Hi.</p><div class='comments'><p>{long}</p><p>{long}</p></div><p>End.</p></article><aside><p>{long}</p></aside>"
    assert extraction.main_text(page) == "Hi.\nEnd."
    weights = extraction.weigh(extraction.lines_of(page))
    assert len(weights) == 5 and min(weights) > 0
    assert extraction.main_text(f"<nav><p>{long}</p></nav><div class='cookie-notice'>{long}</div>") == ""
    body = "b" * 300
    assert extraction.main_text(f"<article><p>{ARTICLE * 20}</p></article><p>{body}</p>") == f"{ARTICLE * 20}\n{body}"


@needs_data
def test_windows_and_surges_decide_on_the_given_pages(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet(f"{MID}/pages.parquet").collect()]
    texts = [extraction.main_text(p) for p in pages]
    monkeypatch.setattr(extraction, "WINDOW", 1)
    assert sum(extraction.main_text(p) != t for p, t in zip(pages, texts)) > 5
    monkeypatch.setattr(extraction, "SURGE", 400)
    assert sum(extraction.main_text(p) != t for p, t in zip(pages, texts)) > 100


def test_extraction_of_frames(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None), (3, "v", "<article>" + "<p>é" * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("c"))
    got = sorted([(r["page_id"], r["url"], r["n_chars"]) for r in extraction.extract(pages).collect()], key=repr)
    assert got == sorted([(1, "u", 1), (1, "u", 1), (None, None, 0), (3, "v", 99_999)], key=repr)
    assert extraction.extract(pages.limit(0)).count() == 0


# ---- language

SAYING = {"aa": ["the", "and", "thing", "with"], "bb": ["das", "und", "nicht", "schön"]}


def sentences(spark, n=240):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(SAYING[lang]) for _ in range(12)), lang) for i, lang in enumerate(rng.choice(["aa", "bb"]) for _ in range(n))]
    return spark.createDataFrame(rows + [(n, None, "aa"), (n + 1, "12 !?", "bb"), (n + 2, "the", None), (None, "und", "bb")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))


def test_language(spark):
    docs = sentences(spark)
    rows = language.identify(docs, language.learn(docs)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == 244
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (240, 241):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["lang_pred"] == truth[r["doc_id"]] and 0.5 < r["score"] <= 1
    nothing = docs.filter(F.lit(False))
    assert language.learn(nothing) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(nothing, language.learn(docs)).count() == 0


def test_language_of_very_long_and_repeated_rows(spark):
    docs = sentences(spark)
    said = {"aa": "the and thing with " * 60_000, "bb": "das und nicht schön " * 60_000}
    more = spark.createDataFrame([(i, said[x]) for i, x in ((900, "aa"), (900, "aa"), (901, "bb"), (901, "bb"))], "doc_id long, text string")
    rows = language.identify(more, language.learn(docs)).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in rows) == [(900, "aa"), (900, "aa"), (901, "bb"), (901, "bb")]
    assert len({(r["doc_id"], r["score"]) for r in rows}) == 2


def test_language_of_a_text_ignores_its_neighbours():
    model = language.fit([" ".join(SAYING[x]) for x in ("aa", "bb")] * 20, ["aa", "bb"] * 20)
    texts = ["the and", "und nicht", "thing", "", "schön das"]
    together = model.logits(filled(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(model.logits(filled(pa.array([t])))[0], together[i])


@needs_data
def test_trees_find_the_links_of_the_given_documents(spark, monkeypatch):
    """With pivots left to trees of more than a leaf, of which there are none, the descent finds them."""
    monkeypatch.setattr(ngramjoin, "PIVOTED", ngramjoin.LEAF)
    links, plain = [], ngramjoin.verified

    def counted(*given):
        found = plain(*given)
        links.append(found.distinct().count())
        return found

    monkeypatch.setattr(ngramjoin, "verified", counted)
    assert ngramjoin.link(spark.read.parquet(f"{MID}/documents.parquet")).count() == 1000
    assert links[0] == 0 and links[-1] > 0


def test_a_document_of_very_many_pairs_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = {i: " ".join(f"w{j}" for j in range(60)) + f" x{i % 9} y{i % 9}" for i in range(30)} | {i: f"alone {i} " * 20 for i in range(30, 34)}
    want = classes_of(texts, 3, 90)
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.link(frame(spark, list(texts.values()))).collect()}
    assert got == want


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    got = language.identify(docs, language.learn(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


# ---- quality and toxicity


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@needs_data
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.learn(docs, labels)).filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.97
    assert (got["predicted"] == got["quality"]).mean() > 0.95


@needs_data
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id"), toxicity.learn(docs, labels)).filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(got["score"].to_numpy(), got["toxic"].to_numpy()) > 0.95
    assert (got["predicted"] == got["toxic"]).mean() > 0.95


def lexicon(spark, n=300):
    rng = random.Random(4)
    words = [f"plain{i}word" for i in range(60)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(20)] + (["awfulness"] * 2 if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    docs = frame(spark, [t for _, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, b, 1 - b) for i, _, b in rows] + [(2, 0, 1), (None, 1, 0), (n + 500, None, None)], "doc_id long, toxic int, quality int").withColumn("text", F.lit("clash"))
    return docs, labels


def test_toxicity_learns_a_lexicon(spark):
    docs, labels = lexicon(spark)
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(rows) == 300 + len(ODD)
    for r in rows:
        assert r["predicted"] == int(r["doc_id"] < 300 and r["doc_id"] % 4 == 0), r
        assert r["predicted"] == 0 or r["evidence"][0]["label"] == 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_block_bounds_of_the_whole_index_lose_no_neighbour(monkeypatch):
    """Topics with words of their own, so that whole blocks can be left out."""
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(toxicity, "FREQUENT", 60)
    rng = random.Random(10)
    topics = [[f"{c}{d}{e}word" for d in "aeiou" for e in "xyz"] for c in "bcdfghjklm"]
    texts = [" ".join(rng.choice(topics[i % 10]) for _ in range(rng.randrange(1, 30))) + f" rare{i % 90}" for i in range(700)]
    whole = toxicity.Whole(filled(pa.array(texts)), np.array([float(i % 10 < 3) for i in range(700)]))
    asked = texts[::9] + ["", "unknown words", "baxword hizword"]
    row, term, weight = whole.vectors(filled(pa.array(asked)))
    every = np.zeros((len(asked), whole.rows))
    for i, t, w in zip(row, term, weight):
        at = slice(whole.ends[t], whole.ends[t + 1])
        every[i, whole.example[at]] += w * whole.weight[at]
    given = np.concatenate([found for _, found in whole.cosines(row, term, weight, len(asked))])
    assert ((given == 0) & (every > 1e-6)).any(), "no block was left out"
    for i, (near, cosine) in enumerate(whole.nearest(filled(pa.array(asked)))):
        best = np.sort(every[i][every[i] > 1e-6])[::-1][: toxicity.NEAREST]
        assert np.allclose(best, cosine, atol=3e-6) and np.allclose(every[i][near], cosine, atol=3e-6)


def test_neighbours_are_over_all_terms(spark):
    rng = random.Random(8)
    same = "quaintly singular wording"  # in one example only, so tied to no label
    words = [f"plain{chr(97 + i)}word" for i in range(20)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) + (" awfulness" if i % 3 == 0 else "") for i in range(120)] + [same]
    unlabelled = [same] + ["awfulness " + same, None, "zz"] * 4
    y = np.array([int(i % 3 == 0) for i in range(120)] + [1])
    docs = frame(spark, texts + unlabelled)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(y)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    learnt = [i for i in range(121) if zlib.crc32(str(i).encode()) % 5]
    assert learnt[-1] == 120 and model.ids.tolist() == learnt
    counts = lambda t: Counter(g for w in (t or "").encode().split() for g in [w + b" ", *(w[:n] for n in toxicity.BEGINNINGS if len(w) > n)])
    every = [counts(t) for t in texts + unlabelled]
    df, known = Counter(g for c in every for g in c), {g for i in learnt for g in every[i]}
    assert len(model.whole.codes) == len(known)

    def tied(g, among):
        cells = Counter((bool(every[i][g]), int(y[i])) for i in among)
        total = lambda k, v: sum(n for key, n in cells.items() if key[k] == v)
        return sum(n * np.log(n * len(among) / (total(0, has) * total(1, label))) for (has, label), n in cells.items())

    ties = {g: np.log1p(max(tied(g, learnt), 0)) for g in known}
    vector = lambda c: {g: (1 + np.log(n)) * (np.log((1 + len(every)) / (1 + df[g])) + 1) * ties[g] for g, n in c.items() if g in known}
    unit = lambda v: {g: x / max(np.sqrt(sum(z * z for z in v.values())), 1e-6) for g, x in v.items()}
    examples = {i: unit(vector(every[i])) for i in learnt}
    got = {r["doc_id"]: r["evidence"] for r in toxicity.score(docs, model).collect()}
    for i in [*range(0, 121, 10), 121, 122, 123, 124]:
        query = unit(vector(every[i]))
        cosine = {j: sum(x * e.get(g, 0) for g, x in query.items()) for j, e in examples.items()}
        best = sorted((c for c in cosine.values() if c > 1e-6), reverse=True)[: toxicity.NEAREST]
        assert np.allclose([e["cosine"] for e in got[i]], best, atol=3e-6)
        assert all(abs(e["cosine"] - cosine[e["id"]]) < 3e-6 for e in got[i])
    assert (got[121][0]["id"], got[121][0]["label"]) == (120, 1) and abs(got[121][0]["cosine"] - 1) < 3e-6
    # the vote and the curve, from all the evidence that is given
    a, b = model.curve
    for r in toxicity.score(docs, model).collect():
        weights = [e["cosine"] ** 2 for e in r["evidence"]]
        vote = (sum(w for w, e in zip(weights, r["evidence"]) if e["label"]) + 0.1 * model.prior) / (sum(weights) + 0.1)
        assert abs(r["score"] - 1 / (1 + np.exp(-(a * vote + b)))) < 1e-6


def test_classifiers_without_labels(spark):
    docs, labels = lexicon(spark, 40)
    none, one = labels.limit(0), labels.filter("toxic = 0")
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, one)).collect()} == {0.0}
    assert {r["score"] for r in quality.score(docs, quality.learn(docs, none)).collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.learn(docs, labels)).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0
    scores = [r["score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()]
    assert len(scores) == 40 + len(ODD) and all(0 <= s <= 1 for s in scores)
