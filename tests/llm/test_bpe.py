"""Encoding against the tokenizer library, exact round trips, and odd rows."""

import base64
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from oracle import SF
from tallygrid.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")
PARTS = [
    " ", "  ", "\n", " \n", "\t", "\xa0", "　", "\x1c", "\x85", "'s", "'re", "'LL", "a", "b", "the", "é", "日本", "1", "23", "!", "...", "_", "x" * 300, " foo",
    "<|endoftext|>", "́", "\U0001f600", "\r\n", "ß",
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def coder():
    with open(PATH, "rb") as file:
        return bpe.Coder(file.read(), PATTERN)


def same(texts, library):
    own = coder()
    ids, counts = own.encode(texts)
    lists = np.split(ids, np.cumsum(counts)[:-1])
    for text, got in zip(texts, lists):
        assert got.tolist() == library.encode_ordinary(text), text[:50]
    assert own.decode(ids, counts) == [t.encode() for t in texts]


def test_mixtures_of_spaces_marks_and_letters(library):
    rng = random.Random(3)
    same(["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", " ", "a ", "  a"], library)


def test_long_words_contract_as_the_library_does(library):
    rng = random.Random(4)
    same(["".join(rng.choice("ab") for _ in range(n)) for n in (257, 300, 1000)] + ["".join(rng.choice("abcdefghijklmnop") for _ in range(700)), "x" * 20_000, "é" * 400, "日本語" * 300, "ab" * 400 + "a"], library)


def test_pieces_are_forgotten_and_come_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    own = coder()
    for text in ("one two three four", "two three four five", "one two"):
        ids, _ = own.encode([text])
        assert ids.tolist() == library.encode_ordinary(text)


def test_odd_rows_and_the_round_trip(spark, library):
    texts = [None, "", " ", "hello world", "hello world", "<|endoftext|> x", "w " * 120_000, "é\x85x nbsp\xa0y"]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    coded = bpe.encode(docs, PATH, PATTERN)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["u"], bytes(r["d"])) for r in coded.join(bpe.decode(coded, PATH).withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", F.col("ids").alias("u"), F.col("decoded").alias("d")).collect())
    want = sorted((i == 3, i if i != 3 else 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts))
    assert got == want
    assert bpe.encode(docs.limit(0), PATH, PATTERN, round_trip=True).collect() == []


@needs_data
def test_query_over_the_whole_table(spark, library):
    rows = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids, row = library.encode_ordinary(doc["text"] or ""), rows[doc["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()
