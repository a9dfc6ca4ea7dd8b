"""Toxicity on odd rows: clashing names, repeated ids, labels both ways, very long texts, ties; and the choice of landmarks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.llm import toxicity


def prose(rnd, n=40):
    return " ".join("".join(rnd.choice(["an", "er", "th", "in", "on", "ed"]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(9)
    rows = [(i, prose(rnd) + (" wazzock plonker " if i % 3 == 0 else " ") + prose(rnd, 5)) for i in range(200)]
    rows += [(7, prose(rnd)), (7, prose(rnd)), (None, "wazzock plonker " + prose(rnd)), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("_id", "_y", "_t", "_text", "id", "y", "score", "model", "doc")})
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(1, 1), (2, None), (None, 1), (4, 5)], "doc_id bigint, toxic int").withColumns({c: F.lit("x") for c in ("_id", "_y", "y", "id")})
    return docs, labels


def test_sample(spark, corpus, monkeypatch):
    docs, labels = corpus
    rows = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic").collect()
    assert all(r["id"] is not None for r in rows) and {r["y"] for r in rows} == {0, 1}
    held = {r["doc_id"] for r in docs.filter(toxicity.held_out()).select("doc_id").distinct().collect()}
    assert not held & {r["id"] for r in rows}
    if 1 not in held:
        assert {r["y"] for r in rows if r["id"] == 1} == {1}  # labelled both ways
    if 7 not in held:
        assert sum(r["id"] == 7 for r in rows) == 3
    monkeypatch.setattr(toxicity, "PER_CLASS", 20)
    few = [sorted(map(repr, toxicity.labelled_sample(docs.repartition(n), labels, "doc_id", "text", "toxic").collect())) for n in (2, 5)]
    assert few[0] == few[1] and len(few[0]) == 40  # the same rows, however they are dealt


def test_rows_are_kept_or_go_by_their_text(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    texts = sorted(repr(r["text"]) for r in kept.collect())
    assert texts == sorted(repr(r["text"]) for r in docs.collect() if "wazzock" not in (r["text"] or ""))
    long = spark.createDataFrame([(1, "an er " * 200_000 + "wazzock plonker"), (2, "an er " * 200_000), (3, "x" * 100_000)], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(long, model).collect()}
    assert scores[1] > scores[2] == scores[3]


def test_chance_is_no_landmark():
    """Words that one class holds by accident aren't taken, however many there are; a stem of many words is."""
    rnd = random.Random(3)
    docs, y = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = [f"w{rnd.randrange(100_000)}" for _ in range(60)] + (["grumfel" + rnd.choice("abcdefgh") * 3 for _ in range(3)] if bad else [])
        docs.append([words])
        y.append(bad)
    found = toxicity.choose_landmarks(docs, np.array(y))
    assert found and all(t.startswith("^grumf") for t in found), found
    assert toxicity.choose_landmarks([d for d, bad in zip(docs, y, strict=True) if not bad], np.array([k % 5 == 0 for k in range(240)])) == []


def test_the_tail_is_a_binomial_one():
    from math import comb

    for bad, good, n_bad, n_good in ((5, 1, 30, 100), (3, 0, 30, 100), (12, 30, 50, 60)):
        n, p = bad + good, n_bad / (n_bad + n_good)
        tail = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad, n + 1))
        for tried in (1, 100):
            assert toxicity.is_telling(bad, good, n_bad, n_good, tried) == (bad > n * p and tail * tried < toxicity.CHANCE)
