import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runtally.llm import mixing

TARGETS = {"x": 0.5, "y": 0.3, "z": 0.2}


def corpus(spark, n=400, seed=1):
    rnd = random.Random(seed)
    words = {d: [f"{d}{i}" for i in range(30)] for d in TARGETS}
    rows, labels = [], []
    for i in range(n):
        d = rnd.choices(list(TARGETS), [0.7, 0.2, 0.1])[0]
        other = rnd.choice(list(TARGETS))
        text = " ".join(rnd.choice(words[other if rnd.random() < 0.25 else d]) for _ in range(rnd.randint(1, 80)))
        rows.append((i, text, "r"))
        if i % 2:
            labels.append((i, d))
    rows += [(i, t, "r") for i, t, _ in rows[:150]] + [(None, None, "r"), (9999, " \n\t", "r")]
    labels += [(5, None), (None, "x"), (7, "unknown"), (123456, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    return docs, spark.createDataFrame(labels, "doc_id long, domain string")


def best(p, n, targets, ridge, rounds=200_000):
    """Plain projected gradient over single documents, to convergence."""
    share = n / n.sum()
    cells, at = np.unique(p, axis=0, return_inverse=True)
    weight = np.bincount(at.ravel(), weights=share)
    r = np.ones(len(cells))
    for _ in range(rounds):
        gap = (weight * r) @ cells - targets
        new = np.maximum(0, r - 0.49 * (2 * cells @ gap + 2 * ridge * (r - 1)))
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return r[at.ravel()]


def test_rates_are_the_least_squares_solution(spark):
    docs, labels = corpus(spark)
    mixed = mixing.mix(docs, labels, TARGETS, ridge=0.01, iterations=300, tolerance=1e-10)
    got = mixed.toPandas()
    p = np.stack(got["posterior"].to_numpy())
    n = got["n_tokens"].to_numpy(dtype=float)
    assert mixed.columns == ["doc_id", "text", "n_tokens", "posterior", "rate"] and len(got) == docs.count()
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert (got["n_tokens"] == [len((t or "").split()) for t in got["text"]]).all()
    want = best(p, n, np.array([0.5, 0.3, 0.2]), 0.01)
    assert np.allclose(got["rate"], want, atol=2e-3)
    totals = (got["rate"].to_numpy() * n) @ p / n.sum()
    assert np.allclose(totals, [0.5, 0.3, 0.2], atol=0.02)


def test_classifier_on_unlabelled_documents(spark):
    docs, labels = corpus(spark)
    got = mixing.mix(docs, labels, TARGETS, keep=["doc_id", "text"]).where("doc_id % 2 = 0 AND n_tokens >= 20").collect()
    right = 0
    for r in got:
        letters = [w[0] for w in r["text"].split()]
        right += max(TARGETS, key=letters.count) == list(TARGETS)[int(np.argmax(r["posterior"]))]
    assert right / len(got) > 0.95


def test_without_labels_tokens_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix(docs, none, {"x": 1.0, "y": 1.0}).collect()
    assert all(r["posterior"] == [0.5, 0.5] and r["rate"] == pytest.approx(1) for r in got)
    empty = mixing.mix(docs.where("doc_id = 2"), none, TARGETS).first()
    assert (empty["n_tokens"], empty["rate"]) == (0, 1.0)
    assert mixing.mix(docs.limit(0), none, TARGETS).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, none, {"x": 0.0})


def test_native_plan(spark):
    docs, labels = corpus(spark, 20)
    plan = mixing.mix(docs, labels, TARGETS).withColumn("f", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rare_domain_with_production_values(spark):
    """One document of 200 holds the third domain: it must be scaled up by several times."""
    rows = [(i, " ".join(f"{d}{(i + k) % 30}" for k in range(50))) for i, d in enumerate("x" * 150 + "y" * 49 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, t[0]) for i, t in rows], "doc_id long, domain string")
    targets = {"x": 0.85, "y": 0.12, "z": 0.03}
    mixed = mixing.mix(docs, labels, targets)
    got = mixed.toPandas()
    p, n = np.stack(got["posterior"].to_numpy()), got["n_tokens"].to_numpy(dtype=float)
    want = best(p, n, np.array(list(targets.values())), mixing.RIDGE)
    assert np.allclose(got["rate"], want, atol=2e-2)
    totals = (want * n) @ p / n.sum()
    shares = mixing.reached(mixed, targets)
    assert np.allclose([shares[d][1] for d in targets], totals, atol=1e-4) and [shares[d][0] for d in targets] == [0.85, 0.12, 0.03]
    assert shares["z"][1] == pytest.approx(0.0258, abs=3e-4)


def test_small_posteriors_are_kept(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(198)] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "x") for i in range(198)], "doc_id long, domain string")
    got = mixing.mix(docs, labels, {"x": 0.5, "y": 0.5}).where("doc_id = 500").first()
    assert got["posterior"] == pytest.approx([199 / 200, 1 / 200], abs=1e-4)


def test_a_fit_that_does_not_converge_says_so(spark):
    docs, labels = corpus(spark, 50)
    with pytest.raises(RuntimeError):
        mixing.mix(docs, labels, {"x": 0.1, "y": 0.1, "z": 0.8}, iterations=0)
