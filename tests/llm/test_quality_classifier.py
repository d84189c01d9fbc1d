import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import quality_classifier as quality
from lakeloom.llm.queries import _table

DATA = "/root/testdata/sf0.01"


def test_labels_are_recovered_from_votes():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.8, 0.75, 0.7, 0.9])
    counts: dict[int, int] = {}
    patterns = []
    for t in truth:
        vote = np.where(rng.random(8) < 0.3, 0, 1 + np.where(rng.random(8) < right, t, not t))
        patterns.append(int((vote * 3 ** np.arange(8)).sum()))
        counts[patterns[-1]] = counts.get(patterns[-1], 0) + 1
    posterior = quality.fit_labellers(counts)
    assert np.mean([(posterior[p] > 0.5) == t for p, t in zip(patterns, truth, strict=True)]) > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = ["One text. ", "é", "another text!! " * 50, ""]
    shapes = quality._shapes(texts)
    together = quality.features([t.encode() for t in texts], shapes)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.features([t.encode()], shapes[i : i + 1])[0])


def test_held_out_accuracy_against_labels(spark):
    docs, labels = _table(spark, DATA, "documents"), _table(spark, DATA, "labels")
    got = quality.classify(docs).join(labels, "doc_id").collect()  # no label was used in training
    assert np.mean([r.kept == bool(r.quality) for r in got]) > 0.95
    clean = [r for r in got if r.quality]
    assert sum(r.kept for r in clean) / len(clean) > 0.97


def test_edge_rows(spark):
    rng = random.Random(1)
    good = " ".join(rng.choice(["the", "and", "house", "of", "garden.", "was", "in", "green"]) for _ in range(60))
    rows = [(1, None, 0.5), (2, "", 0.5), (3, good, None), (3, good, None), (None, "X!! " * 100, None), (5, "long words here " * 40000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality.classify(docs).collect()
    assert len(got) == 6 and {r.score for r in got if r.doc_id in (1, 2)} == {0.0}
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality.classify(docs.limit(0)).count() == 0
    assert quality.reject(docs).columns == docs.columns


def test_copies_do_not_fill_the_draw(spark):
    docs = _table(spark, DATA, "documents").select("doc_id", "text").where("text <> ''").dropDuplicates(["text"])
    hot = docs.orderBy("doc_id").first().text
    assert docs.count() > 500
    copies = spark.range(3000).selectExpr("-id AS doc_id").withColumn("text", F.lit(hot))
    seen = []

    def train(rows, labels):
        seen.append((rows, labels))
        return np.zeros(rows.shape[1], np.float32), 0.0

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "train", train)
        quality.fit(docs.unionByName(copies), sample=200)
        quality.fit(copies.unionByName(docs.orderBy(F.desc("doc_id"))), sample=200)
        # A draw of all: every distinct text once.
        quality.fit(docs.unionByName(copies), sample=10**6)
    (rows, labels), (again, labels_again), (all_rows, _) = seen
    # No text comes twice, though texts can look alike to the features.
    assert 100 < len(rows) <= 400 and len(all_rows) == docs.count()
    assert np.array_equal(rows, again) and np.array_equal(labels, labels_again)
