"""Held-out accuracy, offending sentences and edge cases of the toxicity model."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from streamloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from streamloom.llm import queries

    got = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[d].score, y) for d, y in labels.items() if got[d].held_out]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    ranked = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert ranked > 0.9


def test_offending_sentences_are_located(spark):
    rng = np.random.default_rng(1)
    say = lambda: " ".join(rng.choice(["tree", "stone", "river", "cloud", "light"], 6))
    clean = [f"{say()}. {say()}! {say()}" for _ in range(80)]
    toxic = [f"{say()}. You utter fool {say()}. {say()}" for _ in range(40)]
    model = toxicity.fit(clean + toxic, [0] * 80 + [1] * 40)
    frame = spark.createDataFrame([(0, toxic[0], "x"), (1, clean[0], "x"), (2, None, "x"), (3, "", "x"), (4, "123 ...", "x"), (5, clean[1] * 2000 + "." + toxic[1], "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert [got[i].predicted for i in range(6)] == [1, 0, 0, 0, 0, 1]
    assert [toxic[0][s.start : s.end].strip()[:14] for s in got[0].offending] == ["You utter fool"]
    assert got[2].score == got[3].score == got[4].score == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(None, 1), (1, None), (2, 7)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(docs.where(F.lit(False)), model).count() == 0


def test_gradient_is_that_of_the_noisy_or_likelihood():
    texts = ["one two. bad three", "two two! one", "bad bad. four", "three four. one"] * 4
    labels = [1, 0, 1, 0] * 4
    kept, bags = toxicity.bags_of(texts, labels)
    y, weight = np.array(labels, float), np.random.default_rng(2).random(16)
    theta = np.random.default_rng(3).normal(size=len(kept) + 1)

    def likelihood(at):
        """Plainly: word by word, sentence by sentence."""
        total, of = 0.0, dict(zip(kept, at, strict=False))
        for t, label, w in zip(texts, y, weight, strict=True):
            miss = 1.0
            for _, _, words in toxicity.sentences(t):
                z = at[-1] + sum(of.get(f, 0.0) for word in words for f in toxicity.features(word))
                miss *= 1 - 1 / (1 + np.exp(-z))
            total += w * (np.log(1 - miss) if label else np.log(miss))
        return total - 0.01 / 2 * (at[:-1] ** 2).sum()

    plain = [(likelihood(theta + e) - likelihood(theta - e)) / 2e-6 for e in np.eye(len(theta)) * 1e-6]
    assert np.allclose(toxicity.gradient(theta, bags, y, weight, 0.01), plain, atol=1e-5)


def test_scores_are_those_of_a_plain_model():
    model = toxicity.Model({"=bad": 3.0, "bad": 0.5, "goo": -1.0}, -2.0)
    for text in ("", "bad. good", "Bad, bad! badly\ngood", "...", "1 2 3", "x" * 9, "bad " * 50 + "." + " good" * 3):
        plain, miss = [], 1.0
        for _, _, words in toxicity.sentences(text):
            plain.append(-2.0 + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w)))
            miss *= 1 / (1 + np.exp(plain[-1]))
        assert np.allclose(model.logits(text), plain) and abs(toxicity.noisy_or(model.logits(text)) - (1 - miss)) < 1e-9


def test_a_labelled_id_that_repeats_counts_once(spark):
    say = [f"tree stone {i}. river light" for i in range(40)]
    rows = [(i, t + (". vile words" if i % 4 == 0 else "")) for i, t in enumerate(say)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    once, often = (toxicity.train(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows + [(i, t) for i, t in rows if i % 3 == 0] * 20))
    assert once.weights and once.weights == often.weights
