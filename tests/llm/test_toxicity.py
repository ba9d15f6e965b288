"""Toxicity: features, and scores on held-out documents of a made-up language."""

import random

from pyspark.sql import functions as F

from toolwarden.llm import toxicity as X


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(300)]
    bad = ["grukkor", "zwelfix", "brathumpa", "klonkrat"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(15, 120))
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 6)):
                stem = rng.choice(bad)
                words.insert(rng.randrange(len(words)), stem + rng.choice(["", "s", "en", "isch"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, y = frames(spark, docs, labels)
    scored = X.train(d, y).score(d).join(y, "doc_id").withColumn("fold", X.fold(F.col("doc_id"))).collect()
    held = [r for r in scored if r.fold == 0]
    assert len(held) > 100 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    kept = X.keep_civil(d, y).collect()
    assert sum(dict(labels)[r.doc_id] for r in kept) < 0.1 * sum(dict(labels).values())
    assert sum(1 - dict(labels)[r.doc_id] for r in kept) > 0.97 * sum(1 - t for _, t in labels)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(500)
    d, y = frames(spark, docs, labels)
    turned = y.withColumn("toxic", F.when(X.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda t: {r.doc_id: r.score for r in X.train(d, t).score(d).collect()}
    assert score(y) == score(turned)


def test_edge_rows(spark):
    rows = [(1, None, 0.5), (2, "", None), (2, "", None), (None, "hello", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.train(docs, none).score(docs)
    assert [r.score for r in got.collect()] == [0.0] * 4 and got.columns == ["doc_id", "text", "score", "predicted"]
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert X.train(docs, one).score(docs.limit(0)).collect() == []
    long, labels = corpus(300)
    d, y = frames(spark, [*long, (5000, None), (5001, "grukkor " * 30_000)], labels)
    scores = {r.doc_id: r.score for r in X.train(d, y).score(d).collect()}
    assert len(scores) == 302 and scores[5000] is not None


def test_features():
    lexicon = {"grukkor": 3.0, "zwel~": 2.0}
    describe = X.Describer(lexicon).describe
    found = dict(zip(X.FEATURES, describe(["you GRUKKOR zwelfix g.r.u.k.k.o.r gr0kk plain!! words"])[0]))
    assert found["hit_density"] == 3 / 7 and found["hidden_hits"] == 1 / 7 and found["near_second_person"] > 0
    assert found["capital_words"] == 1 / 7 and found["exclamations"] > 0 and found["max_weight"] == 3.0
    assert describe([None, "  "]) == [[0.0] * len(X.FEATURES)] * 2
