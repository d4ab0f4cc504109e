import numpy as np

from millrace.llm import quality as op
from millrace.llm.language_id import held_out

from .common import SF, documents, empty, odd


def auc(score, label):
    order = np.argsort(np.argsort(score))
    n1 = label.sum()
    return (order[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_ranking(spark):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    docs = documents(spark).sparkSession.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    out = op.classify(docs, labels.where(~held_out())).withColumn("held", held_out()).join(labels, "doc_id").toPandas()
    held = out[out.held]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert ((out.score >= 0.7) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_trees_learn_and_flat_arrays_are_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = op.fit(x[:2000], y[:2000], trees=60)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        total, inner = model.start, model.feature.shape[1]
        for t in range(len(model.feature)):
            n = 0
            while n < inner:
                n = 2 * n + (2 if row[model.feature[t, n]] > model.threshold[t, n] else 1)
            total += model.value[t, n - inner]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])


def test_degenerate_labels():
    x = np.zeros((40, 2))
    assert np.allclose(op.fit(x, np.ones(40)).score(x), 1, atol=0.01)
    assert np.allclose(op.fit(x[:0], np.zeros(0)).score(x), 0.5)


def test_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    out = op.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert op.classify(docs, labels.limit(0)).count() == docs.count()
    assert op.classify(empty(spark), labels).count() == 0
