import random

import numpy as np

from tallyspark.llm import toxicity as tx

CLEAN = "green river stone quiet morning table window letter summer bread".split()


def tables(spark, n=600):
    r, docs, labels = random.Random(4), [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [r.choice(CLEAN) for _ in range(r.randrange(5, 60))]
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out(spark):
    docs, labels = tables(spark)
    rows = tx.score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and all(r["predicted"] == r["toxic"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out(tx.F.col("doc_id")), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(tx.score_toxicity(docs, labels)) == key(tx.score_toxicity(docs, flipped))


def test_edges(spark, edges, empty):
    docs, labels = tables(spark)
    model = tx.fit(docs, labels)
    rows = tx.score_toxicity(edges, labels, model=model).collect()
    assert len(rows) == edges.count() and len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert tx.score_toxicity(empty, labels).count() == 0
    nothing = labels.limit(0)
    assert all(r["score"] < 0.01 for r in tx.score_toxicity(edges, nothing).collect())
    assert tx.keep_clean(edges, nothing).columns == edges.columns and tx.keep_clean(edges, nothing).count() == edges.count()


def test_long_texts_in_runs(monkeypatch):
    text = " ".join(random.Random(1).choice(CLEAN) + str(i) for i in range(1000))
    whole = np.unique(np.concatenate([*tx.features(text)]))
    monkeypatch.setattr(tx, "WORDS", 64)
    assert set(whole) == set(np.concatenate([*tx.features(text)]))


def test_model_is_sparse(spark):
    docs, labels = tables(spark)
    model = tx.fit(docs, labels)
    assert 0 < (model.table != 0).sum() < 2000


def test_rows_come_in_order(spark):
    """Ordered by id, then by the bytes of the features, whatever the parts of the table are."""
    r = np.random.default_rng(2)
    rows = [(int(i), int(i % 2), r.integers(0, 300, int(n)).astype(np.int32).tobytes()) for i, n in zip(r.integers(0, 40, 90), r.integers(0, 6, 90))]
    got, marked = tx.in_order(spark.createDataFrame(rows, "id bigint, y int, f binary").repartition(5))
    want = sorted(rows, key=lambda x: (x[0], x[2]))
    assert [g.tobytes() for g in got] == [w[2] for w in want] and marked == [w[1] for w in want]
    assert tx.in_order(spark.createDataFrame([], "id bigint, y int, f binary")) == ([], [])
