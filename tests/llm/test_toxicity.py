import zlib

import numpy as np

from quillspark.llm import toxicity


def test_held_out_rows(spark, data):
    rows = toxicity.op8_toxicity(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in label]
    bad, good = ([r["score"] for r in rows if label[r["doc_id"]] == k] for k in (1, 0))
    assert np.mean(np.array(bad) >= 0.5) > 0.75
    assert np.mean(np.array(good) >= 0.5) < 0.02


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_odd_tables(spark, docs_of):
    texts = ["you are vile scum"] * 40 + ["a kind word for all"] * 40 + [None, "", "scum " * 20_000]
    df = docs_of(texts)
    labels = labelled(spark, [(k, 1, int(k < 40)) for k in range(80)] + [(3, 1, None), (3, 1, 0), (3, 1, 1)])
    rows = {r["doc_id"]: r for r in toxicity.score(spark, df, labels).collect()}
    assert len(rows) == 83
    assert rows[1]["predicted"] == 1 and rows[50]["predicted"] == 0 and rows[80]["predicted"] == rows[81]["predicted"] == 0
    assert toxicity.without_toxic(spark, df, labels).columns == df.columns
    for few in ([], [(1, 1, 0)], [(1, 1, 1)]):
        assert {r["score"] for r in toxicity.score(spark, df, labelled(spark, few)).collect()} == {0.0}
    assert toxicity.score(spark, docs_of([]), labels).count() == 0


def test_label_model_equals_brute_force():
    """Posteriors against the joint rates of all votes, written out voter by voter."""
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.25
    first = np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.05)
    echo = np.where(rng.random(4000) < 0.9, first, rng.random(4000) < 0.1)  # depends on the first, not on the class
    good = np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.02)
    votes = np.column_stack([first, echo, good, rng.random(4000) < 0.1])
    model = toxicity.LabelModel(votes)
    given = np.where(rng.random(4000) < 0.1, ~y, y)  # labels with errors
    model.maximise(given.astype(float))
    assert model.parent[1] == 0 or model.parent[0] == 1
    post = model.posterior(votes)
    for k in range(50):
        joint = []
        for c, p in ((0, 1 - model.prior), (1, model.prior)):
            for i, up in enumerate(model.parent):
                u = int(votes[k][up]) if up >= 0 else 0
                p *= model.table[c, i, u] if votes[k][i] else 1 - model.table[c, i, u]
            joint.append(p)
        assert abs(post[k] - joint[1] / sum(joint)) < 1e-9
    # the tables are the rates of pairs
    for i, up in enumerate(model.parent):
        for c in (0, 1):
            for u in (0, 1):
                at = (given == c) & (votes[:, up] == u if up >= 0 else True)
                assert abs(model.table[c, i, u] - votes[at, i].mean()) < 0.01
    assert ((post > 0.5) == y).mean() > (given == y).mean()


def test_classes_sum_to_all_votes():
    votes = np.random.default_rng(3).random((300, 3)) < 0.4
    model = toxicity.LabelModel(votes)
    model.maximise(np.arange(300) % 3 / 2)
    grid = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)], dtype=bool)
    assert abs(np.exp(model.log_joint(grid)).sum() - 1) < 1e-9


def test_training_rows_alone_teach(spark, data):
    """Labels of held-out rows change nothing."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score(spark, docs, x).collect()} for x in (labels, turned))
    assert one == two
