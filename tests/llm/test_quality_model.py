import numpy as np
import pytest

from keelson.llm import quality_model as Q


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    d, w = rng.standard_normal((30, 5)), rng.standard_normal(5)
    _, g = Q.pair_loss(w, d)
    for k in range(5):
        step = np.eye(5)[k] * 1e-5
        assert (Q.pair_loss(w + step, d)[0] - Q.pair_loss(w - step, d)[0]) / 2e-5 == pytest.approx(g[k], abs=1e-6)


def test_preferred_documents_rank_above_and_the_quantile_cuts():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, Q.N_FEATURES))
    label = (x[:, 3] > -0.8).astype(int)
    ranker = Q.fit(x, label)
    score = ranker.score(x)
    assert ((score >= Q.ACCEPT) == label).mean() > 0.97
    assert (score >= Q.ACCEPT).sum() == label.sum()


def test_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    good, bad, w = rng.standard_normal((7, 4)), rng.standard_normal((5, 4)), rng.standard_normal(4)
    pairs = np.array([g - b for g in good for b in bad])
    n, loss, *rest = Q.pair_sums(w, good, bad)
    p = 1 / (1 + np.exp(pairs @ w))
    assert n == 35 and loss == pytest.approx(np.log1p(np.exp(-pairs @ w)).sum())
    assert np.allclose(rest[:4], -(pairs.T @ p)) and np.allclose(rest[4:], ((pairs.T * (p * (1 - p))) @ pairs).ravel())
    least = Q.newton(lambda v: Q.pair_sums(v, good, bad), 4)
    assert np.abs(Q.pair_loss(least, pairs)[1]).max() < 1e-4


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_every_labelled_document_is_learned_from(spark, monkeypatch, share):
    """More documents of a label than were once sampled: each is in a pair, and the fit equals one in memory."""
    monkeypatch.setattr(Q, "OTHERS", 16)
    rng = np.random.default_rng(4)
    n = 7000
    x = rng.standard_normal((n, Q.N_FEATURES)).astype(np.float32)
    label = (x[:, 3] + rng.standard_normal(n) > np.quantile(x[:, 3], 1 - share)).astype(int)
    rows = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "doc_id bigint, x binary")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "doc_id bigint, quality int")
    ranked = Q.labelled(rows, labels)
    assert ranked.count() == n
    counts = np.bincount(label)
    rare = int(counts.argmin())
    pairs = Q.paired(ranked, rare, -(-int(counts[rare]) // Q.RARER))
    good = {bytes(v) for r in pairs.select("good").collect() for v in r.good}
    bad = {bytes(v) for r in pairs.select("bad").collect() for v in r.bad}
    assert (len(good), len(bad)) == (label.sum(), n - label.sum())
    found, known = Q.train(ranked), Q.fit(x, label)
    assert ((found.score(x) >= Q.ACCEPT).sum()) == (known.score(x) >= Q.ACCEPT).sum() == label.sum()
    assert np.corrcoef(found.utility(x), known.utility(x))[0, 1] > 0.99


def test_rows(spark):
    texts = ["a good text with some words number %d in it" % i for i in range(20)] + ["### $$$ %%% " * i for i in range(1, 21)]
    docs = spark.createDataFrame([*enumerate(texts), (50, None), (51, ""), (52, "x"), (52, "x"), (None, "y")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None), (99, 0), (3, 1)], "doc_id bigint, quality int")
    got = Q.rate(docs, labels).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert [by[i] for i in range(40)] == [1] * 20 + [0] * 20
    assert {r.score for r in Q.rate(docs, labels.filter("quality = 1")).collect()} == {Q.ACCEPT}
    assert Q.rate(docs.filter("doc_id = -1"), labels).count() == 0


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    from keelson.llm.queries import op7_quality_model

    data = "/root/testdata/sf0.1"
    got = op7_quality_model(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.97
