import numpy as np
import pytest

from keelson.llm import langid

SAMPLES = [("en", "the thing and that was of it"), ("de", "und der die das ist nicht für"), ("fr", "les où été dans une pour")] * 5


@pytest.fixture(scope="module")
def net():
    return langid.train(SAMPLES, steps=80)


def test_gradients_equal_differences():
    net = langid.Network(["a", "b", "c"], 3)
    for w in net.weights():
        w[...] = w.astype(np.float32)
    grid, _ = next(langid._windows([b"hello w", "é1".encode(), b"zz"], 16, 16))
    truth = np.array([0, 1, 2])
    _, grads = net.gradients(grid, truth)
    rng = np.random.default_rng(0)
    for w, g in zip(net.weights(), grads):
        places = [p for p in zip(*np.nonzero(np.abs(g) > 1e-3))]
        for place in [places[i] for i in rng.integers(len(places), size=min(6, len(places)))]:
            old = w[place]
            w[place] = old + 1e-2
            up, _ = net.gradients(grid, truth)
            w[place] = old - 1e-2
            down, _ = net.gradients(grid, truth)
            w[place] = old
            assert (up - down) / 2e-2 == pytest.approx(g[place], rel=0.12, abs=2e-3)


def test_padding_and_batches_change_nothing(net, monkeypatch):
    texts = ["the thing", "", "und der die " * 40, "où", "x"]
    together = net.pooled(texts)
    monkeypatch.setattr(langid, "BATCH", 2)
    assert np.allclose(together, net.pooled(texts), atol=1e-5)
    assert np.allclose(together, [net.pooled([t])[0] for t in texts], atol=1e-5)


def test_pooling_is_the_mean_over_letter_bytes(net):
    text = "the 12 thing."
    steps = np.frombuffer(text.encode(), np.uint8).astype(np.int64)[:, None]
    p = net.label(steps)[:, 0]
    letters = [c.isalpha() for c in text]
    assert np.allclose(p[letters].mean(0), net.pooled([text])[0], atol=1e-5)


def test_rows(spark):
    rows = [(i, t, lang, 0.5) for i, (lang, t) in enumerate(SAMPLES)] + [
        (90, None, "en", 1.0), (91, "", "en", 1.0), (92, "12 $", "en", 1.0), (93, "the thing", None, 1.0),
        (93, "the thing", None, 1.0), (None, "und der", None, 1.0),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    got = langid.identify(docs, docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (90, 91, 92))
    assert all(by[i].lang_pred == lang for i, (lang, _) in enumerate(SAMPLES)) and by[93].lang_pred == "en"
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({90, 91, 92})
    none = docs.filter("doc_id = -1")
    assert none.count() == langid.identify(none, none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_without_labels_only_texts_without_a_letter_go(spark):
    rows = [(1, "the thing", None), (2, "12 $", None), (3, None, None), (4, "中文", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in langid.accepted(docs).collect()) == [1, 4]


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    from keelson.llm.queries import op8_langid

    data = "/root/testdata/sf0.01"
    got = op8_langid(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id")
    share = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.97
