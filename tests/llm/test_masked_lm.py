import numpy as np
import pytest

from keelson.llm import masked_lm as M


@pytest.fixture
def net():
    return M.Network(seed=4)


def test_probabilities_of_all_words_sum_to_one(net):
    near = np.tile([[3], [M.PAD], [70], [4000]], M.WORDS)
    assert np.exp(net.log_p(near, np.arange(M.WORDS))).sum() == pytest.approx(1, abs=1e-4)


def test_a_document_scores_the_sum_over_its_words(net):
    docs = [np.array([5, 900, 4095, 5], np.uint16), np.array([], np.uint16), np.array([7], np.uint16)]
    plain = []
    for d in docs:
        padded = [M.PAD] * 2 + [int(x) for x in d] + [M.PAD] * 2
        total = 0.0
        for i in range(2, len(padded) - 2):
            pre = net.bias + sum(net.side[k][padded[i + j]] for k, j in enumerate((-2, -1, 1, 2)))
            state = np.append(pre / (1 + np.abs(pre)), 1)
            k, w = divmod(padded[i], M.CLASS)
            for logits, at in ((net.classes @ state, k), (net.words[k] @ state, w)):
                total += logits[at] - np.log(np.exp(logits).sum())
        plain.append(total)
    assert np.allclose(M.score_all(net, docs), plain, atol=1e-3)


def test_steps_follow_the_gradient(net):
    rng = np.random.default_rng(0)
    near, target = rng.integers(0, 50, (4, 64)), rng.integers(0, M.WORDS, 64)
    before = net.flat.copy()
    loss = lambda w: -M.Network(w).log_p(near, target).sum()
    net.step(near, target, 1e-3)
    moved = net.flat - before
    start = len(_side := net.side.ravel())
    for place in [int(np.argmax(np.abs(moved[:start]))), start + 3, int(start + M.HIDDEN + np.argmax(np.abs(moved[start + M.HIDDEN :])))]:
        up, down = before.astype(np.float64), before.astype(np.float64)
        up[place] += 1e-2
        down[place] -= 1e-2
        slope = loss(up.astype(np.float32)) - loss(down.astype(np.float32))
        assert moved[place] * slope < 0


def test_training_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = M.score(docs.select("doc_id", "text"))
    total = got.selectExpr("sum(log_p) / sum(n_words)").first()[0]
    known = M.vocabulary(docs)
    ids = np.concatenate([M.number(M.words_of(r.text), known) for r in docs.select("text").collect()])
    p = np.bincount(ids, minlength=M.WORDS) / len(ids)
    assert total > np.log(p[ids]).mean()


def test_rows(spark):
    rows = [(1, "a b a b"), (2, None), (3, "  "), (4, "a b a b"), (4, "a b a b"), (None, "c " * 50)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id bigint, text string, log_p double")
    got = M.score(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[2].log_p == by[3].log_p == 0 and by[1].log_p == pytest.approx(by[4].log_p)
    assert [by[k].n_words for k in (1, 2, 3, 4, None)] == [4, 0, 0, 4, 50]
    assert by[None].log_p < 0 and by[None].mean_log_p == pytest.approx(by[None].log_p / 50)
    assert M.score(docs.filter("doc_id = -1")).count() == 0


def test_the_rounds_learn_every_word_once():
    class Seen:
        targets = []

        def step(self, near, target, rate):
            self.targets += target.tolist()

    docs = [np.arange(100, dtype=np.uint16), np.array([], np.uint16), np.arange(100, 107, dtype=np.uint16)]
    for turn in range(M.ROUNDS):
        M._learn(Seen(), docs, np.random.default_rng(0), turn, M.STRIDE, M.RATE)
    assert sorted(Seen.targets) == list(range(107))


def test_training_starts_from_frequencies(net):
    counts = np.arange(M.WORDS) % 7 + 1.0
    p = np.exp(net.start(counts).log_p(np.tile([[3], [M.PAD], [70], [4000]], M.WORDS), np.arange(M.WORDS)))
    assert np.allclose(p, (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-3)


def test_rare_words_have_their_own_probability(spark, monkeypatch):
    monkeypatch.setattr(M, "TOP", 2)
    monkeypatch.setattr(M, "RARE", 1)
    docs = spark.createDataFrame([(1, "a " * 20 + "b " * 10 + "c c c d")], "doc_id bigint, text string")
    counts = M.materialise(M.word_counts(docs))
    got = {bytes(r.word): (r.n, r.bucket) for r in M.rare_words(counts, M._top(counts)).collect()}
    assert got == {b"c": (3, 0), b"d": (1, 0)}


def test_the_query_adds_each_words_share_of_its_bucket(spark):
    from collections import Counter
    from keelson.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    known, texts = M.vocabulary(docs), {r.doc_id: M.words_of(r.text) for r in docs.collect()}
    counts = Counter(w for ws in texts.values() for w in ws if w not in known)
    total = Counter()
    for w, n in counts.items():
        total[M.zlib.crc32(w) % M.RARE] += n
    share = {w: np.log(n / total[M.zlib.crc32(w) % M.RARE]) for w, n in counts.items()}
    plain = {r.doc_id: r.log_p for r in M.score(docs).collect()}
    got = {r.doc_id: r.log_p for r in QUERIES["op10_masked_lm"](spark, folder).collect()}
    assert counts and min(share.values()) < -1
    for i, words in texts.items():
        assert got[i] - plain[i] == pytest.approx(sum(share.get(w, 0) for w in words), abs=0.05 + 1e-3 * len(words))


def test_a_step_is_that_of_each_class_alone():
    rng = np.random.default_rng(9)
    near, target = rng.integers(0, M.WORDS + 1, (len(M._NEAR), 700)), rng.integers(0, M.WORDS // 9, 700)
    net, plain = M.Network(), M.Network()
    residuals, residual = [], M._residual
    try:
        M._residual = lambda logits, at: residuals.append(len(at)) or residual(logits, at)
        loss = net.step(near, target, 0.1)
    finally:
        M._residual = residual
    assert residuals == [700, 700]  # once for the classes, once for the words of all of them
    assert loss == pytest.approx(-plain.log_p(near, target).mean(), abs=1e-4)
    pre, state = plain.hidden(near)
    klass = target // M.CLASS
    for k in np.unique(klass):
        mine = np.flatnonzero(klass == k)
        d, _ = residual(state[mine] @ plain.words[k].T, target[mine] - k * M.CLASS)
        want = plain.words[k] - 0.1 * (d.T @ state[mine]) / np.sqrt(len(mine))
        assert np.allclose(net.words[k], want, atol=1e-6)
    untouched = np.setdiff1d(np.arange(M.WORDS // M.CLASS), klass)
    assert (net.words[untouched] == plain.words[untouched]).all()
    known = {b"a": 0, b"b": 1}
    numbers, rare = M._numbers([b"a", b"x", b"b", b"x"], known)
    assert rare == [b"x", b"x"] and list(numbers[[0, 2]]) == [0, 1] and numbers[1] == numbers[3] >= M.TOP
    assert len(M._numbers([], known)[0]) == 0


def test_words_told_apart_by_arrow_are_those_of_the_text(monkeypatch):
    every = "".join(f"A{chr(c)}b" for c in range(256))
    texts = [every, None, "", "  ", " Ab  cD\t", "x\u2003y \u00c4\u0130 z", "\n", "last one"] * 3
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(M, "SLICE", size)
        words, n = [], []
        for part in M._slices(M.pa.array(texts, M.pa.string())):
            own, lengths = M._split(part)
            words += own.to_pylist()
            n += lengths.tolist()
        assert n == [len(M.words_of(t)) for t in texts]
        assert words == [w for t in texts for w in M.words_of(t)]
    assert list(M._slices(M.pa.array([], M.pa.string()))) == []


def test_only_words_neither_sent_nor_single_are_joined(spark, monkeypatch):
    monkeypatch.setattr(M, "TOP", 2)
    text = "a " * 90 + "b " * 80 + "c " * 40 + "d d d e e " + " ".join(f"once{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "D d f"), (None, "c once0")], "doc_id bigint, text string")
    got = []
    for sent, rest, joined in ((0, {b"c", b"d", b"e", b"f", b"once0", b"once1"}, {b"c": 41, b"d": 5, b"e": 2, b"once0": 2}), (1, {b"d", b"e", b"f", b"once0", b"once1"}, {b"d": 5, b"e": 2, b"once0": 2}), (99, {b"no"}, {})):
        monkeypatch.setattr(M, "SENT", sent)
        _, tokens, others = M._scored(docs, 1, M.STRIDE)
        left = {bytes(w) for r in tokens.collect() for w in r.rest}
        assert (rest <= left if sent < 99 else not left) and (sent != 1 or b"c" not in left)
        assert {bytes(r.word): r.n for r in others.collect()} == joined
        got.append({r.doc_id: r.log_p for r in M.score_words(docs, 1).collect()})
    for k in (1, 2, 3, None):
        assert got[0][k] == pytest.approx(got[1][k], abs=1e-6) == pytest.approx(got[2][k], abs=1e-6)


def test_great_logits_have_finite_probabilities():
    logits = np.array([[500.0, 499.0, -500.0], [-700.0, -701.0, -702.0], [1.0, 2.0, 3.0]], np.float32)
    at = np.array([1, 0, 2])
    want = logits[np.arange(3), at] - np.logaddexp.reduce(logits.astype(float), axis=1)
    assert np.allclose(M._log_pick(logits.copy(), at), want, atol=1e-4)
    p, loss = M._residual(logits.copy(), at)
    assert np.allclose(p.sum(1), 0, atol=1e-5) and loss == pytest.approx(-want.sum(), abs=1e-3)
