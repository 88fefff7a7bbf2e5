import hashlib

import numpy as np
import pytest

from keelson.llm import suffix_dedup as S


def plain(rows, length):
    """Per row: (n_bytes, n_removed, n_spans, sha256 of what is left), by a table of all windows."""
    place = lambda d: S.LAST if d is None else d
    first = {}
    texts = [(place(d), (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (d, i):
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((None if d == S.LAST else d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, length, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(
        (
            (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
            for r in S.dedup(docs, length, **more).collect()
        ),
        key=str,
    )


def corpus(rng, n, parts, alphabet):
    word = lambda: "".join(rng.choice(alphabet, rng.integers(2, 9)))
    passages = [" ".join(word() for _ in range(rng.integers(3, 40))) for _ in range(parts)]
    texts = []
    for _ in range(n):
        text = " ".join([passages[rng.integers(parts)] if rng.random() < 0.5 else word() for _ in range(rng.integers(1, 14))])
        texts.append(text)
        if rng.random() < 0.3:
            at = int(rng.integers(len(text) + 1))
            texts.append(text[:at] + "é" + text[at + 1 :])
    ids = rng.permutation(len(texts) * 3)[: len(texts)]
    return [(int(i), t) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("length,hot,alphabet", [(100, 20_000, "abcdefgh"), (100, 3, "abcdefgh"), (12, 20_000, "ab"), (12, 4, "ab")])
def test_equals_brute_force(spark, monkeypatch, length, hot, alphabet):
    monkeypatch.setattr(S, "BLOCK", 700)
    monkeypatch.setattr(S, "CHUNK", 64)
    rows = corpus(np.random.default_rng(length + hot), 60, 9, list(alphabet))
    assert ours(spark, rows, length, hot=hot) == plain(rows, length)


def test_edge_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "a" * 99), (4, "a" * 5000), (5, "a" * 101), (6, "xyz" * 200), (6, "xyz" * 200),
        (7, "xyz" * 200), (None, "xyz" * 50), (None, "q" * 150), (8, "q" * 120), (9, "é" * 60), (10, "é" * 60), (3, "b" * 300),
    ]
    assert ours(spark, rows, 100) == plain(rows, 100)
    assert ours(spark, rows[:0], 100) == []


def test_a_long_text_is_hashed_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 30_000).astype(np.uint8))
    whole = S.Anchors(100).find([text])
    monkeypatch.setattr(S, "_MOST", 1000)
    parts = [np.concatenate(x) for x in zip(*S._found(S.Anchors(100), [text]))]
    assert parts[4].sum() == whole[4].sum() == 30_000 - 99
    windows = lambda h, first, place, n: {(int(f + k), int(a), int(p - k)) for a, f, p, c in zip(h, first, place, n) for k in range(c)}
    assert windows(*parts[1:]) == windows(*whole[1:])


def test_order_is_the_order_of_strings():
    rng = np.random.default_rng(4)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8)) for _ in range(777)]
    x = S.Suffixes(strings)
    assert [strings[i] for i in x.order()] == sorted(strings)
    assert list(x.order()) == sorted(range(777), key=strings.__getitem__)
    place, reach = x.classes()
    rows = np.argsort(place)
    for k in range(1, 777):
        a, b = strings[rows[k - 1]], strings[rows[k]]
        assert reach[k] == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_colliding_hashes_are_noticed(monkeypatch):
    rng = np.random.default_rng(6)
    strings = [bytes(rng.integers(97, 99, 12).astype(np.uint8)) for _ in range(300)]
    good = S.Suffixes(strings)
    bad = S.Suffixes(strings)
    bad.hashes &= np.uint64(3)  # nearly all collide
    (p, r), (q, t) = good.classes(), bad.classes()
    assert (r == t).all() and [strings[i] for i in np.argsort(p)] == [strings[i] for i in np.argsort(q)]


def test_only_strings_of_a_group_are_compared(monkeypatch):
    rng = np.random.default_rng(8)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8)) for _ in range(900)]
    group = np.sort(rng.integers(-300, 300, 900))
    met = []
    common = S.Suffixes.common
    monkeypatch.setattr(S.Suffixes, "common", lambda x, a, b: met.append((a, b)) or common(x, a, b))
    x = S.Suffixes(strings, group)
    place, reach = x.classes()
    rows = np.argsort(place)
    assert list(rows) == sorted(range(900), key=lambda i: (group[i], strings[i]))
    a, b = (np.concatenate(side) for side in zip(*met))
    assert (group[a] == group[b]).all()
    assert (reach[np.flatnonzero(np.append(True, np.diff(group) > 0))] == 0).all()
    met.clear()
    S.Suffixes(strings, np.arange(900)).classes()
    assert sum(len(a) for a, _ in met) == 0
