import random

import numpy as np
import pandas as pd

from keelson.llm import jaccard_join


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def components(docs, num=90, den=100):
    held = [(i, shingles(t)) for i, t in docs if i is not None]
    least = {i: i for i, _ in held}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, x in held:
        for b, y in held:
            if x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((root(a), root(b)))
                least[high] = low
    return sorted((i, len(s), root(i)) for i, s in held)


def near_copies(rng, n):
    words = [f"W{i}" for i in range(400)]
    docs = []
    while len(docs) < n:
        base = rng.choices(words, k=rng.choice([1, 2, 3, 9, 14, 30, 80, 200]))
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(max(1, len(copy)))
                copy[at : at + 1] = rng.choice([[], [rng.choice(words)], [*copy[at : at + 1], rng.choice(words)]])
            docs.append((len(docs) * 3 % 1009, " ".join(copy)))
    return docs


def test_hashed_sets_are_the_sets():
    texts = [b"a b c a b c a", b"", b"x", b"x y", b" \n", b"one\ttwo\x0bthree four", b"z " * 3000, b"\xc3\xa9 " + b"q" * 5000 + b" r"]
    of, h = jaccard_join.shingle_hashes(texts)
    counts = np.bincount(of, minlength=len(texts)).tolist()
    assert counts == [len(shingles(t.decode())) for t in texts]
    alone = np.concatenate([jaccard_join.shingle_hashes([t])[1] for t in texts])
    assert (alone == h).all()
    jaccard_join.CHUNK, before = 64, jaccard_join.CHUNK
    try:
        assert (jaccard_join.shingle_hashes(texts)[1] == h).all()
    finally:
        jaccard_join.CHUNK = before


def test_components_equal_brute_force_at_any_allocation(spark):
    rng = random.Random(7)
    docs = near_copies(rng, 320)
    docs += [(2000, None), (2001, ""), (2002, " \n "), (docs[5][0], docs[80][1]), (2003, docs[9][1]), (2003, docs[9][1]), (2004, "v " * 20_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in [*docs, (None, docs[0][1])]], "doc_id bigint, text string, n int, band string").repartition(3)
    for costs in ((4.0, 1.0), (1e6, 1e-6)):  # the second exchanges whatever it can
        got = jaccard_join.components(frame, pair_cost=costs[0], row_cost=costs[1])
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        rows = [tuple(r) for r in got.collect()]
        assert [r for r in rows if r[0] is None] == [(None, len(shingles(docs[0][1])), None)]
        assert sorted(r for r in rows if r[0] is not None) == components(docs)
    assert jaccard_join.components(frame.filter("doc_id = -1")).count() == 0


def test_large_bucket_of_unlinked_texts_loses_no_link(spark):
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(120):  # texts of one template, some of which link
        copy = list(base)
        for _ in range(rng.randrange(4, 9)):
            copy[rng.randrange(200)] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    got = jaccard_join.components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == components(docs)


def test_exchange_keeps_the_sum_of_thresholds():
    loads = pd.DataFrame({"band": 4, "segment": range(6), "sets": 10, "shingles": 30.0, "pairs": [5.0, 900.0, 0.0, 40.0, 800.0, 7.0]})
    found = jaccard_join.allocate(loads, 1.0, 1.0)
    assert found["apart"].sum() == len(found) and set(zip(found["segment"], found["apart"])) == {(1, 0), (2, 2), (4, 0), (0, 2)}
    assert not len(jaccard_join.allocate(loads, 0.01, 1.0))
