import itertools

import numpy as np
import pytest

from keelson.llm import near_dedup as N
from keelson.llm.decontaminate import words_of


def labelled(words):
    seen, out = {}, []
    width = min(N.SHINGLE, len(words))
    for i in range(len(words) - width + 1 if words else 0):
        k = tuple(words[i : i + width])
        seen[k] = seen.get(k, -1) + 1
        out.append((k, seen[k]))
    return out


def plain_similarity(a, b):
    """Longest common subsequence of labelled k-mers over all k-mers, without a band."""
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    n = table[-1, -1]
    return n / max(1, len(a) + len(b) - n)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = int(rng.integers(len(words)))
        kind = rng.integers(4)
        if kind == 0:
            words[at] = f"new{rng.integers(1000)}"
        elif kind == 1:
            del words[at]
        elif kind == 2:
            words.insert(at, f"more{rng.integers(1000)}")
        else:
            words[at : at + 6] = words[at : at + 6][::-1]
    return words


def test_similarity_equals_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a = [f"w{x}" for x in rng.integers(0, 12 if rng.random() < 0.5 else 500, rng.integers(1, 90))]
        b = edited(rng, a, rng.integers(0, 4)) or ["x"]
        x, y = (N.kmers(N.word_numbers([w.encode() for w in ws])) for ws in (a, b))
        got, want = N.similarity(x, y), plain_similarity(labelled(a), labelled(b))
        assert (got >= N.LEAST) == (want >= N.LEAST) and (not got or got == pytest.approx(want))


def test_sketches_take_the_least_in_text_order(monkeypatch):
    x = N.kmers(np.arange(5000, dtype=np.uint32))
    whole = N.sketches(x)
    monkeypatch.setattr(N, "MOST_CELLS", N.TABLES * 100)
    assert (N.sketches(x) == whole).all()
    for t in (0, 7):
        places = np.sort(np.argsort(N._mix(x ^ N._SEEDS[t]))[: N.KEEP])
        out = N._SEEDS[t : t + 1].copy()
        for p in places:
            out = N._mix(out * N._MULTIPLY + x[p])
        assert out.view(np.int64)[0] == whole[t]
    assert (N.sketches(x[::-1]) != whole).any()


def components(texts):
    ids = sorted(texts)
    label = {i: i for i in ids}
    kms = {i: labelled(words_of(texts[i])) for i in ids}
    sets = {i: set(k) for i, k in kms.items()}
    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])  # labelled k-mers differ, so no alignment has more
        most = both / max(1, len(kms[a]) + len(kms[b]) - both)
        if most >= N.LEAST and plain_similarity(kms[a], kms[b]) >= N.LEAST:
            old, new = sorted((label[a], label[b]), reverse=True)
            label = {i: new if v == old else v for i, v in label.items()}
    return label


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts, at = {}, 0
    for _ in range(14):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(6, 130))]
        for _ in range(rng.integers(1, 7)):
            texts[at] = " ".join(edited(rng, base, rng.integers(0, 3)))
            at += 1
    shared = [f"s{x}" for x in range(60)]
    for _ in range(6):
        texts[at] = " ".join([*(f"u{x}" for x in rng.integers(0, 10**6, 60)), *shared])
        at += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert got == components(texts)


def test_edge_rows(spark):
    long = " ".join(f"w{x}" for x in range(30_000))
    rows = [
        (1, None, "a"), (2, None, "a"), (3, "", "b"), (4, " ", None), (5, "One two.", "b"), (6, "one  TWO", "b"),
        (7, "one two three", "b"), (8, long, "c"), (9, long + " tail", "c"), (9, long + " tail", "c"),
        (None, "one two", "d"), (10, "x y z", "e"), (10, "another text", "e"), (11, "another text", "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, class_id string")
    got = N.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {
        1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10, 11: 10, None: None,
    }
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 10]
    assert N.classes(docs.filter("doc_id = -1")).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(300)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (9999, "quite another text of more than five words")], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert sum(v == 0 for v in got.values()) >= 598 and got[9999] == 9999


def test_pairs_in_large_buckets_are_all_found(spark):
    """One template, its texts about 0.7 alike; only the planted pairs reach 0.8."""
    rng = np.random.default_rng(31)
    base, texts = [f"w{x}" for x in range(300)], []
    for i in range(360):
        words = list(base)
        for at in np.arange(5, 300, 60) + rng.integers(0, 50, 5):
            words[at] = f"u{rng.integers(10**9)}"
        texts.append(words)
        if i % 30 == 0:
            texts.append([*words[:-1], f"end{i}"])
    km = [N.kmers(N.word_numbers([w.encode() for w in t])) for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if N.similarity(km[a], km[b]) >= N.LEAST:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if v == old else v for v in label]
    assert len(texts) - 40 <= len(set(label)) <= len(texts) - 12
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_rows_to_keep_are_found_by_the_same_join_at_every_size(spark):
    rng = np.random.default_rng(31)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(500)], 30)) for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(texts + texts[:5]), (None, "x")], "doc_id bigint, text string")
    kept = N.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == list(range(20)) and kept.count() == 21
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
