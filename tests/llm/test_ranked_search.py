import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from keelson.llm import common, ranked_search
from keelson.llm.decontaminate import words_of


def test_trees_hold_their_cells_and_find_the_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n_terms, n_docs = rng.integers(1, 40), rng.integers(1, 30)
        pick = rng.choice(n_terms * n_docs, rng.integers(1, n_terms * n_docs + 1), replace=False).astype(np.int64)
        row, column = np.divmod(pick, n_docs)
        value = rng.integers(1, 50, len(pick)).astype(np.int64)
        height = max(1, int(max(n_terms, n_docs) - 1).bit_length())
        tree = ranked_search.Tree(ranked_search.tree_of(row, column, value, height), height)
        assert sorted(zip(tree.row, tree.column, tree.value)) == sorted(zip(row, column, value))
        grid = np.zeros((n_terms, n_docs), np.int64)
        grid[row, column] = value
        rows = rng.choice(n_terms, rng.integers(1, n_terms + 1), replace=False).astype(np.int64)
        weights = rng.integers(1, 9, len(rows)).astype(np.int64)
        best = ranked_search.Best(5)
        ranked_search.search(tree, rows, weights, list(range(n_docs)), best)
        scores = (grid[rows] * weights[:, None]).sum(0).tolist()
        assert sorted((-s, d) for d, s in best.rows()) == sorted((-s, d) for d, s in enumerate(scores) if s)[:5]


def expected(docs, items, top):
    docs = [(i, Counter(words_of(t))) for i, t in docs if words_of(t)]
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * len(docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                for w in set(words_of(text)) if w in c
            )
            scores.append((-score, i is None, i or 0, i))
        best = sorted(s for s in scores if s[0])[:top]
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(best)]
    return out


def test_ranks_equal_brute_force_over_blocks_rounds_and_odd_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "中文"]
    text = lambda n: " ".join(rng.choices(words, range(len(words), 0, -1), k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(900, docs[3][1]), (900, docs[3][1]), (None, docs[3][1]), (901, None), (902, "  ,;"), (903, "w1 " * 30_000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(25, None), (26, "unseen"), (None, "W3 w59"), (3, "w7, w7")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = ranked_search.rank(frame, asked, 7, block_cells=900, round_terms=40)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(docs, items, 7), key=key)
    assert ranked_search.rank(frame.filter("doc_id = -1"), asked).count() == 0
    assert ranked_search.rank(frame, asked.filter("item_id = -1")).count() == 0


def test_a_block_is_made_in_little_memory_and_read_alone(spark):
    rng = np.random.default_rng(2)
    known = {b"%d" % i: i for i in range(5000)}
    parts = [rng.integers(0, 5000, 1000).astype(np.int32) for _ in range(400)]
    whole = np.stack([np.bincount(p, minlength=5000) for p in parts])
    tracemalloc.start()
    ids, _, terms, df, cells = ranked_search._grid_row(list(range(400)), [1000] * 400, parts, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 400_000  # bytes a word; twice that before
    row, column, tf = np.frombuffer(cells[0].as_buffer(), "<i4").reshape(3, -1)
    number = np.array([known[t.as_py()] for t in terms[0].values])
    assert (whole[column, number[row]] == tf).all() and len(tf) == (whole > 0).sum()
    assert (df[0].values.to_numpy() == (whole > 0).sum(0)[number]).all()

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    names = list(common.ONE_BY_ONE)
    before = [spark.conf.get(n, None) for n in names]
    sizes = common.materialise(spark.range(0, 9, 1, 2).mapInArrow(rows, "n bigint"), common.ONE_BY_ONE)
    assert [r.n for r in sizes.collect()] == [1] * 9 and [spark.conf.get(n, None) for n in names] == before
