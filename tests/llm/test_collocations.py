import random
import re
from collections import Counter, defaultdict

import numpy as np

from keelson.llm import collocations


def expected(docs, least, top):
    found, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                found[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        often = [p for p, a in f.items() if len(p) > 1 and a >= least]
        rows = []
        for p in often:
            cuts = [(2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and inside(q) and 100 * f[q] >= 80 * f[p] for q in often):
                score, _, left, rest = min(cuts)
                rows.append((-score, -f[p], " ".join(p).encode(), left, rest))
        for rank, (score, a, phrase, left, rest) in enumerate(sorted(rows)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, rest, n[lang], -score))
    return sorted(out)


def some_texts(rng, n):
    words = [f"w{i}" for i in range(30)] + ["Été", "中", "X'y", "\x1c"]
    fixed = ["new york city hall", "a b c", "salt and pepper", "yes yes yes yes yes"]
    docs = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(1, 40))]
        docs.append((rng.choice(["en", "en", "de", None]), "".join(p + rng.choice([" ", " ", "\t", ". ", "\n", ",", "  "]) for p in parts)))
    return docs


def test_phrases_equal_brute_force(spark):
    docs = some_texts(random.Random(5), 300)
    docs += [("en", None), ("fr", ""), ("fr", " .,"), ("und", "a b c"), ("xx", "long run " * 20_000), ("zz", "q" * 100_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, n int, phrase string").repartition(3)
    got = collocations.collocations(frame, least=5, top=40, block_words=700, parts_words=4000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected(docs, 5, 40)
    assert collocations.collocations(frame.filter("lang = 'none'")).count() == 0


def test_sparse_tiles_add_up_as_dense_ones(spark, monkeypatch):
    docs = some_texts(random.Random(6), 200)
    monkeypatch.setattr(collocations, "HEAD", 4)
    monkeypatch.setattr(collocations, "MERGE_CELLS", 50)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    got = collocations.collocations(frame, least=5, top=40, block_words=500, parts_words=2000)
    assert sorted(map(tuple, got.collect())) == expected(docs, 5, 40)


def test_tiles_and_sums():
    rng = np.random.default_rng(2)
    head, after = rng.integers(0, 9000, 50_000), rng.integers(0, 5000, 50_000)
    for parts in (1, 3):
        sums = {}
        for at in range(0, 50_000, 7000):
            cells, n = collocations.counted(head[at : at + 7000], after[at : at + 7000])
            tiles = collocations.tiles_of(cells, parts)
            for t in np.unique(tiles).tolist():
                sums.setdefault(t, collocations.Sums(t, parts)).add(cells[tiles == t], n[tiles == t])
        got = Counter()
        for s in sums.values():
            got.update(dict(zip(*(x.tolist() for x in s.frequent(1)))))
        assert got == Counter(((head << 32) | after).tolist())
