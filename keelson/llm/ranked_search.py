"""Ranked search over K2-treaps: quadtrees of the term-document grid that keep the greatest impacts on top.

The index is a table with a row per block of documents. A block's grid has a row per term (frequent
ones first) and a column per document (short ones first); a cell holds the impact of the term in the
document. The grid is cut in four again and again. The node of a square takes the square's greatest
cell, which then leaves the squares below, so there is one node per cell; a square without cells has
no node. Stored are, level by level, four bits per node for its children, the difference of its impact
to its parent's, and its cell's place inside the square, in the fewest bytes that hold a level.

An item is searched in all blocks. Its terms go down together, best first, over halves of document
ranges: for each term the node on the term's row path bounds what the range can still add, cells met
on the way are exact, and a range whose bound falls below the lowest score kept is left. A range
without nodes below has its exact scores. Each task keeps the best documents of an item over all its
blocks. One block in FIRST is searched before the others: the lowest of its best scores is a floor
for the rest, under which nothing can enter the result. The best of all tasks are the result.

Terms: maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased. Null or empty text
has none: such a document is not counted, such an item finds nothing. Repeated rows of documents are
documents of their own, repeated items are answered one by one, a null doc_id comes last among equal
scores. Extra columns are ignored; an empty table gives no rows. A block holds BLOCK_CELLS cells and
one document more at most. Items are read in rounds of ROUND_TERMS terms, so neither the driver nor a
broadcast holds more than a round.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import ONE_BY_ONE, materialise, slim
from keelson.llm.decontaminate import words_of

TOP = 50
BLOCK_CELLS = 2_000_000
STEP = 1 << 16  # cells whose impacts are computed together
ROUND_TERMS = 200_000
FIRST = 8
BATCH = 64  # document ranges opened at once

GRID = "ids array<bigint>, lengths array<bigint>, terms array<binary>, df array<int>, cells binary"
INDEX = "turn int, ids array<bigint>, terms array<binary>, height int, tree binary"
FOUND = "item int, doc_id bigint, score bigint"

_BITS = np.array([bin(x).count("1") for x in range(16)], np.int64)


# ---- the grid of a block


def _grid_row(ids, lengths, parts, known) -> list[pa.Array]:
    """``parts`` holds each document's term numbers in text order, ``known`` the terms by number."""
    order = np.argsort(lengths, kind="stable")
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    cells = np.repeat(column * len(known), lengths)
    at = 0
    for i, numbers in enumerate(parts):
        cells[at : at + len(numbers)] += numbers
        at += len(numbers)
        parts[i] = None  # a block's arrays are its task's memory: each goes when it was used
    cells.sort()
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    tf = np.diff(np.append(starts, len(cells))).astype("<i4")
    cells = cells[starts]
    del starts
    column = (cells // len(known)).astype("<i4")
    cells -= column * np.int64(len(known))
    term = cells.astype("<i4")
    del cells
    df = np.bincount(term, minlength=len(known))
    by_df = np.argsort(-df, kind="stable")
    row = np.empty(len(known), np.int64)
    row[by_df] = np.arange(len(known))
    terms = list(known)
    stacked = np.stack([row.astype("<i4")[term], column, tf])
    del term, column, tf
    return [
        pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
        pa.array([np.asarray(lengths)[order]], pa.list_(pa.int64())),
        pa.array([[terms[i] for i in by_df]], pa.list_(pa.binary())),
        pa.array([df[by_df]], pa.list_(pa.int32())),
        _one(stacked),
    ]


def _one(data) -> pa.Array:
    """An array of one binary value, which is not copied."""
    held = pa.py_buffer(data)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, held.size], "<i4")), held])


def grids(docs: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """The term-document grids of ``docs`` (doc_id, text), a row per block."""
    names = [f.split()[0] for f in GRID.split(", ")]

    def run(batches):
        fresh = lambda: ([], [], [], defaultdict(count().__next__), 0)
        ids, lengths, parts, known, held = fresh()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                numbers = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                ids.append(doc)
                lengths.append(len(words))
                parts.append(numbers)
                held += len(words)
                if held >= block_cells:
                    yield pa.RecordBatch.from_arrays(_grid_row(ids, lengths, parts, known), names=names)
                    ids, lengths, parts, known, held = fresh()
        if ids:
            yield pa.RecordBatch.from_arrays(_grid_row(ids, lengths, parts, known), names=names)

    return slim(docs, "doc_id", "text").mapInArrow(run, GRID)


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of a term's weight adds to a document's score."""
    m = 50 + 50 * lengths * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


# ---- the tree


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each number with a zero before each bit."""
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & keep
    return x


def _gathered(x: np.ndarray) -> np.ndarray:
    x = x & 0x5555555555555555
    for shift, keep in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF),
                        (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> shift)) & keep
    return x


def _packed(x: np.ndarray) -> bytes:
    """The width in bytes, then the numbers in that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def tree_of(row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int) -> bytes:
    """The K2-treap of cells in a square of side 2^height; values are below 2^31."""
    code = _spread(row.astype(np.int64))
    code <<= 1
    code |= _spread(column.astype(np.int64))
    order = np.argsort(code)
    code, value = code[order], value[order]
    del order
    out, square, above = [], None, None
    for level in range(height + 1):
        own = code >> (2 * (height - level))
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
        if level and len(square):  # which children the squares of the level before have
            parent = np.searchsorted(square, own[starts] >> 2)
            mask = np.bincount(parent, 1 << (own[starts] & 3), len(square)).astype(np.uint8)
            out.append(np.packbits(np.unpackbits(mask[:, None], axis=1)[:, 4:]).tobytes())
        if not len(starts):
            break
        best = value.astype(np.int64) << 32
        best |= np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(value), -1)
        best = np.maximum.reduceat(best, starts)
        best = 0xFFFFFFFF - (best & 0xFFFFFFFF)
        top = value[best]
        out.append(len(top).to_bytes(8, "little"))
        out.append(_packed(top if above is None else above[np.searchsorted(square, own[starts] >> 2)] - top))
        out.append(_packed(code[best] - (own[starts] << (2 * (height - level)))))
        square, above = own[starts], top
        left = np.ones(len(code), bool)
        left[best] = False
        code, value = code[left], value[left]
    return b"".join(out)


class Tree:
    """A stored K2-treap, its levels one after the other: children, first child, row, column and value."""

    def __init__(self, data, height: int):
        data, self.height = memoryview(data), height
        at, square, value, kids = 0, np.zeros(1, np.int64), None, None
        masks, codes, values = [], [], []

        def numbers(n):
            nonlocal at
            width = data[at]
            x = np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64)
            at += 1 + n * width
            return x

        level = 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            at += 8
            less = numbers(n)
            value = less if value is None else value[kids] - less
            codes.append((square << (2 * (height - level))) + numbers(n))
            values.append(value)
            if level == height:
                masks.append(np.zeros(n, np.uint8))
                break
            size = (n + 1) // 2
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[: 4 * n].reshape(n, 4)
            at += size
            masks.append(bits @ np.array([8, 4, 2, 1], np.uint8))
            kids, q = np.nonzero(bits[:, ::-1])
            square = square[kids] * 4 + q
            level += 1
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        self.row, self.column = (join([_gathered(c >> s).astype(np.int32) for c in codes]) for s in (1, 0))
        self.mask, self.value = join(masks).astype(np.uint8), join(values).astype(np.int32)
        n_kids = _BITS[self.mask]
        self.first = (1 + np.cumsum(n_kids) - n_kids).astype(np.int32)
        # The greatest value under each node: its children's, as each square's greatest is on top.
        self.below = np.zeros(len(n_kids), np.int32)
        inner = np.flatnonzero(n_kids)
        if len(inner):
            self.below[inner] = np.maximum.reduceat(self.value, self.first[inner])


class Best:
    """The greatest (score, -column order) of one item, and the lowest score that still counts."""

    def __init__(self, top: int, floor: int = 1):
        self.top, self.floor, self.heap = top, floor, []  # ``floor``: a score known to be enough

    @property
    def least(self) -> int:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.top else self.floor

    def add(self, score: int, doc) -> None:
        key = (score, doc is not None, -(doc or 0))  # equal scores: the smaller id, null last
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, key)
        elif key > self.heap[0]:
            heapq.heapreplace(self.heap, key)

    def rows(self):
        return [(-d if has else None, s) for s, has, d in self.heap]


def search(tree: Tree, rows: np.ndarray, weights: np.ndarray, ids, best: Best) -> int:
    """Adds the block's best documents for the terms in ``rows`` to ``best``; returns ranges opened."""
    if not len(rows) or not len(tree.mask):
        return 0
    k, h = len(rows), tree.height
    every = np.arange(k)
    met = every[rows == tree.row[0]]
    root = (every if tree.mask[0] else every[:0], np.zeros(k if tree.mask[0] else 0, np.int64),
            met, np.full(len(met), tree.column[0], np.int64), np.full(len(met), tree.value[0], np.int64))
    queue, turn, opened = [(0, 0, 0, root)], 0, 0
    while queue:
        batch = []
        while queue and len(batch) < BATCH:
            bound, _, level, state = heapq.heappop(queue)
            if -bound < best.least and opened:
                queue = []
                break
            if len(state[0]):
                batch.append((level, state))
            else:  # nothing below: the cells met are whole scores
                docs, of = np.unique(state[3], return_inverse=True)
                for d, s in zip(docs.tolist(), np.bincount(of, weights[state[2]] * state[4].astype(np.int64)).astype(np.int64).tolist()):
                    if s >= best.least:
                        best.add(s, ids[d])
        if not batch:
            continue
        opened += len(batch)
        shift = h - 1 - np.array([level for level, _ in batch], np.int64)
        sizes = [len(s[0]) for _, s in batch]
        n_met = [len(s[2]) for _, s in batch]
        term, node, m_term, m_doc, m_value = (np.concatenate([s[i] for _, s in batch]) for i in range(5))
        of, m_of = np.repeat(np.arange(len(batch)), sizes), np.repeat(np.arange(len(batch)), n_met)
        half = (rows[term] >> shift[of]) & 1
        s_of, s_term, s_node = [], [], []
        for side in (0, 1):
            q = 2 * half + side
            mask = tree.mask[node].astype(np.int64)
            has = np.flatnonzero((mask >> q) & 1)
            s_of.append(2 * of[has] + side)
            s_term.append(term[has])
            s_node.append(tree.first[node[has]] + _BITS[mask[has] & ((1 << q[has]) - 1)])
        of, term, node = np.concatenate(s_of), np.concatenate(s_term), np.concatenate(s_node)
        hit = tree.row[node] == rows[term]
        m_of = np.concatenate([2 * m_of + ((m_doc >> shift[m_of]) & 1), of[hit]])
        m_term = np.concatenate([m_term, term[hit]])
        m_doc = np.concatenate([m_doc, tree.column[node[hit]]])
        m_value = np.concatenate([m_value, tree.value[node[hit]]])
        alive = tree.mask[node] > 0
        of, term, node = of[alive], term[alive], node[alive]
        most = np.zeros((2 * len(batch), k), np.int64)
        np.maximum.at(most, (of, term), tree.below[node])
        np.maximum.at(most, (m_of, m_term), m_value)
        bounds = most @ weights
        order, m_order = np.argsort(of, kind="stable"), np.argsort(m_of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(2 * len(batch) + 1))
        m_cut = np.searchsorted(m_of[m_order], np.arange(2 * len(batch) + 1))
        term, node = term[order], node[order]
        m_term, m_doc, m_value = m_term[m_order], m_doc[m_order], m_value[m_order]
        for i in np.flatnonzero(bounds >= max(1, best.least)).tolist():
            a, b, c, d = cut[i], cut[i + 1], m_cut[i], m_cut[i + 1]
            turn += 1
            state = (term[a:b], node[a:b], m_term[c:d], m_doc[c:d], m_value[c:d])
            heapq.heappush(queue, (-int(bounds[i]), turn, batch[i // 2][0] + 1, state))
    return opened


# ---- the index and its questions


def build_index(grid: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The K2-treaps of all blocks of ``grid``."""

    def run(batches):
        for batch in batches:
            for ids, lengths, terms, _, cells in zip(*batch.columns):
                row, column, tf = np.frombuffer(cells.as_buffer(), "<i4").reshape(3, -1)
                own = lengths.values.to_numpy(zero_copy_only=False)
                value = np.empty(len(tf), np.int32)
                for at in range(0, len(tf), STEP):
                    part = slice(at, at + STEP)
                    value[part] = impacts(tf[part].astype(np.int64), own[column[part]], n_docs, n_terms)
                height = max(1, (max(len(own), len(terms.values)) - 1).bit_length())
                turn = int(ids[0].as_py() or 0) % FIRST
                yield pa.RecordBatch.from_arrays(
                    [pa.array([turn], pa.int32()), pa.array([ids.values], pa.list_(pa.int64())), pa.array([terms.values], pa.list_(pa.binary())),
                     pa.array([height], pa.int32()), _one(tree_of(row, column, value, height))],
                    names=["turn", "ids", "terms", "height", "tree"],
                )

    return grid.mapInArrow(run, INDEX)


def _rounds(items: DataFrame, round_terms: int):
    """Lists of (item_id, its different terms) with at most ``round_terms`` terms and one item more."""
    held, n = [], 0
    for item_id, text in slim(items, "item_id", "text").toLocalIterator():
        words = sorted(set(words_of(text)))
        if words:
            held.append((item_id, words))
            n += len(words)
        if n >= round_terms:
            yield held
            held, n = [], 0
    if held:
        yield held


def _answers(index: DataFrame, questions: list, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents for each question (terms, weights, floor)."""
    sent = index.sparkSession.sparkContext.broadcast(questions)

    def run(batches):
        found = [Best(top, floor) for _, _, floor in sent.value]
        wanted = sorted({w for words, _, _ in sent.value for w in words})
        number = {w: i for i, w in enumerate(wanted)}
        wanted = pa.array(wanted, pa.binary())
        own = [(np.array([number[w] for w in words], np.int64), weights) for words, weights, _ in sent.value]
        for batch in batches:
            for ids, terms, height, data in zip(*batch.columns):
                place = pa.compute.index_in(wanted, value_set=terms.values)
                row = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                tree, docs = Tree(data.as_buffer(), height.as_py()), ids.as_py()
                for (numbers, weights), best in zip(own, found):
                    at = row[numbers]
                    search(tree, at[at >= 0], weights[at >= 0], docs, best)
        rows = [(i, d, s) for i, best in enumerate(found) for d, s in best.rows()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
            names=["item", "doc_id", "score"],
        )

    place = F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)")
    best = index.drop("turn").mapInArrow(run, FOUND)
    return materialise(best.withColumn("rank", place).filter(F.col("rank") <= top), ONE_BY_ONE)


def _round(index: DataFrame, asked: list, weight: dict, top: int) -> DataFrame:
    """The best documents of all blocks for one round of items."""
    known = [[w for w in words if weight.get(w)] for _, words in asked]
    weights = [np.array([weight[w] for w in words], np.int64) for words in known]
    first = _answers(index.filter("turn = 0"), list(zip(known, weights, [1] * len(known))), top)
    floors = [1] * len(known)
    for item, score in first.filter(F.col("rank") == top).select("item", "score").toLocalIterator():
        floors[item] = score
    rest = _answers(index.filter("turn <> 0"), list(zip(known, weights, floors)), top)
    place = F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)")
    return first.union(rest).withColumn("rank", place).filter(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_cells: int = BLOCK_CELLS,
         round_terms: int = ROUND_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of ``docs`` for each row of ``items``."""
    spark = docs.sparkSession
    grid = materialise(grids(docs, block_cells))
    n_docs, n_terms = grid.agg(
        F.sum(F.size("ids")).cast("long"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b))
    ).first()
    kind = items.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    if not n_docs:
        return result
    index = materialise(build_index(grid, n_docs, n_terms), ONE_BY_ONE)
    counted = grid.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
    for asked in _rounds(items, round_terms):
        words = spark.createDataFrame([(w,) for w in sorted({w for _, ws in asked for w in ws})], "terms binary")
        weight = counted.join(words, "terms").groupBy("terms").agg(F.sum("df").alias("df")).select(
            "terms", F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1))).alias("w")
        )
        weight = {bytes(t): w for t, w in weight.collect()}  # of one round's terms
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asked)], f"item int, item_id {kind}")
        ranked = _round(index, asked, weight, top).join(names, "item")
        result = result.union(materialise(ranked.select("item_id", "rank", "doc_id", "score")))
    return result
