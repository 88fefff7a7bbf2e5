"""Phrases of two to four words that stand together, counted in tiles of a grid of ranked word ids.

Texts are cut into pieces and words, and stored as numbers in blocks of BLOCK_WORDS words. Words that
occur often enough are ranked by frequency per language; their adjacent pairs are cells of a grid of
ranks. The grid is split into tiles by octaves of both ranks: the tile of the HEAD most frequent words
is counted by direct addresses in a dense array (bincount), all others as sorted lists of cells with
counts (COO). Each block counts its own tiles and only sorted cells with counts are shuffled, to one
task per tile, which adds them in a dense array or merges the lists. By Zipf's law octaves hold about
equal shares; PARTS_WORDS further splits each tile by its rows as the corpus grows.

Cells that occur often enough are phrases. They are ranked anew and sent back to the blocks that hold
them, where the occurrences left (a phrase's rank and the words after it) make the grid of the next
length: pairs and a third word, then triples and a fourth. A phrase is never more frequent than its
parts, so nothing frequent is missed.

Scores, cuts and drops are joins of the frequent phrases by their words.

Words: A-Z lower-cased; pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs. Null or
empty text has none. A null lang is ``und``. Repeated rows count each time; documents need no id; extra
columns are ignored; an empty table gives no rows. Arithmetic is exact (decimals where 64 bits may not do).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import materialise, slim
from keelson.operators.ranking import rank_in_groups

LEAST = 30
TOP = 2000
LONGEST = 4
BLOCK_WORDS = 4_000_000
HEAD = 1 << 11  # ranks of the dense tile
PARTS_WORDS = 1 << 30  # words of the corpus for each part of a tile
MERGE_CELLS = 1 << 22  # cells held before lists are merged
TOP_PARTS = 64

BLOCKS = "block bigint, lang string, size int, tokens binary, words array<binary>, counts array<int>"
CHUNKS = "block bigint, lang string, tile bigint, cells binary, counts binary"

_END = b"."
_TABLE = bytes(
    46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of all pieces, with an _END after each piece."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . ").split() + [_END]


def _compressed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True) if size else b"", "<i4")


# ---- words


def _fresh():
    known = defaultdict(count().__next__)
    known[_END]
    return known


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words of ``docs`` (lang, text) as numbers of a block's own, a row per block and language."""
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def run(batches):
        first, turn = TaskContext.get().partitionId() << 32, 0
        held, n = defaultdict(lambda: (_fresh(), [])), 0

        def flush():
            for lang, (known, parts) in held.items():
                tokens = np.concatenate(parts)
                counts = np.bincount(tokens, minlength=len(known))
                row = [first + turn, lang, len(tokens), _compressed(tokens), list(known), counts]
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                known, parts = held[lang]
                parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                n += len(words)
                if n >= block_words:
                    yield from flush()
                    held.clear()
                    n, turn = 0, turn + 1
        yield from flush()

    return slim(docs, "lang", "text").withColumn("lang", F.coalesce("lang", F.lit("und"))).mapInArrow(run, BLOCKS)


def word_counts(stored: DataFrame) -> DataFrame:
    """(block, lang, own, word, f): each block's words but the piece end, by their own number."""
    zipped = F.arrays_zip("words", "counts")
    rows = stored.select("block", "lang", F.posexplode(zipped).alias("own", "w")).filter("own > 0")
    return rows.select("block", "lang", "own", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))


def _ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with its rank from 0 per lang, most frequent first, in ``id``."""
    key = F.concat(F.lpad((F.lit(10**18) - F.col("f")).cast("string"), 19, "0"), *order)
    ranked = rank_in_groups(df.withColumn("_order", key), ["lang"], "_order", "id")
    return ranked.withColumn("id", (F.col("id") - 1).cast("int")).drop("_order")


def sequences(stored: DataFrame, numbered: DataFrame) -> DataFrame:
    """(block, lang, size, data): the blocks' words as ranks, -1 for piece ends and rare words."""

    def run(batches):
        for batch in batches:
            out = []
            for size, tokens, own, ids in zip(*batch.columns[2:]):
                own = own.values.to_numpy()
                rank = np.full(int(own.max()) + 1, -1, np.int32)
                rank[own] = ids.values.to_numpy()
                numbers = _numbers(tokens.as_py(), size.as_py())
                inside = numbers < len(rank)
                out.append(_compressed(np.where(inside, rank[np.where(inside, numbers, 0)], -1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["block", "lang", "size", "data"])

    pairs = numbered.groupBy("block", "lang").agg(F.collect_list(F.struct("own", "id")).alias("p"))
    rows = stored.join(pairs, ["block", "lang"]).select("block", "lang", "size", "tokens", "p.own", "p.id")
    return materialise(rows.mapInArrow(run, "block bigint, lang string, size int, data binary"))


# ---- occurrences of phrases: the phrase's rank and the ranks of up to three words after it


def _starts(data: bytes, size: int) -> np.ndarray:
    """Columns (rank, next, next, next) of all word places that have a next word."""
    x = np.append(_numbers(data, size), [-1] * LONGEST)
    out = np.stack([x[k : size + k] for k in range(LONGEST)])
    return out[:, (out[0] >= 0) & (out[1] >= 0)]


def _occurrences(data: bytes, size: int, width: int) -> np.ndarray:
    """What a row holds: a block's sequence, or stored occurrences of ``width`` columns."""
    return _starts(data, size) if width == LONGEST else _numbers(data, size).reshape(width, -1)


def _octave(rank: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp(rank.astype(np.float64))[1] - (HEAD.bit_length() - 1), 0)


def tiles_of(cells: np.ndarray, parts: int) -> np.ndarray:
    """The tile of each cell (head << 32 | next); 0 to ``parts`` - 1 are those of the dense one."""
    head, after = cells >> 32, cells & 0xFFFFFFFF
    return (_octave(head) * 64 + _octave(after)) * parts + head % parts


def counted(head: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of pairs, sorted, and their counts: by address where both ranks are small, else sorted."""
    head, after = head.astype(np.int64), after.astype(np.int64)
    dense = (head < HEAD) & (after < HEAD)
    sums = np.bincount(head[dense] * HEAD + after[dense], minlength=1)
    at = np.flatnonzero(sums)
    cells, n = np.unique((head[~dense] << 32) | after[~dense], return_counts=True)
    return np.append(((at // HEAD) << 32) | (at % HEAD), cells), np.append(sums[at], n)


def chunks(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Each block's cells of each tile, sorted, with their counts."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches):
        for batch in batches:
            for block, lang, size, data in zip(*batch.columns):
                held = _occurrences(data.as_py(), size.as_py(), width)
                cells, n = counted(held[0], held[1])
                tile = tiles_of(cells, parts)
                order = np.lexsort((cells, tile))
                cells, n, tile = cells[order], n[order], tile[order]
                own, first = np.unique(tile, return_index=True)
                ends = np.append(first[1:], len(tile))
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.as_py()] * len(own), pa.int64()), pa.array([lang.as_py()] * len(own), pa.string()),
                         pa.array(own, pa.int64()),
                         pa.array([np.diff(cells[a:b], prepend=0).astype("<i8").tobytes() for a, b in zip(first, ends)], pa.binary()),
                         pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(first, ends)], pa.binary())],
                        names=names,
                    )

    return materialise(rows.select("block", "lang", "size", "data").mapInArrow(run, CHUNKS))


class Sums:
    """The counts of one tile: by address in the dense tile, else lists that are merged now and then."""

    def __init__(self, tile: int, parts: int):
        self.parts, self.dense = parts, tile < parts
        self.table = np.zeros(-(-HEAD // parts) * HEAD if self.dense else 0, np.int64)
        self.cells, self.counts, self.held, self.part = [], [], 0, tile % parts

    def add(self, cells: np.ndarray, n: np.ndarray) -> None:
        if self.dense:
            self.table[(cells >> 32) // self.parts * HEAD + (cells & 0xFFFFFFFF)] += n  # each cell once
            return
        self.cells.append(cells)
        self.counts.append(n.astype(np.int64))
        self.held += len(cells)
        if self.held >= MERGE_CELLS:
            cells, n = self.merged()
            self.cells, self.counts, self.held = [cells], [n], len(cells) // 2

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        cells, n = np.concatenate(self.cells), np.concatenate(self.counts)
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        return cells[first], np.add.reduceat(n, first)

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        if self.dense:
            at = np.flatnonzero(self.table >= least)
            return ((at // HEAD * self.parts + self.part) << 32) | (at % HEAD), self.table[at]
        cells, n = self.merged()
        return cells[n >= least], n[n >= least]


def _cells(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<i8"))


def frequent_cells(counts: DataFrame, least: int, parts: int) -> DataFrame:
    """(lang, tile, cell, f) of the cells that occur ``least`` times in all blocks."""
    names = ["lang", "tile", "cell", "f"]

    def run(batches):
        own, sums = None, None

        def rows():
            cells, n = sums.frequent(least)
            return pa.RecordBatch.from_arrays(
                [pa.array([own[0]] * len(cells), pa.string()), pa.array([own[1]] * len(cells), pa.int64()), pa.array(cells, pa.int64()), pa.array(n, pa.int64())],
                names=names,
            )

        for batch in batches:
            for lang, tile, cells, n in zip(*batch.columns):
                key = lang.as_py(), tile.as_py()
                if key != own:
                    if own:
                        yield rows()
                    own, sums = key, Sums(key[1], parts)
                sums.add(_cells(cells.as_py()), np.frombuffer(n.as_py(), "<u4"))
        if own:
            yield rows()

    dealt = counts.select("lang", "tile", "cells", "counts").repartition("lang", "tile").sortWithinPartitions("lang", "tile")
    return materialise(dealt.mapInArrow(run, "lang string, tile bigint, cell bigint, f bigint"))


def _returned(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(block, lang, known): each block's frequent cells and their ranks, by tiles."""

    def run(batches):
        own, cells, ids, table = None, [], [], None
        for batch in batches:
            for lang, tile, block, cell, rank, data in zip(*[c.to_pylist() for c in batch.columns[:5]], batch.column(5)):
                if (lang, tile) != own:
                    own, cells, ids, table = (lang, tile), [], [], None
                if block is None:
                    cells.append(cell)
                    ids.append(rank)
                    continue
                if not cells:
                    continue
                if table is None:
                    order = np.argsort(np.array(cells))
                    table = np.array(cells)[order], np.array(ids, np.int64)[order]
                mine = _cells(data.as_py())
                at = np.minimum(np.searchsorted(table[0], mine), len(cells) - 1)
                hit = table[0][at] == mine
                if hit.any():
                    pairs = np.stack([mine[hit], table[1][at[hit]]]).astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([pairs], pa.binary())],
                        names=["block", "lang", "known"],
                    )

    asked = counts.select("lang", "tile", "block", F.lit(None).cast("bigint").alias("cell"), F.lit(None).cast("int").alias("id"), "cells")
    found = phrases.select("lang", "tile", F.lit(None).cast("bigint").alias("block"), "cell", "id", F.lit(None).cast("binary").alias("cells"))
    met = asked.union(found).repartition("lang", "tile").sortWithinPartitions("lang", "tile", F.col("block").asc_nulls_first())
    rows = met.mapInArrow(run, "block bigint, lang string, known binary")
    return rows.groupBy("block", "lang").agg(F.collect_list("known").alias("known"))  # of one block's cells


def longer(rows: DataFrame, counts: DataFrame, phrases: DataFrame, width: int) -> DataFrame:
    """Occurrences of ``phrases`` that have a next word: (block, lang, size, data) of one column less."""

    def run(batches):
        for batch in batches:
            sizes, out = [], []
            for size, data, known in zip(*batch.columns[2:]):
                held = _occurrences(data.as_py(), size.as_py(), width)
                parts = [np.frombuffer(k, "<i8").reshape(2, -1) for k in known.as_py()]
                cells, ids = np.concatenate(parts, axis=1)
                order = np.argsort(cells)
                cells, ids = cells[order], ids[order]
                held = held[:, held[2] >= 0]
                own = (held[0].astype(np.int64) << 32) | held[1]
                at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
                hit = cells[at] == own
                left = np.concatenate([ids[at[hit]][None].astype(np.int32), held[2:, hit]])
                sizes.append(left.size)
                out.append(_compressed(left.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["block", "lang", "size", "data"]
            )

    met = rows.join(_returned(counts, phrases), ["block", "lang"]).select("block", "lang", "size", "data", "known")
    return materialise(met.mapInArrow(run, "block bigint, lang string, size int, data binary"))


# ---- phrases


def frequent_phrases(docs: DataFrame, least: int = LEAST, block_words: int = BLOCK_WORDS,
                     parts_words: int = PARTS_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, k, f) of all phrases of up to LONGEST words that occur ``least`` times, and (lang, n)."""
    stored = materialise(blocks(docs, block_words))
    words = word_counts(stored)
    totals = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")))
    parts = 1 + int((totals.agg(F.max("n")).first()[0] or 0) // parts_words)
    often = words.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    ranked = materialise(_ranked(often, F.decode("word", "UTF-8")))
    rows = sequences(stored, words.join(ranked.drop("f"), ["lang", "word"]).select("block", "lang", "own", "id"))
    single = ranked.select("lang", "id", F.decode("word", "UTF-8").alias("word"))
    found = [ranked.select("lang", "id", F.array(F.decode("word", "UTF-8")).alias("words"), "f")]
    for width in range(LONGEST, 1, -1):
        counts = chunks(rows, width, parts)
        cells = frequent_cells(counts, least, parts)
        cells = materialise(_ranked(cells, F.lit("-"), F.lpad(F.col("cell").cast("string"), 19, "0")))
        head, after = F.shiftright("cell", 32).cast("int"), F.col("cell").bitwiseAND(0xFFFFFFFF).cast("int")
        named = (
            cells.select("lang", "id", head.alias("head"), after.alias("after"), "f")
            .join(found[-1].select("lang", F.col("id").alias("head"), "words"), ["lang", "head"])
            .join(single.withColumnRenamed("id", "after"), ["lang", "after"])
        )
        found.append(materialise(named.select("lang", "id", F.concat("words", F.array("word")).alias("words"), "f")))
        if width > 2:
            rows = longer(rows, counts, cells, width)
    out = None
    for k, level in enumerate(found):
        level = level.select("lang", "words", F.lit(k + 1).alias("k"), "f")
        out = level if out is None else out.unionByName(level)
    return out, totals


def _wide(x):
    return x.cast("decimal(38,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, score) of the phrases of two words and more, at their lowest-scoring cut."""
    cuts = phrases.filter("k > 1").select(
        "lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    )
    cuts = cuts.withColumns(
        {"first": F.slice("words", 1, F.col("cut")), "rest": F.slice("words", F.col("cut") + 1, F.size("words"))}
    )
    part = lambda name, f: phrases.filter(F.col("k") < LONGEST).select("lang", F.col("words").alias(name), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    both = both.select("*", _wide(F.lit(2_000_000)).alias("_unit")).withColumn(
        "score", F.expr("CAST((_unit * CAST(a AS DECIMAL(19,0))) div CAST(l + r AS DECIMAL(20,0)) AS BIGINT)")
    )
    return (
        both.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
        .select("lang", "words", "a", "m.l", "m.r", "m.score")
    )


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, words, most): the greatest count of a longer phrase around each phrase."""
    inner = F.expr(
        "flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> slice(words, i, n))))"
    )
    parts = phrases.filter("k > 2").select("lang", F.explode(inner).alias("words"), "f")
    return parts.groupBy("lang", "words").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block_words: int = BLOCK_WORDS,
                 parts_words: int = PARTS_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    phrases, totals = frequent_phrases(docs, least, block_words, parts_words)
    kept = (
        scored(phrases).join(covered(phrases), ["lang", "words"], "left")
        .filter(F.col("most").isNull() | (100 * _wide(F.col("most")) < 80 * _wide(F.col("a"))))
        .select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    )
    order = "ORDER BY score DESC, a DESC, phrase"
    part = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    best = part.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, _part {order})")).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
