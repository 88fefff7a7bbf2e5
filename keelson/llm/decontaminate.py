"""Benchmark passages in documents, found through a stored positional inverted index.

The index is a table with a row per block of documents: the documents' ids and word counts, and for
each term of the benchmark its sorted positions in the block. Blocks are bounded by text size, so
neither a frequent word nor a frequent passage gathers in one task. Counting the lists gives each
term's rarity over all documents. A phrase is searched from its two rarest terms: their lists, less
the terms' places in the phrase, are intersected; the places left are compared with all its words.
Nothing but index rows and results leaves a task, and no stage shuffles text.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. An item's windows are
each 13 consecutive words, or all its words if it has fewer. Null or empty text has no words; such a
document has no hits, such an item no windows. A null item id counts as an empty id. Repeated rows
are judged one by one; extra columns are ignored. Matches never cross documents.

The benchmark's terms and items are sent to all tasks. Their number is checked: items go in rounds
of ROUND_WORDS words against the stored index, and more than MAX_TERMS different terms are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import ONE_BY_ONE, lean, materialise, slim

WINDOW = 13
BLOCK_BYTES = 4 << 20
BATCH_ROWS = 1024  # documents sent to a worker at once
ROUND_WORDS = 2_000_000
MAX_TERMS = 2_000_000
CELLS = 1 << 20  # compared at once

INDEX_NAMES = ("ids", "n_words", "terms", "ends", "positions")
INDEX = "ids array<bigint>, n_words array<int>, terms array<int>, ends array<int>, positions array<int>"
FOUND = (
    "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
)

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _block_row(ids, counts, parts) -> dict:
    """Positions run through the block with a gap after each document."""
    starts = np.cumsum([0, *[c + 1 for c in counts]])[:-1]
    if parts:
        where = [np.flatnonzero(p >= 0) for p in parts]
        terms = np.concatenate([p[w] for p, w in zip(parts, where)])
        at = np.concatenate([w + s for w, s in zip(where, starts)])
    else:
        terms, at = np.empty(0, np.int32), np.empty(0, np.int64)
    order = np.argsort(terms, kind="stable")
    own, first = np.unique(terms[order], return_index=True)
    return {
        "ids": ids, "n_words": counts, "terms": own.astype(np.int32),
        "ends": np.append(first[1:], len(terms))[: len(own)].astype(np.int32),
        "positions": at[order].astype(np.int32),
    }


def build_index(docs: DataFrame, terms: dict[bytes, int], stored: bool = True) -> DataFrame:
    """The index of ``terms`` (word to number) over ``docs`` with doc_id and text."""
    known = docs.sparkSession.sparkContext.broadcast(terms)
    names = list(INDEX_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        ids, counts, parts, held = [], [], [], 0

        def flush():
            row = _block_row(ids, counts, parts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([row["ids"]], pa.list_(pa.int64())),
                    *[pa.array([row[n]], pa.list_(pa.int32())) for n in names[1:]],
                ],
                names=names,
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws = words_of(text.as_py())
                parts.append(np.fromiter((number(w, -1) for w in ws), np.int32, len(ws)))
                ids.append(doc)
                counts.append(len(ws))
                held += sum(map(len, ws)) + len(ws)
                if held >= BLOCK_BYTES:
                    yield flush()
                    ids, counts, parts, held = [], [], [], 0
        if ids:
            yield flush()

    index = slim(docs, "doc_id", "text").mapInArrow(lean(run), INDEX)
    return materialise(index, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}) if stored else index


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often each term occurs in all documents."""
    before = F.expr("transform(ends, (e, i) -> e - IF(i = 0, 0, ends[i - 1]))")
    pairs = F.explode(F.arrays_zip("terms", before.alias("n")))
    return (
        index.select("terms", "ends").select(pairs.alias("p"))
        .groupBy(F.col("p.terms").alias("term"))
        .agg(F.sum("p.n").alias("n"))
    )


def _index_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's blocks one at a time; terms, ends and positions are arrays over the batch's own memory."""
    for k in range(batch.num_rows):
        row = {n: batch.column(n)[k] for n in INDEX_NAMES}
        yield {n: v.as_py() if n in ("ids", "n_words") else v.values.to_numpy() for n, v in row.items()}


def _postings(row) -> tuple[np.ndarray, ...]:
    terms, ends, at = (np.asarray(row[k], np.int64) for k in ("terms", "ends", "positions"))
    return terms, np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(terms)], ends, at


def _lists(wanted: np.ndarray, row) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``wanted`` terms: (its index in wanted, a position), over all positions."""
    terms, first, ends, at = row
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slot = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    has = np.flatnonzero(terms[slot] == wanted)
    n = ends[slot[has]] - first[slot[has]]
    of = np.repeat(has, n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, at[np.repeat(first[slot[has]], n) + inside]


class Phrases:
    """The windows of items as term numbers, with the two rarest places of each window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], rarity: np.ndarray, window: int):
        self.items, self.window = items, window
        keys = set()
        for i, (_, tokens) in enumerate(items):
            k, n = min(window, len(tokens)), rarity[tokens]
            for s in range(len(tokens) - k + 1):
                rare = np.lexsort((np.arange(k), n[s : s + k]))[:2]
                keys.update((i, s + int(q)) for q in rare)
        keys = sorted(keys)
        self.key_item = np.array([i for i, _ in keys], np.int64)
        self.key_place = np.array([q for _, q in keys], np.int64)
        self.key_term = np.array([items[i][1][q] for i, q in keys], np.int64)

    def candidates(self, row) -> tuple[np.ndarray, np.ndarray]:
        """(item, place of its first word) where two key terms stand within a window."""
        of, at = _lists(self.key_term, row)
        item, place = self.key_item[of], self.key_place[of]
        base = at - place
        order = np.lexsort((place, base, item))
        item, base, place = item[order], base[order], place[order]
        same = (item[1:] == item[:-1]) & (base[1:] == base[:-1])
        near = np.append(same & (place[1:] - place[:-1] < self.window), False)
        lone = np.array([len(t) == 1 for _, t in self.items], bool)[item]
        keep = near | lone
        pairs = np.unique(np.stack([item[keep], base[keep]], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def hits(self, tokens: np.ndarray, row) -> tuple[list[np.ndarray], list[int]]:
        """Starts of occurring windows: one array of (start, end) and the item for each find."""
        spans, found = [], []
        items, bases = self.candidates(row)
        for i in np.unique(items):
            own = self.items[i][1]
            k = min(self.window, len(own))
            mine = bases[items == i]
            step = max(1, CELLS // len(own))
            for s in range(0, len(mine), step):
                at = mine[s : s + step, None] + np.arange(len(own))
                inside = (at >= 0) & (at < len(tokens))
                equal = inside & (tokens[np.where(inside, at, 0)] == own)
                run = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
                which, start = np.nonzero(run[:, k:] - run[:, :-k] == k)
                if len(which):
                    first = at[which, start]
                    spans.append(np.stack([first, first + k], 1))
                    found += [i] * len(first)
        return spans, found


def _merged(spans: np.ndarray) -> np.ndarray:
    """The union of (start, end) intervals, sorted."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], 1)


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _rows(wanted: Phrases, row) -> list[dict]:
    lists = _postings(row)
    counts = np.asarray(row["n_words"], np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    tokens = np.full(int((counts + 1).sum()), -1, np.int64)
    tokens[lists[3]] = np.repeat(lists[0], lists[2] - lists[1])
    spans, found = wanted.hits(tokens, lists)
    out = [
        {"doc_id": d, "n_words": n, "spans": [], "items": set()}
        for d, n in zip(row["ids"], row["n_words"])
    ]
    if found:
        all_spans = np.concatenate(spans)
        docs = np.searchsorted(starts, all_spans[:, 0], "right") - 1
        for d, i in {*zip(docs.tolist(), found)}:
            out[d]["items"].add(wanted.items[i][0])
        for d in np.unique(docs):
            own = _merged(all_spans[docs == d]) - starts[d]
            out[d]["spans"] = [{"start": int(a), "end": int(b)} for a, b in own]
    return [{**r, "items": sorted(r["items"])} for r in out]


def _items(benchmark: DataFrame) -> list[tuple[str, list[bytes]]]:
    rows = slim(benchmark, "item_id", "text").toLocalIterator()
    items = [("" if r[0] is None else str(r[0]), words_of(r[1])) for r in rows]
    return sorted(x for x in items if x[1])


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, the disjoint spans of hit words, items found."""
    items = _items(benchmark)
    terms = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    if len(terms) > MAX_TERMS:
        raise ValueError(f"the benchmark has {len(terms)} terms, over {MAX_TERMS}: split it")
    index = build_index(docs, terms)
    rarity = np.zeros(max(1, len(terms)), np.int64)
    for term, n in term_counts(index).toLocalIterator():
        rarity[term] = n
    numbered = [(i, np.array([terms[w] for w in ws], np.int64)) for i, ws in items]
    rounds, held = [[]], 0
    for item in numbered:
        if held >= ROUND_WORDS:
            rounds.append([])
            held = 0
        rounds[-1].append(item)
        held += len(item[1])
    return _search(index, [Phrases(r, rarity, window) for r in rounds])


def _search(index: DataFrame, rounds: list[Phrases]) -> DataFrame:
    """All rounds over the same blocks; spans of a document are united."""
    sent = index.sparkSession.sparkContext.broadcast(rounds)

    def run(batches):
        for batch in batches:
            for row in _index_rows(batch):
                out = _rows(sent.value[0], row)
                for wanted in sent.value[1:]:
                    for a, b in zip(out, _rows(wanted, row)):
                        spans = [(s["start"], s["end"]) for s in a["spans"] + b["spans"]]
                        if spans:
                            a["spans"] = [
                                {"start": int(x), "end": int(y)} for x, y in _merged(np.array(spans))
                            ]
                        a["items"] = sorted({*a["items"], *b["items"]})
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return index.mapInArrow(lean(run), FOUND)


def proximity(docs: DataFrame, phrases: list[str], slack: int) -> DataFrame:
    """(doc_id, phrase, position): the phrase's rarest word where all its others stand within ``slack`` words."""
    split = [(p, words_of(p)) for p in phrases]
    terms = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
    index = build_index(docs, terms)
    counts = dict(term_counts(index).toLocalIterator())
    wanted = [
        (p, sorted({terms[w] for w in ws}, key=lambda t: (counts.get(t, 0), t))) for p, ws in split if ws
    ]
    schema = "doc_id bigint, phrase string, position bigint"

    def run(batches):
        for batch in batches:
            for row in _index_rows(batch):
                lists = _postings(row)
                counts_ = np.asarray(row["n_words"], np.int64)
                starts = np.cumsum(counts_ + 1) - counts_ - 1
                out = []
                for p, ts in wanted:
                    at = _lists(np.array(ts[:1]), lists)[1]
                    doc = np.searchsorted(starts, at, "right") - 1
                    for t in ts[1:]:
                        other = _lists(np.array([t]), lists)[1]
                        low = np.maximum(at - slack, starts[doc])
                        high = np.minimum(at + slack, starts[doc] + counts_[doc] - 1)
                        has = np.searchsorted(other, high, "right") > np.searchsorted(other, low)
                        at, doc = at[has], doc[has]
                    out += [
                        {"doc_id": row["ids"][d], "phrase": p, "position": int(a - starts[d])}
                        for a, d in zip(at, doc)
                    ]
                yield pa.RecordBatch.from_pylist(
                    out, schema=pa.schema([("doc_id", pa.int64()), ("phrase", pa.string()), ("position", pa.int64())])
                )

    return index.mapInArrow(lean(run), schema)


def judged(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated: at least one hit word, and a twentieth of all."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated ids; rows without an id go by their own text."""
    columns = docs.columns
    found = judged(find_passages(docs, benchmark, window)).filter("contaminated")
    dirty = materialise(found.select("doc_id").distinct(), ONE_BY_ONE)
    ids = dirty.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "_dirty")
    kept = docs.join(ids, F.col("doc_id") == F.col("_dirty"), "left_anti")
    if dirty.filter("doc_id IS NULL").isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in columns])
    return kept.filter("doc_id IS NOT NULL").union(_nameless(docs.filter("doc_id IS NULL"), benchmark, window))


def _nameless(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Rows without an id, judged under the hash of their text."""
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    found = find_passages(hashed.select(F.col("_hash").alias("doc_id"), "text"), benchmark, window)
    dirty = judged(found).filter("contaminated").select(F.col("doc_id").alias("_hash")).distinct()
    return hashed.join(dirty, "_hash", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
