"""Removal of byte strings that occurred before, by hash-compared suffix sorting.

Every string of ``length`` bytes that also starts earlier (smaller doc_id, or same document, smaller
start) is removed wherever it repeats. Sorting all suffixes of a corpus is not needed for that: of
the short strings inside each window of ``length`` bytes the one of least hash is its anchor, so equal
windows have equal anchors at equal places, and only suffixes at anchors are sorted.

1. Anchors of all documents are sorted by the hash of their first bytes; those that occur once go.
2. Around each other anchor its context is cut out: the bytes of all windows it is the anchor of.
   Equal contexts in a task become one; those after the first are removed whole.
3. Contexts with equal anchors meet. A mergesort orders their suffixes from the
   anchor on, and their prefixes backwards; two are compared by binary search over prefix polynomial
   hashes for their common extension. Adjacent extensions are verified byte by byte. Windows are
   equal where both extensions reach their ends; all but the first of a class are removed.
4. Intervals come back to their documents, which are cut.

An anchor with more than HOT occurrences is dealt by whole windows instead, so no group of contexts
grows with the corpus. Matches never cross documents. Null text is empty. A null doc_id comes last;
rows that share a doc_id are at the same place and not before each other, so repeated rows give
equal rows. Texts below ``length`` bytes and empty tables are returned as they are. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import materialise, slim

LENGTH = 100
HOT = 20_000  # occurrences of an anchor beyond which its windows are dealt one by one
BLOCK = 1 << 20  # bytes of documents hashed together
CHUNK = 8192  # contexts sorted together, more where one anchor has more
HELD = 24 << 20  # bytes of contexts a task combines
LAST = (1 << 63) - 1  # place of rows without an id

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Anchors:
    """Finds the anchors of documents for windows of ``length`` bytes."""

    def __init__(self, length: int):
        self.length, self.kmer = length, max(1, length // 3)
        self.up = self.down = np.empty(0, np.uint64)

    def find(self, docs: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each anchor: document, hash of its first bytes, first window, place in it, windows."""
        none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
        lens = np.array([len(d) for d in docs], np.int64)
        data = np.frombuffer(b"".join(docs), np.uint8)
        n, k = len(data), self.kmer
        if n < self.length:
            return none
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        kmers = _mix((sums[k:] - sums[:-k]) * self.up[: n - k + 1])
        least = (kmers & ~_LOW) | np.arange(len(kmers), dtype=np.uint64)
        span, want = 1, self.length - k + 1
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if want > span:
            least = np.minimum(least[: -(want - span)], least[want - span :])
        anchor = (least & _LOW).astype(np.int64)
        ends = np.cumsum(lens)
        of = np.repeat(np.arange(len(docs)), lens)[: len(anchor)]
        window = np.flatnonzero(np.arange(len(anchor)) + self.length <= ends[of])
        if not len(window):
            return none
        a = anchor[window]
        cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (np.diff(window) != 1)))
        first = window[cut]
        doc = of[first]
        return doc, kmers[a[cut]], first - (ends - lens)[doc], a[cut] - first, np.diff(np.append(cut, len(window)))


def _blocks(texts: list[bytes]):
    """Runs of documents below 16 MB and about BLOCK bytes; longer ones stand alone, in overlapping parts."""
    run, held = [], 0
    for i, t in enumerate(texts):
        if run and held + len(t) > BLOCK:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(t)
    if run:
        yield run


_MOST = 1 << 23  # bytes of one text hashed at once


def _found(finder: Anchors, texts: list[bytes]):
    """(text, hash, first window, place, windows) arrays over all texts."""
    for run in _blocks(texts):
        if len(run) == 1 and len(texts[run[0]]) > _MOST:
            text = texts[run[0]]
            for at in range(0, len(text), _MOST):
                part = text[at : at + _MOST + finder.length - 1]  # each window is in one part
                doc, h, first, place, n = finder.find([part])
                yield np.full(len(h), run[0]), h, first + at, place, n
        else:
            doc, *rest = finder.find([texts[i] for i in run])
            yield np.array(run, np.int64)[doc], *rest


def _rows(docs: DataFrame) -> DataFrame:
    rows = slim(docs, "doc_id", "text")
    return rows.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"),
        F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _bytes(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, at) of every anchor; ``at`` packs first window, place and windows."""

    def run(batches):
        finder = Anchors(length)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for doc, h, first, place, n in _found(finder, _bytes(batch.column(2))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array((first << 20) | (place << 10) | n)],
                    names=["h", "doc_id", "at"],
                )

    return _rows(docs).mapInArrow(run, "h bigint, doc_id bigint, at bigint")


def repeated(found: DataFrame, hot: int) -> DataFrame:
    """The rows of ``found`` whose h occurs again, and whether it does more than ``hot`` times."""

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        flooding = None  # the hash of which more than ``hot`` rows have passed

        def out(rows, is_hot):
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, rows), pa.array(is_hot)], names=["h", "doc_id", "at", "hot"]
            )

        def settled(rows):
            h = rows[0]
            _, at, n = np.unique(h, return_inverse=True, return_counts=True)
            keep = n[at] > 1
            return out([r[keep] for r in rows], (n[at] > hot)[keep])

        for batch in batches:
            rows = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, batch.columns)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if flooding is not None:
                same = int(np.searchsorted(rows[0], flooding, "right"))
                yield out([r[:same] for r in rows], np.ones(same, bool))
                rows, last = [r[same:] for r in rows], max(0, last - same)
                if not len(rows[0]):
                    held = rows
                    continue
                flooding = None
            yield settled([r[:last] for r in rows])
            held = [r[last:] for r in rows]
            if len(held[0]) > hot:
                flooding = int(held[0][0])
                yield out(held, np.ones(len(held[0]), bool))
                held = [r[:0] for r in held]
        yield settled(held)

    return found.repartition("h").sortWithinPartitions("h").mapInArrow(
        run, "h bigint, doc_id bigint, at bigint, hot boolean"
    )


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, z): texts compressed for the way to their rows."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([squeeze(t) for t in _bytes(batch.column(2))], pa.binary())],
                names=["doc_id", "th", "z"],
            )

    return _rows(docs).mapInArrow(run, "doc_id bigint, th bigint, z binary")


_CONTEXT = ["deal", "doc_id", "th", "start", "place", "windows", "context"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def contexts(docs: DataFrame, flagged: DataFrame, length: int) -> DataFrame:
    """Contexts of flagged anchors. Without a context: windows already known to repeat."""

    def combined(rows):
        """The first of equal contexts in this task stays; the others repeat it."""
        rows.sort(key=lambda r: (r[1], r[3], r[2]))
        seen, out, known = {}, [], {}
        for r in rows:
            key = (r[0], r[4], r[6])
            first = seen.setdefault(key, r)
            if first is r or first[1] == r[1] and first[3] == r[3]:
                if first is r or first[2] != r[2]:
                    out.append(r)
            else:
                known.setdefault((r[1], r[2]), []).append((r[3], r[3] + r[5]))
        for (doc, th), runs in known.items():  # runs of windows that all repeat
            out += [(None, doc, th, a, 0, b - a, None) for a, b in _merged(runs)]
        columns = zip(*out) if out else [[]] * len(_CONTEXT)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_CONTEXT)

    def run(batches):
        grow = zstandard.ZstdDecompressor().decompress
        rows, held = [], 0
        for batch in batches:
            for doc, th, z, marks in zip(*(batch.column(k) for k in range(4))):
                text = grow(z.as_py())
                doc, th = doc.as_py(), th.as_py()
                for m in marks.as_py():
                    at, h = m["at"], m["h"]
                    start, place, n = at >> 20, (at >> 10) & 1023, at & 1023
                    if start + n + length - 1 > len(text):  # of another text with this doc_id
                        continue
                    if m["hot"]:
                        for w in range(n):
                            own = text[start + w : start + w + length]
                            deal = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                            rows.append((deal, doc, th, start + w, place - w, 1, own))
                        held += n * length
                    else:
                        rows.append((h, doc, th, start, place, n, text[start : start + n + length - 1]))
                        held += n + length
                    if held > HELD:
                        yield combined(rows)
                        rows, held = [], 0
        if rows:
            yield combined(rows)

    marks = flagged.groupBy("doc_id").agg(F.collect_list(F.struct("at", "h", "hot")).alias("marks"))
    both = _packed(docs).join(marks, "doc_id").select("doc_id", "th", "z", "marks")
    return materialise(
        both.mapInArrow(
            run, "deal bigint, doc_id bigint, th bigint, start bigint, place int, windows int, context binary"
        )
    )


class Suffixes:
    """Strings, one per row, compared by binary search over their prefix polynomial hashes.

    ``group``, ascending, comes before the strings in the order: rows of different groups are never
    compared, and adjacent ones have nothing in common.
    """

    def __init__(self, strings: list[bytes], group: np.ndarray | None = None):
        n = len(strings)
        group = np.zeros(n, np.int64) if group is None else np.asarray(group)
        new = np.append(True, group[1:] != group[:-1])[:n]
        self.group = np.cumsum(new) - 1
        cut = np.append(np.flatnonzero(new), n)
        self.start, self.end = cut[self.group], cut[self.group + 1]  # places of each row's group
        self.lengths = np.array([len(s) for s in strings], np.int64)
        width = int(self.lengths.max(initial=0)) + 1  # the end of a string sorts before any byte
        flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        self.cells = np.zeros((len(strings), width), np.uint16)
        self.cells[np.arange(width) < self.lengths[:, None]] = flat
        self.hashes = np.zeros((len(strings), width + 1), np.uint64)
        for c in range(width):
            self.hashes[:, c + 1] = self.hashes[:, c] * np.uint64(_BASE) + self.cells[:, c]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows ``a`` and ``b``, by hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.lengths[a], self.lengths[b])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            equal = self.hashes[a, middle] == self.hashes[b, middle]
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row ``a`` sorts before ``b``; equal rows do if ``ties``."""
        at = self.common(a, b)
        x, y = self.cells[a, at], self.cells[b, at]
        return (x < y) | ((x == y) & ties)

    def order(self) -> np.ndarray:
        """Rows in order: a stable mergesort that merges all pairs of runs of a width at once."""
        n = len(self.lengths)
        rows, width = np.arange(n), 1
        place = np.arange(n)
        while width < n:
            pair = place // (2 * width) * (2 * width)
            left = place < pair + width
            start = np.where(left, np.minimum(pair + width, n), pair)  # the other run
            high = np.where(left, np.minimum(pair + 2 * width, n), np.minimum(pair + width, n))
            # A group keeps its places in every run: only its part of the other run is searched.
            low = np.clip(self.start, start, high)
            high = np.maximum(low, np.minimum(high, self.end))
            while (open_ := low < high).any():
                at = np.flatnonzero(open_)
                middle = (low[at] + high[at]) >> 1
                # Others sort before mine: strictly if they stand in the right run.
                less = np.empty(len(at), bool)
                for side in (True, False):
                    mine = left[at] == side
                    less[mine] = self.before(rows[middle[mine]], rows[at[mine]], ties=not side)
                low[at] = np.where(less, middle + 1, low[at])
                high[at] = np.where(less, high[at], middle)
            to = np.where(left, place, place - np.minimum(width, n - pair)) + (low - start)
            if not (np.bincount(to, minlength=n) == 1).all():  # colliding hashes contradict each other
                return self.plain_order()
            out = np.empty(n, np.int64)
            out[to] = rows
            rows, width = out, width * 2
        return rows

    def plain_order(self) -> np.ndarray:
        return np.lexsort([*self.cells.T[::-1], self.group])

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row in order, common extension of each place with the one before)."""
        rows = self.order()
        reach = np.zeros(len(rows), np.int64)
        next_ = 1 + np.flatnonzero(self.group[1:] == self.group[:-1])  # places with one of their group before
        reach[next_] = self.common(rows[next_ - 1], rows[next_])
        a, b = self.cells[rows[next_ - 1]], self.cells[rows[next_]]
        differ = a != b
        true = np.where(differ.any(1), differ.argmax(1), self.lengths[rows[next_]])
        ahead = np.arange(len(a))
        at = np.minimum(true, a.shape[1] - 1)
        if (true != reach[next_]).any() or (a[ahead, at] > b[ahead, at]).any():  # a collision of hashes
            rows = self.plain_order()
            differ = self.cells[rows[next_]] != self.cells[rows[next_ - 1]]
            reach[next_] = np.where(differ.any(1), differ.argmax(1), self.lengths[rows[next_]])
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        return place, reach


def repeats(deal, doc, start, place, windows, context: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context, ascending by ``deal``: its first and its last window that occurred before, or -1.

    Equal windows have equal deals, so the suffixes of different deals are not compared.
    """
    n = len(context)
    rank = np.empty(n, np.int64)  # by place of the anchor
    by_rank = np.lexsort((start + place, doc))
    rank[by_rank] = np.arange(n)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return first, last
    ahead, ahead_reach = Suffixes([c[p:] for c, p in zip(context, place)], deal).classes()
    back, back_reach = Suffixes([c[:p][::-1] for c, p in zip(context, place)], deal).classes()
    for left in range(int(place.max()) + 1):  # bytes of the window before the anchor
        w = place - left
        has = np.flatnonzero((w >= 0) & (w < windows))
        if len(has) < 2:
            continue
        right = np.cumsum(ahead_reach < length - left)[ahead[has]]
        own = np.cumsum(back_reach < left)[back[has]] if left else np.zeros(len(has), np.int64)
        key = right * (n + 1) + own
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
        if new.all():
            continue
        mine = has[order]
        lead = by_rank[np.minimum.reduceat(rank[mine], np.flatnonzero(new))][np.cumsum(new) - 1]
        again = (doc[mine] != doc[lead]) | (start[mine] + w[mine] != start[lead] + w[lead])
        hit = mine[again]
        first[hit] = np.where(first[hit] < 0, w[hit], np.minimum(first[hit], w[hit]))
        last[hit] = np.maximum(last[hit], w[hit])
    return first, last


def intervals(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, start, end) of bytes to remove."""

    def run(batches):
        held = []

        def settle(table):
            deal, doc, start, place, windows = (
                table.column(k).to_numpy() for k in ("deal", "doc_id", "start", "place", "windows")
            )
            first, last = repeats(deal, doc, start, place.astype(np.int64), windows.astype(np.int64), table.column("context").to_pylist(), length)
            hit = np.flatnonzero(first >= 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[hit]), pa.array(table.column("th").to_numpy()[hit]),
                 pa.array(start[hit] + first[hit]), pa.array(start[hit] + last[hit] + length)],
                names=["doc_id", "th", "start", "end"],
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            deal = table.column("deal").to_numpy()
            cut = int(np.searchsorted(deal, deal[-1]))
            for at in _cuts(deal[:cut]):
                yield settle(table.slice(at[0], at[1] - at[0]))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            for at in _cuts(table.column("deal").to_numpy()):
                yield settle(table.slice(at[0], at[1] - at[0]))

    known = found.filter("context IS NULL").select(
        "doc_id", "th", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end")
    )
    met = found.filter("context IS NOT NULL").repartition("deal").sortWithinPartitions("deal", "doc_id", "start", "th")
    return known.union(met.mapInArrow(run, "doc_id bigint, th bigint, start bigint, end bigint"))


def _cuts(deal: np.ndarray):
    """Ranges of about CHUNK rows that keep equal deals together."""
    at = 0
    while at < len(deal):
        end = min(len(deal), at + CHUNK)
        if end < len(deal):
            end = int(np.searchsorted(deal, deal[end - 1], "right"))
        yield at, end
        at = end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (removed, disjoint) and kept (the bytes left) of every row."""
    flagged = repeated(anchors(docs, length), hot)
    found = contexts(docs, flagged, length)
    spans = intervals(found, length).groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )

    def run(batches):
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, sizes, removed, kept = [], [], [], []
            for doc, z, marks in zip(*(batch.column(k) for k in range(3))):
                text = grow(z.as_py())
                merged = _merged([(m["start"], m["end"]) for m in marks.as_py() or ()])
                edges = [0, *(x for span in merged for x in span), len(text)]
                ids.append(None if doc.as_py() == LAST else doc.as_py())
                sizes.append(len(text))
                removed.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    both = _packed(docs).join(spans, ["doc_id", "th"], "left").select("doc_id", "z", "spans")
    return both.mapInArrow(
        run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
