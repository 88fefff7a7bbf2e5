"""Documents packed into sequences by their length histogram, shortest pack first.

Each document's token ids are cut into pieces of ``size`` and a rest. A histogram of piece lengths,
of at most ``size`` entries whatever the number of documents, is all that placing needs: lengths go
longest first, each count into the pattern with the least room that still holds it, or into new
patterns. A pattern is a list of lengths and a number of sequences, so one step places all pieces of
a length that fit. Pieces then find their pattern by rank among the pieces of their length: tasks
number theirs as they cut, and the counts of earlier tasks are added.

Null text is empty text; an empty text still has its end token. Repeated rows are packed each. A
null doc_id stays null. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from keelson.llm.common import lean, materialise, slim

SIZE = 4096
END = 2
SHORT = 64  # bytes of a run between spaces whose ids a worker remembers
KNOWN_BYTES = 64 << 20  # that it remembers in all, in two halves, with ENTRY bytes of overhead for each
ENTRY = 180
MOST_PATTERNS = 1_000_000
PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "block bigint, place bigint, ids binary"
)
# What the vocabularies of this kind do to a text before their model sees a word.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENDED = r"([0-9A-Za-z])([.,;:!?*&%$#]+)([\t-\r ]|\z)"  # marks at the end of a word
PART_BYTES = 1 << 19  # of texts encoded together
_MARKS = (b"\xcc", b"\xcd")  # lead bytes of marks that could join with an ASCII letter


class Encoder:
    """Token ids of texts; the vocabulary drops white space, so runs between spaces stand alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        letters = any(t["content"].isalpha() for t in spec["added_tokens"])
        usual = (spec["normalizer"], spec["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER) and not letters
        #: A word of a-z alone passes the vocabulary's steps unchanged and whole: its model gives the ids.
        self.model = self.tokenizer.model if usual else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _keep(self, found: dict[bytes, bytes]) -> None:
        """Remember ids of chunks that are not known."""
        self.known.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def _renew(self, chunks: set[bytes]) -> None:
        """Take what is still in use over from the older half."""
        older = self.older
        self._keep({c: older[c] for c in older.keys() & chunks})

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of all ``chunks``; the short ones are remembered."""
        found = self._encode(chunks)
        self._keep({c: ids for c, ids in found.items() if len(c) <= SHORT})
        return found

    def _encode(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        if self.model is not None:
            tokenize = self.model.tokenize
            for c in chunks:
                if c.isalpha() and c.islower():  # of ASCII
                    ids = [t.id for t in tokenize(c.decode())]
                    out[c] = struct.pack(f"<{len(ids)}I", *ids)
            chunks = [c for c in chunks if c not in out]
        encoded = self.tokenizer.encode_batch_fast(
            [c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False
        )
        out.update((c, struct.pack(f"<{len(ids)}I", *ids)) for c, ids in zip(chunks, (e.ids for e in encoded)))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raws, spelt = [], []
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            # ASCII case is dropped by the vocabulary too, unless a mark changes what a letter is
            # or a special token is spelt out.
            spelt.append(b"<|" in raw)
            if not spelt[-1] and not any(m in raw for m in _MARKS):
                raw = raw.translate(_LOWER)
            raws.append(raw)
        raws = pa.array(raws, pa.binary())
        # A word and the marks after it are apart for the vocabulary: each is looked up alone.
        apart = pc.replace_substring_regex(raws, pattern=_ENDED, replacement=r"\1 \2\3")
        if any(spelt):
            apart = pc.if_else(pa.array(spelt), raws, apart)
        split = pc.ascii_split_whitespace(apart.view(pa.string()))
        coded = split.values.dictionary_encode()
        found = self._ids(coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        at, cuts = coded.indices.to_numpy().tolist(), split.offsets.to_numpy().tolist()
        return [b"".join(map(found.__getitem__, at[a:b])) for a, b in zip(cuts, cuts[1:])]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of these different chunks."""
        if self.held > KNOWN_BYTES // 2:
            self.older, self.known, self.held = self.known, {}, 0
        new = [c for c in chunks if c not in self.known]
        if self.older:
            self._renew(set(new))
            new = [c for c in new if c not in self.known]
        found = self._learn(new) if new else {}
        known = self.known
        return [known[c] if c in known else found[c] for c in chunks]  # long runs are forgotten with this call


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary, kept between tasks."""
    held = sys.modules.setdefault("_keelson_encoders", types.ModuleType("_keelson_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = Encoder(path)
    return held.__dict__[path]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about PART_BYTES of text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def cut(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """The pieces of every document, numbered within (block, length); ``block`` is the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        tail = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for part in _parts(batch):
                out = {n: [] for n in ("doc", "start", "length", "crc", "tokens", "place", "ids")}
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids += tail
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        n = len(piece) // 4
                        for k, v in zip(out, (doc, start, n, zlib.crc32(piece), total, int(seen[n]), piece if with_ids else None)):
                            out[k].append(v)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(out[k], pa.int64()) for k in ("doc", "start", "length", "crc", "tokens")],
                        pa.array([block] * len(out["doc"]), pa.int64()),
                        pa.array(out["place"], pa.int64()),
                        pa.array(out["ids"], pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "place", "ids"],
                )

    return materialise(slim(docs, "doc_id", "text").mapInArrow(lean(run), PIECE))


def place(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Patterns (sequences, lengths) that hold each length as often as the histogram has it."""
    rooms: dict[int, list[list]] = {}  # room left: patterns, each [count, lengths]
    order: list[int] = []  # rooms that have patterns, ascending
    made = 0

    def put(room, count, lengths):
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fits = size // length
                full, rest = divmod(left, fits)
                # A new pattern takes as many of the length as it holds; shorter ones fill the rest.
                if full:
                    put(size - fits * length, full, [length] * fits)
                if rest:
                    put(size - rest * length, 1, [length] * rest)
                break
            room = order[at]
            pattern = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            each = min(room // length, left)  # as many as fit beside what is there
            used = min(pattern[0], left // each)
            if used < pattern[0]:
                put(room, pattern[0] - used, pattern[1])
            put(room - each * length, used, pattern[1] + [length] * each)
            left -= used * each
            made += 1
            if made > MOST_PATTERNS:
                raise ValueError("the histogram has too many different patterns")
    return sorted(((c, p) for ps in rooms.values() for c, p in ps), key=lambda x: (x[1], x[0]), reverse=True)


def slots(patterns: list[tuple[int, list[int]]], size: int) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first key, first sequence and offset."""
    keys, firsts, offsets, used = [], [], [], {}
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            keys.append((n, used.get(n, 0)))
            used[n] = used.get(n, 0) + count
            firsts.append(sequence)
            offsets.append(offset)
            offset += n
        sequence += count
    order = sorted(range(len(keys)), key=keys.__getitem__)
    pick = lambda x: np.array([x[i] for i in order], np.int64)
    lengths, ranks = (np.array([keys[i][j] for i in order], np.int64) for j in (0, 1))
    return {"length": lengths, "rank": ranks, "sequence": pick(firsts), "offset": pick(offsets),
            "first": np.searchsorted(lengths, np.arange(size + 2))}


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = materialise(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # <= size rows
    runs = spark.sparkContext.broadcast(slots(place(histogram, size), size))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["block", "length"]).withColumn("_rank", F.col("place") + F.col("_before"))
    columns = [c for c in pieces.columns if c not in ("block", "place")]

    def run(batches):
        at = runs.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            slot = np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                low, high = at["first"][n], at["first"][n + 1]
                slot[mine] = low + np.searchsorted(at["rank"][low:high], rank[mine], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in columns],
                    pa.array(at["sequence"][slot] + rank - at["rank"][slot]),
                    pa.array(at["offset"][slot]),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return ranked.select(*columns, "_rank").mapInArrow(lean(run), f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    return pack(cut(docs, tokenizer, size, end, with_ids), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence joined in order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
