"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text's k-mers are its five-word runs, each labelled with its occurrence number, so that repeats
count. For each of TABLES orders of the labelled k-mers a sketch takes the KEEP least and joins them
in text order; equal sketches make candidates, likelier the closer the texts are in content and
order. Texts of equal words are one node from the start.

Candidates are verified by aligning the labelled k-mers of both texts: matches outside the band that
the similarity allows cannot count, the longest common order of the rest does. The similarity is the
aligned k-mers over all k-mers of both, at least LEAST.

No bucket is expanded into pairs. Rounds pair each member with one leader of its bucket, another in
each round, until a round adds no link or STARS have passed. Buckets of up to PART are compared whole
once. What is left in larger ones in different classes is paired exactly: two texts at LEAST must share
one of the rarest k-mers of each (a prefix of their k-mers by rareness), early enough that the rest of
both can still reach LEAST, and their parities (each labelled k-mer flips one of 512 bits) must not
differ in more bits than LEAST allows k-mers to differ. Every pair of different classes that passes is
compared. Classes are connected components, by labels that are lowered and short-cut.

Words: A-Z lower-cased runs of digits, letters and non-ASCII characters; a text of fewer than five is
one k-mer. A text without words, empty or null, is a class of its own. A class is named by its least
doc_id. A null doc_id takes no part: its class is null. Rows that share a doc_id share a class. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keelson.llm.common import lean, materialise, slim
from keelson.llm.decontaminate import words_of

SHINGLE = 5
LEAST = 0.8
TABLES = 24
KEEP = 3
PART = 4
STARS = 3
MOST_CELLS = 1 << 21  # of the table of hashes of one text; longer texts go in column blocks

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(23).integers(1, 1 << 63, TABLES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Four bytes of a hash of each word."""
    own = {w: i for i, w in enumerate(dict.fromkeys(words))}
    hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=4).digest() for w in own), "<u4")
    return hashes[np.fromiter((own[w] for w in words), np.int64, len(words))] if words else hashes


def kmers(numbers: np.ndarray) -> np.ndarray:
    """The labelled k-mers in text order, all different."""
    n = len(numbers)
    if not n:
        return np.empty(0, np.uint64)
    width = min(SHINGLE, n)
    x = numbers.astype(np.uint64)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out * _MULTIPLY + x[k : n - width + 1 + k])
    order = np.argsort(out, kind="stable")
    run = out[order]
    new = np.append(True, run[1:] != run[:-1])
    if new.all():
        return out
    first = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    label = np.empty(len(out), np.uint64)
    label[order] = (np.arange(len(run)) - first).astype(np.uint64)
    return np.where(label > 0, _mix(out + label * _MULTIPLY), out)


def sketches(labelled: np.ndarray) -> np.ndarray:
    """One number per table: the KEEP least k-mers of the table's order, in text order."""
    keep = min(KEEP, len(labelled))
    block = max(KEEP, MOST_CELLS // TABLES)
    best = None
    for at in range(0, len(labelled), block):
        part = _mix(labelled[None, at : at + block] ^ _SEEDS[:, None])
        k = min(keep, part.shape[1])
        where = np.argpartition(part, k - 1, axis=1)[:, :k]
        found = np.take_along_axis(part, where, 1), where + at
        if best is not None:
            found = [np.concatenate([b, f], 1) for b, f in zip(best, found)]
            where = np.argpartition(found[0], keep - 1, axis=1)[:, :keep]
            found = [np.take_along_axis(f, where, 1) for f in found]
        best = found
    places = np.sort(best[1], axis=1)
    out = _SEEDS.copy()
    for k in range(keep):
        out = _mix(out * _MULTIPLY + labelled[places[:, k]])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Aligned k-mers over all k-mers of two lists of labelled k-mers; 0 where ``least`` is out of reach."""
    if not len(a) or not len(b):
        return 0.0
    need = least * (len(a) + len(b)) / (1 + least)  # aligned k-mers that reach ``least``
    band = max(len(a), len(b)) - need + 1e-9
    if band < 0:
        return 0.0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(at - to) <= band
    at, to = at[inside], to[inside]
    if len(at) < need - 1e-9:
        return 0.0
    path = to[np.argsort(at)]
    n = len(path) if (np.diff(path) > 0).all() else _longest_rise(path)
    return n / (len(a) + len(b) - n)


def _longest_rise(path: np.ndarray) -> int:
    tails = np.empty(len(path), np.int64)
    n = 0
    for x in path:
        at = int(np.searchsorted(tails[:n], x))
        tails[at] = x
        n = max(n, at + 1)
    return n


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of rows with an id, and a hash of the text that tells rows of one id apart."""
    rows = slim(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull())
    return rows.withColumn("th", F.xxhash64("text"))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, th, digest of the words (null without words), k-mers n and the sketches of every row."""

    def run(batches):
        for batch in batches:
            digest, count, keys = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                labelled = kmers(word_numbers(words))
                digest.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                count.append(len(labelled))
                keys.append(sketches(labelled) if words else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(count, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "th", "digest", "n", "keys"],
            )

    return _texts(docs).mapInArrow(
        lean(run), "doc_id bigint, th bigint, digest binary, n bigint, keys array<bigint>"
    )


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, th, n) of every bucket with at least two nodes, and the bucket's size."""
    rows = nodes.select(
        F.posexplode("keys").alias("t", "key"), F.col("doc_id").alias("node"), "th", "n"
    ).withColumn("key", F.xxhash64("t", "key")).drop("t")
    shared = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    return materialise(rows.join(shared, "key"))


def _close(a, b, least):
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


_PAIR = ("a", "a_th", "a_label", "b", "b_th", "b_label")


def _pairs(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(*[c.alias(n) for c, n in zip(columns, _PAIR)]).distinct()


def star_pairs(shared: DataFrame, labels: DataFrame, turn: int, least: float) -> DataFrame:
    """Each member with the leader of its bucket, the turn's, where their classes differ."""
    named = shared.select("key", "node", "th", "n").join(labels, "node")
    place = F.xxhash64("node", F.lit(turn)).alias("turn")
    leader = F.min(F.struct(place, "node", "th", "n", "label")).alias("leader")
    rows = named.join(named.groupBy("key").agg(leader), "key")
    lead = F.col("leader")
    rows = rows.filter((lead["label"] != F.col("label")) & _close(F.col("n"), lead["n"], least))
    return _pairs(rows, lead["node"], lead["th"], lead["label"], F.col("node"), F.col("th"), F.col("label"))


def whole_pairs(shared: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """All pairs of different classes in buckets of up to PART members."""
    member = F.struct("node", "th", "n", "label").alias("m")
    parts = (
        shared.filter(F.col("size") <= PART).join(labels, "node")
        .groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("ms"))
    )
    rows = (
        parts.select(F.posexplode("ms").alias("i", "x"), "ms")
        .select("x", F.explode(F.expr("slice(ms, i + 2, size(ms))")).alias("y"))
        .filter((F.col("x.label") != F.col("y.label")) & _close(F.col("x.n"), F.col("y.n"), least))
    )
    return _pairs(rows, *[F.col(f"{m}.{c}") for m in "xy" for c in ("node", "th", "label")])


def open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``shared`` whose bucket holds different classes."""
    named = shared.join(labels, "node")
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b")
    return materialise(shared.join(mixed.select("key"), "key", "left_semi"))


def verified(pairs: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """(a, b): labels of the pairs whose texts align."""

    def run(batches):
        for batch in batches:
            last, own, keep = None, None, []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, own = x, kmers(np.frombuffer(x, "<u4"))
                keep.append(similarity(own, kmers(np.frombuffer(y, "<u4")), least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    of = lambda side: tokens.select(
        F.col("node").alias(side), F.col("th").alias(f"{side}_th"), F.col("numbers").alias(f"{side}_numbers")
    )
    both = pairs.join(of("b"), ["b", "b_th"]).join(of("a"), ["a", "a_th"])
    return both.select("a_label", "b_label", "a_numbers", "b_numbers").mapInArrow(lean(run), "a bigint, b bigint")


def stored_tokens(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, th, numbers) of the nodes in shared buckets."""

    def run(batches):
        for batch in batches:
            numbers = [word_numbers(words_of(t.as_py())).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(numbers, pa.binary())], names=["node", "th", "numbers"]
            )

    wanted = shared.select("node", "th").distinct()
    rows = _texts(docs).select(F.col("doc_id").alias("node"), "th", "text").join(wanted, ["node", "th"], "left_semi")
    tokens = rows.select("node", "th", "text").mapInArrow(lean(run), "node bigint, th bigint, numbers binary")
    return materialise(tokens.groupBy("node", "th").agg(F.first("numbers").alias("numbers")))


def parity(labelled: np.ndarray) -> np.ndarray:
    """512 bits, of which each k-mer flips one: two lists differ in at least as many k-mers as bits."""
    bits = np.bincount((labelled & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _may(a, b, x, y, least):
    """Whether the parities of lists of a and b k-mers allow ``least``."""
    apart = sum(F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(8))
    return apart <= F.lit((1 - least) / (1 + least)) * (a + b) + 1e-6


def prefixes(tokens: DataFrame, least: float) -> DataFrame:
    """(key, node, th, n, parity, at): the k-mers, rarest first, one of which two texts at ``least`` must share.

    ``at`` is the k-mer's place in that order. K-mers of one text only come first and pair nothing.
    """

    def run(batches):
        for batch in batches:
            keys = [kmers(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(k) for k in keys], pa.int64()),
                 pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())),
                 pa.array([parity(k) for k in keys], pa.list_(pa.int64()))],
                names=["node", "th", "n", "keys", "parity"],
            )

    schema = "node bigint, th bigint, n bigint, keys array<bigint>, parity array<bigint>"
    texts = materialise(tokens.select("node", "th", "numbers").mapInArrow(lean(run), schema))
    rows = texts.select("node", "th", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    node = Window.partitionBy("node", "th")
    ranked = rows.join(shared, "key").withColumns(
        {"rank": F.row_number().over(node.orderBy("texts", "key")), "common": F.count(F.lit(1)).over(node)}
    ).withColumn("at", F.col("n") - F.col("common") + F.col("rank") - 1)
    early = ranked.filter(F.col("at") <= F.lit(1 - least) * F.col("n") + 1e-6)
    return early.select("key", "node", "th", "n", "at").join(texts.select("node", "th", "parity"), ["node", "th"])


def prefix_pairs(shared: DataFrame, labels: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """All pairs of different classes among the nodes of ``shared`` that can reach ``least``."""
    open_ = materialise(shared.select("node", "th").distinct().join(labels, "node"))
    keyed = materialise(
        prefixes(tokens.join(open_, ["node", "th"], "left_semi"), least).join(open_, ["node", "th"])
    )
    # A pair of different classes has one text outside the class that is most frequent at the key.
    main = (
        keyed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("key").agg(F.max(F.struct("rows", "label")).alias("m"), F.count(F.lit(1)).alias("classes"))
        .filter("classes > 1").select("key", F.col("m.label").alias("main"))
    )
    keyed = materialise(keyed.join(main, "key"))
    x, y = keyed.filter("label <> main").alias("x"), keyed.alias("y")
    need = F.lit(least / (1 + least)) * (F.col("x.n") + F.col("y.n")) - 1e-6
    rows = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        & (F.col("x.n") - F.col("x.at") >= need) & (F.col("y.n") - F.col("y.at") >= need)
        & _close(F.col("x.n"), F.col("y.n"), least - 1e-6)
        & _may(F.col("x.n"), F.col("y.n"), F.col("x.parity"), F.col("y.parity"), least),
    )
    low = F.col("x.node") < F.col("y.node")  # a pair met at two keys is one pair
    pick = lambda c, first: F.when(low == first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    return _pairs(rows, *[pick(c, F.lit(first)) for first in (True, False) for c in ("node", "th", "label")])


def lowered(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of ``edges`` over ``nodes``."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("near"))
        moved = materialise(
            labels.join(near, labels["node"] == near["b"], "left")
            .select("node", "label", F.least("label", "near").alias("to"))
        )
        if moved.filter("to < label").isEmpty():
            return labels
        ahead = moved.select(F.col("node").alias("to"), F.col("to").alias("far"))
        labels = materialise(
            moved.select("node", "to").join(ahead, "to", "left")
            .select("node", F.coalesce("far", "to").alias("label"))
        )


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after joining the classes that ``links`` connect."""
    met = materialise(links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    moved = lowered(links, met).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialise(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and class_id of every row."""
    rows = materialise(sketched(docs))
    nodes = materialise(
        rows.filter("digest IS NOT NULL").groupBy("digest")
        .agg(F.min(F.struct("doc_id", "th")).alias("m"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        .select("digest", "m.doc_id", "m.th", "n", "keys")
    )
    shared = buckets(nodes)
    own = materialise(shared.select("node").distinct())
    tokens = stored_tokens(docs, shared)
    labels = own.select("node", F.col("node").alias("label"))
    left = shared
    for turn in range(STARS):
        links = materialise(verified(star_pairs(left, labels, turn, least), tokens, least))
        none = links.isEmpty()
        labels = relabelled(labels, links)
        left = open_buckets(left, labels)
        if none or left.isEmpty():
            break
    labels = relabelled(labels, materialise(verified(whole_pairs(left, labels, least), tokens, least)))
    left = open_buckets(left.filter(F.col("size") > PART), labels)
    labels = relabelled(labels, materialise(verified(prefix_pairs(left, labels, tokens, least), tokens, least)))
    named = nodes.select("digest", F.col("doc_id").alias("node")).join(labels, "node", "left")
    named = named.select("digest", F.coalesce("label", "node").alias("class_id"))
    # Rows of one id with different texts join their classes, as their id is one document.
    by_id = rows.join(named, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    odd = by_id.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a < b")
    if not odd.isEmpty():
        seen = by_id.select(F.col("class_id").alias("node")).union(by_id.select("doc_id")).distinct()
        merged = lowered(by_id.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")).filter("a <> b"), materialise(seen))
        by_id = by_id.select("doc_id").join(merged.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", F.col("label").alias("class_id"))
    lost = slim(docs, "doc_id").filter(F.col("doc_id").isNull())
    return by_id.unionByName(lost.select("doc_id", F.lit(None).cast("bigint").alias("class_id")))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each class, that of its least doc_id; rows without an id all stay."""
    found = materialise(classes(docs, least).filter("doc_id IS NOT NULL"))
    heads = materialise(
        found.filter("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumnRenamed("doc_id", "_head")
    )
    # Texts are dealt by id at every size: what a small table saves by a broadcast, a large one cannot.
    once = heads.filter("_rows = 1").select("_head").hint("merge")
    kept = docs.join(once, F.col("doc_id") == F.col("_head"), "left_semi")
    twice = heads.filter("_rows > 1").select("_head")
    if not twice.isEmpty():  # the same id again: one of its rows
        again = docs.join(twice, F.col("doc_id") == F.col("_head"), "left_semi")
        every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        kept = kept.union(again.groupBy("doc_id").agg(F.min(every).alias("_row")).select("_row.*"))
    return kept.union(docs.filter(F.col("doc_id").isNull()))
