"""Groups of texts whose word shingles reach a Jaccard similarity, by the pigeonhole of a split universe.

A text's set holds its distinct SHINGLE-word runs. Two sets of a and b shingles at similarity s differ
in (1 - s) / (1 + s) * (a + b) shingles at most. Sizes are cut into bands; a pair belongs to the band of
its larger set, a set takes part in its own band and in those of sets it may still reach. For a band
whose pairs differ in at most H shingles, a hash splits the universe of shingles into H + 1 segments:
two sets that differ in H places agree in a whole segment. Each segment's subset has a signature, the
sum of its shingles' numbers, and equal signatures make candidates. Bands with H = 0 need none: equal
sets are one node from the start.

Segments are allocated by cost. Where many sets of a band share a segment's subset without being alike
(boilerplate), the segment is left out, and a cheap segment of the band takes its share: there sets that
differ in one shingle meet too, by the signatures of the subset less each one of its shingles. The
thresholds of a band (none, equal, one apart) sum to H + 1 as before, so no link can be missed. An exchange
is made when the comparisons saved outweigh the rows of the one-deletion neighbourhood.

No bucket is expanded into pairs of its members. STARS rounds compare members with one or more leaders
of their bucket, others in each round, and join what links. Then all pairs of different components in a
bucket are compared, those excepted that their parities rule out: each shingle flips one of 512 bits, so
no more bits can differ than shingles. Every pair left is verified on the words of both texts, exactly.

Words: A-Z lower-cased, split at blanks, tabs, newlines and returns. A text of fewer words than SHINGLE
is one shingle of all of them; one without words, empty or null, has an empty set and links with
nothing. Shingles are counted and signed by 64 bits of a hash. A null doc_id takes no part and has no
component. Rows that share a doc_id are one document: a component of any is one of all. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import materialise, slim
from keelson.llm.near_dedup import lowered, relabelled

SHINGLE = 3
LEAST = (90, 100)
GROWTH = 1.2  # of the sizes from one band to the next
STARS = (1, 3, 3)  # leaders of a bucket in each round
CHUNK = 1 << 20  # bytes of text hashed at once
PAIR_COST, ROW_COST = 8.0, 1.0  # of comparing a member of a bucket, and of one more signature

SETS = (
    "doc_id bigint, th bigint, n bigint, d1 bigint, d2 bigint, parity array<bigint>, "
    "bands array<struct<band:int,keys:array<bigint>>>"
)

_RANDOM = np.random.default_rng(41)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---- sizes


def bands_upto(size: int) -> np.ndarray:
    """The least sizes of the bands, up to the first above ``size``."""
    out = [1]
    while out[-1] <= size:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array(out, np.int64)


def segments_of(starts: np.ndarray, least) -> np.ndarray:
    """The number of segments of each band but the last; 0 where a pair cannot differ at all."""
    most = 2 * (starts[1:] - 1) * (least[1] - least[0]) // (least[1] + least[0])
    return np.where(most > 0, most + 1, 0)


# ---- sets of texts


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The start and a hash of each word of ``data``."""
    x = np.frombuffer(data, np.uint8)
    space = _SPACE[x]
    first = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(first):
        return first, np.empty(0, np.uint64)
    place = np.arange(first[0], len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    power = np.full(int(place.max()) + 1, _STEP)
    power[0] = 1
    power = np.cumprod(power)
    return first, _mix(np.add.reduceat(_BYTES[x[first[0]:]] * power[place], first - first[0]))


def _pieces(data: bytes):
    """``data`` cut at blanks into pieces of about CHUNK bytes, with their starts."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield at, data[at:end]
        at = end


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    found = [(at + first, h) for at, piece in _pieces(b"\n".join(texts)) for first, h in [_word_hashes(piece)]]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first, h = np.concatenate([f for f, _ in found]), np.concatenate([h for _, h in found])
    of = np.searchsorted(starts, first, "right") - 1
    own, at, n = np.unique(of, return_index=True, return_counts=True)
    short = n < SHINGLE
    of = np.concatenate([of[: max(0, len(of) - SHINGLE + 1)], own[short]])
    hashed = np.full(max(0, len(h) - SHINGLE + 1), np.uint64(SHINGLE))
    for k in range(SHINGLE):
        hashed = _mix(hashed * _STEP + h[k : len(h) - SHINGLE + 1 + k])
    whole = [_whole(h[a : a + c]) for a, c in zip(at[short], n[short])]
    inside = np.zeros(len(hashed), bool)
    for a, c in zip(at[~short], n[~short]):
        inside[a : a + c - SHINGLE + 1] = True
    keep = np.append(inside, np.ones(len(whole), bool))
    of, hashed = of[keep], np.append(hashed, np.array(whole, np.uint64))[keep]
    order = np.lexsort((hashed, of))
    of, hashed = of[order], hashed[order]
    new = np.append(True, (of[1:] != of[:-1]) | (hashed[1:] != hashed[:-1]))[: len(of)]
    return of[new], hashed[new]


def _whole(h: np.ndarray) -> np.uint64:
    out = np.full(1, np.uint64(len(h)))
    for x in h:
        out = _mix(out * _STEP + x)
    return out[0]


def _segment(number: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (((number >> np.uint64(32)) * k.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _salt(band: np.ndarray, segment: np.ndarray, kind: int) -> np.ndarray:
    return _mix((band.astype(np.uint64) << np.uint64(34)) + (segment.astype(np.uint64) << np.uint64(2)) + np.uint64(kind + 1))


def _taken(sizes: np.ndarray, least):
    """(text, band, segments): the bands in which texts of ``sizes`` take part, and all bands' segments."""
    reach = sizes * least[1] // least[0]
    starts = bands_upto(int(reach.max(initial=1)))
    k = segments_of(starts, least)
    low, high = (np.searchsorted(starts, s, "right") - 1 for s in (sizes, reach))
    n = np.where(sizes > 0, high - low + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    band = np.repeat(low, n) + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    keep = k[band] > 0
    return text[keep], band[keep], k


def _numbered(texts: list[bytes], least):
    """Sizes, (text, band) rows with their first signature's place, and each shingle's text and number."""
    of, h = shingle_hashes(texts)
    number = _mix(h)
    sizes = np.bincount(of, minlength=len(texts))
    text, band, k = _taken(sizes, least)
    return sizes, of, number, text, band, k


def _expanded(of, sizes, text):
    """For rows of ``text``: (row, shingle) of every shingle of the row's text."""
    first = np.cumsum(sizes) - sizes
    n = sizes[text]
    row = np.repeat(np.arange(len(text)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[text[row]]


def _signed(texts: list[bytes], least):
    """What SETS says of each text, from n on."""
    sizes, of, number, text, band, k = _numbered(texts, least)
    n_segments = k[band]
    first = np.cumsum(n_segments) - n_segments
    sums = np.zeros(int(n_segments.sum()), np.uint64)
    row, shingle = _expanded(of, sizes, text)
    np.add.at(sums, first[row] + _segment(number[shingle], n_segments[row]), number[shingle])
    owner = np.repeat(np.arange(len(band)), n_segments)
    keys = _mix(sums + _salt(band[owner], np.arange(len(sums)) - first[owner], 0)).view(np.int64)
    d1, d2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    np.add.at(d1, of, number)
    np.add.at(d2, of, _mix(number ^ _STEP))
    bits = np.bincount(of * 512 + (number & np.uint64(511)).astype(np.int64), minlength=512 * len(texts)) & 1
    parity = np.packbits(bits.astype(np.uint8).reshape(-1, 512), axis=1).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)), pa.int32()), pa.array(keys))
    rows = pa.StructArray.from_arrays([pa.array(band, pa.int32()), lists], ["band", "keys"])
    upto = np.searchsorted(text, np.arange(len(texts) + 1))
    return [
        pa.array(sizes, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * 8, pa.int32()), pa.array(parity.ravel())),
        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows),
    ]


def _lower(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").lower()


def _chunks(batch: pa.RecordBatch, at: int):
    """Slices of ``batch`` with about CHUNK bytes of the text in column ``at``, and the texts."""
    texts, first, held = [], 0, 0
    for i, text in enumerate(batch.column(at)):
        texts.append(_lower(text))
        held += len(texts[-1])
        if held >= CHUNK:
            yield batch.slice(first, len(texts)), texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield batch.slice(first, len(texts)), texts


def _texts(docs: DataFrame) -> DataFrame:
    rows = slim(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull())
    return rows.withColumn("th", F.xxhash64("text"))


def sets(docs: DataFrame, least=LEAST) -> DataFrame:
    """Size, digest, parity and signatures of every row with an id."""
    names = ["doc_id", "th", "n", "d1", "d2", "parity", "bands"]

    def run(batches):
        for batch in batches:
            for part, texts in _chunks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *_signed(texts, least)], names=names)

    return _texts(docs).mapInArrow(run, SETS)


# ---- buckets


def in_buckets(signed: DataFrame) -> DataFrame:
    """The rows of ``signed`` whose key several of them have. Both reads share one shuffle."""
    dealt = signed.repartition("key")
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1").select("key")
    return materialise(dealt.join(shared, "key"))


def allocate(loads: pd.DataFrame, pair_cost: float = PAIR_COST, row_cost: float = ROW_COST) -> pd.DataFrame:
    """The segments of one band that are left out (0) or also meet one apart (2).

    ``loads`` has the members of each segment's buckets (``pairs``: each is compared with a leader), and
    the sets and mean size of the band. The dearest segment is exchanged for the cheapest while that saves
    cost.
    """
    loads = loads.sort_values(["pairs", "segment"]).reset_index(drop=True)
    rows = loads["sets"].iloc[0] * (loads["shingles"].iloc[0] / len(loads) + 1)
    out, low, high = [], 0, len(loads) - 1
    while low < high:
        saved = pair_cost * float(loads["pairs"][high] - loads["pairs"][low])
        if saved <= row_cost * rows:
            break
        out += [(int(loads["band"][0]), int(loads["segment"][high]), 0), (int(loads["band"][0]), int(loads["segment"][low]), 2)]
        low, high = low + 1, high - 1
    return pd.DataFrame(out, columns=["band", "segment", "apart"])


def allocation(banded: DataFrame, met: DataFrame, least, pair_cost: float, row_cost: float) -> DataFrame:
    """(band, segment, apart) where it is not 1."""
    pairs = met.groupBy("band", "segment").agg(F.count(F.lit(1)).cast("double").alias("pairs"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.avg("n").alias("shingles"))
    sizes = sizes.join(pairs.select("band").distinct(), "band")

    def every_segment(batches):
        for frame in batches:
            for band, n, shingles in zip(frame["band"], frame["sets"], frame["shingles"]):
                starts = bands_upto(1)
                while len(starts) < band + 2:
                    starts = bands_upto(int(starts[-1]))
                k = int(segments_of(starts, least)[band])
                yield pd.DataFrame({"band": band, "segment": np.arange(k), "sets": n, "shingles": shingles})

    whole = sizes.mapInPandas(every_segment, "band int, segment int, sets bigint, shingles double")
    loads = whole.join(pairs, ["band", "segment"], "left").fillna(0.0, ["pairs"])

    def run(frame):
        return allocate(frame, pair_cost, row_cost)

    return materialise(loads.groupBy("band").applyInPandas(run, "band int, segment int, apart int"))


def neighbours(texts: DataFrame, twice: DataFrame, least) -> DataFrame:
    """(node, band, segment, key): the whole and one-deletion signatures of the segments in ``twice``."""
    names = ["node", "band", "segment", "key"]

    def run(batches):
        for batch in batches:
            for part, texts in _chunks(batch, 1):
                sizes, of, number, text, band, k = _numbered(texts, least)
                wanted = {t: {(w["band"], w["segment"]) for w in ws.as_py()} for t, ws in enumerate(part.column(2))}
                picked = [i for i in range(len(text)) if any(b == band[i] for b, _ in wanted[text[i]])]
                text, band = text[picked], band[picked]
                row, shingle = _expanded(of, sizes, text)
                segment = _segment(number[shingle], k[band[row]])
                own = {(i, s) for i in range(len(text)) for b, s in wanted[text[i]] if b == band[i]}
                out = []
                for i, s in sorted(own):  # as many as the rows asked for
                    held = number[shingle[(row == i) & (segment == s)]]
                    whole = held.sum(dtype=np.uint64)
                    salt = _salt(np.array([band[i]]), np.array([s]), 1)
                    keys = np.unique(_mix(np.append(whole - held, whole) + salt).view(np.int64))
                    out += [(int(text[i]), int(band[i]), s, key) for key in keys.tolist()]
                take = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), *[pa.array([o[j] for o in out], t) for j, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()))]],
                    names=names,
                )

    wanted = twice.groupBy("node").agg(F.collect_set(F.struct("band", "segment")).alias("wanted"))
    rows = texts.join(wanted, "node")
    return rows.select("node", "text", "wanted").mapInArrow(run, "node bigint, band int, segment int, key bigint")


# ---- pairs


def _alike(a, b, least):
    return least[1] * F.least(a, b) >= least[0] * F.greatest(a, b)


def _apart(x, y):
    """How many bits of two parities differ."""
    return sum(F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(8))


def _near(a, b, x, y, least):
    """What sizes and parities allow of a pair at ``least``."""
    return _alike(a, b, least) & ((least[1] + least[0]) * _apart(x, y) <= (least[1] - least[0]) * (a + b))


_PAIR = ("a", "a_label", "b", "b_label")


def _of(nodes, side):
    return nodes.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in nodes.columns])


def star_pairs(met: DataFrame, sides: DataFrame, turns, least) -> DataFrame:
    """Members with the leaders of their bucket, one for each turn, where they are in different components."""
    first = [F.min(F.struct(F.xxhash64("node", F.lit(t)).alias("turn"), F.col("node").alias("lead")))["lead"] for t in turns]
    leads = met.groupBy("key").agg(F.array(*first).alias("leads"))
    rows = met.join(leads, "key").select(F.explode(F.array_distinct("leads")).alias("a"), F.col("node").alias("b"))
    pairs = rows.filter("a <> b").distinct().join(_of(sides, "a"), "a").join(_of(sides, "b"), "b")
    near = _near(*[F.col(c) for c in ("a_n", "b_n", "a_parity", "b_parity")], least)
    return pairs.filter((F.col("a_label") != F.col("b_label")) & near).select(*_PAIR)


def open_rows(met: DataFrame, sides: DataFrame) -> DataFrame:
    """The rows of buckets that hold different components, with their labels."""
    named = met.select("key", "node").join(sides.select("node", "label"), "node").repartition("key")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return materialise(named.join(mixed.select("key"), "key"))


def other_pairs(met: DataFrame, sides: DataFrame, least) -> DataFrame:
    """All pairs of different components in a bucket that can reach ``least``."""
    # A pair of different components has one set outside the component that is most frequent in the bucket.
    main = (
        met.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("key").agg(F.max(F.struct("rows", "label"))["label"].alias("main"))
    )
    rows = materialise(met.join(main, "key").join(sides.drop("label"), "node"))
    x, y = rows.filter("label <> main").alias("x"), rows.alias("y")
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        & _near(F.col("x.n"), F.col("y.n"), F.col("x.parity"), F.col("y.parity"), least),
    )
    low = F.col("x.node") < F.col("y.node")  # a pair met in two buckets is one pair
    pick = lambda c, first: F.when(low == F.lit(first), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    columns = [pick(c, first) for first in (True, False) for c in ("node", "label")]
    return pairs.select(*[c.alias(n) for c, n in zip(columns, _PAIR)]).distinct()


def linked(one: bytes, other: bytes, least=LEAST) -> bool:
    """Whether two texts' shingles reach ``least``, compared as words."""
    ws = one.split(), other.split()
    if not ws[0] or not ws[1]:
        return False
    known = {w: i for i, w in enumerate({*ws[0], *ws[1]})}
    number = [np.fromiter((known[w] for w in x), np.int64, len(x)) for x in ws]
    if min(map(len, number)) < SHINGLE:
        return len(number[0]) == len(number[1]) and bool((number[0] == number[1]).all())
    cut = len(number[0]) - SHINGLE + 1
    runs = [np.concatenate([x[k : len(x) - SHINGLE + 1 + k] for x in number]) for k in range(SHINGLE)]
    code = runs[0]
    for x in runs[1:]:
        code = np.unique(code, return_inverse=True)[1] * len(known) + x
    a, b = np.unique(code[:cut]), np.unique(code[cut:])
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, least) -> DataFrame:
    """(a, b): the labels of the pairs whose texts link."""

    def run(batches):
        for batch in batches:
            keep = [linked(_lower(x), _lower(y), least) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(_of(texts, "b"), "b").join(_of(texts, "a"), "a")
    return materialise(both.select("a_label", "b_label", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint"))


# ---- components


def components(docs: DataFrame, least=LEAST, pair_cost: float = PAIR_COST, row_cost: float = ROW_COST) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = materialise(sets(docs, least))
    heads = materialise(
        rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("m"))
        .select("n", "d1", "d2", "m.doc_id", "m.th")
    )
    head = heads.select("doc_id", "th")
    own = rows.select("doc_id", "th", "n", "parity", "bands").join(head, ["doc_id", "th"], "left_semi")
    # Stored with a number of its own for each set; repeated rows of one set count once.
    own = materialise(own.dropDuplicates(["doc_id", "th"]).withColumn("node", F.monotonically_increasing_id()))
    text_of = lambda nodes: _texts(docs).join(nodes, ["doc_id", "th"]).select("node", "text").dropDuplicates(["node"])
    banded = own.select("node", "n", F.explode("bands").alias("b")).select("node", "n", "b.*")
    met = in_buckets(banded.select("node", "band", F.posexplode("keys").alias("segment", "key")))
    apart = allocation(banded, met, least, pair_cost, row_cost)
    if not apart.isEmpty():
        twice = banded.select("node", "band").join(apart.filter("apart = 2"), "band").select("node", "band", "segment")
        asked = own.select("doc_id", "th", "node").join(twice.select("node").distinct(), "node")
        more = in_buckets(materialise(neighbours(text_of(asked), twice, least)))
        met = met.join(apart.filter("apart = 0"), ["band", "segment"], "left_anti").select("key", "node").union(more.select("key", "node"))
    met = materialise(met.select("key", "node").distinct())
    nodes = materialise(met.select("node").distinct())
    # The label of a set is a document's id from the start, so that rows of one id are one.
    known = materialise(own.select("node", "doc_id", "th", "n", "parity").join(nodes, "node"))
    texts = materialise(text_of(known.select("doc_id", "th", "node")))
    labels = known.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")).distinct()
    sides = lambda: known.join(labels.withColumnRenamed("node", "doc_id"), "doc_id").drop("doc_id", "th")
    turn = 0
    for leaders in STARS:
        links = verified(star_pairs(met, sides(), range(turn, turn + leaders), least), texts, least)
        labels = relabelled(labels, links)
        met = open_rows(met, sides())
        turn += leaders
        if met.isEmpty() or links.isEmpty():
            break
    labels = relabelled(labels, verified(other_pairs(met, sides(), least), texts, least))
    named = heads.select("n", "d1", "d2", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.select("n", "d1", "d2", F.coalesce("label", "doc_id").alias("component"))
    by_row = materialise(
        rows.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )
    # Rows of one id with different texts join their components, as their id is one document.
    odd = by_row.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).filter("a < b")
    if not odd.isEmpty():
        seen = materialise(by_row.select(F.col("component_id").alias("node")).union(by_row.select("doc_id")).distinct())
        edges = by_row.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).filter("a <> b")
        merged = lowered(edges, seen).select(F.col("node").alias("doc_id"), F.col("label").alias("component_id"))
        by_row = by_row.drop("component_id").join(merged, "doc_id").select("doc_id", "n_shingles", "component_id")
    lost = sets(docs.filter(F.col("doc_id").isNull()).withColumn("doc_id", F.lit(0).cast("bigint")), least)
    none = F.lit(None).cast("bigint")
    return by_row.unionByName(lost.select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("component_id")))
