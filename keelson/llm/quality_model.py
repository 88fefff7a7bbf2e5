"""Quality scores learned from preferences between pairs of documents (Bradley-Terry).

Each document has a feature vector computed from its whole text. A document marked good is preferred
to one marked bad; weights are fitted to the logistic loss of feature differences over pairs, by
Newton's method. All labelled documents are learned from: they are dealt out to groups, in a group
each good one is paired with each bad one, and each step sums over all pairs in Spark. A document's
utility is its weighted sum; the threshold is the exact quantile of all labelled utilities at the
share of bad ones, and the score is a logistic curve that passes ACCEPT there.

Null text is empty text and is scored; rows without a label are scored alike; with no labels of one
kind all scores are ACCEPT. Repeated rows give equal rows; null labels, and labels of null ids, are
ignored; repeated ones count once, and a document labelled both ways is learned as both; of texts of
one id one is learned. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import fold, materialise, slim
from keelson.operators.ranking import rank_in_groups

ACCEPT = 0.7
DECAY = 1e-3
LEAST_SCALE = 0.02
RARER = 8  # documents of the rarer label in a group of pairs
OTHERS = 128  # of the other label in a row of pairs
PASSES = 40  # over all pairs, at most
ENOUGH = 1e-9  # of the mean loss that a pass still gains
PIECES = 16  # of a sum, for adding
PART_ROWS = 16_384  # rows that one task ranks

#: lower, upper, digit, space, line end, sentence mark, other ASCII mark, non-ASCII
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    _CLASS[_c] = (
        0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in (32, 9)
        else 4 if _c in (10, 13) else 5 if chr(_c) in ".,;:!?'\"()-" else 7 if _c >= 128 else 6
    )
N_FEATURES = 8 + 64 + 96 + 10


def features(text: str) -> np.ndarray:
    """Shares of byte classes, of their pairs and of ASCII bytes, and how much words and lines repeat."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = text.encode("utf-8", "replace")
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    kinds = _CLASS[data]
    n = len(data)
    out[:8] = np.sqrt(np.bincount(kinds, minlength=8) / n)
    if n > 1:
        out[8:72] = np.sqrt(np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64) / (n - 1))
    out[72:168] = np.sqrt(np.bincount(data, minlength=256)[32:128] / n)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w, s = max(1, len(words)), max(1, len(lines))
    own = len(set(words))
    out[168:] = (
        own / w, np.log1p(own) / 10, np.log1p(len(words)) / 10, len(set(lines)) / s, np.log1p(s) / 10,
        min(n / w, 50) / 50, sum(a == b for a, b in zip(words, words[1:])) / w,
        len({*zip(words, words[1:])}) / w, min(len(words), 50) / 50, 1.0,
    )
    return out


class Ranker:
    def __init__(self, mean, scale, weights, threshold, spread):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.threshold, self.spread = threshold, spread

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.utility(x) - self.threshold) / self.spread + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_loss(weights: np.ndarray, differences: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of preferring the first of each pair, and its gradient."""
    z = differences @ weights
    loss = np.logaddexp(0, -z).mean() + DECAY * (weights @ weights) / 2
    return float(loss), -(differences.T @ (1 / (1 + np.exp(np.clip(z, -30, 30))))) / len(z) + DECAY * weights


def pair_sums(weights: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Over all pairs of a good and a bad one: their number, loss, gradient and second derivatives."""
    z = (good @ weights)[:, None] - (bad @ weights)[None, :]
    p = 1 / (1 + np.exp(np.clip(z, -30, 30)))  # probability of the wrong order
    q = p * (1 - p)
    gradient = bad.T @ p.sum(0) - good.T @ p.sum(1)
    cross = good.T @ (q @ bad)
    second = (good.T * q.sum(1)) @ good + (bad.T * q.sum(0)) @ bad - cross - cross.T
    return np.concatenate([[z.size, np.logaddexp(0, -z).sum()], gradient, second.ravel()])


def newton(sums, size: int) -> np.ndarray:
    """Weights of the least mean loss; ``sums(weights)`` are the pair sums over all pairs."""

    def at(weights):
        total = sums(weights)
        n = total[0]
        loss = total[1] / n + DECAY * (weights @ weights) / 2
        gradient = total[2 : 2 + size] / n + DECAY * weights
        return loss, gradient, total[2 + size :].reshape(size, size) / n + DECAY * np.eye(size)

    weights = np.zeros(size)
    loss, gradient, second = at(weights)
    step, share = -np.linalg.solve(second, gradient), 1.0
    for _ in range(PASSES):
        tried = at(weights + share * step)
        if tried[0] > loss:
            share /= 2
            continue
        gained = loss - tried[0]
        weights = weights + share * step
        loss, gradient, second = tried
        step, share = -np.linalg.solve(second, gradient), 1.0
        if gained < ENOUGH:
            break
    return weights


def wanted_ranks(n: int, bad: int) -> tuple[int, list[tuple[int, int, float]]]:
    """The last rank below the threshold, and of the quartiles the ranks on either side and the share between."""
    cut = min(max(1, bad), n - 1)
    places = [(n - 1) * q for q in (0.25, 0.75)]
    return cut, [(int(x) + 1, min(int(x) + 2, n), x - int(x)) for x in places]


def cut_at(ranker: Ranker, at: dict[int, float], n: int, bad: int) -> Ranker:
    """Threshold and spread from the utilities at the wanted ranks."""
    cut, quartiles = wanted_ranks(n, bad)
    ranker.threshold = float((at[cut] + at[cut + 1]) / 2)
    low, high = (at[a] + share * (at[b] - at[a]) for a, b, share in quartiles)
    ranker.spread = float(max(1e-6, high - low))
    return ranker


def fit(x: np.ndarray, label: np.ndarray) -> Ranker | None:
    """A ranker of documents in memory, from all of them."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + LEAST_SCALE
    z = (x - mean) / scale
    groups = -(-min(len(good), len(bad)) // RARER)
    dealt = [(z[good[k::groups]], z[bad[k::groups]]) for k in range(groups)]
    weights = newton(lambda w: sum(pair_sums(w, g, b) for g, b in dealt), x.shape[1])
    ranker = Ranker(mean, scale, weights, 0.0, 1.0)
    utilities = dict(enumerate(np.sort(ranker.utility(x)), 1))
    return cut_at(ranker, utilities, len(x), len(bad))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row, computed once and stored."""

    def run(batches):
        for batch in batches:
            vectors = [features(t.as_py() or "").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["doc_id", "x"])

    return materialise(slim(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, x binary"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, rank, x) of all documents with a label, ranked within it by hash of their id from 1; stored."""
    known = slim(labels, "doc_id", "quality").filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    joined = rows.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    ranked = rank_in_groups(joined, ["quality"], [F.xxhash64("doc_id"), F.col("doc_id")], part_rows=PART_ROWS)
    return materialise(ranked.select("quality", "rank", "x"))


def paired(rows: DataFrame, rare: int, groups: int) -> DataFrame:
    """(good, bad): features of documents that form pairs, each with each; stored.

    Both labels are dealt out to ``groups``; a row has all the documents of the rarer label in a group,
    RARER at most, and up to OTHERS of the other, so every document is in a pair.
    """
    place = F.floor((F.col("rank") - 1) / groups)
    dealt = rows.withColumn("group", (F.col("rank") - 1) % groups)
    listed = F.array_sort(F.collect_list(F.struct("rank", "x")))["x"]
    few = dealt.filter(F.col("quality") == rare).groupBy("group").agg(listed.alias("few"))
    many = dealt.filter(F.col("quality") != rare).groupBy("group", F.floor(place / OTHERS).alias("part")).agg(listed.alias("many"))
    names = ("bad", "good") if rare == 0 else ("good", "bad")
    return materialise(many.join(few, "group").select(F.col("few").alias(names[0]), F.col("many").alias(names[1])).select("good", "bad"))


def _vectors(arrow) -> np.ndarray:
    return np.frombuffer(b"".join(arrow.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def summed(rows: DataFrame, of) -> np.ndarray:
    """The sum of ``of(batch)``, arrays of one length, over all batches; added up in shuffled pieces."""

    def run(batches):
        total = None
        for batch in batches:
            own = of(batch)
            total = own if total is None else total + own
        if total is not None:
            task = TaskContext.get().partitionId()
            parts = [p.tobytes() for p in np.array_split(total, PIECES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([task] * PIECES, pa.int32()), pa.array(parts, pa.binary())],
                names=["piece", "task", "part"],
            )

    def add(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for piece, task, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                by.setdefault(piece, []).append((task, part))
        for piece, parts in by.items():  # in order of the tasks, so that the sum is the same each time
            total = np.sum([np.frombuffer(p, np.float64) for _, p in sorted(parts)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "part"])

    parts = rows.mapInArrow(run, "piece int, task int, part binary").repartition(PIECES, "piece")
    by = {r.piece: np.frombuffer(r.part, np.float64) for r in parts.mapInArrow(add, "piece int, part binary").collect()}
    return np.concatenate([by[k] for k in range(PIECES)])


def train(rows: DataFrame) -> Ranker | None:
    """A ranker from all rows (quality, rank, x); every row takes part in each step of the fit."""
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    n, rare = sum(counts.values()), min(counts, key=lambda k: (counts[k], k))

    def moments(batch):
        x = _vectors(batch.column(0))
        return np.concatenate([x.sum(0), np.square(x).sum(0)])

    first, second = np.split(summed(rows.select("x"), moments) / n, 2)
    scale = np.sqrt(np.maximum(0, second - first * first)) + LEAST_SCALE
    pairs = paired(rows, rare, -(-counts[rare] // RARER))

    def sums(weights):
        def of(batch):
            whiten = lambda a: (_vectors(a.values) - first) / scale
            return sum(pair_sums(weights, whiten(g), whiten(b)) for g, b in zip(batch.column(0), batch.column(1)))

        return summed(pairs, of)

    ranker = Ranker(first, scale, newton(sums, N_FEATURES), 0.0, 1.0)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranker.utility(_vectors(batch.column(0))))], names=["u"])

    cut, quartiles = wanted_ranks(n, counts[0])
    wanted = {cut, cut + 1, *(k for a, b, _ in quartiles for k in (a, b))}
    ranked = rank_in_groups(rows.select("x").mapInArrow(run, "u double"), [], "u", part_rows=PART_ROWS)
    at = {r["rank"]: r["u"] for r in ranked.filter(F.col("rank").isin(*wanted)).collect()}  # six at most
    return cut_at(ranker, at, n, counts[0])


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``, learned from ``labels``."""
    rows = described(docs)
    sent = docs.sparkSession.sparkContext.broadcast(train(labelled(rows, labels)))

    def run(batches):
        ranker = sent.value
        for batch in batches:
            score = ranker.score(_vectors(batch.column(1))) if ranker else np.full(batch.num_rows, ACCEPT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out quarter."""
    return labels.filter(fold(F.col("doc_id"), 4) != 2)
