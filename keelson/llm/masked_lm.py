"""Documents scored by masked pseudo-likelihood: each word predicted from the words on both sides.

The network's vocabulary is the TOP most frequent words of all documents and RARE buckets, by crc32,
for the rest. A word of a bucket has the bucket's probability times its share of the bucket's
occurrences, from the counts of all words (``score_words``; ``score`` is the network alone). The counts
of at most SENT words are sent to all tasks, words that occur once need none, the others' are joined. A word's hidden state is a softsign of the sum of one vector for each of its SIDE neighbours
on either side; the word itself is masked. Its probability is that of its class times that of the
word in the class; classes are runs of CLASS numbers, frequent words first. A document's score is
the sum of the logarithms over all its words.

Training is data-parallel: the network starts from fixed random vectors and outputs that give each
word its frequency in all documents. In each round every task takes the network through its own
documents by stochastic steps in numpy; the weights are then averaged by the words each task saw,
summed in shuffled pieces of the network. A round takes every STRIDE-th word of all documents, from
another start each, so the STRIDE rounds predict every word once.

Words are runs between ASCII spaces, A-Z lower-cased. Null or empty text has no words and score 0.
Neighbours beyond a document's ends are a padding word. Repeated rows are scored each; extra columns
are ignored; an empty table gives no rows. A null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import materialise, slim

TOP = 3072
RARE = 1024
CLASS = 64
WORDS = TOP + RARE
PAD = WORDS
HIDDEN = 16
SIDE = 2
STRIDE = 8
ROUNDS = STRIDE  # together they take every word
BATCH = 8192  # positions of a step
RATE = 0.15
PIECES = 64  # of the network, for averaging
SLICE = 8 << 20  # bytes of text told apart at once
HELD = 4_000_000  # words a task counts before it passes the counts on
SENT = 1 << 18  # words without a number whose counts are sent to all tasks

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FITS = 40  # logits whose exponentials, and the sums of them, are far from a float's bounds
_NEAR = [k for k in range(-SIDE, SIDE + 1) if k]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def _slices(texts: pa.Array):
    """``texts`` in runs of about SLICE bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")) + 1
        yield texts.slice(at, to - at)
        at = min(to, len(texts))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` each text, all in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten().cast(pa.binary())
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # beside spaces at either end
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full], minlength=len(n))
        words = words.filter(pa.array(full))
    return words, n.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents."""

    def run(batches):
        def out():
            counts = pa.chunked_array(parts, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "n"])

        parts, held = [], 0
        for batch in batches:
            for texts in _slices(batch.column(0)):
                parts.append(_split(texts)[0])
                held += len(parts[-1])
                if held >= HELD:
                    yield out()
                    parts, held = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), "word").limit(TOP)


def vocabulary(docs: DataFrame) -> dict[bytes, int]:
    """The TOP most frequent words, ties by their bytes, numbered from 0."""
    return {bytes(r.word): i for i, r in enumerate(_top(word_counts(docs)).collect())}


def rare_words(counts: DataFrame, top: DataFrame) -> DataFrame:
    """(word, n, bucket) of the words that have no number of their own."""
    rest = counts.join(F.broadcast(top.select("word")), "word", "left_anti")  # at most TOP
    return rest.withColumn("bucket", F.crc32("word") % RARE)


def _level():
    """Of a count, four for each doubling."""
    return F.floor(4 * F.log2("n")).cast("int")


def _levels(rare: DataFrame) -> list:
    """bucket, level, total n and number of words: what is known of the rare words on the driver."""
    return rare.groupBy("bucket", _level().alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()


def frequencies(top: list, levels: list) -> np.ndarray:
    """How often each number occurs in all documents."""
    out = np.zeros(WORDS)
    out[: len(top)] = [r.n for r in top]
    for r in levels:
        out[TOP + r.bucket] += r.n
    return out


def _least(levels: list) -> int:
    """The least level from which on there are at most SENT words."""
    words = Counter()
    for r in levels:
        words[r.level] += r.words
    least, total = max(words, default=0) + 1, 0
    for level in sorted(words, reverse=True):
        total += words[level]
        if total > SENT:
            break
        least = level
    return least


def number(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return _numbers(words, known)[0]


def _numbers(words: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    """The words' numbers, and those words that have no number of their own."""
    get, crc = known.get, zlib.crc32
    out = np.array([get(w, -1) for w in words], np.int64)
    at = np.flatnonzero(out < 0)
    rare = [words[i] for i in at.tolist()]
    out[at] = [TOP + crc(w) % RARE for w in rare]
    return out.astype(np.uint16), rare


def _lists(values: pa.Array, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values)


def numbered(docs: DataFrame, known: dict[bytes, int], totals: np.ndarray, frequent: pa.Table) -> DataFrame:
    """doc_id, the word numbers of every row, two bytes each, inside, the row's rest, row; stored.

    ``totals``: occurrences of each bucket; ``frequent``: the counts of some words without a number.
    ``inside`` sums the logarithms of the shares of a row's words in their buckets, as if every word
    that is not in ``frequent`` occurred once; ``rest`` has those words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(
        (known, np.log(np.maximum(totals, 1)), frequent["word"].combine_chunks(), np.log(frequent["n"].to_numpy()))
    )

    def run(batches):
        known, log_totals, often, log_often = sent.value
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                words, n = _split(texts)
                told = words.dictionary_encode()
                numbers, codes = number(told.dictionary.to_pylist(), known), told.indices.to_numpy()
                place = np.full(len(numbers), -1)
                share = np.zeros(len(numbers))
                rare = np.flatnonzero(numbers >= TOP)
                place[rare] = pc.fill_null(pc.index_in(told.dictionary.take(pa.array(rare)), often), -1).to_numpy()
                share[rare] = -log_totals[numbers[rare] - TOP]
                share[place >= 0] += log_often[place[place >= 0]]
                of = np.repeat(np.arange(len(n)), n)
                left = np.flatnonzero(((numbers >= TOP) & (place < 0))[codes])
                data = pa.py_buffer(np.ascontiguousarray(numbers[codes]))
                ends = pa.array(np.append(0, np.cumsum(2 * n)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)),
                     pa.Array.from_buffers(pa.binary(), len(n), [None, ends.buffers()[1], data]),
                     pa.array(np.bincount(of, share[codes], len(n)).astype(np.float64)),  # whole numbers without words
                     _lists(words.take(pa.array(left)), np.bincount(of[left], minlength=len(n)))],
                    names=["doc_id", "ids", "inside", "rest"],
                )
                at += len(n)

    schema = "doc_id bigint, ids binary, inside double, rest array<binary>"
    rows = slim(docs, "doc_id", "text").mapInArrow(run, schema)
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()))


class Network:
    """``side``: a table of vectors for each neighbour; ``classes`` and ``words``: outputs."""

    def __init__(self, weights: np.ndarray | None = None, seed: int = 13):
        rng = np.random.default_rng(seed)
        shapes = [(len(_NEAR), WORDS + 1, HIDDEN), (HIDDEN,), (WORDS // CLASS, HIDDEN + 1), (WORDS // CLASS, CLASS, HIDDEN + 1)]
        sizes = [int(np.prod(s)) for s in shapes]
        if weights is None:
            weights = np.zeros(sum(sizes), np.float32)
            weights[: sizes[0]] = rng.standard_normal(sizes[0]) * 0.5
            weights[sizes[0] + sizes[1] :] = rng.standard_normal(sizes[2] + sizes[3]) * 0.05
        self.flat = np.ascontiguousarray(weights, np.float32)
        parts = np.split(self.flat, np.cumsum(sizes)[:-1])
        self.side, self.bias, self.classes, self.words = (p.reshape(s) for p, s in zip(parts, shapes))

    def start(self, counts: np.ndarray) -> "Network":
        """Outputs from the words' frequencies, whatever the neighbours."""
        each = counts.reshape(-1, CLASS) + 0.5
        self.classes[:, :HIDDEN] = self.words[:, :, :HIDDEN] = 0
        self.classes[:, HIDDEN] = np.log(each.sum(1) / each.sum())
        self.words[:, :, HIDDEN] = np.log(each / each.sum(1, keepdims=True))
        return self

    def hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-activation, state with a constant 1 last); ``near``: (neighbour, position)."""
        pre = self.bias + self.side[0][near[0]]
        for table, ids in zip(self.side[1:], near[1:]):
            pre += table[ids]
        state = np.ones((len(pre), HIDDEN + 1), np.float32)
        np.divide(pre, 1 + np.abs(pre), out=state[:, :HIDDEN])
        return pre, state

    def log_p(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | neighbours) at each position."""
        order, runs = self._runs(target // CLASS)
        own = target[order]
        _, state = self.hidden(near[:, order])
        logits = state @ self.classes.T
        found = _log_pick(logits, own // CLASS)
        for k, run in runs:
            np.matmul(state[run], self.words[k].T, out=logits[run])
        found += _log_pick(logits, own % CLASS)
        out = np.empty_like(found)
        out[order] = found
        return out

    def _runs(self, klass: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order in which all positions of a class follow each other, and each class's slice of it."""
        cuts = np.append(0, np.cumsum(np.bincount(klass, minlength=len(self.classes))))
        return _order(klass), [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]

    def step(self, near: np.ndarray, target: np.ndarray, rate: float) -> float:
        """One step down the mean loss of these positions, each output and vector by its own rows."""
        order, runs = self._runs(target // CLASS)  # a step is a sum: any order will do
        near, target = near[:, order], target[order]
        pre, state = self.hidden(near)
        n = len(target)
        dclass, loss = _residual(state @ self.classes.T, target // CLASS)
        dstate = dclass @ self.classes
        # Word outputs and vectors see few positions of a batch each; their steps are by the sum.
        self.classes -= rate * np.sqrt(n) * (dclass.T @ state) / n
        logits = np.empty((n, CLASS), np.float32)
        for k, run in runs:
            np.matmul(state[run], self.words[k].T, out=logits[run])
        dword, part = _residual(logits, target % CLASS)
        loss += part
        for k, run in runs:
            dstate[run] += dword[run] @ self.words[k]
            self.words[k] -= rate * (dword[run].T @ state[run]) / np.sqrt(run.stop - run.start)
        dpre = dstate[:, :HIDDEN] / np.square(1 + np.abs(pre))
        self.bias -= rate * dpre.mean(0)
        for table, ids in zip(self.side, near):
            _descend(table, ids, dpre, rate)
        return loss / n


def _fitted(logits):
    """Each row less its greatest logit, unless all exponentials and their sums fit well as they are."""
    if not -FITS < logits.min() <= logits.max() < FITS:
        logits -= logits.max(1, keepdims=True)
    return logits


def _total(p):
    return p @ np.ones(p.shape[1], p.dtype)


def _log_pick(logits, at):
    own = _fitted(logits)[np.arange(len(at)), at]
    return own - np.log(_total(np.exp(logits, out=logits)))


def _residual(logits, at):
    """Probabilities less one at the truth, and the summed loss."""
    p = np.exp(_fitted(logits), out=logits)
    p *= (1 / _total(p))[:, None]
    rows = np.arange(len(at))
    loss = -float(np.log(p[rows, at] + 1e-30).sum())
    p[rows, at] -= 1
    return p, loss


def _order(numbers):
    """The stable order of word or class numbers; numpy sorts 16 bits by radix."""
    return np.argsort(numbers.astype(np.uint16), kind="stable")


def _descend(table, ids, gradient, rate):
    """Each word's vector moves by its summed gradient over the root of its occurrences."""
    size, width = table.shape
    cells = (ids.astype(np.int64) * width)[:, None] + np.arange(width)
    sums = np.bincount(cells.ravel(), gradient.ravel(), size * width).reshape(size, width)
    table -= rate * sums / np.sqrt(np.maximum(np.bincount(ids, minlength=size), 1))[:, None]


def _laid(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another with SIDE pads between, and the places of their words."""
    gap = np.full(SIDE, PAD, np.int64)
    row = np.concatenate([gap, *[x for d in docs for x in (d.astype(np.int64), gap)]])
    return row, np.flatnonzero(row != PAD)


def _near(row, at):
    return np.stack([row[at + k] for k in _NEAR])


def _gathered(batches, most: int = 1 << 19):
    """(other columns of rows, arrays of numbers) of a few rows at a time, bounded by their words."""
    docs, ids, held = [], [], 0
    for batch in batches:
        *others, numbers = batch.columns
        for doc, raw in zip(zip(*(c.to_pylist() for c in others)), numbers):
            docs.append(np.frombuffer(raw.as_py() or b"", np.uint16))
            ids.append(doc)
            held += len(docs[-1])
            if held >= most:
                yield ids, docs
                docs, ids, held = [], [], 0
    if ids:
        yield ids, docs


def _learn(net: Network, docs: list[np.ndarray], rng, turn: int, stride: int, rate: float) -> int:
    """Steps over every ``stride``-th position from ``turn``; how many positions."""
    row, places = _laid(docs)
    places = rng.permutation(places[turn::stride])
    for at in range(0, len(places), BATCH):
        mine = places[at : at + BATCH]
        net.step(_near(row, mine), row[mine], rate)
    return len(places)


def train(tokens: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE) -> np.ndarray:
    """Weights of the network, averaged over tasks after each round."""
    weights = Network().start(counts).flat
    for turn in range(rounds):
        weights = _round(tokens, weights, turn, stride, RATE / (1 + turn))
    return weights


def _round(tokens: DataFrame, weights: np.ndarray, turn: int, stride: int, rate: float) -> np.ndarray:
    sent = tokens.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        net, seen = Network(sent.value.copy()), 0
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
        for _, docs in _gathered(batches):
            seen += _learn(net, docs, rng, turn, stride, rate)
        if seen:
            pieces = np.array_split(net.flat, PIECES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([seen] * PIECES, pa.int64()),
                 pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["piece", "seen", "part"],
            )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        seen: Counter = Counter()
        for batch in batches:
            for piece, n, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sums[piece] = sums.get(piece, 0) + n * np.frombuffer(part, np.float32).astype(np.float64)
                seen[piece] += n
        for piece, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([seen[piece]], pa.int64()),
                 pa.array([(total / seen[piece]).astype(np.float32).tobytes()], pa.binary())],
                names=["piece", "seen", "part"],
            )

    schema = "piece int, seen bigint, part binary"
    parts = tokens.select("row", "ids").mapInArrow(run, schema).repartition(PIECES, "piece").mapInArrow(add, schema).collect()
    if not parts:
        return weights
    by = {r.piece: np.frombuffer(r.part, np.float32) for r in parts}
    return np.concatenate([by[k] for k in range(PIECES)])


def score_all(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """The summed log-probability of each document's words."""
    row, places = _laid(docs)
    out = np.zeros(len(row))
    for at in range(0, len(places), 4 * BATCH):
        mine = places[at : at + 4 * BATCH]
        out[mine] = net.log_p(_near(row, mine), row[mine])
    lengths = np.array([len(d) for d in docs])
    total = np.concatenate([[0], np.cumsum(out)])
    starts = SIDE + np.cumsum(lengths + SIDE) - lengths - SIDE
    return total[starts + lengths] - total[starts]


def _scored(docs: DataFrame, rounds: int, stride: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """row, doc_id, n_words, inside and the network's log_p of every row; the rows' rest; (word, n) of words in it."""
    spark = docs.sparkSession
    counts = materialise(word_counts(docs))
    top = _top(counts).collect()
    rare = rare_words(counts, spark.createDataFrame([(r.word,) for r in top], "word binary"))
    levels = _levels(rare)
    number_of, least = frequencies(top, levels), _least(levels)
    frequent = rare.filter(_level() >= least).select("word", "n").toArrow()  # at most SENT
    tokens = numbered(docs, {bytes(r.word): i for i, r in enumerate(top)}, number_of[TOP:], frequent)
    sent = spark.sparkContext.broadcast(train(tokens, number_of, rounds, stride))

    def run(batches):
        net = Network(sent.value)
        for ids, rows in _gathered(batches):
            at, doc_ids, inside = zip(*ids)
            n = np.array([len(r) for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(n), pa.array(inside, pa.float64()),
                 pa.array(np.where(n > 0, score_all(net, rows), 0.0))],
                names=["row", "doc_id", "n_words", "inside", "log_p"],
            )

    schema = "row bigint, doc_id bigint, n_words bigint, inside double, log_p double"
    scores = tokens.select("row", "doc_id", "inside", "ids").mapInArrow(run, schema)
    return scores, tokens, rare.filter((_level() < least) & (F.col("n") > 1)).select("word", "n")


def _with_mean(scores: DataFrame) -> DataFrame:
    mean = F.col("log_p") / F.greatest("n_words", F.lit(1))
    return scores.select("doc_id", "n_words", "log_p", mean.alias("mean_log_p"))


def score(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """doc_id, n_words, log_p (summed) and mean_log_p of every row, a rare word scored as its bucket."""
    return _with_mean(_scored(docs, rounds, stride)[0])


def score_words(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """``score`` with each rare word's own probability: that of its bucket times its share of it.

    The shares of frequent words and those of words that occur once are summed where words are
    numbered; the counts of the others are joined.
    """
    scores, tokens, others = _scored(docs, rounds, stride)
    more = (
        tokens.select("row", F.explode("rest").alias("word")).join(others, "word")
        .groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    )
    inside = F.col("inside") + F.coalesce("more", F.lit(0.0))
    return _with_mean(scores.join(more, "row", "left").withColumn("log_p", F.col("log_p") + inside))
