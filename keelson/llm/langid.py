"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two gated recurrent layers read windows of WINDOW bytes, one from either end; at every byte their
states together give the probabilities of the languages, and a document's are the mean over its
letter bytes. Gates are hard sigmoids and candidates softsigns, so a step is a few plain array
operations. Whole texts are read; windows of many documents form one batch.

The network is trained here, on the driver, by backpropagation through time, on one window of each
of at most PER_LANGUAGE documents of each language, chosen by hash of the id.

A null text, or one without a letter, is "und" with score 0. Without any labelled row every text is
"und". Ties go to the first language in order. Repeated rows give equal rows; extra columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keelson.llm.common import fold, lean, slim

UNKNOWN = "und"
WINDOW = 128
STATE = 8
BATCH = 2048  # windows at once
PER_LANGUAGE = 1000
MOST_LANGUAGES = 500
SNIPPET = 120  # characters of a training document
STEPS = 260
TRAIN_BATCH = 96
TRAIN_WINDOW = 64
PAD = 256

LETTER = re.compile(r"[^\W\d_]")
_LETTER_BYTES = np.array([65 <= c <= 90 or 97 <= c <= 122 or 128 <= c < 256 for c in range(257)])


class Layer:
    """One direction: gates z (keep) and r (reset) and a candidate."""

    def __init__(self, rng, state=STATE):
        self.state = state
        self.x = (rng.standard_normal((PAD + 1, 3 * state)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((state, 3 * state)) / np.sqrt(state)).astype(np.float32)
        self._close()

    def _close(self):
        self.x[PAD] = 0
        self.x[PAD, : self.state] = 1e3  # padding keeps the state as it is

    def forward(self, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; ``steps``: (time, batch) bytes. ``keep`` gets what backward needs."""
        n, s = steps.shape[1], self.state
        out = np.empty((len(steps), n, s), np.float32)
        h = np.zeros((n, s), np.float32)
        x, a = np.empty((n, 3 * s), np.float32), np.empty((n, 3 * s), np.float32)
        for t, bytes_ in enumerate(steps):
            np.take(self.x, bytes_, axis=0, out=x)
            np.matmul(h, self.u, out=a)
            pre = x[:, : 2 * s] + a[:, : 2 * s]
            gates = pre * 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r = gates[:, :s], gates[:, s:]
            un = a[:, 2 * s :]
            v = r * un
            v += x[:, 2 * s :]
            c = np.abs(v)
            c += 1
            c = np.divide(v, c, out=c)
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), un.copy(), v, c, np.abs(pre) < 2))
            h = h - c
            h *= z
            h += c
            out[t] = h
        return out

    def backward(self, steps, kept, dout) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of x and u from those of the states, through time."""
        s = self.state
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh = np.zeros_like(dout[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, un, v, c, open_ = kept[t]
            dh = dh + dout[t]
            dz = dh * (h - c)
            dv = dh * (1 - z) / np.square(1 + np.abs(v))
            gates = np.concatenate([dz, dv * un], 1) * 0.25 * open_
            du += h.T @ np.concatenate([gates, dv * r], 1)
            np.add.at(dx, steps[t], np.concatenate([gates, dv], 1))
            dh = dh * z + np.concatenate([gates, dv * r], 1) @ self.u.T
        dx[PAD] = 0
        return dx, du


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Layer(rng), Layer(rng)
        self.out = (rng.standard_normal((2 * STATE, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.u, self.behind.x, self.behind.u, self.out, self.bias]

    def label(self, steps: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every byte: (time, batch, language)."""
        states = np.concatenate([self.ahead.forward(steps), self.behind.forward(steps[::-1])[::-1]], 2)
        return _softmax(states @ self.out + self.bias)

    def gradients(self, steps: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the letter bytes and its gradients; ``truth``: language of each column."""
        ka, kb = [], []
        states = np.concatenate([self.ahead.forward(steps, ka), self.behind.forward(steps[::-1], kb)[::-1]], 2)
        p = _softmax(states @ self.out + self.bias)
        use = _LETTER_BYTES[steps].astype(np.float32)
        total = max(1.0, float(use.sum()))
        own = np.take_along_axis(p, truth[None, :, None], 2)[..., 0]
        loss = -float((np.log(own + 1e-12) * use).sum()) / total
        np.put_along_axis(p, np.broadcast_to(truth[None, :, None], (*steps.shape, 1)), own[..., None] - 1, 2)
        d = p * (use / total)[..., None]
        dstates = d @ self.out.T
        flat, dflat = states.reshape(-1, 2 * STATE), d.reshape(-1, d.shape[2])
        ax, au = self.ahead.backward(steps, ka, dstates[..., :STATE])
        bx, bu = self.behind.backward(steps[::-1], kb, dstates[::-1, :, STATE:])
        return loss, [ax, au, bx, bu, flat.T @ dflat, dflat.sum(0)]

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities over each text's letter bytes; texts without letter bytes get zeros."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        total, letters = np.zeros((len(raw), len(self.languages))), np.zeros(len(raw))
        for steps, of in _windows(raw, WINDOW, BATCH):
            use = _LETTER_BYTES[steps]
            p = self.label(steps) * use[..., None]
            np.add.at(total, of, p.sum(0))
            np.add.at(letters, of, use.sum(0))
        return total / np.maximum(letters, 1)[:, None]


def _softmax(x):
    x = np.exp(x - x.max(-1, keepdims=True))
    x /= x.sum(-1, keepdims=True)
    return x


def _windows(raw: list[bytes], width: int, most: int):
    """Batches of (time, window) bytes and the text of each window; shorter windows are padded."""
    cells, of = [], []

    def batch():
        longest = max(map(len, cells))
        steps = np.full((len(cells), longest), PAD, np.int64)
        for i, c in enumerate(cells):
            steps[i, : len(c)] = np.frombuffer(c, np.uint8)
        return np.ascontiguousarray(steps.T), np.array(of)

    for k, text in enumerate(raw):
        for at in range(0, len(text), width):
            cells.append(text[at : at + width])
            of.append(k)
            if len(cells) == most:
                yield batch()
                cells, of = [], []
    if cells:
        yield batch()


def train(samples: list[tuple[str, str]], seed: int = 11, steps: int = STEPS) -> Network:
    """A network fitted to (language, snippet) pairs by Adam over random batches."""
    languages = sorted({lang for lang, _ in samples})
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    by = [[t.encode()[:TRAIN_WINDOW] for lang, t in samples if lang == own and t] or [b" "] for own in languages]
    if len(languages) < 2:
        return net
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        truth = rng.integers(len(languages), size=TRAIN_BATCH)  # each language as often
        chosen = [by[k][rng.integers(len(by[k]))] for k in truth]
        grid, _ = next(_windows(chosen, TRAIN_WINDOW, TRAIN_BATCH))
        if grid.shape[1] < TRAIN_BATCH:  # empty snippets make no window
            continue
        _, grads = net.gradients(grid, truth)
        rate = 0.03 * (1 - step / (steps + 1)) + 0.001
        for w, g, m, v in zip(net.weights(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        net.ahead._close()
        net.behind._close()
    return net


def samples(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """One snippet of at most ``per_language`` documents of each language, by hash of the id."""
    turn = F.xxhash64(F.col("doc_id"), F.lit(3))
    room = F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1
    at = (F.pmod(F.xxhash64("doc_id", F.lit(5)), room) + 1).cast("int")
    rows = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.col("text").substr(at, F.lit(SNIPPET)).alias("text"), turn.alias("turn"),
                F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(per_language)).alias("slot"))
        .groupBy("lang", "slot").agg(F.min(F.struct("turn", "text")).alias("m"))
        .select("lang", "m.text")
        .limit(per_language * MOST_LANGUAGES + 1)
    )
    found = [(r.lang, r.text) for r in rows.toLocalIterator()]
    if len({lang for lang, _ in found}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return sorted(found)


def predict(docs: DataFrame, net: Network | None, columns: list[str], names=("lang_pred", "score")) -> DataFrame:
    """``columns`` of every row, with the language and its score under ``names``."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                has = [bool(LETTER.search(t)) for t in texts]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if net is not None and any(has):
                    p = net.pooled([t if h else "" for t, h in zip(texts, has)])
                    for i, h in enumerate(has):
                        if h:
                            langs[i] = net.languages[int(p[i].argmax())]
                            scores[i] = min(1.0, float(p[i].max()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*columns, *names],
                )

    kept = slim(docs, *columns)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_keelson_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(lean(run), f"{schema}, {names[0]} string, {names[1]} double")


def identify(docs: DataFrame, learn_from: DataFrame, columns=("doc_id",), names=("lang_pred", "score")) -> DataFrame:
    """``columns``, lang_pred and score of every row, learned from rows with lang and text."""
    found = samples(learn_from)
    return predict(docs, train(found) if found else None, list(columns), names)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those outside the held-out fifth."""
    return slim(docs, "doc_id", "text", "lang").filter(fold(F.col("doc_id"), 5) != 0)


def accepted(docs: DataFrame, least: float | None = None) -> DataFrame:
    """``docs`` without texts of no language or of a score below ``least``.

    By default ``least`` is a fifth above chance among the languages learned, one half at most. Where
    no row tells its language nothing can be learned, and only texts without a letter go.
    """
    columns, names = docs.columns, ("_keelson_lang", "_keelson_score")
    found = samples(learnable(docs))
    if not found:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    net = train(found)
    if least is None:
        least = min(0.5, 1.2 / len(net.languages))
    rated = predict(docs, net, columns, names)
    passed = (F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)
    return rated.filter(passed).select(*[F.col(f"`{c}`") for c in columns])
