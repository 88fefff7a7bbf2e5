"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field beside them.

The patterns find email, ip, card and phone. The field reads islands, the stretches of text around
digits and at-signs, cut into atoms (digit runs, letter runs, single characters). It scores whole
candidate segments of at most MOST_ATOMS atoms by features of the span (digit groups, separators,
check digit, what stands beside it) and by the transition between labels; dynamic programming over
segments chooses boundaries and kinds jointly. Its spans are added where no pattern matched.

It is trained here, by the gradient of the conditional likelihood (forward and backward over
segments), on at most SAMPLE islands of the corpus, chosen by hash: the patterns' matches label
them, and each match is also rewritten in other usual spellings, or spoilt to a negative.

Null text is empty and has no spans; a null doc_id stays null; repeated rows give equal rows; extra
columns are ignored; an empty table gives no rows. Text is read whole; an island's reach left and
right of its digits is bounded by REACH, an entity by MOST_ATOMS.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keelson.llm.common import lean, materialise, slim

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MOST_ATOMS = 24
REACH = 48
SAMPLE = 1500
EPOCHS = 4
RATE = 0.3

_LOCAL = r"[A-Za-z0-9._%+-]"
# An attempt inside a run fails where the attempt at its start failed, so only starts are tried.
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HERE = re.compile(rf"{_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[\[(] ?at ?[\])]")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[\[(] ?(?:at|dot) ?[\])]|[^A-Za-z0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text):
    at = 0
    while True:
        found = _EMAIL_HERE.match(text, at) if at else None
        found = found or _EMAIL.search(text, at)
        if not found:
            return
        yield found
        at = found.end()


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns by start, then kind as listed; ends are exclusive."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", *m.span()) for m in _emails(text)]
    if _DIGIT.search(text):
        out += [
            ("ip", *m.span()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        ]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [
                ("phone", *m.span()) for m in _PHONE.finditer(text)
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15
            ]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def islands(text: str) -> list[tuple[int, str]]:
    """(start, text) of stretches around digits and at-signs, apart from each other."""
    runs: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if runs and m.start() - runs[-1][1] <= 4:
            runs[-1][1] = m.end()
        else:
            runs.append([*m.span()])
    out: list[list[int]] = []
    for a, b in runs:
        left, right = a, b
        while left > 0 and a - left < REACH and not text[left - 1].isspace():
            left -= 1
        while right < len(text) and right - b < REACH and not text[right].isspace():
            right += 1
        if out and left <= out[-1][1] + 1:
            out[-1][1] = right
        else:
            out.append([left, right])
    return [(a, text[a:b]) for a, b in out]


def atoms(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text)]


FEATURES = (
    "bias", "digits<=6", "digits7-9", "digits10-11", "digits12-13", "digits14-19", "digits>19",
    "groups1", "groups2", "groups3", "groups4", "groups5+", "only dots", "space", "hyphen", "bracket",
    "slash", "other mark", "plus first", "bracket first", "octets", "bad octets", "luhn", "not luhn",
    "one at", "spelt at", "many at", "dotted domain", "letters", "334", "334 after 1", "4444",
    "left alnum", "right alnum", "left dot digit", "right dot digit", "left plus", "uneven brackets",
    "no at", "word space",
)
_INDEX = {n: i for i, n in enumerate(FEATURES)}


@lru_cache(maxsize=20_000)
def features(segment: str, left: str, right: str) -> tuple[int, ...]:
    """Indices of the features that hold of a whole span; ``left``, ``right``: what stands beside it."""
    groups = re.findall("[0-9]+", segment)
    digits = "".join(groups)
    n, on = len(digits), ["bias"]
    on.append(next(k for k, most in (("digits<=6", 6), ("digits7-9", 9), ("digits10-11", 11),
                                     ("digits12-13", 13), ("digits14-19", 19), ("digits>19", n)) if n <= most))
    if groups:
        on.append(f"groups{len(groups)}" if len(groups) < 5 else "groups5+")
    marks = re.sub(r"[A-Za-z0-9]", "", segment)
    if marks and set(marks) == {"."}:
        on.append("only dots")
    on += [k for k, c in (("space", " "), ("hyphen", "-"), ("bracket", "("), ("slash", "/")) if c in marks]
    if set(marks) - set(" .-()+/@_%[]"):
        on.append("other mark")
    on += ["plus first"] * segment.startswith("+") + ["bracket first"] * segment.startswith("(")
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", segment):
        on.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "bad octets")
    if 14 <= n <= 19:
        on.append("luhn" if luhn(digits) else "not luhn")
    spelt = len(re.findall(r"[\[(] ?at ?[\])]", segment))
    signs = segment.count("@") + spelt
    on.append("no at" if not signs else "one at" if signs == 1 else "many at")
    on += ["spelt at"] * bool(spelt)
    if re.search(r"(@|at ?[\])])[A-Za-z0-9 -]+(\.|[\[(] ?dot ?[\])])[A-Za-z0-9 -]*[A-Za-z]$", segment) or re.search(
        r"@[A-Za-z0-9.-]+\.[A-Za-z]+$", segment
    ):
        on.append("dotted domain")
    if re.search("[A-Za-z]", re.sub(r"[\[(] ?(at|dot) ?[\])]", "", segment)):
        on.append("letters")
    on += ["word space"] * bool(re.search("[A-Za-z] [A-Za-z]", segment))
    lengths = [len(g) for g in groups]
    on += ["334"] * (lengths == [3, 3, 4]) + ["334 after 1"] * (lengths[1:] == [3, 3, 4] and lengths[0] <= 3)
    on += ["4444"] * (lengths == [4, 4, 4, 4])
    on += ["left alnum"] * left[-1:].isalnum() + ["right alnum"] * right[:1].isalnum()
    on += ["left dot digit"] * bool(re.search(r"[0-9][./,-]$", left)) + ["right dot digit"] * bool(re.match(r"[./,-][0-9]", right))
    on += ["left plus"] * left.endswith("+") + ["uneven brackets"] * (segment.count("(") != segment.count(")"))
    return tuple(_INDEX[k] for k in on)


def segments(text: str, cut: list[tuple[int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """Candidate entities (first atom, atom after the last, features) of at most MOST_ATOMS atoms."""
    out = []
    for i, (a, b) in enumerate(cut):
        first = text[a]
        if not (first.isascii() and first.isalnum()) and first not in "+(":
            continue
        digits = sign = 0
        for j in range(i, min(len(cut), i + MOST_ATOMS)):
            c, d = cut[j]
            atom = text[c:d]
            if "\n" in atom:
                break
            digits += (d - c) * ("0" <= atom[0] <= "9")
            sign |= atom == "@" or (len(atom) > 2 and "at" in atom[1:4] and atom[0] in "[(")
            if not (atom.isascii() and atom[-1].isalnum()) or (digits < 7 and not (sign and j > i + 1)):
                continue
            out.append((i, j + 1, features(text[a:d], text[max(0, a - 2) : a], text[d : d + 2])))
    return out


class Field:
    """Weights of the field: (label, feature) for segments, (label, label) for transitions."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS), len(FEATURES)))
        self.weights[:, 0] = -2.0
        self.weights[:, _INDEX["word space"]] = -2.0
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    def _scores(self, cands):
        return [(i, j, self.weights[:, f].sum(1)) for i, j, f in ((i, j, list(f)) for i, j, f in cands)]

    def decode(self, text: str) -> list[Span]:
        cut = atoms(text)
        cands = segments(text, cut)
        if not cands:
            return []
        ending: dict[int, list] = {}
        for i, j, s in self._scores(cands):
            ending.setdefault(j, []).append((i, s))
        best = np.full((len(cut) + 1, len(LABELS)), -np.inf)
        best[0, 0] = 0
        back: dict = {}
        for j in range(1, len(cut) + 1):
            into = best[j - 1] + self.moves[:, 0]
            best[j, 0], back[j, 0] = into.max(), (j - 1, int(into.argmax()))
            for i, s in ending.get(j, ()):
                into = best[i][:, None] + self.moves[:, 1:]
                top = into.max(0) + s
                for y in np.flatnonzero(top > best[j, 1:]):
                    best[j, y + 1], back[j, int(y) + 1] = top[y], (i, int(into[:, y].argmax()))
        out, j, y = [], len(cut), int(best[len(cut)].argmax())
        while j:
            i, before = back[j, y]
            if y:
                out.append((LABELS[y], cut[i][0], cut[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def learn(self, text: str, gold: list[Span], rate: float) -> None:
        """One step up the gradient of log p(gold | text)."""
        cut = atoms(text)
        cands = segments(text, cut)
        starts, ends = {a: i for i, (a, _) in enumerate(cut)}, {b: i + 1 for i, (_, b) in enumerate(cut)}
        known = {(i, j) for i, j, _ in cands}
        want = {
            (starts[a], ends[b]): KINDS.index(k) for k, a, b in gold
            if a in starts and b in ends and (starts[a], ends[b]) in known
        }
        if not cands or len(want) < len(gold):
            return
        n, L = len(cut), len(LABELS)
        scored = self._scores(cands)
        ending, starting = {}, {}
        for at, (i, j, s) in enumerate(scored):
            ending.setdefault(j, []).append(at)
            starting.setdefault(i, []).append(at)
        sumexp = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        ahead, behind = np.full((n + 1, L), -1e9), np.full((n + 1, L), -1e9)
        ahead[0, 0], behind[n] = 0, 0
        for j in range(1, n + 1):
            ahead[j, 0] = sumexp(ahead[j - 1] + self.moves[:, 0], 0)
            for at in ending.get(j, ()):
                i, _, s = scored[at]
                ahead[j, 1:] = np.logaddexp(ahead[j, 1:], sumexp(ahead[i][:, None] + self.moves[:, 1:], 0) + s)
        for i in range(n - 1, -1, -1):
            behind[i] = self.moves[:, 0] + behind[i + 1, 0]
            for at in starting.get(i, ()):
                _, j, s = scored[at]
                behind[i] = np.logaddexp(behind[i], sumexp(self.moves[:, 1:] + s + behind[j, 1:], 1))
        whole = sumexp(ahead[n], 0)
        moves = np.zeros_like(self.moves)
        for i in range(n):
            moves[:, 0] -= np.exp(ahead[i] + self.moves[:, 0] + behind[i + 1, 0] - whole)
        gradient = np.zeros_like(self.weights)
        for (i, j, s), (_, _, f) in zip(scored, cands):
            p = np.exp(ahead[i][:, None] + self.moves[:, 1:] + s + behind[j, 1:] - whole)
            moves[:, 1:] -= p
            expected = -p.sum(0)
            if (i, j) in want:
                expected[want[i, j]] += 1
            gradient[:, list(f)] += expected[:, None]
        before, at = 0, 0
        opened = {i: (j, k + 1) for (i, j), k in want.items()}
        while at < n:
            j, y = opened.get(at, (at + 1, 0))
            moves[before, y] += 1
            before, at = y, j
        self.weights += rate * gradient
        self.moves += rate * moves


def rewritten(kind: str, value: str, rng) -> tuple[str, bool]:
    """Another spelling of a match and whether it is still one of its kind."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        shapes = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}")
        return (shapes[rng.integers(len(shapes))], True) if rng.random() < 0.7 else (f"{b}{c}{a}{b}"[: rng.integers(7, 14)], False)
    if kind == "card":
        if rng.random() < 0.5:
            broken = digits[:-1] + str((int(digits[-1]) + rng.integers(1, 10)) % 10)
            return broken, False
        sep = (".", "/", "-", " ")[rng.integers(4)]
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)), True
    if kind == "ip":
        parts = value.split(".")
        parts[rng.integers(4)] = str(rng.integers(256, 999))
        return (".".join(parts) if rng.random() < 0.5 else "-".join(value.split(".")[:3])), False
    local, _, domain = value.partition("@")
    if rng.random() < 0.7:
        return local + ("[at]", "(at)", " @ ", "@")[rng.integers(4)] + domain, True
    return f"{local}@{domain.split('.')[0]}", False


def train(sample: list[str], seed: int = 5) -> Field:
    """A field fitted to islands labelled by the patterns, with rewritten matches."""
    rng = np.random.default_rng(seed)
    examples = []
    for text in sample:
        taken, gold = 0, []
        for kind, a, b in base_spans(text):
            if a >= taken:
                gold.append((kind, a, b))
                taken = b
        examples.append((text, gold))
        for kind, a, b in gold[:3]:
            new, real = rewritten(kind, text[a:b], rng)
            left = text[:a].rpartition(" ")[0][-8:] + " " if a else ""
            right = " " + text[b:].partition(" ")[2][:8] if b < len(text) else ""
            left, right = re.sub("[0-9@+]", "", left), re.sub("[0-9@+]", "", right)
            left, right = left or ("", "to ", "a la ")[rng.integers(3)], right or ("", " or", " la a")[rng.integers(3)]
            examples.append((left + new + right, [(kind, len(left), len(left) + len(new))] if real else []))
    for value in ("2024-01-31", "12:30:45", "3.14159265", "1.2.30", "0123456789abcdef0123", "10000000",
                  "2024/01/31 12:30", "1,000,000,000", "v10.20.30", "9876543210123", "#1234567"):
        examples += [(f"on {value} at", [])] * 3
    field = Field()
    for epoch in range(EPOCHS):
        for at in rng.permutation(len(examples)):
            field.learn(*examples[at], RATE / (1 + epoch))
    return field


SCAN = (
    "doc_id bigint, base array<struct<kind:string,start:bigint,end:bigint>>, "
    "islands array<struct<start:bigint,text:string>>"
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ISLANDS = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string())]))


def _as_rows(spans):
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the patterns' spans and the islands of every row."""

    def run(batches):
        for batch in batches:
            base, around = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base.append(_as_rows(base_spans(text)))
                around.append([{"start": a, "text": t} for a, t in islands(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _SPANS), pa.array(around, _ISLANDS)],
                names=["doc_id", "base", "islands"],
            )

    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(lean(run), SCAN)


def sampled(scanned: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most ``most`` different islands of up to 400 characters, by hash: most with a match."""
    each = scanned.select(F.explode("islands.text").alias("text")).filter("length(text) <= 400")
    likely = F.col("text").rlike(r"@|\+|[0-9]\.[0-9]|[0-9]{14}").cast("int")
    rows = (
        each.withColumn("turn", F.pmod(F.xxhash64("text"), F.lit(1 << 40)) - likely * (1 << 39))
        .distinct().orderBy("turn", "text").limit(most).collect()
    )
    return sorted((r.text for r in rows), key=lambda t: (zlib.crc32(t.encode()), t))


def find(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, base (the patterns' spans) and spans (with the field's) of every row of ``docs``."""
    scanned = materialise(scan(slim(docs, "doc_id", "text")))
    sent = docs.sparkSession.sparkContext.broadcast(train(sampled(scanned, most)))

    def run(batches):
        field = sent.value
        seen: dict[str, list[Span]] = {}
        for batch in batches:
            spans = []
            for base, around in zip(batch.column("base").to_pylist(), batch.column("islands").to_pylist()):
                own = [(s["kind"], s["start"], s["end"]) for s in base]
                for land in around:
                    text, at = land["text"], land["start"]
                    if text not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[text] = field.decode(text)
                    for kind, a, b in seen[text]:
                        a, b = a + at, b + at
                        if all(b <= s[1] or s[2] <= a for s in own):
                            own.append((kind, a, b))
                spans.append(_as_rows(ordered(own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("base"), pa.array(spans, _SPANS)],
                names=["doc_id", "base", "spans"],
            )

    schema = SCAN.replace("islands array<struct<start:bigint,text:string>>", "") + (
        "spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
    return scanned.mapInArrow(lean(run), schema)


def of_kind(spans, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the kind of its first, in square brackets."""
    out, done = [], 0
    for kind, a, b in ordered(spans):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``docs`` with personal data replaced in text; all rows and columns stay."""
    columns = docs.columns
    scanned = scan(slim(docs, "doc_id", "text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(sampled(scanned, most)))

    def run(batches):
        field = sent.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    own = base_spans(text)
                    for start, land in islands(text):
                        for kind, a, b in field.decode(land):
                            if all(b + start <= s[1] or s[2] <= a + start for s in own):
                                own.append((kind, a + start, b + start))
                    text = masked_text(text, own) if own else text
                new.append(text)
            yield batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(lean(run), docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return out.select(*columns)
