import hashlib
import re

import numpy as np
import pytest

from keelson.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_patterns_equal_plain_regular_expressions():
    rng = np.random.default_rng(1)
    parts = ["a", "b.c", "@", ".", "12", "4", "255", "256", "4111111111111111", " ", "-", "+1", "(", ")", "_%", "é", "\n", "555-0100", "x@y.zz", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_little_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000 + ".", "a@" * 100_000, "+" * 200_000, "1.2." * 90_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(2)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    sample = []
    for i in range(300):
        digits = d(15)
        card = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        sample += [f"the {card} of", f"and +1 ({d(3)}) 555-{d(4)} one", f"in {ip}.", f"or.{d(2)}@mail{i % 9}.example.com", f"{d(16)}", f'"{d(6)}af{d(4)}"']
    return pii.train(sample)


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("call (212) 555-0187 now", "phone", "(212) 555-0187"),
        ("call 212-555-0187 now", "phone", "212-555-0187"),
        ("pay 4111.1111.1111.1111 now", "card", "4111.1111.1111.1111"),
        ("to ann.8(at)mail3.example.com or", "email", "ann.8(at)mail3.example.com"),
    ],
)
def test_the_field_finds_other_spellings(field, text, kind, value):
    at = text.index(value)
    assert (kind, at, at + len(value)) in field.decode(text)


@pytest.mark.parametrize("text", ["on 2024-01-31 at 12:30", "no. 4111111111111112.", "300.1.2.900", "version 1.22.333", "deadbeef0123456789abcdef", "sum 1234567"])
def test_the_field_leaves_other_numbers(field, text):
    assert field.decode(text) == []


def test_decoding_equals_all_segmentations(field):
    text = "x +1 (2)"
    cut, scored = pii.atoms("+1 212-5550187 x"), None
    text = "+1 212-5550187 x"
    cands = {(i, j): field.weights[:, list(f)].sum(1) for i, j, f in pii.segments(text, cut)}

    def paths(at, before):
        if at == len(cut):
            yield 0.0, []
            return
        for s, p in paths(at + 1, 0):
            yield s + field.moves[before, 0], p
        for (i, j), s0 in cands.items():
            if i == at:
                for k in range(len(pii.KINDS)):
                    for s, p in paths(j, k + 1):
                        yield s + s0[k] + field.moves[before, k + 1], [(pii.KINDS[k], cut[i][0], cut[j - 1][1]), *p]

    assert field.decode(text) == max(paths(0, 0), key=lambda x: x[0])[1]


def test_edge_rows_and_masking(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "+1 (212) 555-0187 x", None), (3, "a.b@c.de, 1.2.3.4", "b"), (3, "a.b@c.de, 1.2.3.4", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = pii.find(docs).select("doc_id", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    assert sorted((r.doc_id or -1, r.b) for r in got) == [
        (-1, "phone:0:17"), (1, ""), (2, ""), (3, "email:0:8,ip:10:17"), (3, "email:0:8,ip:10:17"),
    ]
    assert all(r.b in r.s for r in got)
    texts = {r.text for r in pii.mask(docs).collect()}
    assert texts == {None, "", "[PHONE] x", "[EMAIL], [IP]"}
    assert pii.find(docs.filter("doc_id = 9")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_the_query_equals_plain_patterns(spark):
    from keelson.llm.queries import op9_pii

    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op9_pii(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain(texts[r.doc_id])
        text = ",".join(":".join(map(str, s)) for s in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert {x for x in text.split(",") if x} <= set(r.spans.split(","))
