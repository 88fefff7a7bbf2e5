import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from keelson.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello,  WORLD's 12 cats!!", "á H̱ ẖ ẞ İ ß", "x <|endoftext|> Y <|ENDOFTEXT|>",
    " non breaking\u001cseparators", "日本語 テスト", "long " * 9000, "same", "same", "é", "\x00 nul",
]


def whole(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_equal_the_whole_text_at_once():
    assert [list(np.frombuffer(x, "<u4")) + [2] for x in packing.Encoder(PATH).encode(TEXTS)] == [
        whole(t) for t in TEXTS
    ]


def test_each_id_lies_in_one_piece_and_sequences_are_gapless(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(9, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    out = packing.pack_documents(docs, PATH, size=64)
    got = out.collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) == r.ids_crc32
    for doc, text, _ in rows[:9]:  # 9 is there twice
        pieces = sorted(by[doc], key=lambda r: r.start)
        assert list(np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4")) == whole(text)
        assert {r.doc_tokens for r in pieces} == {len(whole(text))}
    assert len(by[9]) == 2
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 64 and sorted(room) == list(range(len(room)))
    joined = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(out).collect()}
    assert joined == room


def test_placing_uses_every_length_and_little_room():
    rng = np.random.default_rng(3)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 4097, 900), rng.integers(1, 10**9, 900))}
    patterns = packing.place(histogram)
    used = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 4096 and count > 0
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == histogram
    tokens = sum(n * c for n, c in histogram.items())
    assert tokens > 0.95 * 4096 * sum(c for c, _ in patterns)


def test_an_empty_table_has_no_pieces(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_long_runs_are_never_remembered_and_short_ones_within_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    chinese = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 3000)) for _ in range(5)]
    words = ["w" + "".join(map(chr, rng.integers(97, 123, 7))) for _ in range(400)]
    texts = [f"{c} {' '.join(words)} {'x' * 500}" for c in chinese]
    enc = packing.Encoder(PATH)
    assert [list(np.frombuffer(x, "<u4")) + [2] for x in enc.encode(texts)] == [whole(t) for t in texts]
    assert all(len(c) <= packing.SHORT for c in enc.known)
    held = sum(len(c) + len(ids) + packing.ENTRY for c, ids in enc.known.items())
    assert enc.held == held > 0
    monkeypatch.setattr(packing, "KNOWN_BYTES", 1000)
    for t in texts:
        assert list(np.frombuffer(enc.encode([t])[0], "<u4")) + [2] == whole(t)
        assert enc.held <= held  # emptied before each call that finds it above the bound


def test_words_in_use_stay_known_and_plain_words_need_no_pipeline(monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 9)))
    often = [word() for _ in range(20)]
    texts = [" ".join([*often, "é1", "it's", *(word() for _ in range(30))]) for _ in range(40)]
    enc = packing.Encoder(PATH)
    monkeypatch.setattr(packing, "KNOWN_BYTES", 40_000)
    asked = []
    encode = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda chunks: asked.extend(chunks) or encode(chunks))
    for t in texts:
        assert list(np.frombuffer(enc.encode([t])[0], "<u4")) + [2] == whole(t)
    assert enc.older and enc.held < 40_000 and all(asked.count(w.encode()) == 1 for w in [*often, "é1"])

    class Bare:
        def encode_batch_fast(self, texts, **_):
            assert not any(t.isalpha() and t.isascii() for t in texts)
            return []

    assert enc.model is not None
    enc.tokenizer = Bare()
    got = encode([w.encode() for w in often])
    assert [list(np.frombuffer(got[w.encode()], "<u4")) + [2] for w in often] == [whole(w) for w in often]


def test_marks_at_a_word_s_end_are_looked_up_alone_and_parts_hold_bytes(monkeypatch):
    texts = ["Word, word. word?! 'word,' x.y, \x0bword;\tword", "<|a|>, é, É. 9,\n", None, "", " "]
    enc = packing.Encoder(PATH)
    assert [list(np.frombuffer(x, "<u4")) + [2] for x in enc.encode(texts)] == [whole(t or "") for t in texts]
    assert {b"word", b",", b"?!"} <= set(enc.known) and not {b"word.", b"word?!", b"word;"} & set(enc.known)
    monkeypatch.setattr(packing, "PART_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(6), "text": ["aaaa", None, "é" * 3, "b" * 50, "", "c"]})
    parts = [p.column(0).to_pylist() for p in packing._parts(batch)]
    assert parts == [[0, 1, 2], [3], [4, 5]]
