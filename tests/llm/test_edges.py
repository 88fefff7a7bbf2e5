from pyspark.sql import functions as F

from keelson.llm import decontaminate, quality_rules, sharding


def test_shards_hold_no_more_than_their_limit(spark):
    rows = [(i, "x" * (i % 30), None) for i in range(80)] + [(7, f"hot {i}", "a") for i in range(40)]
    rows += [(9, "same row", "b")] * 50 + [(None, "no key", None), (5, None, None), (6, "y" * 500, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    out = sharding.shard(docs, "doc_id", F.octet_length("text"), 100).collect()
    assert len(out) == len(rows)
    held = {}
    for r in out:
        held.setdefault(r.shard, []).append(len(r.text or ""))
    for r in out:
        assert (r.shard_bytes, r.shard_rows) == (sum(held[r.shard]), len(held[r.shard]))
        assert r.shard_bytes <= 100 or r.shard_rows == 1
    assert sharding.shard(docs.filter("doc_id = -1"), "doc_id", F.octet_length("text"), 100).count() == 0


def test_quality_rules_take_odd_rows(spark):
    good = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None, None, None, 0), (2, "", "en", None, 0), (3, good, "en", "a", 0), (3, good, "en", "a", 0),
            (None, good, None, "a", 0), (4, "a b c d e " * 5, "en", "a", 0), (5, " ".join(f"w{i}" for i in range(30_000)), "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept int")
    got = quality_rules.judge(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [by[k].kept for k in (1, 2, 3, None, 4, 5)] == [False, False, True, True, False, True]
    assert by[4].n_repeat_words == 25 and by[5].n_words == 30_000 and by[1].n_words == 0
    assert quality_rules.judge(docs.filter("doc_id = -1")).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns


def test_junk_in_a_group_is_rejected_and_even_groups_lose_nothing(spark):
    import random

    rng = random.Random(2)
    plain = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 7))) for _ in range(n))
    junk = lambda: " ".join(rng.choice(["##", "%%$", "abc", "<|>"]) for _ in range(30)) + f" {rng.random()}"
    rows = [(i, plain(40), "en", "even") for i in range(400)]
    rows += [(1000 + i, junk() if i % 10 == 0 else plain(40), "en", "mixed") for i in range(400)]
    rows += [(2000 + i, junk() if i % 10 < 6 else plain(40), "en", "mostly junk") for i in range(100)]
    rows += [(3000 + i, plain(40) + " #" * (i % 3), "en", "few") for i in range(6)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in got.collect() if not r.base_failed}
    assert all(kept[i] for i in range(400)) and all(v for k, v in kept.items() if k >= 3000)
    for i in range(400):
        assert kept.get(1000 + i, False) == (i % 10 != 0)
    for i in range(100):
        assert kept.get(2000 + i, False) == (i % 10 >= 6)


def test_decontamination_takes_odd_rows_and_finds_words_nearby(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    bench = spark.createDataFrame([(1, item), (2, None), (None, "short one"), (3, ""), (4, "omega")], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (3, f"x {item.upper()}! y"), (3, f"x {item.upper()}! y"), (4, "a short, one omega"), (None, item[:-3]), (5, "beta alpha " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int")
    got = decontaminate.judged(decontaminate.find_passages(docs, bench)).collect()
    by = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in got}
    assert len(got) == 7 and by[1] == by[2] == (0, 0, [], False) and by[5] == (40_000, 0, [], False)
    assert by[3] == (16, 14, ["1"], True) and by[4] == (4, 3, ["", "4"], True) and by[None] == (13, 13, ["1"], True)
    near = decontaminate.proximity(docs, ["gamma alpha", "omega short"], 2).collect()
    assert {(r.doc_id, r.phrase) for r in near} == {(3, "gamma alpha"), (None, "gamma alpha"), (4, "omega short")}
    assert decontaminate.find_passages(docs.filter("doc_id = -1"), bench).count() == 0


def test_blocks_of_an_index_are_read_one_at_a_time_as_arrays():
    import numpy as np
    import pyarrow as pa

    parts = [np.array([2, -1, 0, 2], np.int32), np.array([], np.int32)]
    blocks = [decontaminate._block_row([7, None], [4, 0], parts), decontaminate._block_row([], [], [])]
    kinds = {"ids": pa.int64()}
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b[n] for b in blocks], pa.list_(kinds.get(n, pa.int32()))) for n in decontaminate.INDEX_NAMES],
        names=list(decontaminate.INDEX_NAMES),
    ).slice(0, 2)
    got = list(decontaminate._index_rows(batch))
    for row, block in zip(got, blocks, strict=True):
        assert row["ids"] == list(block["ids"]) and row["n_words"] == list(block["n_words"])
        for n in ("terms", "ends", "positions"):
            assert isinstance(row[n], np.ndarray) and row[n].dtype == np.int32 and (row[n] == block[n]).all()
    assert got[0]["positions"].base is not None  # no copy of the batch's memory
