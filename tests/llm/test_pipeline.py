import pytest

import corpus_pipeline
from keelson.llm import decontaminate, packing, pii

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    folder, out = tmp_path_factory.mktemp("stages"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [x.toPandas() for x in out]


def test_columns(stages):
    assert all(list(x.columns) == list(stages[0].columns) for x in stages[1:-1])


def test_language_stage_drops_only_texts_without_a_language(stages):
    has = stages[0].text.fillna("").str.contains(r"[^\W\d_]", regex=True)
    assert set(stages[1].doc_id) <= set(stages[0][has].doc_id)
    assert len(stages[1]) >= 0.99 * has.sum()


def test_near_duplicate_stage_equals_brute_force(stages):
    from test_near_dedup import components

    label = components(dict(zip(stages[1].doc_id, stages[1].text)))
    assert sorted(stages[2].doc_id) == sorted(set(label.values()))


def test_contaminated_documents_go(stages, spark):
    items = [decontaminate.words_of(t) for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().text]
    keep = []
    for doc, text in zip(stages[2].doc_id, stages[2].text):
        words, hit = decontaminate.words_of(text), set()
        where = {}
        for i, w in enumerate(words):
            where.setdefault(w, []).append(i)
        for item in items:
            k = min(13, len(item))
            for s in range(len(item) - k + 1 if item else 0):
                for i in where.get(item[s], ()):
                    if words[i : i + k] == item[s : s + k]:
                        hit |= set(range(i, i + k))
        if not (hit and 20 * len(hit) >= len(words)):
            keep.append(doc)
    assert sorted(stages[3].doc_id) == sorted(keep) and len(keep) < len(stages[2])


def test_personal_data_is_masked(stages):
    before, after = dict(zip(stages[3].doc_id, stages[3].text)), dict(zip(stages[4].doc_id, stages[4].text))
    assert before.keys() == after.keys()
    assert not any(pii.base_spans(t) for t in after.values())
    assert all(before[d] == after[d] for d in before if not pii.islands(before[d]))


def test_all_tokens_are_packed(stages):
    import public_tokenizers

    enc = packing.Encoder(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = sum(len(x) // 4 + 1 for x in enc.encode(list(stages[4].text)))
    assert stages[5].length.sum() == want
    assert stages[5].groupby("sequence_id").length.sum().max() <= 4096


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, length int"
    rows = [
        (1, "the thing and that was of it by the river", "en", "a", 41, 0.1, 1), (1, "the thing and that was of it by the river", "en", "a", 41, 0.1, 1),
        (2, None, None, None, None, None, None), (3, "", "en", None, 0, None, 2), (None, "a text without an id in this table", None, "b", 3, 0.2, 3),
        (4, "word " * 30_000, "en", "b", 150_000, 0.5, 4), (5, "mail me at a.b@c.example or +1 (212) 555-0187", None, "b", 46, 0.5, 5),
    ]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            out.write.parquet(f"{tmp_path}/{len(data)}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{len(data)}-{name}")
            if name != "packing":
                assert docs.columns == [f.strip().split()[0] for f in schema.split(",")]
            if data and name == "near_duplicates":
                assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 4, 5]
        assert docs.count() == (0 if not data else docs.count()) and (not data or docs.count() > 0)
