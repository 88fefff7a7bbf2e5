"""From raw documents to packed sequences; each stage's rows are stored and read by the next.

Stages in order: texts without a language go; one document of each near-duplicate class stays;
contaminated documents go; personal data is replaced in the text; what is left is packed into
sequences. All but the last return the columns of documents. Nulls, empty texts, repeated rows and
empty tables are treated as the operators' modules say. SQL cannot express the stages (a trained
network, an alignment, a trained field, a tokenizer): tests compare them with brute force.
"""

import os
import uuid

import public_tokenizers

from keelson.llm import decontaminate, langid, near_dedup, packing, pii
from keelson.llm.common import table
from keelson.session import work_dir

VOCABULARY = "word_bpe_49k.json"
ORACLE_SQL = None


def identify_language(spark, docs, sf_dir):
    return langid.accepted(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark, docs, sf_dir):
    return pii.mask(docs)


def pack_sequences(spark, docs, sf_dir):
    packed = packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=False)
    return packed.drop("ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    """The rows of the last stage, over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(work_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
