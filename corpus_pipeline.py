"""From raw documents to token shards, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``.

1. ``toxicity``: documents that the classifier rejects go.
2. ``near_dedup``: one document of each component of near-duplicates stays.
3. ``decontamination``: documents with words in a benchmark window go.
4. ``mixing``: the documents of the Pfair mix stay; those beyond the slot at which
   a source that is not small runs out of blocks are not in this mix.
5. ``token_shards``: the token ids, written to shard files and read back.

A document with a null ``doc_id`` is judged by its text in stages 1 and 3 as any
other; duplicates are found among identified documents only, so it stays in stage 2;
stage 5 puts it first.  A null text is empty: it is not toxic beyond the intercept, a
duplicate of nothing, clean, one character to the mix, and one end id.  Very long
texts are treated whole in every stage.  Rows that repeat an identifier are one
document from stage 2 on; of documents with equal texts the one with the smallest
identifier stays.  Ties do not decide anything else.  Empty tables give no rows, an
empty benchmark or no labels of both classes leave everything clean or to the seed
lexicon.  Further columns go through stages 1 to 4, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.llm.common import cut, discard, shrink_heaps, table
from ledgerfold.llm.decontaminate import clean_documents
from ledgerfold.llm.mixing import mixed_documents
from ledgerfold.llm.near_dedup import one_of_each
from ledgerfold.llm.token_shards import encode_documents
from ledgerfold.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        written: list[str] = []
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", written)
        discard(spark, before)  # what the stage before wrote is read
        before = written
    return docs


#: SQL can express neither the classifier nor the tokeniser.
ORACLE_SQL = None
