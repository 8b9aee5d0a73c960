"""Documents to token ids in five stages; each reads all that the stage before it kept.

Defined cases of all stages: an empty table gives an empty one; repeated rows are rows each unless a stage says otherwise;
columns other than text and n_chars pass through, whatever their names; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from rondo.llm import bpe, compression, decontaminate, jaccard_join, line_dedup
from rondo.llm.common import cut, fold, packed, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts good; fitted on the labelled documents of the input.

    A null or empty text has the share of good labels as its score, and without labels of both classes so has every text.
    """
    small_batches(spark)
    model = compression.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    return packed(docs, lambda own: compression.with_score(own, model, only_kept=True))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; one that loses every word goes.

    Null and empty texts and rows with a null id stay as they are; equal rows share their fate.
    """
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: of least id, and of equal rows one; a null id comes last. Texts without words all stay."""
    small_batches(spark)
    return jaccard_join.dedup(docs)


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without spans of the benchmark; one that would lose more than four fifths of its words goes.

    Null and wordless texts and items match nothing.
    """
    small_batches(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of every document; a null or empty text has no ids."""
    small_batches(spark)
    return bpe.encoded(
        docs, public_tokenizers.path("word_bpe_49k.json"), lambda ids, number, piece: bpe.text_digest(ids, number, piece) | {"ids": ids},
        "doc_id long, lang string, source string, n_tokens long, ids array<int>, decoded_sha256 string", keep=("lang", "source"),
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_spans),
    ("BPE encoding and decoding", token_ids),
]

#: SQL has no trained classifier and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
