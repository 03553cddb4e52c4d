"""A training-data pipeline: toxic documents go, copies go, sources are mixed, what is left is encoded.

Each stage works on all that its predecessor kept, written as Parquet and read
again.  Defined cases, in every stage: an empty table gives no rows; a null id
is kept as any other; a null text is empty; a text of any length is read whole
by one task; columns of docs stay, whatever their names (but for the last
stage, which returns its own).  What equal rows and ties come to is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordia.llm import exact_dedup, jaccard_join, mixing, tokens, toxicity
from concordia.llm.store import rewritten, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers finds toxic go; equal rows go or stay together; without labels all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows equal in text but for runs of white space the one of smallest id stays (a null id last), of equal ids the least by all columns."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more: the smallest id (a null id last), then the smallest hash of the text; rows without words all stay."""
    return jaccard_join.drop_near_copies(docs, width=5, t_num=80, t_den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times; rows alike in source, id and text share what the rounding gave them; rows without words are not taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of the mix, repeated rows each."""
    import public_tokenizers

    return tokens.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL: models, shingles and token ids are beyond it; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = rewritten(docs)
    return docs
